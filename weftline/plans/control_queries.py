"""Queries on the runtime plane, queues, deployments and validation (Z*, W*, C*, L*, V*, A11-A28, J10-J20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import operations, queues, runtime, validation
from weftline.plans.registry import query
from weftline.sources import inputs
from weftline.sources.inputs import SQL_CLOSINGS, SQL_DEPLOYMENTS, SQL_GROUPS, SQL_MESSAGES, SQL_OBSERVATIONS, table

NOW = "1999-01-01"
#: A session's observations one after another, with the maps of what was accepted: a fold, written as a recursion over their places.
JUDGED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS rn FROM observations),
judged AS (WITH RECURSIVE f AS (
  SELECT session_id, rn, sequence, arrival, 'ACCEPTED' AS status, MAP([observation_id], [checksum]) AS seen, MAP([dataset], [sequence]) AS high FROM ranked WHERE rn = 1
  UNION ALL SELECT session_id, rn, sequence, arrival, status, CASE WHEN status = 'ACCEPTED' THEN map_concat(seen, MAP([observation_id], [checksum])) ELSE seen END, CASE WHEN status = 'ACCEPTED' THEN map_concat(high, MAP([dataset], [sequence])) ELSE high END
  FROM (SELECT r.*, f.seen, f.high, CASE WHEN len(map_extract(f.seen, r.observation_id)) > 0 THEN CASE WHEN map_extract(f.seen, r.observation_id)[1] = r.checksum THEN 'DUPLICATE' ELSE 'CONFLICT' END
    WHEN r.sequence <= map_extract(f.high, r.dataset)[1] THEN 'OUT_OF_SEQUENCE' ELSE 'ACCEPTED' END AS status FROM f JOIN ranked r ON r.session_id = f.session_id AND r.rn = f.rn + 1))
  SELECT session_id, sequence, arrival, status FROM f)"""
MANIFEST = """manifest AS (SELECT j.session_id, attempted, accepted, duplicates, rejected, last_sequence, CASE WHEN drained AND accepted = expected AND rejected = 0 AND buffered = 0 AND dropped = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS outcome
  FROM (SELECT session_id, count(*) AS attempted, count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'DUPLICATE') AS duplicates, count(*) FILTER (status IN ('CONFLICT', 'OUT_OF_SEQUENCE')) AS rejected, max(sequence) AS last_sequence FROM judged GROUP BY session_id) j
  LEFT JOIN closings c ON c.session_id = j.session_id)"""


def _now():
    return F.lit(NOW).cast("timestamp")


@query("SELECT session_id, sequence, status FROM judged", SQL_OBSERVATIONS, JUDGED)
def z2_z3_w3_deduplicate(spark, d):
    return runtime.deduplicate(inputs.observations(spark, d)).select("session_id", "sequence", "status")


@query("SELECT * FROM manifest", SQL_OBSERVATIONS, SQL_CLOSINGS, JUDGED, MANIFEST)
def z4_session_manifest(spark, d):
    return runtime.session_manifest(runtime.deduplicate(inputs.observations(spark, d)), inputs.closings(spark, d))


@query("""SELECT dataset, count(o.session_id) AS n_observed, CASE WHEN count(o.session_id) >= 100 THEN 'HOT' WHEN count(o.session_id) >= 10 THEN 'WARM' WHEN count(o.session_id) >= 1 THEN 'COLD' ELSE 'UNOBSERVED' END AS liveness
    FROM (SELECT DISTINCT dataset FROM observations UNION SELECT 'never') e LEFT JOIN (SELECT * FROM observations WHERE value > 20) o USING (dataset) GROUP BY dataset""", SQL_OBSERVATIONS)  # fmt: skip
def a11_liveness(spark, d):
    o = inputs.observations(spark, d)
    edges = o.select("dataset").distinct().unionByName(spark.createDataFrame([("never",)], "dataset string"))
    return runtime.edge_liveness(edges, o.where(F.col("value") > 20), "dataset")


@query("SELECT dataset, n = 0 AS demotable FROM (SELECT dataset, count(*) FILTER (value > 99) AS n FROM observations GROUP BY dataset)", SQL_OBSERVATIONS)
def v15_demotion(spark, d):
    o = inputs.observations(spark, d)
    live = runtime.edge_liveness(o.select("dataset").distinct(), o.where(F.col("value") > 99), "dataset")
    return live.select("dataset", (F.col("n_observed") == 0).alias("demotable"))


#: One session for each order; those of even orders that were revoked are the engine's own.
SESSIONS = """sessions AS (SELECT o_custkey AS artifact, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'INCOMPLETE' ELSE 'REVOKED' END AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN 'collection-orchestrator' ELSE 'operator' END AS actor FROM orders)"""


def _sessions(spark, d):
    outcome = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "INCOMPLETE").otherwise("REVOKED")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("artifact"), outcome.alias("outcome"), F.when(F.col("o_orderkey") % 2 == 0, "collection-orchestrator").otherwise("operator").alias("actor"))


@query("""SELECT a.artifact, CASE WHEN count(s.artifact) = 0 THEN 'NOT_PROVIDED' WHEN bool_or(outcome = 'COMPLETE') THEN 'VALIDATED' ELSE 'INCOMPLETE' END AS status, count(s.artifact) AS n_sessions
    FROM (SELECT c_custkey AS artifact FROM customer) a LEFT JOIN (SELECT * FROM sessions WHERE NOT (outcome = 'REVOKED' AND actor = 'collection-orchestrator')) s USING (artifact) GROUP BY a.artifact""", SESSIONS)  # fmt: skip
def a12_evidence_status(spark, d):
    return runtime.evidence_status(table(spark, d, "customer").select(F.col("c_custkey").alias("artifact")), _sessions(spark, d))


@query("""SELECT o_custkey AS system, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'QUARANTINED' WHEN bool_or(o_orderstatus = 'O') THEN 'INCOMPLETE' ELSE 'VALIDATED' END AS state,
    CASE WHEN bool_or(o_orderstatus IN ('P', 'O')) THEN 0 ELSE sum(o_orderkey % 11) END::BIGINT AS accepted FROM orders GROUP BY o_custkey""")
def a13_coverage(spark, d):
    state = F.when(F.col("o_orderstatus") == "P", "INVALID").when(F.col("o_orderstatus") == "O", "INCOMPLETE").otherwise("VALID")
    return runtime.coverage(table(spark, d, "orders").select(F.col("o_custkey").alias("system"), state.alias("state"), (F.col("o_orderkey") % 11).alias("accepted")), "system")


#: Manifests as JSON; what is wrong in each follows from its key.
MANIFESTS = """bodies AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'EXPIRED' WHEN k % 4 = 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS outcome, 10 + (k % 3 = 0)::INT AS attempted, 7 AS accepted, (k % 10 = 9)::INT AS dropped, (k % 14 = 5)::INT AS quarantined,
  7 + (k % 5 = 0)::INT - (k % 6 = 1)::INT AS drained, (k % 7 = 0)::INT AS off, CASE WHEN k % 4 = 0 AND k % 8 <> 0 OR k % 10 = 9 THEN 1 ELSE 0 END AS reasons, k % 13 = 0 AS torn, k % 23 = 0 AS other, k % 29 = 0 AS blank FROM (SELECT o_orderkey AS k FROM orders))"""


def _manifests(spark, d):
    k = F.col("k")
    bump = lambda test: F.when(test, 1).otherwise(0)
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).select(
        "k", F.when(k % 11 == 0, "EXPIRED").when(k % 4 == 0, "INCOMPLETE").otherwise("COMPLETE").alias("outcome"), (10 + bump(k % 3 == 0)).alias("attempted"), bump(k % 10 == 9).alias("dropped"), bump(k % 14 == 5).alias("quarantined"),
        (F.lit(7) + bump(k % 5 == 0) - bump(k % 6 == 1)).alias("drained"), bump(k % 7 == 0).alias("off"), (((k % 4 == 0) & (k % 8 != 0)) | (k % 10 == 9)).alias("told"),
    )
    digest = F.lit("sha256:" + "a" * 64)
    counters = {"attempted": F.col("attempted"), "accepted": F.lit(7), "rejected": F.lit(0), "duplicates": F.lit(3), "retried": F.lit(0), "buffered": F.lit(0), "dropped": F.col("dropped"), "quarantined": F.col("quarantined"), "drained": F.col("drained")}
    emitter = lambda half: F.struct(*[(c + F.col("off") if half and n == "retried" else c if half else F.lit(0)).alias(n) for n, c in counters.items()])
    texts = {c: F.when((k % 29 == 0) & F.lit(c == "repo"), " ").otherwise("x") for c in runtime.TEXT_FIELDS}
    body = F.struct(
        F.lit("1.0.0").alias("schemaVersion"), *[v.alias(c) for c, v in texts.items()], *[digest.alias(c) for c in runtime.DIGEST_FIELDS], F.lit("SDK").alias("mechanism"), "outcome",
        *[(F.when(k % 13 == 0, -1).otherwise(c) if n == "dropped" else c).alias(n) for n, c in counters.items()],
        F.when(F.col("told"), F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(F.col("told"), F.create_map(F.lit("r"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>")).alias("reasonCounts"),
        F.create_map(F.lit("a"), emitter(True), F.lit("b"), emitter(False)).alias("emitterCounts"), F.lit("2024-01-01T00:00:00Z").alias("closedAt"),
    )
    text = F.to_json(body)
    return m.select("k", F.when(k % 23 == 0, F.regexp_replace(text, '"repo"', '"repository"')).otherwise(text).alias("body"))


@query("""SELECT k AS window_id, CASE WHEN other THEN 'SCHEMA_FIELDS' ELSE array_to_string(list_sort(list_filter(CASE WHEN torn THEN [CASE WHEN blank THEN 'INVALID_REPO' END, 'INVALID_COUNTERS'] ELSE [
      CASE WHEN blank THEN 'INVALID_REPO' END, CASE WHEN attempted <> 10 THEN 'ATTEMPTED_ARITHMETIC' END, CASE WHEN drained > accepted THEN 'DRAINED_ARITHMETIC' END,
      CASE WHEN attempted <> 10 OR drained > accepted THEN 'INVALID_EMITTER_ARITHMETIC' END, CASE WHEN off > 0 THEN 'EMITTER_TOTAL_MISMATCH' END, CASE WHEN reasons <> dropped + quarantined + (outcome = 'EXPIRED')::INT THEN 'REASON_TOTAL_MISMATCH' END,
      CASE WHEN outcome = 'COMPLETE' AND (dropped + quarantined > 0 OR drained <> accepted OR reasons > 0) THEN 'COMPLETE_CONTAINS_LOSS' END, CASE WHEN outcome <> 'COMPLETE' AND reasons = 0 THEN 'INCOMPLETE_WITHOUT_REASON' END] END,
    lambda x: x IS NOT NULL)), ',') END AS errors FROM bodies""", MANIFESTS)  # fmt: skip
def v4_a17_manifest_errors(spark, d):
    found = runtime.manifest_errors(_manifests(spark, d), "k")
    return found.select(F.col("k").alias("window_id"), F.array_join("errors", ",").alias("errors"))


HEADS = "heads AS (SELECT lane, group_id, min(sequence) AS sequence FROM messages WHERE status IN ('AVAILABLE', 'IN_FLIGHT') GROUP BY lane, group_id)"


@query("""SELECT m.lane, m.group_id, m.sequence, m.created_at, m.attempts, row_number() OVER (PARTITION BY m.lane ORDER BY g.last_claim_order NULLS FIRST, m.sequence) AS claim FROM messages m LEFT JOIN groups g ON g.lane = m.lane AND g.group_id = m.group_id
    WHERE m.status = 'AVAILABLE' AND m.available_at <= TIMESTAMP '1999-01-01' AND NOT EXISTS (SELECT 1 FROM messages o WHERE o.lane = m.lane AND o.group_id = m.group_id AND o.sequence < m.sequence AND o.status IN ('AVAILABLE', 'IN_FLIGHT'))""", SQL_MESSAGES, SQL_GROUPS)  # fmt: skip
def j13_claimable(spark, d):
    return queues.claimable(inputs.messages(spark, d), _now(), inputs.group_states(spark, d))


@query("SELECT lane, group_id, sequence, row_number() OVER (PARTITION BY lane, group_id ORDER BY sequence) AS turn FROM messages WHERE status = 'AVAILABLE'", SQL_MESSAGES)
def w7_fair_order(spark, d):
    return queues.fair_order(inputs.messages(spark, d)).select("lane", "group_id", "sequence", "turn")


@query("SELECT lane, group_id, sequence, nxt AS by FROM (SELECT *, lead(sequence) OVER (PARTITION BY lane, group_id ORDER BY sequence) AS nxt FROM messages) WHERE status = 'AVAILABLE' AND nxt IS NOT NULL", SQL_MESSAGES)
def w9_superseded(spark, d):
    return queues.superseded(inputs.messages(spark, d), "group_id")


@query("SELECT lane, sequence, CASE WHEN attempts >= 5 THEN 'DEAD' ELSE 'AVAILABLE' END AS status FROM messages WHERE status = 'IN_FLIGHT' AND lease_expires_at <= TIMESTAMP '1999-01-01'", SQL_MESSAGES)
def c4_recovered(spark, d):
    return queues.recovered(inputs.messages(spark, d), 5, _now())


#: A message's log: published, claimed as often as its order has lines, each time expired but for the last, then acked; every fifth is redriven and claimed again.
LOG = """lines AS (SELECT o_orderkey AS id, least(count(l_orderkey), 6) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def _log(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left").select(F.col("o_orderkey").alias("message_id"), F.least(F.coalesce("n", F.lit(0)), F.lit(6)).cast("int").alias("n"))
    step = lambda at, name: F.struct(at.cast("int").alias("at"), F.lit(name).alias("step"))
    tries = F.when(F.col("n") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.array(step(i * 10, "claim"), F.struct((i * 10 + 1).alias("at"), F.when(i == F.col("n"), "ack").otherwise("expire").alias("step")))))).otherwise(F.array(step(F.lit(5), "ack")))
    again = F.when(F.col("message_id") % 5 == 0, F.array(step(F.lit(900), "redrive"), step(F.lit(901), "claim"))).otherwise(F.array().cast("array<struct<at:int,step:string>>"))
    log = F.concat(F.array(step(F.lit(0), "publish")), tries, again)
    return o.select("message_id", F.inline(log)).withColumn("max_attempts", F.lit(3))


@query("""SELECT id AS message_id, CASE WHEN n = 0 THEN CASE WHEN id % 5 = 0 THEN 'IN_FLIGHT' ELSE 'AVAILABLE' END WHEN n <= 3 THEN 'ACKED' WHEN id % 5 = 0 THEN 'IN_FLIGHT' ELSE 'DEAD' END AS status,
    CASE WHEN n = 0 THEN (id % 5 = 0)::INT WHEN n <= 3 THEN n WHEN id % 5 = 0 THEN 1 ELSE 3 END::INT AS attempts,
    CASE WHEN n = 0 THEN 1 + (id % 5 = 0)::INT WHEN n <= 3 THEN 2 * (id % 5 = 0)::INT ELSE 2 * (n - 3) END::INT AS refused FROM lines""", LOG)  # fmt: skip
def c3_replayed(spark, d):
    return queues.replayed(_log(spark, d))


@query("""SELECT lane, n_open, retries, dead, age AS oldest_s, CASE WHEN retries > 0 OR dead > 0 OR age > 60 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state, CASE lane WHEN 'interactive' THEN 0 WHEN 'events' THEN 1 ELSE 2 END AS priority FROM (
    SELECT lane, count(*) FILTER (status IN ('AVAILABLE', 'IN_FLIGHT')) AS n_open, count(*) FILTER (attempts > 1 AND status <> 'DEAD') AS retries, count(*) FILTER (status = 'DEAD') AS dead,
    greatest(0, CAST(epoch(TIMESTAMP '1999-01-01') - epoch(min(created_at) FILTER (status IN ('AVAILABLE', 'IN_FLIGHT'))) AS BIGINT)) AS age FROM messages GROUP BY lane)""", SQL_MESSAGES)  # fmt: skip
def c8_lane_stats(spark, d):
    return queues.lane_stats(inputs.messages(spark, d), _now())


@query("SELECT lane, max(n) - min(n) AS spread, count(*) AS n_groups FROM (SELECT lane, group_id, count(*) AS n FROM messages GROUP BY ALL) GROUP BY lane", SQL_MESSAGES)
def a28_fairness(spark, d):
    return queues.fairness(inputs.messages(spark, d))


@query("SELECT lane, sequence, available_at FROM messages WHERE status = 'AVAILABLE' AND available_at <= TIMESTAMP '1999-01-01' ORDER BY available_at, created_at, sequence LIMIT 25", SQL_MESSAGES)
def l3_due_outbox(spark, d):
    m = inputs.messages(spark, d).where((F.col("status") == "AVAILABLE") & (F.col("available_at") <= _now()))
    return m.orderBy("available_at", "created_at", "sequence").limit(25).select("lane", "sequence", "available_at")


PLACED = """placed AS (SELECT *, authentic AND event_type <> 'MERGE' AS counts FROM deployments),
firsts AS (SELECT *, counts AND row_number() OVER (PARTITION BY system, event_id, counts ORDER BY arrival) > 1 AS again FROM placed),
highs AS (SELECT *, max(CASE WHEN counts AND NOT again THEN provider_sequence * 10 + attempt END) OVER (PARTITION BY system ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM firsts),
reasons AS (SELECT *, CASE WHEN NOT authentic THEN 'AUTHENTICATION_FAILED' WHEN event_type = 'MERGE' THEN 'NON_DEPLOYMENT_EVENT' WHEN again THEN 'DUPLICATE' WHEN provider_sequence * 10 + attempt <= high THEN 'STALE_EVENT' WHEN outcome = 'FAILED' THEN 'DEPLOYMENT_FAILED'
  WHEN artifact_digest IS NULL THEN 'MISSING_ARTIFACT_DIGEST' WHEN artifact_digest = 'd4' OR (system + substr(artifact_digest, 2)::INT) % 4 = 0 THEN 'EXACT_PACKAGE_NOT_FOUND' WHEN artifact_digest = 'd3' THEN 'PROMOTION_REFUSED' END AS reason FROM highs)"""


@query("""SELECT system, event_id, arrival, reason, CASE WHEN reason IN ('AUTHENTICATION_FAILED', 'NON_DEPLOYMENT_EVENT') THEN 'UNCHANGED' WHEN reason = 'DUPLICATE' THEN 'DUPLICATE' WHEN reason = 'STALE_EVENT' THEN 'STALE' WHEN reason = 'DEPLOYMENT_FAILED' THEN 'FAILED_NO_CHANGE'
    WHEN reason = 'EXACT_PACKAGE_NOT_FOUND' THEN 'LINEAGE_OUT_OF_SYNC' WHEN reason IS NOT NULL THEN 'FAILED_TERMINAL' WHEN event_type = 'ROLLBACK' THEN 'ROLLED_BACK' ELSE 'PROMOTED' END AS state FROM reasons""", SQL_DEPLOYMENTS, PLACED)  # fmt: skip
def w4_c14_deployments(spark, d):
    graphs = spark.createDataFrame([("staging", f"g{i}", "c" if i < 3 else "moved") for i in range(4)], "environment string, graph_version string, checksum string")
    return queues.judged_deployments(inputs.deployments(spark, d), inputs.packages(spark, d), graphs).drop("environment")


@query("SELECT system, provider_sequence, attempt, event_id FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY provider_sequence DESC, attempt DESC, event_id DESC) AS nth FROM deployments) WHERE nth = 1", SQL_DEPLOYMENTS)
def u11_current_deployment(spark, d):
    return queues.current_deployment(inputs.deployments(spark, d))


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def w8_version_chain(spark, d):
    return queues.chain(table(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("SELECT o_orderpriority AS env, o_orderkey AS reservation_id, row_number() OVER w AS token, lead(o_orderkey) OVER w IS NULL AS may_activate FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)")
def w10_fencing(spark, d):
    return queues.fenced(table(spark, d, "orders").select(F.col("o_orderpriority").alias("env"), F.col("o_orderkey").alias("reservation_id"), F.col("o_orderdate").alias("reserved_at")))


@query("SELECT conv_id AS command_id, count(*) FILTER (epoch > 1) AS steals, count(*) FILTER (before = 'LEASE_EXPIRED') AS after_expiry FROM (SELECT conv_id, turn + 1 AS epoch, lag(CASE WHEN role = 'user' THEN 'LEASE_EXPIRED' ELSE 'RUNNING' END) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def w11_lease_steals(spark, d):
    status = F.when(F.col("role") == "user", "LEASE_EXPIRED").otherwise("RUNNING")
    return queues.lease_steals(table(spark, d, "conversations").select(F.col("conv_id").alias("command_id"), (F.col("turn") + 1).alias("epoch"), status.alias("status")))


@query("""SELECT o_orderkey AS command_id, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'UNAVAILABLE' WHEN o_orderkey % 7 >= 5 OR o_orderdate < TIMESTAMP '1996-01-01' THEN 'FAILED_TERMINAL'
    WHEN o_orderstatus = 'P' THEN 'RECLAIM' ELSE 'CLAIM' END AS result FROM orders""")
def c5_command_status(spark, d):
    now = F.lit("1996-01-01").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("QUEUED")
    lease = F.when(F.col("o_orderkey") % 2 == 0, now).otherwise(F.lit("1990-01-01").cast("timestamp"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("command_id"), status.alias("status"), (F.col("o_orderkey") % 7).alias("attempts"), F.lit(5).alias("max_attempts"), F.col("o_orderdate").alias("deadline"), lease.alias("lease_until"))
    return queues.command_status(rows, now)


@query("SELECT l_orderkey || '-' || l_linenumber AS identity, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'REUSE' ELSE 'NEW' END AS result FROM lineitem GROUP BY ALL")
def c6_idempotent_stages(spark, d):
    return queues.idempotent(table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("identity"), F.col("l_returnflag").alias("checksum")))


@query("""SELECT event_id, event_type, CASE event_type WHEN 'pr.updated' THEN 'interactive' WHEN 'repo.push' THEN 'events' WHEN 'nightly' THEN 'bulk' END AS lane, CASE event_type WHEN 'pr.updated' THEN 120 WHEN 'repo.push' THEN 900 WHEN 'nightly' THEN 86400 END AS deadline_s
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'pr.updated' WHEN 'click' THEN 'repo.push' WHEN 'error' THEN 'nightly' ELSE event_type END AS event_type FROM events)""")
def c1_routing(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "view", "pr.updated").when(e == "click", "repo.push").when(e == "error", "nightly").otherwise(e)
    return queues.route(table(spark, d, "events").select("event_id", kind.alias("event_type"))).select("event_id", "event_type", "lane", "deadline_s")


@query("""SELECT delivery_id, event_id, CASE WHEN reason IS NOT NULL THEN 'QUARANTINED' WHEN row_number() OVER (PARTITION BY event_id, reason IS NULL ORDER BY delivery_id) > 1 THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS status, reason FROM (
    SELECT event_id AS delivery_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'e' || (event_id % 700) END AS event_id, CASE WHEN event_id % 11 = 0 THEN 'BAD_SIGNATURE' WHEN event_id % 17 = 0 THEN 'MISSING_IDENTITY' WHEN event_type = 'signup' THEN 'UNKNOWN_EVENT_TYPE'
    WHEN event_id % 13 = 0 THEN 'INVALID_REPOSITORY_SOURCE' WHEN event_id % 19 = 0 THEN 'INVALID_TIMESTAMP' END AS reason FROM events)""")
def c2_intake(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        k.alias("delivery_id"), F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("e"), (k % 700).cast("string"))).alias("event_id"), (k % 11 != 0).alias("signed"),
        F.when(F.col("event_type") == "signup", "other").otherwise("repo.push").alias("event_type"), F.when(k % 13 == 0, "No/Good!").otherwise("team/app").alias("repository"), F.when(k % 19 == 0, "soon").otherwise("2024-01-01 00:00:00").alias("sent_at"),
    )
    return queues.intake(rows)


CLASSES = ["APPLICATION_RUNTIME", "SHARED_LIBRARY", "DOCUMENTATION", "CONTRACT_SCHEMA_SOURCE", "DATA_PIPELINE"]


@query("""SELECT repository, CASE WHEN n IS NULL THEN 7 ELSE lowest END AS level, CASE WHEN reason IS NULL THEN cls ELSE 'UNKNOWN' END AS class, CASE WHEN reason IS NULL THEN 'EVALUATED' ELSE 'REVIEW_REQUIRED' END AS status, reason,
    CASE WHEN reason IS NOT NULL THEN 'BLOCK' WHEN cls IN ('APPLICATION_RUNTIME', 'DATA_PIPELINE') THEN 'INCLUDE' WHEN cls = 'CONTRACT_SCHEMA_SOURCE' THEN 'METADATA_ONLY' ELSE 'EXCLUDE' END AS baseline,
    CASE WHEN reason IS NOT NULL THEN 'REVIEW' ELSE CASE cls WHEN 'APPLICATION_RUNTIME' THEN 'INCREMENTAL_LINEAGE' WHEN 'DATA_PIPELINE' THEN 'INCREMENTAL_AND_NATIVE' WHEN 'CONTRACT_SCHEMA_SOURCE' THEN 'REEVALUATE_DEPENDENTS' WHEN 'SHARED_LIBRARY' THEN 'REANALYZE_CONSUMERS' ELSE 'NO_LINEAGE_IMPACT' END END AS on_change
    FROM (SELECT *, CASE WHEN n IS NULL THEN 'NO_DECISIVE_EVIDENCE' WHEN n > 1 THEN 'EVIDENCE_CONFLICT' WHEN lowest = 7 AND cls IN ('SHARED_LIBRARY', 'DOCUMENTATION', 'CONTRACT_SCHEMA_SOURCE') THEN 'HEURISTIC_EXCLUSION_FORBIDDEN' END AS reason
    FROM (SELECT c_custkey AS repository FROM customer) r LEFT JOIN (SELECT o_custkey, lv AS lowest, count(DISTINCT cls) AS n, min(cls) AS cls FROM (
      SELECT o_custkey, CAST(o_orderkey % 3 + 5 AS INT) AS lv, min(CAST(o_orderkey % 3 + 5 AS INT)) OVER (PARTITION BY o_custkey) AS m, ['APPLICATION_RUNTIME', 'SHARED_LIBRARY', 'DOCUMENTATION', 'CONTRACT_SCHEMA_SOURCE', 'DATA_PIPELINE'][o_orderkey // 8 % 5 + 1] AS cls FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') WHERE lv = m GROUP BY o_custkey, lv) e ON e.o_custkey = r.repository)""")  # fmt: skip
def c11_classification(spark, d):
    cls = F.element_at(F.array(*map(F.lit, CLASSES)), (F.floor(F.col("o_orderkey") / 8) % 5 + 1).cast("int"))
    # urgent orders in progress are evidence, so some repositories have none
    told = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    evidence = table(spark, d, "orders").where(told).select(F.col("o_custkey").alias("repository"), (F.col("o_orderkey") % 3 + 5).cast("int").alias("level"), cls.alias("class"))
    return queues.classify(table(spark, d, "customer").select(F.col("c_custkey").alias("repository")), evidence)


@query("SELECT s_nationkey::VARCHAR AS repository, s_name AS path, CAST(floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1) / 3) AS INT) AS unit FROM supplier")
def c13_work_units(spark, d):
    return queues.work_units(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("repository"), F.col("s_name").alias("path")), 3)


@query("""SELECT p_partkey AS unit_id, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN 'DUPLICATE' WHEN p_partkey % 2 = 1 THEN 'UNPLANNED' ELSE 'MISSING' END AS problem FROM part
    WHERE (p_partkey % 2 = 0 AND p_partkey % 3 <> 0) OR (p_partkey % 2 = 0 AND p_partkey % 4 = 0 AND p_partkey % 3 = 0) OR (p_partkey % 2 = 1 AND p_partkey % 3 = 0)""")
def j20_bijection(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"))
    results = p.where(F.col("unit_id") % 3 == 0)
    return queues.bijection(p.where(F.col("unit_id") % 2 == 0), results.unionByName(results.where(F.col("unit_id") % 4 == 0)))


@query("SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE -1 END::BIGINT AS difference FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def a14_x6_accounting(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    once = p.where(F.col("p_partkey") % 3 != 0)
    return queues.accounted(p, once.unionByName(once.where(F.col("p_partkey") % 5 == 0)).unionByName(p.where((F.col("p_partkey") % 15 == 0) & F.lit(False))))


@query("""SELECT t.h::INT AS hours_ago, count(event_id) AS n FROM range(24) t(h) LEFT JOIN events e ON CAST(floor((epoch(TIMESTAMP '2024-01-20') - epoch(ts)) / 3600) AS INT) = t.h GROUP BY t.h""")
def a20_z10_hourly(spark, d):
    return queues.hourly(table(spark, d, "events"), "ts", F.lit("2024-01-20").cast("timestamp"))


@query("SELECT user_id % 10 AS caller, event_type AS callee, array_to_string(list_sort(list(DISTINCT 'op-' || (event_id % 4))), ',') AS operations, count(*) AS n FROM events GROUP BY ALL")
def a22_interaction_matrix(spark, d):
    return queues.matrix(table(spark, d, "events").select((F.col("user_id") % 10).alias("caller"), F.col("event_type").alias("callee"), F.concat(F.lit("op-"), (F.col("event_id") % 4).cast("string")).alias("operation")))


@query("SELECT o_custkey AS system, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_run, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F' AND o_orderkey % 2 = 0) AS last_published FROM orders GROUP BY o_custkey")
def a21_freshness(spark, d):
    k = F.col("o_orderkey")
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("system"), k.alias("run_id"), F.when(k % 2 == 0, "BASELINE").otherwise("INCREMENTAL").alias("workflow"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("IN_REVIEW").alias("state"), F.col("o_orderdate").alias("updated_at"))
    return operations.freshness(runs)


@query("SELECT user_id AS run_id, min(ts) AS started, max(ts + to_seconds(floor(value)::BIGINT)) AS ended, sum(floor(value)::BIGINT)::BIGINT AS busy_s FROM events GROUP BY user_id")
def a23_stage_durations(spark, d):
    e = table(spark, d, "events")
    return operations.durations(e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("started_at"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("value") * 1_000_000).alias("ended_at")))


@query("SELECT user_id AS run_id, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS sequence FROM events GROUP BY user_id, event_type")
def w2_stage_sequence(spark, d):
    return operations.stage_sequence(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("ts").alias("at")))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'awaiting' ELSE 'failed' END AS category, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'quarantined', count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) FROM events""")
def a18_a19_run_tally(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "IN_REVIEW").otherwise("FAILED_REDRIVABLE")
    quarantines = table(spark, d, "events").where(F.col("event_type") == "error").select(F.when(F.col("event_id") % 2 == 1, F.col("ts")).alias("resolved_at"))
    return operations.overview(table(spark, d, "orders").select(state.alias("state")), quarantines)


@query("SELECT o_custkey AS run_id, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN NULL ELSE bool_and(o_orderstatus = 'F') FILTER (o_orderstatus <> 'P') END AS corroborated FROM orders GROUP BY o_custkey")
def a27_combined_verdict(spark, d):
    verdict = F.when(F.col("o_orderstatus") == "P", "NOT_PROVIDED").when(F.col("o_orderstatus") == "F", "CORROBORATED").otherwise("CONTRADICTED")
    return operations.verdicts(table(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), verdict.alias("verdict")))


@query("""SELECT c.c_custkey AS env, 'g' || (c_custkey % 4) AS version, CASE WHEN c_custkey % 7 = 0 THEN 'OUT_OF_SYNC' WHEN d.system IS NULL THEN 'NOT_AVAILABLE' WHEN d.state = 'P' OR d.digest IS NULL OR d.version <> 'g' || (c_custkey % 4) THEN 'OUT_OF_SYNC' ELSE 'IN_SYNC' END AS sync
    FROM customer c LEFT JOIN (SELECT o_custkey AS system, arg_max(o_orderstatus, (o_orderdate, -o_orderkey)) AS state, arg_max(coalesce('g' || (o_orderkey % 4), ''), (o_orderdate, -o_orderkey)) AS version,
      nullif(arg_max(CASE WHEN o_orderkey % 5 <> 0 THEN 'p' ELSE '' END, (o_orderdate, -o_orderkey)), '') AS digest FROM orders GROUP BY o_custkey) d ON d.system = c.c_custkey""")  # fmt: skip
def j12_u12_sync(spark, d):
    c, k = table(spark, d, "customer"), F.col("o_orderkey")
    pointers = c.select(F.col("c_custkey").alias("env"), F.concat(F.lit("g"), (F.col("c_custkey") % 4).cast("string")).alias("version"))
    versions = pointers.where(F.col("env") % 7 != 0).withColumn("checksum", F.lit("c"))
    deployed = table(spark, d, "orders").select(
        F.col("o_custkey").alias("env"), F.concat(F.lit("g"), (k % 4).cast("string")).alias("graph_version"), F.when(k % 5 != 0, "p").alias("package_digest"),
        F.when(F.col("o_orderstatus") == "P", "LINEAGE_OUT_OF_SYNC").otherwise("PROMOTED").alias("state"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), k.alias("system"),
    )
    return queues.sync_status(pointers, versions, deployed)


@query("""SELECT s_nationkey::VARCHAR AS repository, s_suppkey AS seq, CASE WHEN f IS NOT NULL THEN f WHEN coalesce(sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 THEN 'BUDGET' ELSE 'ACCEPTED' END AS result
    FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN 'SCHEMA' WHEN s_suppkey % 7 = 0 THEN 'CITATION' WHEN s_suppkey % 11 = 0 THEN 'URN' END AS f FROM supplier)""")
def s20_v7_guardrails(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("repository"), k.alias("seq"), (k % 5 != 0).alias("has_schema"), (k % 7 != 0).alias("has_citation"), (k % 11 != 0).alias("urn_known"))
    return queues.guarded(rows, 2)


MOVED = """moves AS (SELECT o_orderkey AS k, ['IN_REVIEW', 'APPROVED', 'REJECTED', 'SUPERSEDED', 'FINALIZED', 'DRAFT'][o_orderkey % 6 + 1] AS a, ['APPROVED', 'REJECTED', 'SUPERSEDED', 'FINALIZED', 'IN_REVIEW'][o_orderkey // 8 % 5 + 1] AS b FROM orders),
judged AS (SELECT *, CASE WHEN a = 'DRAFT' THEN NULL ELSE (a, b) IN (('IN_REVIEW', 'APPROVED'), ('IN_REVIEW', 'REJECTED'), ('IN_REVIEW', 'SUPERSEDED'), ('APPROVED', 'FINALIZED')) END AS legal FROM moves)"""


def _moves(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    states = ("IN_REVIEW", "APPROVED", "REJECTED", "SUPERSEDED", "FINALIZED")
    return table(spark, d, "orders").select("o_orderkey", pick((*states, "DRAFT"), k % 6).alias("before"), pick((*states[1:], states[0]), F.floor(k / 8) % 5).alias("after"))


@query("SELECT k AS o_orderkey, a AS before, b AS after, legal FROM judged", MOVED)
def v5_transitions(spark, d):
    return validation.legal_moves(_moves(spark, d))


@query("""SELECT k AS proposal, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 <> 0 AND coalesce(legal, false) THEN b ELSE a END AS state, CASE WHEN k % 7 = 0 THEN NULL ELSE 3 + (k % 5 <> 0 AND coalesce(legal, false))::INT END AS lock,
    CASE WHEN k % 7 = 0 THEN 'NOT_FOUND' WHEN k % 5 = 0 THEN 'LOCK_CONFLICT' WHEN coalesce(legal, false) THEN 'APPLIED' ELSE 'INVALID_TRANSITION' END AS result FROM judged""", MOVED)  # fmt: skip
def u9_decided(spark, d):
    m, k = _moves(spark, d), F.col("o_orderkey")
    proposals = m.where(k % 7 != 0).select(k.alias("proposal"), F.col("before").alias("state"), F.lit(3).alias("lock"))
    return validation.decided(proposals, m.select(k.alias("proposal"), F.col("after").alias("requested"), F.when(k % 5 == 0, 2).otherwise(3).alias("lock")))


@query("""SELECT 'lineitem.l_orderkey' AS name, 'FOREIGN_KEY' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'events.event_id', 'UNIQUE', count(*) FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem.l_orderkey,l_linenumber', 'UNIQUE', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'events.value', 'CHECK', count(*) FROM events WHERE NOT (value >= 0 AND value < 50)""")
def v1_constraints(spark, d):
    t = lambda n: table(spark, d, n)
    return (
        validation.foreign_key(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.l_orderkey")
        .unionByName(validation.unique(t("events"), ["event_id"], "events.event_id"))
        .unionByName(validation.unique(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem.l_orderkey,l_linenumber"))
        .unionByName(validation.check(t("events"), (F.col("value") >= 0) & (F.col("value") < 50), "events.value"))
    )


@query("SELECT c_custkey, lower(c_mktsegment) LIKE 'b%' AS denied FROM customer")
def v12_hard_deny(spark, d):
    env = F.when(F.lower("c_mktsegment").like("b%"), F.concat(F.lit("Prod-"), "c_mktsegment")).otherwise("staging")
    return table(spark, d, "customer").select("c_custkey", validation.denied(env).alias("denied"))


@query("""SELECT o_orderkey, array_to_string(list_sort(list(hit)), ',') AS stopped_by FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'ENVIRONMENT:P' END, CASE WHEN o_custkey % 10 = 3 THEN 'WORKLOAD:w3' END,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'MECHANISM:1-URGENT' END, CASE WHEN o_orderkey % 8 = 1 THEN 'PROFILE:p1@1.0.0' END, CASE WHEN o_orderkey % 6 = 2 THEN 'DATASET:d2' END, CASE WHEN o_orderkey % 9 = 2 THEN 'DATASET:x2' END], lambda x: x IS NOT NULL)) AS hit FROM orders) GROUP BY o_orderkey""")  # fmt: skip
def j18_kill_switches(spark, d):
    k = F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    leases = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("environment"), text("w", F.col("o_custkey") % 10).alias("workload"), F.col("o_orderpriority").alias("mechanism"), F.concat(text("p", k % 8), F.lit("@1.0.0")).alias("profile"),
        F.array(text("d", k % 6), text("x", k % 9)).alias("datasets"),
    )
    rows = [("GLOBAL", "*", False), ("ENVIRONMENT", "P", True), ("WORKLOAD", "w3", True), ("MECHANISM", "1-URGENT", True), ("PROFILE", "p1@1.0.0", True), ("PROFILE", "p2@1.0.0", False), ("DATASET", "d2", True), ("DATASET", "x2", True)]
    return validation.stopped(leases, spark.createDataFrame(rows, "scope string, value string, active boolean"), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 3 THEN 'PROFILE_NOT_FOUND' WHEN o_orderkey % 8 = 5 THEN 'PROFILE_DISABLED' WHEN o_orderstatus = 'P' THEN 'PRODUCTION' WHEN o_custkey % 4 = 1 OR o_orderdate <= TIMESTAMP '1992-06-01' THEN 'ATTESTATION_MISSING'
    WHEN o_orderkey % 6 = 4 THEN 'SCOPE' WHEN o_orderpriority = '1-URGENT' THEN 'COLLECTION_DISABLED' END AS error FROM orders""")
def j18_lease_error(spark, d):
    """Requests of orders: their profile, the attestation of their own artifact, the datasets they ask for, and one mechanism that is switched off."""
    k = F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    requests = table(spark, d, "orders").select(
        k, F.when(k % 17 == 3, "none@1.0.0").otherwise(F.concat(text("p", k % 8), F.lit("@1.0.0"))).alias("profile"), text("sha-", k).alias("artifact_digest"), F.when(F.col("o_orderstatus") == "P", "Production").otherwise("staging").alias("environment"), F.lit("w").alias("workload"),
        F.col("o_orderpriority").alias("mechanism"), F.array(F.lit("d0"), text("d", k % 6)).alias("datasets"), "o_custkey", "o_orderdate",
    )
    profiles = spark.createDataFrame([(f"p{i}@1.0.0", "DISABLED" if i == 5 else "ENABLED", ["d0", "d1", "d2", "d3", "d5"]) for i in range(8)], "profile string, state string, datasets array<string>")
    attestations = requests.select("profile", "artifact_digest", F.when(F.col("o_custkey") % 4 == 1, "REVOKED").otherwise("APPROVED").alias("state"), F.col("o_orderdate").alias("expires_at"))
    switches = spark.createDataFrame([("MECHANISM", "1-URGENT", True), ("GLOBAL", "*", False)], "scope string, value string, active boolean")
    return validation.lease_error(requests, profiles, attestations, switches, F.lit("1992-06-01").cast("timestamp"), "o_orderkey")


@query("""SELECT o_orderkey AS command_id, 'r' || i AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 'STALE_LEASE' WHEN i = 1 THEN 'RENEWED'
    WHEN i = 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN CASE WHEN o_orderkey % 7 < 5 THEN 'FAILED_REDRIVABLE' ELSE 'FAILED_TERMINAL' END ELSE 'RENEWED' END
    WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'REPLAYED' ELSE 'CONFLICT' END WHEN o_orderkey % 3 = 1 THEN 'STALE_LEASE' ELSE 'COMPLETED' END AS result FROM orders, (VALUES (1), (2), (3)) t(i)""")
def c5_lease_results(spark, d):
    """Of each order, as a running command: a renewal, then its end or another renewal, then a completion; every fifth is held by another epoch."""
    k, begin = F.col("o_orderkey"), F.lit("1996-01-01").cast("timestamp")
    o = table(spark, d, "orders")
    commands = o.select(k.alias("command_id"), F.lit("RUNNING").alias("status"), F.lit("w").alias("owner"), F.lit(2).alias("epoch"), (begin + F.expr("INTERVAL 30 SECONDS")).alias("lease_until"), (k % 7).alias("attempts"), F.lit(5).alias("max_attempts"), (begin + F.expr("INTERVAL 1 HOUR")).alias("deadline"), F.lit(None).cast("string").alias("checksum"))
    request = lambda i, op, checksum: F.struct(F.lit(f"r{i}").alias("request_id"), op.alias("op"), (begin + F.expr(f"INTERVAL {20 * i} SECONDS")).alias("at"), checksum.cast("string").alias("checksum"))
    second = F.when(k % 3 == 0, "complete").when(k % 3 == 1, "fail").otherwise("renew")
    each = F.array(request(1, F.lit("renew"), F.lit(None)), request(2, second, F.lit("a")), request(3, F.lit("complete"), F.when((k % 3 != 0) | (k % 2 == 0), "a").otherwise("b")))
    requests = o.select(k.alias("command_id"), F.lit("w").alias("owner"), F.when(k % 5 == 0, 1).otherwise(2).alias("epoch"), F.lit(30).alias("lease_s"), F.lit(True).alias("retryable"), F.explode(each).alias("r")).select("*", "r.*").drop("r")
    return queues.lease_results(commands, requests)[0]
