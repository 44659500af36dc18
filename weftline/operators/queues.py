"""Queues, commands, deployments and publication bookkeeping (J12-J13, W2-W11, C1-C6, U*, L*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators.ordered import numbered, scanned

#: Event type, lane, workflow, deadline in seconds, attempts.
LANES = (
    ("pr.updated", "interactive", "PR_GATE", 120, 2),
    ("repo.push", "events", "INCREMENTAL", 900, 5),
    ("deploy", "events", "DEPLOYMENT", 900, 5),
    ("baseline", "bulk", "BASELINE", 86400, 3),
    ("backfill", "bulk", "BASELINE", 86400, 3),
    ("nightly", "bulk", "NIGHTLY", 86400, 3),
    ("llm.batch", "bulk", "NIGHTLY", 86400, 3),
)


def route(events: DataFrame) -> DataFrame:
    """An event's lane, workflow, deadline and attempts; none for an unknown type."""
    lanes = events.sparkSession.createDataFrame(LANES, "event_type string, lane string, workflow string, deadline_s int, max_attempts int")
    return events.join(F.broadcast(lanes), "event_type", "left")


def intake(deliveries: DataFrame) -> DataFrame:
    """QUARANTINED with the first reason, DUPLICATE of an earlier event_id, or ACCEPTED.

    Columns: delivery_id, event_id, signed, event_type, repository, sent_at (text).
    """
    known = [x[0] for x in LANES]
    reason = F.when(~F.col("signed"), "BAD_SIGNATURE").when(F.coalesce("event_id", F.lit("")) == "", "MISSING_IDENTITY").when(~F.coalesce(F.col("event_type").isin(*known), F.lit(False)), "UNKNOWN_EVENT_TYPE").when(~F.coalesce(F.col("repository").rlike("^[a-z0-9-]+/[a-z0-9-]+$"), F.lit(False)), "INVALID_REPOSITORY_SOURCE").when(F.try_to_timestamp("sent_at").isNull(), "INVALID_TIMESTAMP")
    judged = deliveries.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull())
    first = good.groupBy("event_id").agg(F.min("delivery_id").alias("first"))
    status = F.when(F.col("delivery_id") > F.col("first"), "DUPLICATE").otherwise("ACCEPTED")
    told = good.join(first, "event_id").select("delivery_id", "event_id", status.alias("status"), "reason")
    return told.unionByName(judged.where(F.col("reason").isNotNull()).select("delivery_id", "event_id", F.lit("QUARANTINED").alias("status"), "reason"))


#: States of a message; those in BLOCKING hold up the younger messages of their group.
BLOCKING = ("AVAILABLE", "IN_FLIGHT")
LANE_RANK = ("interactive", "events", "bulk")


def claimable(messages: DataFrame, now: Column, groups: DataFrame | None = None) -> DataFrame:
    """Due messages that are the oldest open one of their group (FIFO): a grouped minimum, no theta join.

    messages: (lane, group_id, sequence, status, created_at, available_at, attempts). Acknowledged, dead and superseded messages block
    nothing. groups: (lane, group_id, last_claim_order); with it the claim order of a lane is given too: groups that never were
    claimed first, then by their last claim, then by sequence.
    """
    open_ = messages.where(F.col("status").isin(*BLOCKING))
    head = F.min_by(F.struct("sequence", "status", "created_at", "available_at", "attempts"), "sequence").alias("head")
    heads = open_.groupBy("lane", "group_id").agg(head).where((F.col("head.status") == "AVAILABLE") & (F.col("head.available_at") <= now))
    out = heads.select("lane", "group_id", "head.sequence", "head.created_at", "head.attempts")
    if groups is None:
        return out
    placed = out.join(groups.select("lane", "group_id", "last_claim_order"), ["lane", "group_id"], "left")
    return numbered(placed.withColumn("last_claim_order", F.coalesce("last_claim_order", F.lit(-1))), ["last_claim_order", "sequence"], by=["lane"], name="claim").drop("last_claim_order")


def fair_order(messages: DataFrame) -> DataFrame:
    """W7 in batch: round robin: each group's first, then each one's second, ... ; ``turn`` and sequence order the claims."""
    return numbered(messages.where(F.col("status") == "AVAILABLE"), ["sequence"], by=["lane", "group_id"], name="turn")


def superseded(messages: DataFrame, key: str) -> DataFrame:
    """Available messages with a newer message of the same key in the lane, whatever became of that one."""
    newer = scanned(messages, ["sequence"], ["lane", key], {"by": ("lead", F.col("sequence"))})
    return newer.where((F.col("status") == "AVAILABLE") & F.col("by").isNotNull()).select("lane", key, "sequence", "by")


#: What may be done to a message, the states it may be in then, and the state that follows.
STEPS = (
    ("claim", ("AVAILABLE",), "IN_FLIGHT"), ("ack", ("IN_FLIGHT",), "ACKED"), ("retry", ("IN_FLIGHT",), "AVAILABLE"), ("expire", ("IN_FLIGHT",), "AVAILABLE"),
    ("redrive", ("DEAD",), "AVAILABLE"), ("supersede", ("AVAILABLE",), "SUPERSEDED"),
)


def replayed(events: DataFrame) -> DataFrame:
    """The state of each message after its log, with its attempts: (message_id, status, attempts, refused).

    events: (message_id, at, step, max_attempts), the first of a message being ``publish``. A claim is an attempt; a retry or expiry at the last
    attempt leaves it DEAD; a redrive sets attempts to 0; a step that the state does not allow is refused and changes nothing. A message's log is
    folded in order; it is as long as the attempts that it may have.
    """
    logs = events.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("at", "step", "max_attempts"))).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))

    def step(state: Column, e: Column) -> Column:
        status, attempts = state["status"], state["attempts"]
        last = attempts >= e["max_attempts"]
        to = F.when(e["step"].isin("retry", "expire") & last, "DEAD")
        ok = (e["step"] == "publish") & status.isNull()
        to = F.when(e["step"] == "publish", "AVAILABLE").when(to.isNotNull(), to)
        for name, froms, after in STEPS:
            ok = ok | ((e["step"] == name) & status.isin(*froms))
            to = to.when(e["step"] == name, after)
        ok = F.coalesce(ok, F.lit(False))
        tries = F.when(e["step"] == "claim", attempts + 1).when(e["step"] == "redrive", 0).otherwise(attempts)
        return F.struct(F.when(ok, to).otherwise(status).alias("status"), F.when(ok, tries).otherwise(attempts).alias("attempts"), (state["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    return logs.select("message_id", F.aggregate("log", start, step).alias("s")).select("message_id", "s.status", "s.attempts", "s.refused")


def recovered(messages: DataFrame, most_attempts: int, now: Column) -> DataFrame:
    """C4: messages in flight whose lease ran out: DEAD at the last attempt, else AVAILABLE."""
    late = (F.col("status") == "IN_FLIGHT") & (F.col("lease_expires_at") <= now)
    return messages.where(late).select("lane", "sequence", F.when(F.col("attempts") >= most_attempts, "DEAD").otherwise("AVAILABLE").alias("status"))


def lane_stats(messages: DataFrame, now: Column) -> DataFrame:
    """C8, C9's queue part for each lane: open messages, oldest age, those tried again, dead ones and the state."""
    open_ = F.col("status").isin(*BLOCKING)
    g = messages.groupBy("lane").agg(F.count_if(open_).alias("n_open"), F.min(F.when(open_, F.col("created_at"))).alias("oldest"), F.count_if((F.col("attempts") > 1) & (F.col("status") != "DEAD")).alias("retries"), F.count_if(F.col("status") == "DEAD").alias("dead"))
    age = rules.age_seconds(F.col("oldest"), now)
    degraded = (F.col("retries") > 0) | (F.col("dead") > 0) | F.coalesce(age > 60, F.lit(False))
    return g.select("lane", "n_open", "retries", "dead", age.alias("oldest_s"), F.when(degraded, "DEGRADED").otherwise("HEALTHY").alias("state"), rules.ordinal(F.col("lane"), LANE_RANK).alias("priority"))


def fairness(messages: DataFrame) -> DataFrame:
    """Most less fewest messages of a group, for each lane."""
    each = messages.groupBy("lane", "group_id").agg(F.count("*").alias("n"))
    return each.groupBy("lane").agg((F.max("n") - F.min("n")).alias("spread"), F.count("*").alias("n_groups"))


def judged_deployments(events: DataFrame, packages: DataFrame, pointers: DataFrame) -> DataFrame:
    """What each deployment event comes to, in order of arrival in its system and environment.

    events: (system, environment, arrival, event_id, event_type, provider_sequence, attempt, outcome, artifact_digest, authentic); packages:
    (system, environment, artifact_digest, graph_version, graph_checksum, approved); pointers: (environment, graph_version, checksum) of the
    graphs that are there. Unauthentic events and merges change nothing and order nothing; a known event_id is a DUPLICATE; an event whose
    (provider_sequence, attempt) is not above all before it is STALE.
    """
    key = ["system", "environment"]
    counts = F.col("authentic") & (F.col("event_type") != "MERGE")
    place = F.when(F.col("counts"), F.struct("provider_sequence", "attempt"))
    counted = events.withColumn("counts", counts)
    first = counted.where("counts").groupBy(*key, "event_id").agg(F.min("arrival").alias("first"))
    e = counted.join(first, [*key, "event_id"], "left").withColumn("again", F.col("counts") & (F.col("arrival") > F.col("first"))).drop("first")
    e = scanned(e, ["arrival"], key, {"high": ("high", F.when(~F.col("again"), place))})
    e = e.withColumn("stale", F.coalesce(place <= F.col("high"), F.lit(False)) & ~F.col("again"))
    p = packages.where("approved").select(*key, "artifact_digest", "graph_version", "graph_checksum", F.lit(True).alias("packed"))
    g = pointers.select("environment", "graph_version", F.col("checksum").alias("there"))
    j = e.join(p, [*key, "artifact_digest"], "left").join(g, ["environment", "graph_version"], "left")
    reason = (
        F.when(~F.col("authentic"), "AUTHENTICATION_FAILED").when(F.col("event_type") == "MERGE", "NON_DEPLOYMENT_EVENT").when(F.col("again"), "DUPLICATE").when(F.col("stale"), "STALE_EVENT")
        .when(F.col("outcome") == "FAILED", "DEPLOYMENT_FAILED").when(F.col("artifact_digest").isNull(), "MISSING_ARTIFACT_DIGEST").when(F.col("packed").isNull(), "EXACT_PACKAGE_NOT_FOUND")
        .when(F.col("there").isNull() | (F.col("there") != F.col("graph_checksum")), "PROMOTION_REFUSED")
    )
    state = (
        F.when(F.col("reason").isin("AUTHENTICATION_FAILED", "NON_DEPLOYMENT_EVENT"), "UNCHANGED").when(F.col("reason") == "DUPLICATE", "DUPLICATE").when(F.col("reason") == "STALE_EVENT", "STALE")
        .when(F.col("reason") == "DEPLOYMENT_FAILED", "FAILED_NO_CHANGE").when(F.col("reason") == "EXACT_PACKAGE_NOT_FOUND", "LINEAGE_OUT_OF_SYNC").when(F.col("reason").isNotNull(), "FAILED_TERMINAL")
        .when(F.col("event_type") == "ROLLBACK", "ROLLED_BACK").otherwise("PROMOTED")
    )
    return j.withColumn("reason", reason).select(*key, "event_id", "arrival", state.alias("state"), "reason")


def current_deployment(events: DataFrame) -> DataFrame:
    """The state that each system is left in."""
    return events.groupBy("system").agg(F.max(F.struct("provider_sequence", "attempt", "event_id")).alias("m")).select("system", "m.provider_sequence", "m.attempt", "m.event_id")


def chain(rows: DataFrame, key: str, version: str) -> DataFrame:
    """What each version supersedes and is superseded by."""
    return scanned(rows.select(key, version), [version], [key], {"supersedes": ("lag", F.col(version)), "superseded_by": ("lead", F.col(version))})


def fenced(reservations: DataFrame) -> DataFrame:
    """Tokens grow with each reservation of an environment; only the last may activate."""
    n = reservations.groupBy("env").agg(F.count("*").alias("last"))
    given = numbered(reservations, ["reserved_at", "reservation_id"], by=["env"], name="token")
    return given.join(n, "env").select("env", "reservation_id", "token", (F.col("token") == F.col("last")).alias("may_activate"))


def lease_steals(attempts: DataFrame) -> DataFrame:
    """Per command, attempts beyond the first epoch and those that followed an expired lease."""
    r = scanned(attempts, ["epoch"], ["command_id"], {"before": ("lag", F.col("status"))})
    return r.groupBy("command_id").agg(F.count_if(F.col("epoch") > 1).alias("steals"), F.count_if(F.col("before") == "LEASE_EXPIRED").alias("after_expiry"))


def command_status(commands: DataFrame, now) -> DataFrame:
    """What a claim of each command would do."""
    late = (F.col("attempts") >= F.col("max_attempts")) | (F.col("deadline") < now)
    live = (F.col("status") == "RUNNING") & (F.col("lease_until") >= now)
    status = F.when(F.col("status").isin("COMPLETE", "FAILED_TERMINAL"), "CLOSED").when(live, "UNAVAILABLE").when(late, "FAILED_TERMINAL").when(F.col("status") == "RUNNING", "RECLAIM").otherwise("CLAIM")
    return commands.select("command_id", status.alias("result"))


_LEASE = "struct<status: string, owner: string, epoch: bigint, lease_until: timestamp, checksum: string, results: array<struct<request_id: string, result: string>>>"


def lease_results(commands: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each renewal, completion and failure of a leased command comes to: (command_id, request_id, result), and the commands after them: (command_id, status, epoch, lease_until).

    commands: (command_id, status, owner, epoch, lease_until, attempts, max_attempts, deadline, checksum); requests: (command_id, request_id, op, owner, epoch, at, lease_s, checksum, retryable), taken in
    the order of at, then of request_id. STALE_LEASE: the command is not running, another holds it, its epoch has passed, or the lease has run out. A completion is REPLAYED if the command has it
    with the same checksum, CONFLICT with another. A failure that may be tried again, within attempts and deadline, is FAILED_REDRIVABLE, else FAILED_TERMINAL. Requests of no known command are left out.
    What is gathered are the requests of one command, which has few.
    """
    asked = requests.groupBy("command_id").agg(F.array_sort(F.collect_list(F.struct("at", "request_id", "op", F.col("owner").alias("by"), F.col("epoch").alias("of"), "lease_s", "checksum", "retryable"))).alias("asked"))
    zero = F.struct("status", "owner", F.col("epoch").cast("bigint").alias("epoch"), "lease_until", "checksum", F.array().cast("array<struct<request_id: string, result: string>>").alias("results")).cast(_LEASE)

    def step(s: Column, r: Column) -> Column:
        active = (s["status"] == "RUNNING") & s["owner"].eqNullSafe(r["by"]) & s["epoch"].eqNullSafe(r["of"]) & F.coalesce(r["at"] < s["lease_until"], F.lit(False))
        again = r["retryable"] & (F.col("attempts") < F.col("max_attempts")) & (r["at"] < F.col("deadline"))
        completion = F.when(s["checksum"].isNotNull() & ~s["checksum"].eqNullSafe(r["checksum"]), "CONFLICT").when((s["status"] == "COMPLETED") & s["checksum"].isNotNull(), "REPLAYED").when(~active, "STALE_LEASE").otherwise("COMPLETED")
        result = F.when(r["op"] == "complete", completion).when(~active, "STALE_LEASE").when(r["op"] == "renew", "RENEWED").when(again, "FAILED_REDRIVABLE").otherwise("FAILED_TERMINAL")
        over = result.isin("COMPLETED", "FAILED_REDRIVABLE", "FAILED_TERMINAL")
        until = F.when(result == "RENEWED", r["at"] + F.make_interval(secs=r["lease_s"])).when(~over, s["lease_until"])
        return F.struct(
            F.when(over, result).otherwise(s["status"]).alias("status"), F.when(~over, s["owner"]).alias("owner"), s["epoch"].alias("epoch"), until.alias("lease_until"), F.when(result == "COMPLETED", r["checksum"]).otherwise(s["checksum"]).alias("checksum"),
            F.concat(s["results"], F.array(F.struct(r["request_id"].cast("string").alias("request_id"), result.alias("result")))).alias("results"),
        )

    done = commands.join(asked, "command_id").select("command_id", F.aggregate("asked", zero, step).alias("s"))
    return done.select("command_id", F.inline("s.results")), done.select("command_id", "s.status", "s.epoch", "s.lease_until")


def distinct_documents(rows: DataFrame, document: str) -> DataFrame:
    """The documents, once each, as canonical JSON: keys in order, no white space; a text that is no JSON is a document of its own, as it is."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(document)), F.col(document))
    return rows.select(canonical.alias(document)).distinct()


def idempotent(stages: DataFrame) -> DataFrame:
    """REUSE for a stage identity recorded again with the same checksum, CONFLICT with others, else NEW."""
    g = stages.groupBy("identity").agg(F.count("*").alias("n"), F.countDistinct("checksum").alias("k"))
    return g.select("identity", F.when(F.col("k") > 1, "CONFLICT").when(F.col("n") > 1, "REUSE").otherwise("NEW").alias("result"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """New values where there are any, else the old."""
    both = old.select(*key, *[F.col(v).alias(f"{v}_old") for v in values]).join(new, key, "full_outer")
    return both.select(*key, *[F.coalesce(v, f"{v}_old").alias(v) for v in values])


def projected(base: DataFrame, removed: DataFrame, added: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """U4: base without removed, with added and changed; of several rows of a key the later list wins."""
    r = lambda df, n: df.withColumn("turn", F.lit(n))
    rows = r(base.join(removed.select(key), key, "left_anti"), 0).unionByName(r(added, 1)).unionByName(r(changed, 2))
    others = [c for c in rows.columns if c not in (key, "turn")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col("turn")).alias("row")).select(key, "row.*", F.lit("PUBLISHED").alias("status"))


def checksum(rows: DataFrame, by: str, text: str) -> DataFrame:
    """A digest of a namespace's rows that no order changes: row hashes are summed, nothing is gathered.

    Sums are made in 256 parts of a namespace as whole numbers, and of these as decimals, so that no sum passes its type.
    """
    hashed = rows.select(by, F.sha2(F.col(text), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", i, 8), 16, 10).cast("bigint")).alias(f"s{i}")
    parts = hashed.groupBy(by, F.substring("h", 33, 2).alias("part")).agg(F.count("*").alias("n"), part(1), part(9), part(17), part(25))
    whole = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 9, 17, 25)]
    return parts.groupBy(by).agg(F.sum("n").alias("n"), *whole).select(by, F.sha2(F.concat_ws("-", "n", "s1", "s9", "s17", "s25"), 256).alias("checksum"), "n")


def reconciled(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are MISSING or UNEXPECTED."""
    e, a = expected.select(*key).distinct(), actual.select(*key).distinct()
    return e.join(a, key, "left_anti").withColumn("drift", F.lit("MISSING")).unionByName(a.join(e, key, "left_anti").withColumn("drift", F.lit("UNEXPECTED")))


def sync_status(pointers: DataFrame, versions: DataFrame, deployments: DataFrame) -> DataFrame:
    """Whether what the pointer names is what was deployed.

    pointers: (env, version); versions: (env, version, checksum) of the graphs that are there; deployments: (env, graph_version, package_digest,
    state, updated_at, system), of which the latest counts. OUT_OF_SYNC without the pointer's graph; NOT_AVAILABLE without a deployment.
    """
    latest = deployments.groupBy("env").agg(F.min_by(F.struct("graph_version", "package_digest", "state"), F.struct(-F.unix_micros("updated_at"), F.col("system"))).alias("d"))
    j = pointers.join(versions, ["env", "version"], "left").join(latest, "env", "left")
    off = (F.col("d.state") == "LINEAGE_OUT_OF_SYNC") | ~F.col("d.graph_version").eqNullSafe(F.col("version")) | F.col("d.package_digest").isNull()
    return j.select("env", "version", F.when(F.col("checksum").isNull(), "OUT_OF_SYNC").when(F.col("d").isNull(), "NOT_AVAILABLE").when(off, "OUT_OF_SYNC").otherwise("IN_SYNC").alias("sync"))


def accounted(expected: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Paths whose number of dispositions is not their number of expectations."""
    rows = expected.select("path", F.lit(1).alias("d")).unionByName(dispositions.select("path", F.lit(-1).alias("d")))
    return rows.groupBy("path").agg(F.sum("d").alias("difference")).where(F.col("difference") != 0)


def work_units(paths: DataFrame, chunk: int = 100) -> DataFrame:
    """Paths of a repository in units of at most chunk, by order."""
    placed = numbered(paths, ["path"], by=["repository"], name="unit")
    return placed.withColumn("unit", F.floor((F.col("unit") - 1) / chunk).cast("int"))


def bijection(units: DataFrame, results: DataFrame) -> DataFrame:
    """Units without exactly one result, and results without a unit."""
    r = results.groupBy("unit_id").agg(F.count("*").alias("n"))
    j = units.select("unit_id", F.lit(True).alias("planned")).join(r, "unit_id", "full_outer")
    return j.select("unit_id", F.when(F.col("planned").isNull(), "UNPLANNED").when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "DUPLICATE").alias("problem")).where(F.col("problem").isNotNull())


#: Repository class, treatment of a baseline, treatment of a change.
TREATMENTS = (
    ("APPLICATION_RUNTIME", "INCLUDE", "INCREMENTAL_LINEAGE"),
    ("DATA_PIPELINE", "INCLUDE", "INCREMENTAL_AND_NATIVE"),
    ("CONTRACT_SCHEMA_SOURCE", "METADATA_ONLY", "REEVALUATE_DEPENDENTS"),
    ("SHARED_LIBRARY", "EXCLUDE", "REANALYZE_CONSUMERS"),
    ("INFRASTRUCTURE", "EXCLUDE", "EVALUATE_BINDINGS"),
    ("DOCUMENTATION", "EXCLUDE", "NO_LINEAGE_IMPACT"),
    ("TEST_AUTOMATION", "EXCLUDE", "UPDATE_COVERAGE"),
    ("MIXED_MONOREPO", "PATH_LEVEL", "ROUTE_CHANGED_PATHS"),
    ("UNKNOWN", "BLOCK", "REVIEW"),
)
HEURISTIC = 7


def classify(repositories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each repository's class by its lowest level of evidence, with its treatments.

    evidence: (repository, level, class). UNKNOWN, to be reviewed: without evidence (NO_DECISIVE_EVIDENCE), with several classes on the lowest
    level (EVIDENCE_CONFLICT), or where only a heuristic (level 7) would leave content out (HEURISTIC_EXCLUSION_FORBIDDEN).
    """
    treatments = evidence.sparkSession.createDataFrame(TREATMENTS, "class string, baseline string, on_change string")
    # smallest and largest class of the lowest level: they differ where there are several
    low = evidence.groupBy("repository").agg(F.min(F.struct("level", "class")).alias("a"), F.max(F.struct(-F.col("level"), F.col("class"))).alias("z"))
    level, found = F.coalesce("a.level", F.lit(HEURISTIC)), F.col("a.class")
    left = repositories.select("repository").distinct().join(low, "repository", "left")
    leaves_out = found.isin(*[c for c, t, _ in TREATMENTS if t in ("EXCLUDE", "METADATA_ONLY")])
    reason = F.when(F.col("a").isNull(), "NO_DECISIVE_EVIDENCE").when(found != F.col("z.class"), "EVIDENCE_CONFLICT").when((level == HEURISTIC) & leaves_out, "HEURISTIC_EXCLUSION_FORBIDDEN")
    judged = left.select("repository", level.alias("level"), F.when(reason.isNull(), found).otherwise("UNKNOWN").alias("class"), reason.alias("reason"))
    return judged.join(F.broadcast(treatments), "class", "left").select("repository", "level", "class", "baseline", "on_change", F.when(F.col("class") == "UNKNOWN", "REVIEW_REQUIRED").otherwise("EVALUATED").alias("status"), "reason")


def gate(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """BLOCK if a calibrated change blocks, else WARN if there is any reason, else PASS; reasons once each, in the order of the checks.

    requests, one a pull request: (pr, deadline_s, head_matches, coverage_complete, environment (null: missing), environment_version,
    head_matches_after, environment_after, environment_version_after, took_s). changes: (pr, at, change_type, mechanisms, available, version,
    truncated, warn, block, elapsed_s). A change is looked at only in a healthy environment and before the deadline. What only a model says blocks nothing.
    """
    healthy = F.coalesce(F.col("environment") == "HEALTHY", F.lit(False))
    c = changes.join(requests.select("pr", "deadline_s", healthy.alias("healthy"), "environment_version"), "pr")
    # after the first change beyond the deadline none is looked at
    late = changes.join(requests.select("pr", "deadline_s"), "pr").where(F.col("elapsed_s") >= F.col("deadline_s")).groupBy("pr").agg(F.min("at").alias("stopped"))
    c = c.join(late, "pr", "left").where(F.col("healthy") & (F.col("stopped").isNull() | (F.col("at") < F.col("stopped"))))
    seen = F.col("available")
    model_only = F.coalesce((F.size(F.array_distinct("mechanisms")) == 1) & F.array_contains("mechanisms", "LLM"), F.lit(False))
    blocks = seen & (F.col("block") > 0)
    found = F.array(
        F.when(~seen, "PROJECTION_UNAVAILABLE"), F.when(seen & ~F.col("version").eqNullSafe(F.col("environment_version")), "ENVIRONMENT_VERSION_MISMATCH"), F.when(seen & F.col("truncated"), "IMPACT_TRUNCATED"),
        F.when(seen & (F.col("warn") > 0), "IMPACT_WARNING"), F.when(blocks & model_only, "LLM_ONLY_BLOCK_EVIDENCE"),
    )
    # a pull request has five reasons of a change at most, so these lists stay short: the first change that gives each
    each = c.select("pr", "at", blocks.alias("blocks"), (blocks & ~model_only).alias("calibrated"), "truncated", seen.alias("seen"), F.posexplode_outer(F.array_compact(found)).alias("nth", "reason"))
    first = each.groupBy("pr", "reason").agg(F.min(F.struct("at", "nth")).alias("at"), F.bool_or("calibrated").alias("calibrated"), F.bool_or(F.col("truncated") & F.col("seen")).alias("truncated"))
    mid = first.groupBy("pr").agg(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("at", "reason")))).alias("mid"), F.bool_or("calibrated").alias("calibrated"), F.bool_or("truncated").alias("truncated"))
    j = requests.join(mid, "pr", "left").join(late, "pr", "left")
    head = F.array(F.when(~F.col("head_matches"), "PR_HEAD_SUPERSEDED"), F.when(~F.col("coverage_complete"), "INCOMPLETE_COVERAGE"), F.when(F.col("environment").isNull(), "MISSING_ENVIRONMENT").when(F.col("environment") != "HEALTHY", "LINEAGE_OUT_OF_SYNC"))
    moved = ~(F.col("environment").eqNullSafe(F.col("environment_after")) & F.col("environment_version").eqNullSafe(F.col("environment_version_after")))
    tail = F.array(F.when(F.col("stopped").isNotNull() | (F.col("took_s") >= F.col("deadline_s")), "DEADLINE_EXCEEDED"), F.when(~F.col("head_matches_after"), "PR_HEAD_SUPERSEDED"), F.when(moved, "ENVIRONMENT_CHANGED"))
    between = F.transform(F.coalesce("mid", F.array().cast("array<struct<at:struct<at:bigint,nth:int>,reason:string>>")), lambda x: x["reason"])
    codes = F.array_distinct(F.array_compact(F.concat(head, between, tail)))
    verdict = F.when(F.coalesce("calibrated", F.lit(False)), "BLOCK").when(F.size(codes) > 0, "WARN").otherwise("PASS")
    return j.select("pr", verdict.alias("verdict"), F.array_join(codes, ",").alias("reasons"), F.coalesce("truncated", F.lit(False)).alias("truncated"))


def guarded(proposals: DataFrame, budget: int) -> DataFrame:
    """SCHEMA, CITATION, URN, then BUDGET: the first that fails; the budget is for accepted ones before, by order."""
    first = F.when(~F.col("has_schema"), "SCHEMA").when(~F.col("has_citation"), "CITATION").when(~F.col("urn_known"), "URN")
    r = proposals.withColumn("failed", first)
    r = numbered(r.withColumn("good", F.col("failed").isNull().cast("bigint")), ["seq"], by=["repository"], value="good", name="upto").withColumn("before", F.col("upto") - F.col("good"))
    return r.select("repository", "seq", F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("before") >= budget, "BUDGET").otherwise("ACCEPTED").alias("result"))


def hourly(events: DataFrame, at: str, now) -> DataFrame:
    """Events in each of the last 24 hours before now, zero-filled."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hours_ago"))
    # by microseconds: seconds would put what came just after a full hour into the one before it
    age = F.floor((F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 3_600_000_000).cast("int")
    counts = events.select(age.alias("hours_ago")).where(F.col("hours_ago").between(0, 23)).groupBy("hours_ago").agg(F.count("*").alias("n"))
    return hours.join(counts, "hours_ago", "left").select("hours_ago", F.coalesce("n", F.lit(0)).alias("n"))


def matrix(calls: DataFrame) -> DataFrame:
    """Operations of each caller and callee."""
    return calls.groupBy("caller", "callee").agg(F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"), F.count("*").alias("n"))
