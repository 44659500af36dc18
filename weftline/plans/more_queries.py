"""Queries on Spring facts, publication and nightly work."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import consolidate, graph, interactions, java_facts, operations, publication, queues, validation, workflows
from weftline.operators.checkpoints import shared_folder
from weftline.operators.ordered import shares
from weftline.plans.registry import query
from weftline.sources import inputs, objects
from weftline.sources.inputs import SQL_MESSAGES, SQL_OBSERVATIONS, table

#: Fields of each part's entity: what it names its column, if it does, and what its schema has. All entities share a superclass with an id.
FIELDS = [("lastName", None), ("cityName", "city"), ("ghost", "nope"), ("pets", None)]
COLUMNS = ("id", "last_name", "city")


def _grounded(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey").cast("string")
    entity, own = F.concat(F.lit("E"), k), F.concat(F.lit("t"), k)
    field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(e).cast("string").alias("explicit")) for f, e in FIELDS])).alias("f")
    fields = p.select(entity.alias("owner"), field).select("owner", "f.*").unionByName(spark.createDataFrame([("Base", "id", None)], "owner string, field string, explicit string"))
    supers = p.select(entity.alias("entity"), F.explode(F.array(entity, F.lit("Base"))).alias("owner"), own.alias("table"))
    return java_facts.entity_columns(fields, supers, p.select(own.alias("table"), F.explode(F.array(*map(F.lit, COLUMNS))).alias("column")))


@query("""SELECT 'E' || p_partkey AS entity, 't' || p_partkey AS "table", field, "column", code FROM part, (VALUES ('lastName', 'last_name', NULL), ('cityName', 'city', NULL), ('ghost', 'nope', 'unmapped-entity-column'), ('id', 'id', NULL)) t(field, "column", code)""")
def s9b_entity_columns(spark, d):
    return _grounded(spark, d)


@query("""SELECT 'E' || p_partkey AS entity, method, field, "column", code FROM part, (VALUES ('findByLastNameAndCityName', 'lastName', 'last_name', NULL), ('findByLastNameAndCityName', 'cityName', 'city', NULL), ('countByNothing', 'nothing', NULL, 'unresolved-query-property'), ('findById', 'id', 'id', NULL)) t(method, field, "column", code)""")
def s9c_query_columns(spark, d):
    named = F.explode(F.array(*map(F.lit, ("findByLastNameAndCityName", "countByNothing", "findById")))).alias("method")
    return java_facts.query_columns(table(spark, d, "part").select(F.concat(F.lit("E"), F.col("p_partkey").cast("string")).alias("entity"), named), _grounded(spark, d))


#: Invocations on repositories; what each must come to is stated by the call alone.
CALLS = """calls AS (SELECT o_orderkey AS line, 'svc' || (o_custkey % 7) AS caller, CASE o_orderkey % 6 WHEN 0 THEN 'owners' WHEN 1 THEN 'vets' WHEN 2 THEN 'twice' WHEN 3 THEN 'gone' WHEN 4 THEN 'unmapped' ELSE 'marker' END AS receiver,
  ['findById/1', 'save/1', 'saveAndFlush/1', 'flush/0', 'findAll/2', 'findByCity/1', 'byQuery/1', 'native/1', 'other/1', 'moved/0', 'twice/1', 'wrap/1', 'deleteAllInBatch/0', 'custom/0', 'broken/0'][o_orderkey % 15 + 1] AS called FROM orders),
compiled AS (SELECT caller, split_part(called, '/', 1) AS method, line, CASE WHEN code IS NULL THEN CASE WHEN called = 'byQuery/1' THEN 'visits' WHEN receiver = 'vets' THEN 'vets' ELSE 'owners' END END AS "table",
  CASE WHEN code IS NULL THEN CASE WHEN called IN ('save/1', 'saveAndFlush/1', 'native/1', 'deleteAllInBatch/0') THEN 'WRITES' ELSE 'READS' END END AS edge_type, code
  FROM (SELECT *, CASE WHEN receiver = 'gone' THEN 'unknown-repository' WHEN receiver = 'twice' THEN 'ambiguous-repository' WHEN receiver = 'unmapped' THEN 'unmapped-entity'
    WHEN called IN ('findAll/2', 'custom/0') THEN 'unsupported-operation' WHEN called = 'flush/0' AND receiver <> 'marker' THEN 'ignored-repository-operation' WHEN called IN ('findById/1', 'save/1', 'saveAndFlush/1', 'flush/0', 'deleteAllInBatch/0') AND receiver = 'marker' THEN 'unsupported-operation'
    WHEN receiver <> 'owners' AND called IN ('findByCity/1', 'byQuery/1', 'native/1', 'other/1', 'moved/0', 'twice/1', 'wrap/1', 'broken/0') THEN 'unsupported-operation'
    WHEN called = 'other/1' THEN 'query-table-conflict' WHEN called = 'moved/0' THEN 'query-table-conflict' WHEN called = 'twice/1' THEN 'ambiguous-operation-overload' WHEN called = 'broken/0' THEN 'unsupported-query' END AS code FROM calls))"""
METHODS = [
    ("owners", "findByCity", 1, "abstract-interface", ["String"], None, False, None, None),
    ("owners", "byQuery", 1, "abstract-interface", ["String"], "select v from Visit v join fetch v.pet where v.city = ?1", False, None, None),
    ("owners", "native", 1, "abstract-interface", ["int"], "UPDATE owners SET city = 'from x' WHERE id = ?1", True, None, None),
    ("owners", "other", 1, "abstract-interface", ["int"], "delete from vets where id = ?1", True, None, None),
    ("owners", "moved", 0, "abstract-interface", [], "select g from Ghost g", False, None, None),
    ("owners", "broken", 0, "abstract-interface", [], "select o from Owner o where o.id in (select 1)", False, None, None),
    ("owners", "twice", 1, "abstract-interface", ["int"], None, False, None, None),
    ("owners", "twice", 1, "abstract-interface", ["String"], None, False, None, None),
    ("owners", "wrap", 1, "default", ["String"], None, False, "findByCity", 1),
]


def _compiled(spark, d):
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    called = ("findById/1", "save/1", "saveAndFlush/1", "flush/0", "findAll/2", "findByCity/1", "byQuery/1", "native/1", "other/1", "moved/0", "twice/1", "wrap/1", "deleteAllInBatch/0", "custom/0", "broken/0")
    parts = F.split(pick(called, 15), "/")
    calls = o.select(F.concat(F.lit("svc"), (F.col("o_custkey") % 7).cast("string")).alias("caller"), pick(("owners", "vets", "twice", "gone", "unmapped", "marker"), 6).alias("receiver"), parts[0].alias("method"), parts[1].cast("int").alias("arity"), F.lit("A.java").alias("path"), k.alias("line"))
    repositories = [("owners", "Owner", "Integer", "JPA"), ("vets", "Vet", "Integer", "JPA"), ("twice", "Owner", "Integer", "JPA"), ("twice", "Vet", "Integer", "JPA"), ("unmapped", "Pet", "Integer", "JPA"), ("marker", "Owner", "Integer", "MARKER")]
    tables = spark.createDataFrame([("Owner", "owners"), ("Vet", "vets"), ("Visit", "visits")], "entity string, table string")
    methods = spark.createDataFrame(METHODS, "receiver string, method string, arity int, mode string, parameter_types array<string>, query string, native boolean, delegates_to string, delegate_arity int")
    return java_facts.compile_edges(calls, spark.createDataFrame(repositories, "receiver string, entity string, id_type string, base string"), tables, methods)


@query("SELECT * FROM compiled", CALLS)
def s10_j17_compile(spark, d):
    return _compiled(spark, d).drop("path")


@query("SELECT caller, \"table\", edge_type, array_to_string(list_sort(list(DISTINCT 'A.java:' || line)), ',') AS citations FROM compiled WHERE code IS NULL GROUP BY ALL", CALLS)
def s10c_collapse(spark, d):
    return java_facts.collapse(_compiled(spark, d).where("code IS NULL"))


@query("SELECT count(*) FILTER (edge_type = 'READS' AND code IS NULL) AS reads, count(*) FILTER (edge_type = 'WRITES' AND code IS NULL) AS writes, count(*) FILTER (code IS NOT NULL) AS residue FROM compiled", CALLS)
def a26_analysis_counts(spark, d):
    ok = F.col("code").isNull()
    return _compiled(spark, d).agg(F.count_if((F.col("edge_type") == "READS") & ok).alias("reads"), F.count_if((F.col("edge_type") == "WRITES") & ok).alias("writes"), F.count_if(~ok).alias("residue"))


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def s10d_unique_facts(spark, d):
    return java_facts.unique_facts(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("""SELECT DISTINCT 't' || l_suppkey AS "table", 'last_name' AS "column" FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def j10_witnessed(spark, d):
    """Edges of each supplier's table, of which those of a column that some line observed (by another spelling) are witnessed."""
    t = lambda k: F.concat(F.lit("t"), F.col(k).cast("string"))
    edges = table(spark, d, "supplier").select(t("s_suppkey").alias("table"), F.lit("READ").alias("operation"), F.explode(F.array(F.lit("last_name"), F.lit("city"))).alias("column"))
    flag = F.col("l_returnflag")
    fields = F.when(flag == "A", F.array(F.lit("lastName"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    seen = table(spark, d, "lineitem").select(t("l_suppkey").alias("table"), F.when(flag == "N", "WRITE").otherwise("READ").alias("operation"), fields.alias("fields")).distinct()
    return java_facts.witnessed(edges, seen).select("table", "column")


@query("""SELECT file, row_number() OVER (ORDER BY root, mid, low) AS nth FROM (SELECT 'r' || r_regionkey AS file, 'r' || r_regionkey AS root, '' AS mid, '' AS low FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, lpad(n_nationkey::VARCHAR, 6, '0'), '' FROM nation UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, lpad(n_nationkey::VARCHAR, 6, '0'), lpad(s_suppkey::VARCHAR, 6, '0') FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def s8b_t11_changelog_order(spark, d):
    """Changelogs of regions include those of their nations, these those of their suppliers, who also include their region's: a cycle."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n, sup = table(spark, d, "nation"), table(spark, d, "supplier")
    includes = n.select(name("r", "n_regionkey").alias("file"), name("n", "n_nationkey").alias("child"), F.col("n_nationkey").alias("position")).unionByName(sup.select(name("n", "s_nationkey").alias("file"), name("s", "s_suppkey").alias("child"), F.col("s_suppkey").alias("position")))
    back = sup.select(name("s", "s_suppkey").alias("file"), name("n", "s_nationkey").alias("child"), F.lit(1).alias("position"))
    files = table(spark, d, "region").select(name("r", "r_regionkey").alias("file")).unionByName(n.select(name("n", "n_nationkey").alias("file"))).unionByName(sup.select(name("s", "s_suppkey").alias("file")))
    return java_facts.changelog_order(includes.unionByName(back), files).select("file", "nth")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS before, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END END AS after,
    CASE WHEN c_custkey % 3 = 0 THEN 'added' WHEN c_custkey % 2 = 1 THEN 'removed' ELSE 'bandChanged' END AS kind FROM customer
    WHERE (c_custkey % 3 <> 0 OR c_custkey % 2 = 0) AND NOT (c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0)""")
def u10_j15_diff(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("band"))
    new = cu.where(F.col("c_custkey") % 2 == 0).withColumn("band", F.when(F.col("c_custkey") % 5 == 0, "X").otherwise(F.col("band")))
    return publication.diff(cu.where(F.col("c_custkey") % 3 != 0), new, "c_custkey", "band")


@query("SELECT 1 AS active, 2 AS prior, 3 AS token, (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS n")
def u6_u8_publish_rollback(spark, d):
    """Two versions are published, then the first is named again; an old token is refused."""
    store = publication.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    first = store.publish("staging", 1, p.where("p_partkey % 2 = 0"), store.reserve("staging"))
    token = store.reserve("staging")
    store.publish("staging", 2, p, token)
    last = store.reserve("staging")
    try:
        store.publish("staging", 2, p, token)
        raise AssertionError("an old token activated")
    except publication.Refused:
        pass
    store.rollback("staging", 1, last, first)
    at = store.pointer("staging")
    return store.read("staging").agg(F.count("*").alias("n")).select(F.lit(at["active"]).alias("active"), F.lit(at["prior"]).alias("prior"), F.lit(at["token"]).alias("token"), "n")


@query("SELECT 'p' || p_partkey AS edge_key, p_name AS payload, version FROM part, (VALUES (6), (7)) t(version)")
def u2_copied(spark, d):
    """A namespace is written, copied under a new version, and both are read."""
    store = objects.Namespaces(spark, f"{shared_folder(spark)}/copied-{uuid.uuid4().hex}")
    store.write("staging", 6, table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("edge_key"), F.col("p_name").alias("payload")))
    store.copy("staging", 6, 7)
    return store.read("staging", 6).withColumn("version", F.lit(6)).unionByName(store.read("staging", 7).withColumn("version", F.lit(7))).drop("batch")


@query("""SELECT o_orderkey AS night, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'ARCHIVE_RECONCILIATION_DRIFT' END, CASE WHEN o_orderkey % 7 = 0 THEN 'PUBLISHED_SAMPLE_DRIFT' END, CASE WHEN o_orderkey % 11 = 0 THEN 'PROJECTION_CHECKSUM_DRIFT' END,
    CASE WHEN o_orderstatus = 'P' THEN 'ENVIRONMENT_CHANGED' END, CASE WHEN o_orderkey % 13 = 0 THEN 'CACHE_DRAIN_INCOMPLETE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'AUTOPUBLISH_AUDIT_DRIFT' END) AS alerts,
    CASE WHEN o_orderkey % 7 = 0 THEN 'PROPOSALS_RAISED' ELSE 'RECONCILED' END AS terminal FROM orders""")
def c12_nightly_alerts(spark, d):
    k = F.col("o_orderkey")
    checks = table(spark, d, "orders").select(k.alias("night"), (k % 5 == 0).cast("int").alias("archive_drift"), (k % 7 == 0).cast("int").alias("sample_drift"), (k % 11 != 0).alias("checksum_ok"), (F.col("o_orderstatus") == "P").alias("env_changed"), (k % 13 == 0).alias("drain_truncated"), (k % 3 == 0).cast("int").alias("unsafe"))
    return publication.alerts(checks)


#: The control tables of an environment (customer): its orders and their lines as commands, messages, manifests and so on.
CONTROL = """o AS (SELECT *, o_custkey AS env, TIMESTAMP '1998-08-02' AS now FROM orders),
queued AS (SELECT env, o_orderdate AS since FROM o WHERE o_orderstatus = 'P' UNION ALL SELECT env, o_orderdate FROM o WHERE o_orderkey % 8 = 1 AND o_orderkey % 70 <> 3 UNION ALL SELECT env, o_orderdate FROM o WHERE o_orderpriority = '1-URGENT'),
part AS (SELECT env, any_value(now) AS now, count(*) FILTER (o_orderkey % 50 = 7) + count(*) FILTER (o_orderkey % 60 = 7 AND NOT (o_orderkey % 70 = 3)) AS retries, count(*) FILTER (o_orderkey % 70 = 3) + count(*) FILTER (o_orderkey % 80 = 5 AND o_orderstatus <> 'P') AS dead, count(*) FILTER (o_orderkey % 90 = 9) AS steals,
  count(*) AS manifests, count(*) FILTER (o_orderkey % 25 = 0) AS incomplete, count(*) FILTER (o_orderkey % 2 = 1) AS joined, max(o_orderdate) FILTER (o_orderkey % 3 = 0) AS base_at, arg_max(o_orderkey % 25 <> 0, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 3 = 0) AS base_ok,
  min(o_orderdate) FILTER (o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0) AS approval, min(o_orderdate) FILTER (o_orderkey % 40 = 2) AS publishing, arg_max(o_orderkey % 120, (o_orderdate, o_orderkey)) FILTER (o_orderkey % 40 <> 2 AND o_orderkey % 4 = 0) AS lag, count(*) * 2 AS tracked, count(*) FILTER (o_orderkey % 30 = 4) AS lost FROM o GROUP BY env),
observed AS (SELECT p.*, q.depth, q.oldest FROM part p LEFT JOIN (SELECT env, count(*) AS depth, min(since) AS oldest FROM queued GROUP BY env) q ON q.env = p.env)"""


def _control(spark, d):
    o, k = table(spark, d, "orders").withColumn("env", F.col("o_custkey")).withColumn("at", F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    commands = o.select("env", F.when(F.col("o_orderstatus") == "P", "QUEUED").when(k % 80 == 5, "FAILED_TERMINAL").otherwise("COMPLETE").alias("status"), F.when(k % 50 == 7, 2).otherwise(1).alias("attempt"), F.col("at").alias("created_at"))
    messages = o.select("env", F.when(k % 70 == 3, "DEAD").when(k % 8 == 1, "AVAILABLE").otherwise("ACKED").alias("status"), F.when(k % 60 == 7, 2).otherwise(1).alias("attempts"), F.col("at").alias("published_at"))
    outbox = o.select("env", F.when(F.col("o_orderpriority") == "1-URGENT", "PENDING").otherwise("DELIVERED").alias("status"), F.col("at").alias("created_at"))
    coverage = o.select("env", F.when(k % 3 == 0, "BASELINE").otherwise("INCREMENTAL").alias("workflow"), F.when(k % 25 == 0, "INCOMPLETE").otherwise("COMPLETE").alias("state"), F.when(k % 2 == 1, "VALIDATED").otherwise("NOT_RECORDED").alias("runtime_status"), F.col("at").alias("updated_at"), k.alias("manifest_id"))
    proposals = o.select("env", F.when((F.col("o_orderpriority") == "5-LOW") & (k % 5 == 0), "IN_REVIEW").otherwise("FINALIZED").alias("state"), F.col("at").alias("created_at"))
    publications = o.select("env", k.alias("operation_id"), F.when(k % 40 == 2, F.lit(None)).when(k % 4 == 0, "SUCCEEDED").otherwise("FAILED").alias("outcome"), F.timestamp_micros(F.unix_micros("at") - k % 120 * 1_000_000).alias("created_at"), F.col("at").alias("terminal_at"))
    # those under way began at their own time
    publications = publications.withColumn("created_at", F.when(F.col("outcome").isNull(), F.col("terminal_at")).otherwise(F.col("created_at")))
    correlated = [o.select("env", F.when(k % 30 == 4, "").otherwise("c").alias("correlation_id")), o.select("env", F.lit("c").alias("correlation_id"))]
    return operations.observations("env", commands, o.select("env", F.when(k % 90 == 9, 2).otherwise(1).alias("lease_epoch")), messages, outbox, coverage, proposals, publications, correlated)


@query("SELECT env, coalesce(depth, 0) AS queue_depth, oldest AS oldest_queued, retries, dead AS dead_letters, steals AS lease_steals, manifests, incomplete, joined, approval AS oldest_approval, publishing AS publishing_since, tracked, lost AS uncorrelated FROM observed", CONTROL)
def a16_operational_observations(spark, d):
    return _control(spark, d).drop("baseline", "published")


@query("""SELECT *, CASE WHEN publication = 'OUT_OF_SYNC' THEN 'OUT_OF_SYNC' WHEN list_has_any([queue, coverage, runtime, baseline, review, publication, watermark, correlation], ['DEGRADED', 'INCOMPLETE', 'STALE']) THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall FROM (
    SELECT env, CASE WHEN retries > 0 OR dead > 0 OR steals > 0 OR epoch(now) - epoch(oldest) > 60 THEN 'DEGRADED' ELSE 'HEALTHY' END AS queue, CASE WHEN incomplete > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS coverage, CASE WHEN joined = manifests THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS runtime,
    CASE WHEN base_at IS NULL THEN 'NOT_AVAILABLE' WHEN NOT base_ok THEN 'INCOMPLETE' WHEN epoch(now) - epoch(base_at) > 86400 THEN 'STALE' ELSE 'CURRENT' END AS baseline, CASE WHEN epoch(now) - epoch(approval) > 300 THEN 'DEGRADED' ELSE 'HEALTHY' END AS review,
    CASE WHEN env % 10 = 0 THEN 'OUT_OF_SYNC' WHEN l IS NULL THEN 'NOT_AVAILABLE' WHEN l > 60 THEN 'DEGRADED' ELSE 'HEALTHY' END AS publication, CASE WHEN env % 3 = 0 THEN 'NOT_AVAILABLE' WHEN env % 3 = 1 THEN 'CURRENT' ELSE 'STALE' END AS watermark,
    CASE WHEN lost > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS correlation, l AS publish_lag_s, joined / manifests AS runtime_rate
    FROM (SELECT *, CASE WHEN publishing IS NOT NULL THEN greatest(0, epoch(now) - epoch(publishing))::BIGINT ELSE lag END AS l FROM observed))""", CONTROL)  # fmt: skip
def c9_resilience(spark, d):
    now, k = F.lit("1998-08-02").cast("timestamp"), F.col("c_custkey")
    projection = table(spark, d, "customer").select(k.alias("env"), F.when(k % 10 == 0, "OUT_OF_SYNC").otherwise("IN_SYNC").alias("sync"), F.when(k % 3 == 1, now).when(k % 3 == 2, F.timestamp_micros(F.unix_micros(now) - 301_000_000)).alias("watermark_at"))
    return operations.resilience(_control(spark, d), projection, "env", now)


@query("SELECT user_id AS key, CASE WHEN user_id % 4 = 0 THEN 'MISSING' WHEN user_id % 4 = 1 THEN 'SUPERSEDED' WHEN user_id % 4 = 2 THEN 'DUPLICATE' ELSE 'INVALIDATED' END AS disposition FROM events GROUP BY user_id")
def u13_cache_disposition(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("key")).distinct()
    cache = users.where(F.col("key") % 4 != 0).select("key", F.when(F.col("key") % 4 == 1, 9).otherwise(1).alias("version"), (F.col("key") % 4 == 2).alias("invalid"))
    return publication.cache_disposition(users.withColumn("version", F.lit(3)), cache)


@query("SELECT lane, sequence, true AS truncated FROM messages WHERE status = 'AVAILABLE' ORDER BY lane, sequence LIMIT 10", SQL_MESSAGES)
def l6_l9_drained(spark, d):
    some, more = publication.drained(inputs.messages(spark, d).where(F.col("status") == "AVAILABLE").select("lane", "sequence"), ["lane", "sequence"], 10)
    return some.withColumn("truncated", F.lit(more))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND NOT (p_partkey % 3 = 0 AND p_partkey % 5 <> 0)")
def v10_audit(spark, d):
    p = table(spark, d, "part")
    edges = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "AUTO_PUBLISHED").otherwise("PUBLISHED").alias("status"), F.lit("COMPLETE").alias("coverage"), (F.col("p_partkey") % 3 == 0).alias("static_exact"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("LLM"))).otherwise(F.array(F.lit("SCA"), F.lit("LLM"))).alias("mechanisms"))
    return publication.unsafe_auto_publish(edges).select("p_partkey")


@query("SELECT session_id, array_to_string(list_sort(list(DISTINCT dataset) FILTER (dataset NOT IN ('view', 'click'))), ',') AS outside FROM observations GROUP BY session_id", SQL_OBSERVATIONS)
def x4_outside_scope(spark, d):
    seen = inputs.observations(spark, d).groupBy("session_id").agg(F.collect_set("dataset").alias("seen"))
    return seen.select("session_id", F.nullif(F.array_join(F.array_sort(F.array_except("seen", F.array(F.lit("view"), F.lit("click")))), ","), F.lit("")).alias("outside"))


@query("SELECT DISTINCT CASE WHEN event_id % 7 = 0 THEN 'no JSON: ' || event_type ELSE '{\"a\":{\"k\":' || CAST(props::JSON->>'k' AS INT) || ',\"n\":[1,2]},\"t\":\"' || event_type || '\"}' END AS document FROM events")
def x8_duplicate_documents(spark, d):
    """Documents that differ in the order of their keys and in white space are one."""
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    one = F.concat(F.lit('{"t":"'), t, F.lit('","a":{"n":[1,2],"k":'), k, F.lit("}}"))
    other = F.concat(F.lit('{ "a": {"k":  '), k, F.lit(', "n": [ 1, 2 ]},\n "t": "'), t, F.lit('" }'))
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no JSON: "), t)).when(F.col("event_id") % 2 == 0, one).otherwise(other)
    return queues.distinct_documents(table(spark, d, "events").select(text.alias("document")), "document")


@query("SELECT 'message' AS kind, count(*) AS n FROM messages UNION ALL SELECT 'observation', count(*) FROM observations", SQL_MESSAGES, SQL_OBSERVATIONS)
def x2_union_all(spark, d):
    m = inputs.messages(spark, d).select(F.lit("message").alias("kind"))
    return m.unionByName(inputs.observations(spark, d).select(F.lit("observation").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT run_id, arg_min(proposal, (state <> 'IN_REVIEW', proposal)) AS proposal FROM (SELECT 'r' || c_custkey AS run_id, 'c' || c_nationkey AS correlation FROM customer) r JOIN (
    SELECT o_orderkey AS proposal, 'r' || o_custkey AS command, CASE WHEN o_orderkey % 100 = 0 THEN 'c' || (o_orderkey // 100 % 25) ELSE 'unavailable' END AS correlation, CASE WHEN o_orderstatus = 'O' THEN 'IN_REVIEW' ELSE 'FINALIZED' END AS state FROM orders) p
    ON p.command = r.run_id OR (p.correlation = r.correlation AND r.correlation <> 'unavailable') GROUP BY run_id""")  # fmt: skip
def j14_run_proposal(spark, d):
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    k = F.col("o_orderkey")
    runs = table(spark, d, "customer").select(text("r", F.col("c_custkey")).alias("run_id"), text("c", F.col("c_nationkey")).alias("correlation_id"))
    proposals = table(spark, d, "orders").select(k.alias("proposal"), text("r", F.col("o_custkey")).alias("command_id"), F.when(k % 100 == 0, text("c", F.floor(k / 100) % 25)).otherwise("unavailable").alias("correlation_id"), F.when(F.col("o_orderstatus") == "O", "IN_REVIEW").otherwise("FINALIZED").alias("state"))
    return operations.run_proposals(runs, proposals)


@query("""SELECT s_nationkey AS system, max(s_suppkey) AS document, CASE max(s_suppkey) % 3 WHEN 0 THEN 'COLLECTED' WHEN 1 THEN 'FAILED' ELSE 'RUNNING' END AS status, max(s_suppkey) FILTER (s_suppkey % 3 = 0) AS collected FROM supplier GROUP BY s_nationkey""")
def u14_u15_latest_document(spark, d):
    """Each system's last document and its status, and the last that was collected."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("system"), k.alias("document"), k.alias("version"), F.when(k % 3 == 0, "COLLECTED").when(k % 3 == 1, "FAILED").otherwise("RUNNING").alias("status"))
    good = rows.where("status = 'COLLECTED'").groupBy("system").agg(F.max_by("document", "version").alias("collected"))
    return consolidate.latest(rows, "system", "version").select("system", "document", "status").join(good, "system", "left")


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def v9_identity_conflicts(spark, d):
    return validation.identity_conflicts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT sequence AS o_orderkey, CASE lane WHEN 'interactive' THEN 0 WHEN 'events' THEN 1 ELSE 2 END AS lane_rank FROM messages WHERE status = 'AVAILABLE' AND available_at <= TIMESTAMP '1999-01-01' ORDER BY lane_rank, o_orderkey LIMIT 30", SQL_MESSAGES)
def l4_c8_next_claims(spark, d):
    m = queues.claimable(inputs.messages(spark, d).withColumn("group_id", F.col("sequence")), F.lit("1999-01-01").cast("timestamp"))
    rank = F.when(F.col("lane") == "interactive", 0).when(F.col("lane") == "events", 1).otherwise(2)
    return m.select(F.col("sequence").alias("o_orderkey"), rank.alias("lane_rank")).orderBy("lane_rank", "o_orderkey").limit(30)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")
def l2_l7_newest_runs(spark, d):
    return operations.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 6)


@query("SELECT p_partkey FROM part WHERE (p_size % 2 = 0 OR p_size % 5 = 0) AND p_size % 3 = 0")
def x5_written_and_removed(spark, d):
    p = table(spark, d, "part")
    pick = lambda n: p.where(F.col("p_size") % n == 0)
    return validation.written_and_removed(pick(2), pick(5), pick(3), "p_partkey")


@query("""SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'IDENTITY' WHEN o_orderkey % 13 = 0 THEN 'ORDER' WHEN o_orderkey % 7 = 0 THEN 'EVENT_TYPE' WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'OUTCOME' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'P' THEN 'ROLLBACK_OUTCOME'
    WHEN o_orderkey % 17 = 0 AND o_orderstatus <> 'P' THEN 'ARTIFACT_DIGEST' WHEN o_orderkey % 19 = 0 THEN 'OCCURRED_AT' END AS error FROM orders""")  # fmt: skip
def v13_deployment_events(spark, d):
    k = F.col("o_orderkey")
    events = table(spark, d, "orders").select(
        k.alias("event_id"), F.lit("ci").alias("provider"), F.when(k % 11 == 0, "").otherwise("sys").alias("system"), F.lit("staging").alias("environment"), F.lit("c").alias("correlation_id"), F.lit("a").alias("audit_ref"),
        F.when(k % 13 == 0, 0).otherwise(1).alias("provider_sequence"), F.lit(1).alias("attempt"), F.when(k % 7 == 0, "PUSH").when(k % 3 == 0, "ROLLBACK").otherwise("DEPLOYMENT").alias("event_type"),
        F.when(F.col("o_orderstatus") == "P", "FAILED").when((F.col("o_orderstatus") == "O") & (k % 5 == 0), "MAYBE").otherwise("SUCCEEDED").alias("outcome"), F.when(k % 17 != 0, "sha256:x").alias("artifact_digest"),
        F.when(k % 19 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("occurred_at"),
    )
    return validation.deployment_event_error(events)


@query("""SELECT p_partkey AS profile_id, CASE WHEN p_size % 11 = 0 THEN 'MECHANISM' WHEN p_size % 7 = 0 THEN 'PROFILE_VERSION' WHEN p_size % 5 = 0 THEN 'DATASETS' WHEN p_size % 13 = 0 THEN 'GRANULARITY' WHEN p_size % 3 = 0 THEN 'BUFFER_BUDGET' WHEN p_partkey % 4 = 0 THEN 'OVERHEAD_BUDGET' WHEN p_partkey % 9 = 0 THEN 'CANARY' END AS error FROM part""")
def v14_profiles(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    words = lambda *w: F.array(*map(F.lit, w))
    named = {"schema_version": "1.0.0", "environment_class": "NON_PRODUCTION", "identity_strategy": "DIGEST", "owner": "o", "workload": "w", "repo": "r", "environment": "staging", "package_digest": "sha256:" + "0" * 64, "install_mode": "SIDECAR", "criticality": "OPTIONAL"}
    profiles = table(spark, d, "part").select(
        k.alias("profile_id"), *[F.lit(v).alias(c) for c, v in named.items()], F.when(n % 11 == 0, "EBPF").otherwise("OTEL").alias("mechanism"), F.when(n % 7 == 0, "1.0").otherwise("1.0.0").alias("profile_version"),
        F.struct(F.lit("spring").alias("name"), F.lit("3.x").alias("version_range")).alias("framework"), F.when(n % 5 == 0, words("a", "a")).otherwise(words("a", "b")).alias("datasets"), F.array().cast("array<string>").alias("attributes"), F.array().cast("array<string>").alias("parsers"),
        F.when(n % 13 == 0, words("ROW")).otherwise(words("ELEMENT", "DATASET")).alias("granularities"),
        F.struct(F.when(n % 3 == 0, 0).otherwise(1).alias("max_records"), F.lit(1).alias("max_bytes"), F.lit(1).alias("drain_timeout_s"), F.lit(0).alias("enqueue_timeout_ms"), F.lit(0).alias("max_retries")).alias("buffer"),
        F.struct(F.when(k % 4 == 0, 101.0).otherwise(5.0).alias("cpu_percent"), F.lit(1).alias("memory_bytes"), F.lit(0.0).alias("p95_ms")).alias("overhead"), F.when(k % 9 == 0, 101).otherwise(10).alias("canary"),
    )
    return validation.profile_error(profiles)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 3 THEN 'SOURCES' WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'URN' WHEN l_linenumber = 3 THEN 'EDGE_TYPE' WHEN l_linenumber = 4 THEN 'MECHANISM' WHEN l_tax = 0 THEN 'FLAGS' WHEN l_linenumber = 5 THEN 'RUNTIME_SCOPE' WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'CITATION' END AS error FROM lineitem""")
def v6_assertions(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row"), F.lit("p").alias("provenance_id"), F.when(F.col("l_quantity") < 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("urn:ldp:e:p:s:d#x"))).alias("sources"),
        F.when((F.col("l_returnflag") == "R") & (line == 2), "urn:ldp:e:p").otherwise("urn:ldp:e:p:s:d").alias("target"), F.when(line == 3, "COPIES").otherwise("READS").alias("edge_type"), F.when(line == 4, "GUESS").when(line == 5, "RUNTIME").otherwise("SCA").alias("mechanism"),
        F.lit(True).alias("exact"), F.when(F.col("l_tax") != 0, F.lit(True)).alias("session_complete"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("transform"), F.when((F.col("l_linestatus") == "F") & (line == 1), 0).otherwise(7).alias("line"),
    )
    return validation.assertion_error(rows, "row").select("row.*", "error")


@query("""SELECT o_orderkey AS manifest_id, concat_ws(',', CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 4 = 0 THEN 'UNACCOUNTED' END, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'UNFINISHED' END) AS errors FROM orders""")
def v2_v3_coverage(spark, d):
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    some = lambda *w: F.array(*map(F.lit, w))
    manifests = table(spark, d, "orders").select(
        k.alias("manifest_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PLANNED").otherwise("INCOMPLETE").alias("state"), F.when(k % 4 == 0, some("a", "b", "c", "c")).otherwise(some("a", "b", "c")).alias("expectedScope"),
        F.when(k % 3 == 0, some("a")).otherwise(some("a", "c")).alias("completedScope"), some("b").alias("reusedScope"), none.alias("skippedScope"), F.when(k % 3 == 0, some("c")).otherwise(none).alias("unsupportedScope"), none.alias("quarantinedScope"), none.alias("failedScope"),
    )
    return validation.coverage_errors(manifests).select("manifest_id", F.array_join("errors", ",").alias("errors"))


#: Of each workflow its kind, prefix, timeout, state after an error, and its stages' timeouts.
TIMES = """w(kind, prefix, most, bad, t) AS (VALUES ('BASELINE', 'B', 43200, 'FAILED_REDRIVABLE', [30, 120, 300, 120, 7200, 900, 3600, 1800, 300, 600]), ('INCREMENTAL', 'I', 1800, 'FAILED_REDRIVABLE', [30, 120, 60, 180, 600, 180, 300, 60, 120, 150]),
  ('PR_GATE', 'P', 120, 'WARN', [5, 30, 5, 35, 15, 10, 5, 5]), ('DEPLOYMENT', 'D', 600, 'FAILED_TERMINAL', [30, 30, 60, 120, 240, 120]), ('NIGHTLY', 'N', 14400, 'FAILED_REDRIVABLE', [1800, 7200, 1800, 1800, 900, 300])),
timed AS (SELECT kind, prefix, most, bad, i, coalesce(list_sum(t[1 : i - 1]), 0) AS begins FROM w, range(1, 11) r(i) WHERE i <= len(t)),
runs AS (SELECT o_orderkey AS run_id, ['BASELINE', 'INCREMENTAL', 'PR_GATE', 'DEPLOYMENT', 'NIGHTLY'][o_orderkey % 5 + 1] AS kind, o_orderkey * 37 % 16000 // (CASE o_orderkey % 5 WHEN 2 THEN 100 WHEN 1 THEN 8 WHEN 3 THEN 20 ELSE 1 END) AS elapsed FROM orders)"""


@query("""SELECT run_id, r.kind, CASE WHEN elapsed <= any_value(most) THEN any_value(prefix) || max(i) END AS stage, CASE WHEN elapsed <= any_value(most) THEN CASE WHEN any_value(prefix) || max(i) IN ('I2', 'P4', 'P6') THEN 1 ELSE 3 END END AS max_attempts,
    CASE WHEN elapsed > any_value(most) THEN any_value(bad) ELSE 'RUNNING' END AS state FROM runs r JOIN timed t ON t.kind = r.kind AND (begins <= elapsed OR i = 1) GROUP BY run_id, r.kind, elapsed""", TIMES)
def c16_workflows(spark, d):
    """The stage that each order, as a run, should have come to."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("BASELINE", "INCREMENTAL", "PR_GATE", "DEPLOYMENT", "NIGHTLY"))), (k % 5 + 1).cast("int"))
    part = F.when(k % 5 == 2, 100).when(k % 5 == 1, 8).when(k % 5 == 3, 20).otherwise(1)
    return workflows.latest_stage(table(spark, d, "orders").select(k.alias("run_id"), kind.alias("kind"), F.floor(k * 37 % 16000 / part).alias("elapsed_s")))


#: Each customer is a workflow, its orders are the stages, by key.
STAGED = "staged AS (SELECT 'w' || o_custkey AS kind, o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query("""SELECT kind, 's' || o AS stage, 'ATTEMPTS' AS error FROM staged WHERE o % 7 = 0 UNION ALL SELECT kind, 's' || o, e FROM staged, (VALUES ('UNDECLARED_TERMINAL'), ('ERROR_WITHOUT_TERMINAL')) t(e) WHERE o % 11 = 0
    UNION ALL SELECT kind, 's' || o, 'STAGE_TIMEOUT' FROM staged WHERE o % 13 = 0 UNION ALL SELECT kind, 's' || o, 'UNREACHABLE' FROM staged WHERE k % 5 = 0 AND nth > 1
    UNION ALL SELECT kind, NULL, 'CRITICAL_PATH' FROM staged GROUP BY kind HAVING sum(CASE WHEN o % 13 = 0 THEN 150 ELSE 10 END) > 140""", STAGED)  # fmt: skip
def t8_workflow_errors(spark, d):
    """Each customer's orders as a workflow: stages that lead to the next order; some with too many attempts, a route to no state, too long a time, or none that leads to them."""
    o, k = F.col("o_orderkey"), F.expr("CAST(substring(kind, 2) AS BIGINT)")  # what is shuffled is the same for stages and workflows
    by = Window.partitionBy("kind").orderBy("o_orderkey")  # the orders of one customer
    orders = table(spark, d, "orders").select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("kind"), o)
    # one shuffle serves the order of the stages and what is found in them
    rows = orders.repartition(shares(spark, orders.count()), "kind").select("kind", o, F.lead("o_orderkey").over(by).alias("next"), F.row_number().over(by).alias("nth"))
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    done = F.lit("terminal:DONE")
    success = F.when((k % 5 == 0) & (F.col("nth") == 1), done).otherwise(F.coalesce(name(F.col("next")), done))
    stages = rows.select(
        "kind", name(o).alias("stage"), F.when(o % 13 == 0, 150).otherwise(10).alias("timeout_s"), F.when(o % 7 == 0, 9).otherwise(3).alias("max_attempts"), F.lit("BOUNDED_TRANSIENT").alias("retry_class"),
        F.lit("READ_ONLY").alias("side_effect"), F.array(success).alias("on_success"), F.array(F.when(o % 11 == 0, "terminal:LOST").otherwise(done)).alias("on_error"), "nth",
    )
    kinds = stages.where("nth = 1").select("kind", F.col("stage").alias("entry"), F.lit(140).alias("timeout_s"), F.array(F.lit("DONE")).alias("terminals"))
    return graph.workflow_errors(stages.drop("nth"), kinds)


#: Orders call the services of nations: a route that only a variable fits, one that a literal fits better, one that none fits, and hosts of no service.
CALLS = """c AS (SELECT o_orderkey AS k, o_custkey % 25 AS n, o_orderkey % 5 AS kind FROM orders)"""


@query("""SELECT k AS call_id, CASE WHEN kind = 4 THEN NULL ELSE 'service-' || n END AS service, CASE kind WHEN 0 THEN 'n' || n || '-one' WHEN 1 THEN 'n' || n || '-top' WHEN 2 THEN 'n' || n || '-lines' END AS endpoint_id,
    CASE kind WHEN 3 THEN 'unmatched-route' WHEN 4 THEN 'unknown-service' END AS code FROM c""", CALLS)
def s11_linked_calls(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 25
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    route = F.when(k % 5 == 0, text("/api/orders/", k)).when(k % 5 == 1, "/api/orders/top?limit=3").when(k % 5 == 2, text("//api/orders/", k, "/lines/")).otherwise(text("/api/orders/", k, "/lines/1/more"))
    host = F.when(k % 5 == 4, "elsewhere").otherwise(text("Nation", n, ".local:8080"))
    calls = table(spark, d, "orders").select(k.alias("call_id"), text("repo-", k % 100).alias("caller"), F.lit("get").alias("method"), text("http://", host, route).alias("url"))
    nation, m = table(spark, d, "nation"), F.col("n_nationkey")
    routes = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(method).alias("method"), F.lit(r).alias("route")) for name, method, r in (("one", "GET", "/api/orders/{id}"), ("top", "GET", "/api/orders/top"), ("lines", "GET", "/api/orders/:id/lines"), ("any", "GET", "/api/{kind}/{id}/lines"), ("put", "PUT", "/api/orders/{id}"))])
    endpoints = nation.select(m, F.explode(routes).alias("r")).select(text("n", m, "-", F.col("r.name")).alias("endpoint_id"), text("service-", m).alias("service"), "r.method", "r.route")
    return interactions.linked(calls, endpoints, nation.select(text("nation", m, ".local").alias("host"), text("service-", m).alias("service"))).drop("caller")
