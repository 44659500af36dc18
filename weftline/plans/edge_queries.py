"""Queries on claims, edges and graphs (A*, J*, T*, U*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import consolidate as c
from weftline.operators import graph, queues, resolver, validation
from weftline.operators.checkpoints import stored
from weftline.operators.ordered import numbered
from weftline.plans.registry import query
from weftline.sources import inputs
from weftline.sources.inputs import BASE, SQL_ASSERTIONS, SQL_EDGES, SQL_JOINED, entity, table

#: A transform's tokens, and the words in it whose case does not count.
NORMAL = r"""array_to_string(list_transform(regexp_extract_all(transform, '[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\w\s]'), lambda t: CASE WHEN upper(t) IN ('AS', 'AVG', 'CASE', 'CAST', 'COUNT', 'DATE', 'ELSE', 'END', 'MAX', 'MIN', 'SUM', 'THEN', 'WHEN') THEN lower(t) ELSE t END), '')"""
KEYED = f"""keyed AS (SELECT *, {NORMAL} AS normal, 'edge-' || substr(sha256('{{"edgeType":"' || edge_type || '","from":["' || source || '"],"to":"' || target || '"}}'), 1, 24) AS edge_key FROM assertions)"""
CONSOLIDATED = """grouped AS (
  SELECT edge_key, min(source) AS source, target, edge_type, bool_or(mechanism = 'SCA') AS sca, bool_or(mechanism = 'LLM') AS llm,
         bool_or(mechanism = 'RUNTIME' AND session_complete AND scope = 'ELEMENT') AS runtime,
         max(CASE WHEN mechanism = 'RUNTIME' AND session_complete THEN CASE scope WHEN 'ELEMENT' THEN 2 ELSE 1 END ELSE 0 END) AS observed,
         count(DISTINCT normal) > 1 AS conflict,
         arg_min(transform, CASE WHEN mechanism = 'SCA' AND exact THEN '0' ELSE '1' END || provenance_id) FILTER (WHERE transform IS NOT NULL) AS first_transform,
         bool_or(mechanism = 'SCA' AND exact) AS exact_sca, count(*) AS n_claims
  FROM keyed GROUP BY edge_key, target, edge_type),
consolidated AS (
  SELECT edge_key, source, target, edge_type,
         CASE WHEN sca AND llm AND runtime THEN 'HIGHEST' WHEN sca AND runtime THEN 'HIGH' WHEN llm AND (sca OR runtime) THEN 'MEDIUM' WHEN sca OR runtime THEN 'SINGLE' WHEN llm THEN 'LOWEST' END AS band,
         ['NONE', 'DATASET', 'ELEMENT'][observed + 1] AS corroboration, CASE WHEN conflict THEN 'CONFLICTING' ELSE 'PROPOSED' END AS status,
         CASE WHEN NOT conflict THEN first_transform END AS transform, NOT conflict AND exact_sca AS auto_publishable, 'tpch' AS system, n_claims
  FROM grouped)"""
BY_PART = (SQL_ASSERTIONS, KEYED, CONSOLIDATED)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return c.consolidate(inputs.assertions(spark, d), inputs.assertion_ends(spark, d))


@query("SELECT * FROM consolidated", *BY_PART)
def a1_a5_consolidate(spark, d):
    return _edges(spark, d).withColumn("source", F.array_join("sources", ",")).drop("sources")


@query("""SELECT key AS provenance_id, min(l_partkey::VARCHAR || l_returnflag) <> max(l_partkey::VARCHAR || l_returnflag) AS conflict FROM (
    SELECT l_orderkey || '-' || l_linenumber AS key, l_partkey, l_returnflag FROM lineitem) GROUP BY key""")
def a6_deduplicate(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("provenance_id"), F.array(entity("part", F.col("l_partkey"))).alias("sources"), F.lit("t").alias("target"), F.lit("DERIVES").alias("edge_type"),
        F.lit("SCA").alias("mechanism"), F.col("l_returnflag").alias("transform"), F.lit(True).alias("exact"), F.lit("ELEMENT").alias("scope"), F.lit(True).alias("session_complete"),
    )
    return c.deduplicated(rows).select("provenance_id", "conflict")


@query("SELECT edge_key, provenance_id, row_number() OVER (PARTITION BY edge_key ORDER BY provenance_id) AS version FROM keyed", SQL_ASSERTIONS, KEYED)
def a7_ledger(spark, d):
    return c.ledger(inputs.assertions(spark, d))


#: A ledger of the static claims, and what a day brings: runtime claims and, once more, those of the models.
DAY = """old AS (SELECT edge_key, provenance_id, row_number() OVER (PARTITION BY edge_key ORDER BY provenance_id) AS version FROM keyed WHERE mechanism <> 'RUNTIME'),
fresh AS (SELECT edge_key, provenance_id FROM keyed WHERE mechanism <> 'SCA' EXCEPT SELECT edge_key, provenance_id FROM old)"""


@query("""SELECT *, false AS fresh FROM old UNION ALL SELECT f.edge_key, f.provenance_id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY f.edge_key ORDER BY f.provenance_id), true
    FROM fresh f LEFT JOIN (SELECT edge_key, max(version) AS top FROM old GROUP BY edge_key) t ON t.edge_key = f.edge_key""", SQL_ASSERTIONS, KEYED, DAY)  # fmt: skip
def a7_merged(spark, d):
    a = inputs.assertions(spark, d)
    return c.merged(c.ledger(a.where(F.col("mechanism") != "RUNTIME")), a.where(F.col("mechanism") != "SCA"))


#: Sessions that observe parts at suppliers: elements, or both datasets; a service endpoint for each part.
LATE = f"""seen AS (SELECT DISTINCT l_orderkey AS session_id, CASE WHEN l_returnflag = 'R' THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS outcome, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'),
late AS (SELECT 'runtime:' || session_id || ':o' || l_linenumber AS provenance_id, edge_key, 'ELEMENT' AS scope FROM seen JOIN consolidated ON source = '{BASE}part#' || l_partkey AND target = '{BASE}supplier#' || l_suppkey WHERE outcome = 'COMPLETE' AND edge_type = 'DERIVES')"""


def late_observations(spark, d):
    """What late sessions observed, and the edges that there are."""
    lines = table(spark, d, "lineitem").where(F.col("l_linestatus") == "O").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").distinct()
    observed = lines.select(
        F.col("l_orderkey").alias("session_id"), F.concat(F.lit("o"), F.col("l_linenumber").cast("string")).alias("observation_id"), F.when(F.col("l_returnflag") == "R", "INCOMPLETE").otherwise("COMPLETE").alias("outcome"), F.lit("ELEMENT").alias("granularity"),
        F.array(entity("part", F.col("l_partkey"))).alias("sources"), entity("supplier", F.col("l_suppkey")).alias("target"), F.lit(None).cast("string").alias("endpoint"), F.lit("DERIVES").alias("edge_type"), F.lit(None).cast("string").alias("transform"), F.lit(True).alias("exact"),
    )
    return observed, _edges(spark, d)


@query("SELECT DISTINCT * FROM late", *BY_PART, LATE)
def c15_z6_late_claims(spark, d):
    return c.late_claims(*late_observations(spark, d)).select("provenance_id", "edge_key", "scope")


@query("""SELECT source, target, array_to_string(list_sort(list(DISTINCT repository)), ',') AS contributed_by, array_to_string(list_sort(list(DISTINCT transform) FILTER (WHERE transform IS NOT NULL)), ',') AS transforms,
    array_to_string(list_sort(list(DISTINCT provenance_id)), ',') AS provenance_ids, count(DISTINCT transform) > 1 AS transform_conflict FROM assertions GROUP BY source, target, edge_type""", SQL_ASSERTIONS)  # fmt: skip
def a8_compose(spark, d):
    made, joined = c.compose(inputs.assertions(spark, d), inputs.assertion_ends(spark, d)), lambda c: F.array_join(c, ",").alias(c)
    return made.select(F.array_join("sources", ",").alias("source"), "target", joined("contributed_by"), F.nullif(F.array_join("transforms", ","), F.lit("")).alias("transforms"), joined("provenance_ids"), "transform_conflict")


@query("SELECT repository, count(*) AS n_edges, (SELECT count(DISTINCT e) FROM (SELECT split_part(source, '#', 1) AS e FROM assertions b WHERE b.repository = a.repository UNION SELECT split_part(target, '#', 1) FROM assertions b WHERE b.repository = a.repository)) AS n_datasets FROM assertions a GROUP BY repository", SQL_ASSERTIONS)
def a9_contributions(spark, d):
    return c.contributions(inputs.assertions(spark, d))


@query("SELECT split_part(dataset, '#', 1) AS dataset, count(DISTINCT repository) AS n_repositories FROM (SELECT source AS dataset, repository FROM assertions UNION ALL SELECT target, repository FROM assertions) GROUP BY 1 HAVING count(DISTINCT repository) > 1", SQL_ASSERTIONS)
def j16_seams(spark, d):
    return c.seams(inputs.assertions(spark, d))


@query("SELECT system, coalesce(band, 'NONE') AS band, count(*) AS n FROM consolidated GROUP BY ALL", *BY_PART)
def a15_band_histogram(spark, d):
    return c.summary(_edges(spark, d), F.col("system"))


@query("SELECT edge_key, arg_max(provenance_id, version) AS provenance_id, max(version) AS version FROM (SELECT edge_key, provenance_id, row_number() OVER (PARTITION BY edge_key ORDER BY provenance_id) AS version FROM keyed) GROUP BY edge_key", SQL_ASSERTIONS, KEYED)
def j11_w1_latest(spark, d):
    """The last row of each edge's ledger, without numbering the others."""
    return c.last_versions(inputs.assertions(spark, d), inputs.assertion_ends(spark, d))


@query("SELECT DISTINCT k.edge_key FROM keyed k WHERE EXISTS (SELECT 1 FROM assertions a WHERE a.mechanism = 'RUNTIME' AND a.session_complete AND a.scope = 'ELEMENT' AND a.source = k.source AND a.target = k.target)", SQL_ASSERTIONS, KEYED)
def j6_corroborated_elements(spark, d):
    a = inputs.assertions(spark, d)
    seen = a.where((F.col("mechanism") == "RUNTIME") & F.col("session_complete") & (F.col("scope") == "ELEMENT"))
    return c.corroborated_elements(seen, _edges(spark, d)).select("edge_key")


@query(f"""SELECT target, count(*) AS n FROM edges WHERE regexp_replace(source, '#.*', '') IN ('{BASE}nation', '{BASE}region') GROUP BY target""", SQL_EDGES)
def j7_corroborated_datasets(spark, d):
    seen = spark.createDataFrame([([f"{BASE}nation"], f"{BASE}customer", "DERIVES"), ([f"{BASE}nation"], f"{BASE}supplier", "DERIVES"), ([f"{BASE}region#1"], f"{BASE}nation#2", "DERIVES")], "sources array<string>, target string, edge_type string")
    return c.corroborated_datasets(seen, inputs.entity_edges(spark, d)).groupBy("target").agg(F.count("*").alias("n"))


CALLS = """calls AS (SELECT DISTINCT 'service://repo/' || event_type AS endpoint, 'u' || user_id AS name FROM events WHERE value > 50),
pairs AS (SELECT 'service://repo/' || event_type AS source, 'u' || user_id AS target FROM events UNION SELECT 'u' || user_id, 'service://repo/' || event_type FROM events)"""


@query("SELECT p.source, p.target FROM pairs p WHERE EXISTS (SELECT 1 FROM calls c WHERE (c.endpoint = p.source AND c.name = p.target) OR (c.endpoint = p.target AND c.name = p.source))", CALLS)
def j8_corroborated_endpoints(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("service://repo/"), "event_type").alias("endpoint"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "value")
    pairs = e.select(F.col("endpoint").alias("source"), F.col("name").alias("target")).unionByName(e.select(F.col("name").alias("source"), F.col("endpoint").alias("target"))).distinct()
    return c.corroborated_endpoints(e.where(F.col("value") > 50), pairs)


@query("""SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.source IS NOT NULL AND b.source IS NOT NULL THEN 'CORROBORATED' WHEN b.source IS NULL THEN 'STATIC_ONLY' ELSE 'RUNTIME_ONLY' END AS verdict
    FROM (SELECT DISTINCT source, target FROM assertions WHERE mechanism <> 'RUNTIME') a FULL JOIN (SELECT DISTINCT source, target FROM assertions WHERE mechanism = 'RUNTIME') b ON a.source = b.source AND a.target = b.target""", SQL_ASSERTIONS)  # fmt: skip
def j9_verify_static(spark, d):
    a = inputs.assertions(spark, d).withColumn("source", F.col("sources")[0])
    return c.verify_static(a.where(F.col("mechanism") != "RUNTIME"), a.where(F.col("mechanism") == "RUNTIME"), ["source", "target"])


@query("SELECT t.node, count(*) AS n_edges, min(band_at) AS band_at FROM (SELECT source AS node, band_at FROM edges UNION ALL SELECT target, band_at FROM edges) t GROUP BY t.node", SQL_EDGES)
def a24_weakest_incident(spark, d):
    return graph.weakest_incident(graph.adjacency(inputs.entity_edges(spark, d)))


SUBJECT = f"{BASE}region#1"


def _levels(subject: str, direction: str, depth: int) -> str:
    """T1's levels as WITH items: met, nodes and frontier of each."""
    steps = {"down": "SELECT source AS a, target AS b, edge_key FROM joined", "up": "SELECT target AS a, source AS b, edge_key FROM joined"}
    steps["both"] = f"{steps['down']} UNION ALL {steps['up']}"
    parts = [f"steps AS ({steps[direction]})", f"f0 AS (SELECT '{subject}' AS node)", f"n0 AS (SELECT '{subject}' AS node, 0 AS hops)"]
    for k in range(1, depth + 1):
        parts.append(f"m{k} AS (SELECT DISTINCT b, edge_key FROM f{k - 1} JOIN steps ON a = node)")
        parts.append(f"f{k} AS (SELECT DISTINCT b AS node FROM m{k} WHERE b NOT IN (SELECT node FROM n{k - 1}))")
        parts.append(f"n{k} AS (SELECT * FROM n{k - 1} UNION ALL SELECT DISTINCT e, {k} FROM (SELECT source AS e FROM joined WHERE edge_key IN (SELECT edge_key FROM m{k}) UNION SELECT target FROM joined WHERE edge_key IN (SELECT edge_key FROM m{k})) WHERE e NOT IN (SELECT node FROM n{k - 1}))")
    return ", ".join(parts)


#: Stored graphs by session and folder.
_GRAPHS: dict = {}


def _joined(spark, d):
    """A stored graph: made once for all queries of a session on the same tables."""
    own = (spark.sparkContext.applicationId, d)
    if own not in _GRAPHS:
        _GRAPHS[own] = stored(inputs.joined_edges(spark, d))
    return _GRAPHS[own]


DOWN, UP, BOTH = (_levels(SUBJECT, "down", 4), _levels(f"{BASE}orders#1", "up", 5), _levels(f"{BASE}part#1", "both", 2))


@query("SELECT node, hops FROM n4", SQL_EDGES, SQL_JOINED, DOWN)
def t1_lineage_down(spark, d):
    return graph.lineage(_joined(spark, d), SUBJECT, "down", 4).nodes


@query("SELECT DISTINCT edge_key FROM (SELECT edge_key FROM m1 UNION ALL SELECT edge_key FROM m2 UNION ALL SELECT edge_key FROM m3 UNION ALL SELECT edge_key FROM m4)", SQL_EDGES, SQL_JOINED, DOWN)
def t1_lineage_edges(spark, d):
    return graph.lineage(_joined(spark, d), SUBJECT, "down", 4).edges.select("edge_key")


@query("SELECT node, hops FROM n5", SQL_EDGES, SQL_JOINED, UP)
def t1_lineage_up(spark, d):
    return graph.lineage(_joined(spark, d), f"{BASE}orders#1", "up", 5).nodes


@query("SELECT node, hops FROM n2", SQL_EDGES, SQL_JOINED, BOTH)
def t1_lineage_both(spark, d):
    return graph.lineage(_joined(spark, d), f"{BASE}part#1", "both", 2).nodes


@query(" UNION ALL ".join(f"SELECT {k} AS depth, EXISTS (SELECT 1 FROM f{k} JOIN steps ON a = node) AS truncated" for k in range(1, 5)), SQL_EDGES, SQL_JOINED, DOWN)
def t2_truncated(spark, d):
    rows = list(enumerate(graph.truncated(_joined(spark, d), SUBJECT, "down", 4), 1))
    return spark.createDataFrame(rows, "depth int, truncated boolean")


PATHS = f"""walk AS (WITH RECURSIVE w AS (SELECT '{SUBJECT}' AS node, CAST([] AS VARCHAR[]) AS via, 4 AS band_at UNION ALL
  SELECT e.target, list_append(w.via, e.edge_key), least(w.band_at, e.band_at) FROM w JOIN edges e ON e.source = w.node WHERE len(w.via) < 4 AND NOT list_contains(w.via, e.edge_key)) SELECT * FROM w WHERE len(via) > 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY len(via), node, via) AS nth FROM walk) WHERE nth <= 1000)"""


@query("SELECT DISTINCT edge_key FROM (SELECT unnest(via) AS edge_key FROM firsts) ORDER BY edge_key LIMIT 1000", SQL_EDGES, PATHS)
def t4_path_lineage(spark, d):
    return graph.path_lineage(inputs.entity_edges(spark, d), SUBJECT, 4, 1000).edges.select("edge_key")


@query("""SELECT node, len(via) AS path_length, array_to_string(via, '>') AS via, ['LOWEST', 'SINGLE', 'MEDIUM', 'HIGH', 'HIGHEST'][band_at + 1] AS band, CASE WHEN band_at >= 3 THEN 'BLOCK' WHEN band_at >= 2 THEN 'WARN' ELSE 'INFO' END AS severity
    FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY len(via), via) AS best FROM firsts) WHERE best = 1""", SQL_EDGES, PATHS)  # fmt: skip
def t5_path_impact(spark, d):
    found = graph.path_impact(inputs.entity_edges(spark, d), SUBJECT, "COLUMN_DROP", 4, 1000).rows
    return found.withColumn("via", F.array_join("via", ">")).withColumn("path_length", F.col("path_length").cast("bigint"))


@query("""SELECT node, len(via) AS path_length, array_to_string(via, '>') AS via, ['LOWEST', 'SINGLE', 'MEDIUM', 'HIGH', 'HIGHEST'][band_at + 1] AS band, CASE WHEN band_at >= 3 THEN 'BLOCK' WHEN band_at >= 2 THEN 'WARN' ELSE 'INFO' END AS severity
    FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY len(via), via) AS best FROM (SELECT *, row_number() OVER (ORDER BY len(via), via) AS visited FROM walk) WHERE visited <= 500) WHERE best = 1""", SQL_EDGES, PATHS)  # fmt: skip
def t6_visited_impact(spark, d):
    found = graph.path_impact(inputs.entity_edges(spark, d), SUBJECT, "COLUMN_DROP", 4, 500, trails=False, by_via=True).rows
    return found.withColumn("via", F.array_join("via", ">")).withColumn("path_length", F.col("path_length").cast("bigint"))


IMPACT = f"""steps AS (SELECT source, target, edge_key, band_at, band_at % 3 AS corroboration_at FROM edges),
walk AS (WITH RECURSIVE w AS (
  SELECT r_regionkey AS change_id, CASE WHEN r_regionkey % 2 = 0 THEN 'COLUMN_DROP' ELSE 'TRANSFORM_CHANGE' END AS change_type, '{BASE}region#' || r_regionkey AS node, CAST([] AS VARCHAR[]) AS via, 4 AS b, 2 AS c FROM region
  UNION ALL SELECT w.change_id, w.change_type, s.target, list_append(w.via, s.edge_key), least(w.b, s.band_at), least(w.c, s.corroboration_at) FROM w JOIN steps s ON s.source = w.node WHERE len(w.via) < 5)
  SELECT * FROM w WHERE len(via) > 0),
impact AS (SELECT change_id, node AS target, len(via) AS path_length, array_to_string(via, '>') AS via_edges, ['LOWEST', 'SINGLE', 'MEDIUM', 'HIGH', 'HIGHEST'][b + 1] AS band, ['NONE', 'DATASET', 'ELEMENT'][c + 1] AS corroboration,
  CASE WHEN change_type = 'COLUMN_DROP' AND b >= 3 THEN 'BLOCK' WHEN b >= 2 THEN 'WARN' ELSE 'INFO' END AS severity, 'team-tpch' AS owner, 'ELEMENT' AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY change_id, node ORDER BY len(via), via) AS nth FROM walk) WHERE nth = 1)"""


def _impact_inputs(spark, d):
    steps = graph.adjacency(inputs.entity_edges(spark, d)).withColumn("corroboration_at", (F.col("band_at") % 3).cast("int"))
    subjects = table(spark, d, "region").select(F.col("r_regionkey").alias("change_id"), F.when(F.col("r_regionkey") % 2 == 0, "COLUMN_DROP").otherwise("TRANSFORM_CHANGE").alias("change_type"), entity("region", F.col("r_regionkey")).alias("subject"))
    return steps, subjects


def _impact(spark, d):
    return graph.impact(*_impact_inputs(spark, d))


@query("SELECT * FROM impact", SQL_EDGES, IMPACT)
def t3_impact(spark, d):
    return _impact(spark, d).withColumn("via_edges", F.array_join("via_edges", ">")).withColumn("path_length", F.col("path_length").cast("bigint"))


@query("SELECT change_id, count(*) FILTER (severity = 'BLOCK') AS block, count(*) FILTER (severity = 'WARN') AS warn, count(*) FILTER (severity = 'INFO') AS info FROM impact GROUP BY change_id", SQL_EDGES, IMPACT)
def a10_impact_summary(spark, d):
    return graph.impact_summary(_impact(spark, d))


@query("SELECT change_id, n, sum(n) OVER (ORDER BY change_id) > 500 AS truncated FROM (SELECT change_id, count(*) AS n FROM impact GROUP BY change_id)", SQL_EDGES, IMPACT)
def l8_impact_budget(spark, d):
    return graph.within_budget(_impact(spark, d), 500)


@query("SELECT c.change_id, EXISTS (SELECT 1 FROM impact i JOIN edges e ON e.source = i.target WHERE i.change_id = c.change_id AND i.path_length = 2) AS truncated FROM (SELECT r_regionkey AS change_id FROM region) c", SQL_EDGES, IMPACT)
def t3_impact_truncated(spark, d):
    steps, subjects = _impact_inputs(spark, d)
    return graph.impact_truncated(steps, subjects, graph.impact(steps, subjects, 2), 2)


#: A pull request for each customer, a change for each of its orders.
REQUESTS = """requests AS (SELECT c_custkey AS pr, c_custkey % 11 <> 0 AS head_matches, c_custkey % 7 <> 0 AS covered, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'OUT' ELSE 'HEALTHY' END AS env, c_custkey % 19 <> 0 AS still, c_custkey % 23 = 0 AS moved, CASE WHEN c_custkey % 29 = 0 THEN 130 ELSE 60 END AS took FROM customer),
changes AS (SELECT o_custkey AS pr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, o_orderkey % 31 <> 0 AS available, CASE WHEN o_orderkey % 37 = 0 THEN 'v2' ELSE 'v1' END AS version, o_orderkey % 41 = 0 AS truncated, (o_orderkey % 3 = 0)::INT AS warn, (o_orderkey % 9 = 0)::INT AS block, o_orderkey % 2 = 0 AS model_only, CASE WHEN o_orderkey % 97 = 0 THEN 121 ELSE 5 END AS elapsed FROM orders),
stops AS (SELECT pr, min(place) AS stopped FROM changes WHERE elapsed >= 120 GROUP BY pr),
seen AS (SELECT c.* FROM changes c JOIN requests r ON r.pr = c.pr AND r.env = 'HEALTHY' LEFT JOIN stops s ON s.pr = c.pr WHERE s.stopped IS NULL OR c.place < s.stopped),
told AS (SELECT pr, 0 AS place, 1 AS nth, 'PR_HEAD_SUPERSEDED' AS reason FROM requests WHERE NOT head_matches UNION ALL SELECT pr, 0, 2, 'INCOMPLETE_COVERAGE' FROM requests WHERE NOT covered
  UNION ALL SELECT pr, 0, 3, CASE WHEN env IS NULL THEN 'MISSING_ENVIRONMENT' ELSE 'LINEAGE_OUT_OF_SYNC' END FROM requests WHERE env IS DISTINCT FROM 'HEALTHY'
  UNION ALL SELECT pr, place, 1, 'PROJECTION_UNAVAILABLE' FROM seen WHERE NOT available UNION ALL SELECT pr, place, 2, 'ENVIRONMENT_VERSION_MISMATCH' FROM seen WHERE available AND version <> 'v1' UNION ALL SELECT pr, place, 3, 'IMPACT_TRUNCATED' FROM seen WHERE available AND truncated
  UNION ALL SELECT pr, place, 4, 'IMPACT_WARNING' FROM seen WHERE available AND warn > 0 UNION ALL SELECT pr, place, 5, 'LLM_ONLY_BLOCK_EVIDENCE' FROM seen WHERE available AND block > 0 AND model_only
  UNION ALL SELECT r.pr, 1000000000, 1, 'DEADLINE_EXCEEDED' FROM requests r LEFT JOIN stops s ON s.pr = r.pr WHERE took >= 120 OR stopped IS NOT NULL UNION ALL SELECT pr, 1000000000, 2, 'PR_HEAD_SUPERSEDED' FROM requests WHERE NOT still UNION ALL SELECT pr, 1000000000, 3, 'ENVIRONMENT_CHANGED' FROM requests WHERE moved)"""


@query("""SELECT r.pr, CASE WHEN coalesce(b.block, false) THEN 'BLOCK' WHEN t.reasons IS NOT NULL THEN 'WARN' ELSE 'PASS' END AS verdict, coalesce(t.reasons, '') AS reasons, coalesce(b.truncated, false) AS truncated FROM requests r
    LEFT JOIN (SELECT pr, string_agg(reason, ',' ORDER BY place, nth) AS reasons FROM (SELECT pr, reason, arg_min(place, (place, nth)) AS place, arg_min(nth, (place, nth)) AS nth FROM told GROUP BY pr, reason) GROUP BY pr) t ON t.pr = r.pr
    LEFT JOIN (SELECT pr, bool_or(available AND block > 0 AND NOT model_only) AS block, bool_or(available AND truncated) AS truncated FROM seen GROUP BY pr) b ON b.pr = r.pr""", REQUESTS)  # fmt: skip
def c10_pr_gate(spark, d):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    env = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "OUT").otherwise("HEALTHY")
    requests = table(spark, d, "customer").select(
        k.alias("pr"), F.lit(120).alias("deadline_s"), (k % 11 != 0).alias("head_matches"), (k % 7 != 0).alias("coverage_complete"), env.alias("environment"), F.lit("v1").alias("environment_version"),
        (k % 19 != 0).alias("head_matches_after"), env.alias("environment_after"), F.when(k % 23 == 0, "v2").otherwise("v1").alias("environment_version_after"), F.when(k % 29 == 0, 130).otherwise(60).alias("took_s"),
    )
    numbered_ = numbered(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_orderkey"], by=["o_custkey"], name="at")
    changes = numbered_.select(
        F.col("o_custkey").alias("pr"), "at", F.lit("COLUMN_DROP").alias("change_type"), F.when(o % 2 == 0, F.array(F.lit("LLM"))).otherwise(F.array(F.lit("LLM"), F.lit("SCA"))).alias("mechanisms"), (o % 31 != 0).alias("available"),
        F.when(o % 37 == 0, "v2").otherwise("v1").alias("version"), (o % 41 == 0).alias("truncated"), (o % 3 == 0).cast("int").alias("warn"), (o % 9 == 0).cast("int").alias("block"), F.when(o % 97 == 0, 121).otherwise(5).alias("elapsed_s"),
    )
    return queues.gate(requests, changes)


@query(f"""SELECT node, split_part(node, '#', 1) AS dataset, hops, CASE hops WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'BREAK' ELSE 'WARN' END AS severity, array_to_string(via, '>') AS via FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, via) AS nth FROM (
    WITH RECURSIVE r(node, hops, via) AS (SELECT '{BASE}nation', 0, CAST([] AS VARCHAR[]) UNION ALL
    SELECT s.target, hops + 1, list_append(via, s.transform) FROM r JOIN (SELECT source, target, transform FROM edges UNION SELECT regexp_replace(source, '#.*', ''), target, transform FROM edges) s ON s.source = r.node WHERE hops < 10) SELECT * FROM r)) WHERE nth = 1""", SQL_EDGES)  # fmt: skip
def t7_blast_radius(spark, d):
    # each node of these tables has one parent, so the winner's rank and the smallest list agree
    out = graph.blast_radius(graph.adjacency(inputs.entity_edges(spark, d)), f"{BASE}nation")
    return out.withColumn("via", F.array_join("via", ">"))


@query(f"""SELECT '{BASE}nation#1' AS node, '{BASE}nation' AS dataset, 0 AS hops, 'SOURCE' AS severity, '' AS via UNION ALL SELECT node, split_part(node, '#', 1), 1, 'BREAK', transform FROM one
    UNION ALL SELECT o.node, '{BASE}orders', 2, 'WARN', arg_min(one.transform || '>' || o.transform, one.node) FROM one JOIN (SELECT '{BASE}customer#' || o_custkey AS parent, '{BASE}orders#' || o_orderkey AS node, 't' || (o_orderkey % 3) AS transform FROM orders
      UNION ALL SELECT '{BASE}supplier#' || l_suppkey, '{BASE}orders#' || l_orderkey, 'join' FROM lineitem) o ON o.parent = one.node GROUP BY o.node""",
    f"""one AS (SELECT '{BASE}customer#' || c_custkey AS node, 't' || (c_custkey % 3) AS transform FROM customer WHERE c_nationkey = 1 UNION ALL SELECT '{BASE}supplier#' || s_suppkey, 't' || (s_suppkey % 3) FROM supplier WHERE s_nationkey = 1)""")
def t7_shared_targets(spark, d):
    """Orders are reached over their customer and over several suppliers at once: that of the smallest rank counts, whatever its transforms are."""
    out = graph.blast_radius(graph.adjacency(_joined(spark, d)), f"{BASE}nation#1")
    return out.withColumn("via", F.array_join("via", ">"))


LINKS = """links AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), pairs AS (SELECT a, b FROM links UNION SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT DISTINCT 'm' || c_nationkey, 'c' || c_custkey FROM customer)"""


@query("""SELECT node, rank::INT AS rank FROM (SELECT node, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN d WHEN u IS NOT NULL THEN -u END - (SELECT min(CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN d ELSE -u END) FROM ranks) AS rank FROM ranks)""",
    LINKS, """down AS (SELECT node, min(hops) AS d FROM (WITH RECURSIVE r(node, hops) AS (SELECT 's1', 0 UNION SELECT p.b, hops + 1 FROM r JOIN pairs p ON p.a = r.node) SELECT * FROM r) GROUP BY node), up AS (SELECT node, min(hops) AS u FROM (WITH RECURSIVE r(node, hops) AS (SELECT 's1', 0 UNION SELECT p.a, hops + 1 FROM r JOIN pairs p ON p.b = r.node) SELECT * FROM r) GROUP BY node),
    near AS (SELECT a AS node FROM pairs UNION SELECT b FROM pairs), base AS (SELECT near.node, d, u FROM near LEFT JOIN down ON down.node = near.node LEFT JOIN up ON up.node = near.node),
    known AS (SELECT node, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN d ELSE -u END AS r FROM base WHERE d IS NOT NULL OR u IS NOT NULL),
    s1 AS (SELECT b.node, coalesce((SELECT arg_min(k.r, k.node) + 1 FROM pairs p JOIN known k ON k.node = p.a WHERE p.b = b.node), (SELECT arg_min(k.r, k.node) - 1 FROM pairs p JOIN known k ON k.node = p.b WHERE p.a = b.node)) AS r FROM base b WHERE d IS NULL AND u IS NULL),
    k2 AS (SELECT * FROM known UNION ALL SELECT * FROM s1 WHERE r IS NOT NULL),
    s2 AS (SELECT b.node, coalesce((SELECT arg_min(k.r, k.node) + 1 FROM pairs p JOIN k2 k ON k.node = p.a WHERE p.b = b.node), (SELECT arg_min(k.r, k.node) - 1 FROM pairs p JOIN k2 k ON k.node = p.b WHERE p.a = b.node)) AS r FROM s1 b WHERE r IS NULL),
    k3 AS (SELECT * FROM k2 UNION ALL SELECT * FROM s2 WHERE r IS NOT NULL),
    s3 AS (SELECT b.node, coalesce((SELECT arg_min(k.r, k.node) + 1 FROM pairs p JOIN k3 k ON k.node = p.a WHERE p.b = b.node), (SELECT arg_min(k.r, k.node) - 1 FROM pairs p JOIN k3 k ON k.node = p.b WHERE p.a = b.node), 0) AS r FROM s2 b WHERE r IS NULL),
    ranks AS (SELECT node, r AS d, NULL::INT AS u FROM k3 UNION ALL SELECT node, r, NULL FROM s3)""")  # fmt: skip
def t9_canvas_ranks(spark, d):
    """Customers before the suppliers of their orders, those before nations, and customers' own nations before them; drawn around supplier 1."""
    t = lambda n: table(spark, d, n)
    pair = lambda df, a, ka, b, kb: df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("a"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("b"))
    bought = t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey")
    pairs = pair(bought, "c", "o_custkey", "s", "l_suppkey").unionByName(pair(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionByName(pair(t("customer"), "m", "c_nationkey", "c", "c_custkey"))
    return graph.canvas_ranks(pairs, "s1")


@query("SELECT node, ancestor, hops FROM (WITH RECURSIVE r AS (SELECT target AS node, source AS ancestor, 1 AS hops FROM edges UNION ALL SELECT r.node, e.source, hops + 1 FROM r JOIN edges e ON e.target = r.ancestor) SELECT * FROM r)", SQL_EDGES)
def t8_t10_closure(spark, d):
    return graph.closure(graph.adjacency(inputs.entity_edges(spark, d)).select(F.col("target").alias("node"), F.col("source").alias("parent")))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_name, c_custkey) > ('Customer#000000050', 50) ORDER BY c_name, c_custkey LIMIT 20")
def l5_keyset_page(spark, d):
    return graph.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], ("Customer#000000050", 50), 20)


LOCATORS = """locators AS (SELECT DISTINCT 'h/' || split_part(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/', 1) AS locator FROM pages UNION SELECT 'h/' || regexp_extract(url, '://[^/]*/([^?#]*)', 1) FROM pages WHERE page_id % 3 = 0),
keys AS (SELECT DISTINCT 'h/' || regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS key FROM pages)"""


@query("SELECT key, arg_max(locator, length(locator)) AS locator FROM keys JOIN locators ON key = locator OR starts_with(key, locator || '/') GROUP BY key", LOCATORS)
def j1_longest_prefix(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("h/"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)).alias("key"))
    locators = p.select(F.concat_ws("/", F.split("key", "/")[0], F.split("key", "/")[1]).alias("locator")).unionByName(p.where(F.col("page_id") % 3 == 0).select(F.col("key").alias("locator"))).distinct()
    return resolver.longest_prefix(p.select("key").distinct(), locators).select("key", "locator")


#: A catalog of suppliers: two of each four share a name on one platform, three share an alias; and what is asked for by each of them.
NAMED = """cat AS (SELECT s_suppkey AS k, 'catalog://s' || s_suppkey AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 'kafka' ELSE 'postgres' END AS platform, 'sys' || s_nationkey AS system, 'd' || (s_suppkey // 4) AS dataset, 'a' || (s_suppkey // 3) AS alias, ['id', 'e' || (s_suppkey % 3)] AS elements FROM supplier),
asked AS (SELECT DISTINCT * FROM (SELECT ref AS name, platform, NULL AS system, ['id'] AS elements FROM cat UNION ALL SELECT alias, platform, NULL, ['id'] FROM cat UNION ALL SELECT dataset, platform, system, ['e' || (k % 3)] FROM cat UNION ALL SELECT dataset, platform, NULL, ['id'] FROM cat
  UNION ALL SELECT ref, platform, 'x', ['nope', 'id'] FROM cat UNION ALL SELECT 'absent' || k, platform, NULL, [] FROM cat)),
tiers AS (SELECT a.*, c.ref, 1 AS tier FROM asked a JOIN cat c ON a.name = c.ref UNION ALL SELECT a.*, c.ref, 2 FROM asked a JOIN cat c ON a.name = c.alias UNION ALL SELECT a.*, c.ref, 3 FROM asked a JOIN cat c ON a.name = c.dataset AND a.platform = c.platform AND (a.system IS NULL OR a.system = c.system)),
best AS (SELECT name, platform, system, elements, list_sort(list(DISTINCT ref) FILTER (tier = top)) AS refs FROM (SELECT *, min(tier) OVER (PARTITION BY name, platform, system, elements) AS top FROM tiers) GROUP BY name, platform, system, elements),
told AS (SELECT a.*, b.refs, c.platform AS p, c.system AS s, c.dataset AS d, list_sort(list_filter(a.elements, lambda e: NOT list_contains(c.elements, e))) AS missing FROM asked a LEFT JOIN best b ON a.name = b.name AND a.platform = b.platform AND a.system IS NOT DISTINCT FROM b.system AND a.elements = b.elements
  LEFT JOIN cat c ON len(b.refs) = 1 AND c.ref = b.refs[1]), reasons AS (SELECT *, CASE WHEN refs IS NULL THEN 'UNKNOWN_DATASET' WHEN len(refs) > 1 THEN 'AMBIGUOUS' WHEN len(missing) > 0 THEN 'UNKNOWN_ELEMENT' END AS reason, 'urn:ldp:staging:' || p || ':' || s || ':' || d AS base FROM told)"""


@query("""SELECT name, platform, system, CASE WHEN reason IS NULL THEN 'RESOLVED' ELSE 'QUARANTINED' END AS status, reason, CASE WHEN reason IS NULL THEN base END AS urn, CASE WHEN reason IS NULL THEN array_to_string(list_transform(elements, lambda e: base || '#' || e), ',') END AS element_urns,
    CASE WHEN reason = 'AMBIGUOUS' THEN array_to_string(refs, ',') END AS candidates, CASE WHEN reason = 'UNKNOWN_ELEMENT' THEN array_to_string(missing, ',') END AS missing FROM reasons""", NAMED)  # fmt: skip
def j2_j4_resolve(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    catalog = s.select(k, text("catalog://s", k).alias("ref"), F.when(k % 2 == 0, "kafka").otherwise("postgres").alias("platform"), text("sys", F.col("s_nationkey")).alias("system"), text("d", F.floor(k / 4)).alias("dataset"), F.array(text("a", F.floor(k / 3))).alias("aliases"), F.array(F.lit("id"), text("e", k % 3)).alias("elements"))
    ask = lambda name, system, *elements: F.struct(name.alias("name"), system.cast("string").alias("system"), (F.array(*elements) if elements else F.array().cast("array<string>")).alias("elements"))
    id_, none = F.lit("id"), F.lit(None)
    asked = F.array(ask(F.col("ref"), none, id_), ask(F.col("aliases")[0], none, id_), ask(F.col("dataset"), F.col("system"), text("e", k % 3)), ask(F.col("dataset"), none, id_), ask(F.col("ref"), F.lit("x"), F.lit("nope"), id_), ask(text("absent", k), none))
    raw = catalog.select("platform", F.explode(asked).alias("q")).select("q.name", "platform", "q.system", "q.elements")
    return resolver.resolve(raw, catalog.drop("s_suppkey"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j5_vocabulary(spark, d):
    nations = table(spark, d, "nation").where(F.col("n_regionkey") == 1)
    return resolver.in_vocabulary(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", nations, "n_nationkey")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) a
    FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""")
def u1_upsert(spark, d):
    cu = table(spark, d, "customer")
    old = cu.where(F.col("c_custkey") % 3 != 0).select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = cu.where(F.col("c_custkey") % 2 == 0).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("v"))
    return queues.upsert(old, new, ["c_custkey"], ["v"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'changed' WHEN p_partkey % 7 = 0 THEN 'added' ELSE p_brand END AS body, 'PUBLISHED' AS status FROM part
    WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)""")
def u3_u4_projected_edges(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("body"))
    pick = lambda k, v: p.where(F.col("id") % k == 0).withColumn("body", F.lit(v))
    return queues.projected(p, p.where(F.col("id") % 3 == 0), pick(7, "added"), pick(5, "changed"), "id")


@query("""SELECT l_returnflag, sha256(concat_ws('-', count(*), sum(s1), sum(s9), sum(s17), sum(s25))) AS checksum, count(*) AS n FROM (
    SELECT l_returnflag, ('0x' || substr(h, 1, 8))::BIGINT AS s1, ('0x' || substr(h, 9, 8))::BIGINT AS s9, ('0x' || substr(h, 17, 8))::BIGINT AS s17, ('0x' || substr(h, 25, 8))::BIGINT AS s25
    FROM (SELECT l_returnflag, sha256(l_orderkey || '|' || l_partkey) AS h FROM lineitem)) GROUP BY l_returnflag""")
def u5_checksum(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.concat_ws("|", "l_orderkey", "l_partkey").alias("body"))
    return queues.checksum(rows, "l_returnflag", "body")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'MISSING' ELSE 'UNEXPECTED' END AS drift FROM customer WHERE (c_custkey % 2 = 0) <> (c_custkey % 3 = 0)")
def x1_x3_reconcile(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return queues.reconciled(rows.where(F.col("id") % 2 == 0), rows.where(F.col("id") % 3 == 0), ["id"])


@query("""SELECT p_partkey AS ask, e.edge_key, CASE p_partkey % 3 WHEN 0 THEN v.version WHEN 1 THEN 1 ELSE 1000000 END AS version, CASE p_partkey % 3 WHEN 0 THEN last WHEN 1 THEN first END AS provenance_id, CASE WHEN p_partkey % 3 = 2 THEN 'NOT_FOUND' END AS code
    FROM (SELECT DISTINCT p_partkey, edge_key FROM part JOIN keyed ON source = '{BASE}part#' || p_partkey) e JOIN (SELECT edge_key, count(DISTINCT provenance_id) AS version, max(provenance_id) AS last, min(provenance_id) AS first FROM keyed GROUP BY edge_key) v ON v.edge_key = e.edge_key""".replace("{BASE}", BASE), SQL_ASSERTIONS, KEYED)
def t12_edge_detail(spark, d):
    """For each part its edges at their last version, at their first, or at one that there never was."""
    claims = c.with_key(inputs.assertions(spark, d))
    ledger = c.ledger(claims)
    last = ledger.groupBy("edge_key").agg(F.max("version").alias("last"))
    part = F.regexp_extract(F.col("sources")[0], "#([0-9]+)$", 1).cast("bigint")
    asked = claims.select(part.alias("ask"), "edge_key").distinct().join(last, "edge_key")
    version = F.when(F.col("ask") % 3 == 0, F.col("last")).when(F.col("ask") % 3 == 1, 1).otherwise(1_000_000)
    return graph.edge_detail(ledger, asked.select("ask", "edge_key", version.cast("bigint").alias("version")))

@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey) WHERE parts <> list_sort(list_distinct(parts))")
def v8_unsorted_arrays(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    return validation.unsorted_arrays(lines.select("l_orderkey", F.transform("lines", lambda x: x["l_partkey"]).alias("parts")), "l_orderkey", "parts")


@query("SELECT edge_key, band FROM consolidated WHERE auto_publishable AND NOT (coalesce(band, '') IN ('HIGH', 'HIGHEST'))", *BY_PART)
def v10_unsafe_auto_publish(spark, d):
    e = _edges(spark, d)
    return e.where(F.col("auto_publishable") & ~F.coalesce(F.col("band").isin("HIGH", "HIGHEST"), F.lit(False))).select("edge_key", "band")


@query("SELECT edge_key, 'NO_ELEMENT_MECHANISM' AS reason FROM consolidated WHERE band IS NULL", *BY_PART)
def q10_quarantined_edges(spark, d):
    return _edges(spark, d).where(F.col("band").isNull()).select("edge_key", F.lit("NO_ELEMENT_MECHANISM").alias("reason"))


@query("""SELECT provenance_id, edge_key AS identity, scope = 'DATASET' AS moved, CASE WHEN scope = 'DATASET' THEN 'edge-' || substr(sha256('{"edgeType":"READS","from":["' || source || '"],"to":"' || target || '"}'), 1, 24) ELSE edge_key END AS corrected FROM keyed""", SQL_ASSERTIONS, KEYED)
def v11_recomputed_identity(spark, d):
    """A correction makes edges of datasets reads: their identity moves, that of elements stays."""
    a = inputs.assertions(spark, d)
    kind = F.when(F.col("scope") == "DATASET", "READS").otherwise("DERIVES")
    own, corrected = (rules.edge_key(F.col("sources"), F.col("target"), t) for t in (F.lit("DERIVES"), kind))
    return a.select("provenance_id", own.alias("identity"), (own != corrected).alias("moved"), corrected.alias("corrected"))


@query(f"""SELECT '{BASE}orders#' || o_orderkey AS node, '{BASE}region#' || (o_orderkey % 5) AS ancestor, CASE WHEN n_regionkey = o_orderkey % 5 THEN 3 END AS hops FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def t10_reachable(spark, d):
    """Whether each order comes from a region, which is asked for it alone."""
    steps = graph.adjacency(inputs.entity_edges(spark, d)).select(F.col("target").alias("node"), F.col("source").alias("parent"))
    k = F.col("o_orderkey")
    return graph.reaches(steps, table(spark, d, "orders").select(entity("orders", k).alias("node"), entity("region", k % 5).alias("ancestor")))
