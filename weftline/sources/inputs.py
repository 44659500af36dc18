"""Lineage-shaped inputs, projected from the star schema and the event stream.

Each is deterministic, so an independent SQL engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordered import shares

BASE = "urn:ldp:staging:duck:tpch:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all tasks: for a table of few bytes, so few read tasks, of whose rows much is made. Their number is given, so that no small one is joined to others again."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def entity(kind: str, key: Column) -> Column:
    """The URN of one row of a table, as an element."""
    return F.concat(F.lit(f"{BASE}{kind}#"), key.cast("string"))


def _line_ends() -> list[Column]:
    """sources, target and edge_type of a line's claim: part to supplier."""
    return [F.array(entity("part", F.col("l_partkey"))).alias("sources"), entity("supplier", F.col("l_suppkey")).alias("target"), F.lit("DERIVES").alias("edge_type")]


def assertion_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sources, target, edge_type) of the claims of ``assertions``, with those of repeated lines: what a count of an edge's claims reads without a shuffle."""
    return table(spark, sf_dir, "lineitem").select(*_line_ends())


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim of a mechanism for each distinct line: part to supplier."""
    all_lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_tax")
    lines = all_lines.repartition(shares(spark, all_lines.count()), *all_lines.columns[:-1]).distinct()
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 3
    return lines.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")], F.round(F.col("l_tax") * 100).cast("int").cast("string")).alias("provenance_id"),
        *_line_ends(),
        F.when(kind == 0, "SCA").when(kind == 1, "LLM").otherwise("RUNTIME").alias("mechanism"),
        F.when(kind != 2, F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("SUM( "), F.lower("l_returnflag"), F.lit(" )"))).otherwise(F.concat(F.lit("sum("), F.lower("l_returnflag"), F.lit(")")))).alias("transform"),
        (F.col("l_linestatus") == "F").alias("exact"),
        F.when(F.col("l_linenumber") % 2 == 0, "ELEMENT").otherwise("DATASET").alias("scope"),
        (F.col("l_tax") < 0.05).alias("session_complete"),
        F.concat(F.lit("repo-"), (F.col("l_suppkey") % 5).cast("string")).alias("repository"),
    )


def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_key, sources, target, edge_type, band_at, transform) along region > nation > customer > order, and nation > supplier."""
    t = lambda n: table(spark, sf_dir, n)

    def edges(df: DataFrame, a: str, ka: str, b: str, kb: str) -> DataFrame:
        key, transform = F.concat(F.lit("k-"), entity(b, F.col(kb))), F.concat(F.lit("t"), (F.col(kb) % 3).cast("string"))
        return df.select(key.alias("edge_key"), F.array(entity(a, F.col(ka))).alias("sources"), entity(b, F.col(kb)).alias("target"), F.lit("DERIVES").alias("edge_type"), (F.col(kb) % 5).cast("int").alias("band_at"), transform.alias("transform"))

    return (
        edges(t("nation"), "region", "n_regionkey", "nation", "n_nationkey")
        .unionByName(edges(t("customer"), "nation", "c_nationkey", "customer", "c_custkey"))
        .unionByName(edges(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey"))
        .unionByName(edges(t("orders"), "customer", "o_custkey", "orders", "o_orderkey"))
    )


def joined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_edges, and of each line the edge from its part and its supplier together to its order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    key = F.concat_ws("-", F.lit("j"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    made = lines.select(
        key.alias("edge_key"), F.array(entity("part", F.col("l_partkey")), entity("supplier", F.col("l_suppkey"))).alias("sources"), entity("orders", F.col("l_orderkey")).alias("target"), F.lit("DERIVES").alias("edge_type"),
        (F.col("l_partkey") % 5).cast("int").alias("band_at"), F.lit("join").alias("transform"),
    )
    return entity_edges(spark, sf_dir).unionByName(made)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runtime observations: a session for each user, a dataset for each event type; every tenth arrives late."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        (F.col("event_id") * 2 + F.when(F.col("event_id") % 10 == 0, 1201).otherwise(0)).alias("arrival"),
        F.col("event_id").alias("sequence"),
        F.col("event_type").alias("dataset"),
        F.concat(F.col("event_type"), F.lit("-"), F.get_json_object("props", "$.k")).alias("observation_id"),
        F.sha2(F.col("props"), 256).alias("checksum"),
        F.col("ts").alias("observed_at"),
        F.col("value"),
    )


def closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the producers closed their sessions: what they expected to be accepted, drained or not, and what they still held."""
    sent = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"))
    k = F.col("session_id")
    return sent.select("session_id", F.when(k % 3 == 0, F.col("n")).otherwise(F.lit(24)).alias("expected"), (k % 5 != 0).alias("drained"), F.when(k % 7 == 0, 1).otherwise(0).alias("buffered"), F.lit(0).alias("dropped"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages from orders: lane by priority, group by customer, sequence by order."""
    lane = F.when(F.col("o_orderpriority").startswith("1"), "interactive").when(F.col("o_orderpriority").rlike("^[23]"), "events").otherwise("bulk")
    k, days = F.col("o_orderkey"), lambda n: F.make_dt_interval(n.cast("int"))
    status = F.when(F.col("o_orderstatus") == "O", "AVAILABLE").when(F.col("o_orderstatus") == "P", "IN_FLIGHT").when(k % 4 == 0, "DEAD").otherwise("ACKED")
    return table(spark, sf_dir, "orders").select(
        lane.alias("lane"), F.col("o_custkey").alias("group_id"), k.alias("sequence"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + days(k % 4 * 500)).alias("available_at"),
        (F.col("o_orderdate") + days(k % 3 * 900)).alias("lease_expires_at"), (k % 7).alias("attempts"),
    )


def group_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each group of a lane was last claimed; every third never was."""
    lanes = F.explode(F.array(*map(F.lit, ("interactive", "events", "bulk")))).alias("lane")
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(lanes, F.col("c_custkey").alias("group_id"), (F.col("c_custkey") * 7 % 1009).alias("last_claim_order"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployment events of systems (customers) in environments (priorities), in order of arrival; every ninth event comes twice."""
    k = F.col("o_orderkey")
    kind = F.when(k % 13 == 0, "MERGE").when((k % 8 == 0) & (F.col("o_orderstatus") != "P"), "ROLLBACK").otherwise("DEPLOYMENT")
    own = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("system"), F.lit("staging").alias("environment"), (k * 10).alias("arrival"), k.alias("event_id"), kind.alias("event_type"), (k % 50).alias("provider_sequence"), (k % 3).alias("attempt"),
        F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("outcome"), F.when(k % 17 != 0, F.concat(F.lit("d"), (k % 5).cast("string"))).alias("artifact_digest"), (k % 19 != 0).alias("authentic"),
    )
    return own.unionByName(own.where(F.col("event_id") % 9 == 0).withColumn("arrival", F.col("arrival") + 1))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved and other lineage packages of each system: of the digests d0 to d3."""
    n = F.explode(F.sequence(F.lit(0), F.lit(3)))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("system"), F.lit("staging").alias("environment"), n.alias("n"))
    return p.select("system", "environment", F.concat(F.lit("d"), F.col("n").cast("string")).alias("artifact_digest"), F.concat(F.lit("g"), F.col("n").cast("string")).alias("graph_version"), F.lit("c").alias("graph_checksum"), ((F.col("system") + F.col("n")) % 4 != 0).alias("approved"))


#: The same projections for the SQL that the queries are held against.
SQL_ASSERTIONS = f"""
lines AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_tax FROM lineitem),
assertions AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(round(l_tax * 100) AS INT)) AS provenance_id,
         '{BASE}part#' || l_partkey AS source, '{BASE}supplier#' || l_suppkey AS target, 'DERIVES' AS edge_type,
         CASE (l_orderkey + l_linenumber) % 3 WHEN 0 THEN 'SCA' WHEN 1 THEN 'LLM' ELSE 'RUNTIME' END AS mechanism,
         CASE WHEN (l_orderkey + l_linenumber) % 3 <> 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'SUM( ' || lower(l_returnflag) || ' )' ELSE 'sum(' || lower(l_returnflag) || ')' END END AS transform, l_linestatus = 'F' AS exact,
         CASE WHEN l_linenumber % 2 = 0 THEN 'ELEMENT' ELSE 'DATASET' END AS scope, l_tax < 0.05 AS session_complete, 'repo-' || (l_suppkey % 5) AS repository
  FROM lines)
"""
SQL_EDGES = f"""
edges AS (
  SELECT 'k-{BASE}nation#' || n_nationkey AS edge_key, '{BASE}region#' || n_regionkey AS source, '{BASE}nation#' || n_nationkey AS target, n_nationkey % 5 AS band_at, 't' || (n_nationkey % 3) AS transform FROM nation
  UNION ALL SELECT 'k-{BASE}customer#' || c_custkey, '{BASE}nation#' || c_nationkey, '{BASE}customer#' || c_custkey, c_custkey % 5, 't' || (c_custkey % 3) FROM customer
  UNION ALL SELECT 'k-{BASE}supplier#' || s_suppkey, '{BASE}nation#' || s_nationkey, '{BASE}supplier#' || s_suppkey, s_suppkey % 5, 't' || (s_suppkey % 3) FROM supplier
  UNION ALL SELECT 'k-{BASE}orders#' || o_orderkey, '{BASE}customer#' || o_custkey, '{BASE}orders#' || o_orderkey, o_orderkey % 5, 't' || (o_orderkey % 3) FROM orders)
"""
SQL_JOINED = f"""
joined AS (
  SELECT edge_key, source, target, band_at FROM edges
  UNION ALL SELECT concat_ws('-', 'j', l_orderkey, l_partkey, l_suppkey), unnest(['{BASE}part#' || l_partkey, '{BASE}supplier#' || l_suppkey]), '{BASE}orders#' || l_orderkey, l_partkey % 5
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem))
"""
SQL_OBSERVATIONS = """
observations AS (
  SELECT user_id AS session_id, event_id * 2 + CASE WHEN event_id % 10 = 0 THEN 1201 ELSE 0 END AS arrival, event_id AS sequence, event_type AS dataset, event_type || '-' || json_extract_string(props, '$.k') AS observation_id,
         sha256(props) AS checksum, ts AS observed_at, value FROM events)
"""
SQL_CLOSINGS = """
closings AS (SELECT user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN count(*) ELSE 24 END AS expected, user_id % 5 <> 0 AS drained, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS buffered, 0 AS dropped FROM events GROUP BY user_id)
"""
SQL_MESSAGES = """
messages AS (
  SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'interactive' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'events' ELSE 'bulk' END AS lane,
         o_custkey AS group_id, o_orderkey AS sequence, CASE WHEN o_orderstatus = 'O' THEN 'AVAILABLE' WHEN o_orderstatus = 'P' THEN 'IN_FLIGHT' WHEN o_orderkey % 4 = 0 THEN 'DEAD' ELSE 'ACKED' END AS status,
         o_orderdate AS created_at, o_orderdate + to_days((o_orderkey % 4 * 500)::INT) AS available_at, o_orderdate + to_days((o_orderkey % 3 * 900)::INT) AS lease_expires_at, o_orderkey % 7 AS attempts FROM orders)
"""
SQL_GROUPS = """
groups AS (SELECT unnest(['interactive', 'events', 'bulk']) AS lane, c_custkey AS group_id, c_custkey * 7 % 1009 AS last_claim_order FROM customer WHERE c_custkey % 3 <> 0)
"""
SQL_DEPLOYMENTS = """
own AS (SELECT o_custkey AS system, o_orderkey * 10 AS arrival, o_orderkey AS event_id, CASE WHEN o_orderkey % 13 = 0 THEN 'MERGE' WHEN o_orderkey % 8 = 0 AND o_orderstatus <> 'P' THEN 'ROLLBACK' ELSE 'DEPLOYMENT' END AS event_type,
  o_orderkey % 50 AS provider_sequence, o_orderkey % 3 AS attempt, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome, CASE WHEN o_orderkey % 17 <> 0 THEN 'd' || (o_orderkey % 5) END AS artifact_digest, o_orderkey % 19 <> 0 AS authentic FROM orders),
deployments AS (SELECT * FROM own UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM own WHERE event_id % 9 = 0)
"""
