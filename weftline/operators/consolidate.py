"""Consolidation: claims of mechanisms become edges with bands."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names, rules
from weftline.operators.checkpoints import stored
from weftline.operators.ordered import crowds, numbered, shares


def deduplicated(claims: DataFrame) -> DataFrame:
    """One row for each provenance_id, with ``conflict`` if its rows differ in what they claim; of several bodies the smallest stays."""
    columns = [c for c in claims.columns if c != "provenance_id"]
    body = F.struct(*columns)
    seen = claims.groupBy("provenance_id").agg(F.min(body).alias("claim"), F.max(body).alias("other"))
    return seen.select("provenance_id", "claim.*", (F.col("claim") != F.col("other")).alias("conflict"))


class Conflict(RuntimeError):
    """Claims under one provenance_id that differ."""


def accepted(claims: DataFrame) -> DataFrame:
    """Claims without repeats; raises Conflict if two of one provenance_id differ."""
    once = deduplicated(claims)
    clash = once.where("conflict").select("provenance_id").first()
    if clash is not None:
        raise Conflict(clash["provenance_id"])
    return once.drop("conflict")


def with_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("edge_key", rules.edge_key(F.col("sources"), F.col("target"), F.col("edge_type")))


def _by_edge(claims: DataFrame, counted: DataFrame | None, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``grouped`` of keyed claims, by edge_key, in as many tasks as their number asks for. Edges of a hash with many claims are combined before they are shuffled, so that no task gets all claims of one.

    counted: (sources, target, edge_type) of the claims, at least as often, if that is easier to read than claims are.
    """
    n, crowded = crowds(claims if counted is None else counted, [F.array_sort("sources"), "target", "edge_type"])
    lone = lambda df: grouped(df.repartition(shares(df.sparkSession, n), "edge_key"))
    keyed = with_key(claims)
    return lone(keyed) if crowded is None else lone(keyed.where(~crowded)).unionByName(grouped(keyed.where(crowded)))


def consolidate(claims: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A1-A5: one edge for each (sources, target, edge_type).

    Runtime counts as a mechanism only for complete sessions that observed elements. An edge without any counting
    mechanism has a null band (to be quarantined). The transform is that of the first exact SCA claim by
    provenance_id, else of the first SCA or LLM claim; none if their normalised transforms conflict. Its system is that of its target, or of
    the first governed source where the target is a service. counted: as ``_by_edge`` takes it.
    """
    complete_runtime = (F.col("mechanism") == "RUNTIME") & F.col("session_complete")
    static = F.col("mechanism") != "RUNTIME"
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    given = static & F.col("transform").isNotNull()
    normal = F.when(given, rules.normal_transform(F.col("transform")))
    rank = F.when(given, F.struct((~((F.col("mechanism") == "SCA") & F.col("exact"))).cast("int").alias("later"), F.col("provenance_id")))
    # one aggregate without DISTINCT: two normalised transforms differ if their smallest and largest do
    grouped = _by_edge(claims, counted, lambda keyed: keyed.withColumn("normal", normal).groupBy("edge_key").agg(
        F.min_by(F.struct("sources", "target", "edge_type"), "provenance_id").alias("e"),
        has(F.col("mechanism") == "SCA").alias("sca"),
        has(F.col("mechanism") == "LLM").alias("llm"),
        has(complete_runtime & (F.col("scope") == "ELEMENT")).alias("runtime"),
        F.max(F.when(complete_runtime, rules.ordinal(F.col("scope"), rules.CORROBORATION)).otherwise(0)).alias("observed"),
        F.coalesce(F.min("normal") != F.max("normal"), F.lit(False)).alias("conflict"),
        F.min_by("transform", rank).alias("first_transform"),
        has((F.col("mechanism") == "SCA") & F.col("exact") & F.col("transform").isNotNull()).alias("exact_sca"),
        F.count("*").alias("n_claims"),
    ))
    governed = F.when(F.col("e.target").startswith("urn:ldp:"), F.col("e.target")).otherwise(F.get(F.filter("e.sources", lambda x: x.startswith("urn:ldp:")), 0))
    return grouped.select(
        "edge_key", F.array_sort("e.sources").alias("sources"), "e.target", "e.edge_type",
        rules.band(F.col("sca"), F.col("llm"), F.col("runtime")).alias("band"),
        rules.named(F.col("observed"), rules.CORROBORATION).alias("corroboration"),
        F.when(F.col("conflict"), "CONFLICTING").otherwise("PROPOSED").alias("status"),
        F.when(~F.col("conflict"), F.col("first_transform")).alias("transform"),
        (~F.col("conflict") & F.col("exact_sca")).alias("auto_publishable"),
        names.system_of(governed).alias("system"),
        "n_claims",
    )


def ledger(claims: DataFrame) -> DataFrame:
    """A7 from nothing: the version that each provenance_id gives its edge: 1, 2, ... in order of provenance_id."""
    return numbered(with_key(claims).select("edge_key", "provenance_id"), ["provenance_id"], by=["edge_key"], name="version", once=True)


def last_versions(claims: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """J11 over ``ledger``: each edge's last row of it, by one aggregate: versions are counts, so the last is how many there are. counted: as ``_by_edge`` takes it."""
    last = [F.max("provenance_id").alias("provenance_id"), F.count("*").alias("version")]
    return _by_edge(claims, counted, lambda keyed: keyed.select("edge_key", "provenance_id").distinct().groupBy("edge_key").agg(*last))


def merged(known: DataFrame, claims: DataFrame, order: str = "provenance_id") -> DataFrame:
    """A ledger (edge_key, provenance_id, version) after claims arrive in ``order``; rows that are new have ``fresh``.

    A provenance_id that its edge already has changes nothing, and among the new ones only the first of each counts; every other claim gives
    its edge the next version.
    """
    known = stored(known.select("edge_key", "provenance_id", "version"))
    keyed = with_key(claims).groupBy("edge_key", "provenance_id").agg(F.min(order).alias("at_"))
    new = keyed.join(known.select("edge_key", "provenance_id"), ["edge_key", "provenance_id"], "left_anti")
    top = known.groupBy("edge_key").agg(F.max("version").alias("top_"))
    placed = numbered(new, ["at_", "provenance_id"], by=["edge_key"], name="nth_", counted=with_key(claims).select("edge_key")).join(top, "edge_key", "left")
    added = placed.select("edge_key", "provenance_id", (F.coalesce("top_", F.lit(0)) + F.col("nth_")).alias("version"), F.lit(True).alias("fresh"))
    return known.select("edge_key", "provenance_id", F.col("version").cast("bigint"), F.lit(False).alias("fresh")).unionByName(added)


def late_shapes(observed: DataFrame) -> set[str]:
    """Which of the joins of ``late_claims`` complete observations need: direct, end, coarse; at most three rows."""
    shape = F.when(F.col("granularity") == "DATASET", "coarse").when(F.col("granularity") == "ELEMENT", F.when(F.col("endpoint").isNull(), "direct").otherwise("end"))
    return {r["shape"] for r in observed.where(F.col("outcome") == "COMPLETE").select(shape.alias("shape")).distinct().collect()}


def late_claims(observed: DataFrame, edges: DataFrame, shapes: set[str] | None = None) -> DataFrame:
    """Runtime claims that complete sessions, whenever they came, make on edges that are there.

    observed: (session_id, observation_id, outcome, granularity, sources, target, endpoint, edge_type, transform, exact), sources and target as
    URNs: elements, or datasets for DATASET. Nothing observed makes an edge of its own, and sessions that are not complete claim nothing.
    Claims have the columns that ``consolidate`` takes, and edge_key. shapes: as ``late_shapes`` has them, if known: the edges are not shuffled for joins that none needs.
    """
    o = observed.where(F.col("outcome") == "COMPLETE").withColumn("k", F.array_sort("sources"))
    e = edges.select("edge_key", F.col("sources").alias("edge_sources"), F.col("target").alias("edge_target"), "edge_type")
    element = o.where((F.col("granularity") == "ELEMENT") & F.col("endpoint").isNull())
    direct = element.withColumnRenamed("target", "t").join(e.withColumn("k", F.array_sort("edge_sources")).withColumn("t", F.col("edge_target")), ["k", "t", "edge_type"])
    ends = o.where((F.col("granularity") == "ELEMENT") & F.col("endpoint").isNotNull() & (F.size("sources") == 1)).withColumn("a", F.col("sources")[0])
    single = e.where(F.size("edge_sources") == 1).withColumn("s", F.col("edge_sources")[0]).withColumn("t", F.col("edge_target"))
    out = ends.withColumn("s", F.col("a")).withColumn("t", F.col("endpoint")).join(single, ["s", "t", "edge_type"])
    back = ends.withColumn("s", F.col("endpoint")).withColumn("t", F.col("a")).join(single, ["s", "t", "edge_type"])
    governed = e.where(F.col("edge_target").startswith("urn:ldp:") & F.forall("edge_sources", lambda s: s.startswith("urn:ldp:")))
    by_set = governed.withColumn("k", F.array_sort(F.array_distinct(F.transform("edge_sources", names.dataset_of)))).withColumn("t", names.dataset_of(F.col("edge_target")))
    coarse = o.where(F.col("granularity") == "DATASET").withColumn("k", F.array_sort(F.array_distinct("sources"))).withColumnRenamed("target", "t").join(by_set, ["k", "t", "edge_type"])
    name = F.concat_ws(":", F.lit("runtime"), F.col("session_id").cast("string"), F.col("observation_id"))

    def claim(df: DataFrame, own: Column) -> DataFrame:
        return df.select(
            own.alias("provenance_id"), "edge_key", F.col("edge_sources").alias("sources"), F.col("edge_target").alias("target"), "edge_type", F.lit("RUNTIME").alias("mechanism"), "transform",
            "exact", F.col("granularity").alias("scope"), F.lit(True).alias("session_complete"),
        )

    found = [("direct", claim(direct, name)), ("end", claim(out, name)), ("end", claim(back, name)), ("coarse", claim(coarse, F.concat_ws(":", name, "edge_key")))]
    wanted = [df for shape, df in found if shapes is None or shape in shapes]
    return reduce(DataFrame.unionByName, wanted or [claim(direct, name).limit(0)]).distinct()


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Each key's row of the highest version."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("row"))
    return best.select(key, "row.*")


def compose(edges: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Edges of several repositories by (sources, target, edge_type): who contributes, by which claims, and whether transforms differ.

    What the edges hold beside that comes from the first repository's smallest claim. One grouping by the edge's key; the lists are as long as an edge's own
    witnesses. counted: as ``_by_edge`` takes it.
    """
    return _by_edge(edges, counted, lambda keyed: keyed.groupBy("edge_key").agg(
        F.min_by(F.struct(F.array_sort("sources").alias("sources"), "target", "edge_type"), F.struct("repository", "provenance_id")).alias("e"),
        F.array_sort(F.collect_set("repository")).alias("contributed_by"),
        F.array_sort(F.collect_set("provenance_id")).alias("provenance_ids"),
        F.array_sort(F.collect_set("transform")).alias("transforms"),
    )).select("edge_key", "e.*", "contributed_by", "provenance_ids", "transforms", (F.size("transforms") > 1).alias("transform_conflict"))


def _ends(edges: DataFrame) -> DataFrame:
    """(repository, dataset) of every edge's ends, each once."""
    return edges.select("repository", F.explode(F.array_distinct(F.transform(F.concat("sources", F.array("target")), names.dataset_of))).alias("dataset")).distinct()


def contributions(edges: DataFrame) -> DataFrame:
    """Edges and distinct datasets of each repository."""
    sets = _ends(edges).groupBy("repository").agg(F.count("*").alias("n_datasets"))
    return edges.groupBy("repository").agg(F.count("*").alias("n_edges")).join(sets, "repository")


def seams(edges: DataFrame) -> DataFrame:
    """Datasets in edges of more than one repository."""
    return _ends(edges).groupBy("dataset").agg(F.count("*").alias("n_repositories")).where(F.col("n_repositories") > 1)


def corroborated_elements(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that an ELEMENT observation matches in sources, target and type."""
    seen = observed.select(F.array_sort("sources").alias("k"), "target", "edge_type").distinct()
    return edges.withColumn("k", F.array_sort("sources")).join(seen, ["k", "target", "edge_type"], "left_semi").drop("k")


def corroborated_datasets(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose datasets of sources and target a DATASET observation has; service endpoints are left out."""

    def keyed(df: DataFrame) -> DataFrame:
        sources = F.array_sort(F.array_distinct(F.transform("sources", names.dataset_of)))
        return df.withColumn("k", sources).withColumn("t", names.dataset_of(F.col("target")))

    only_urns = edges.where(F.col("target").startswith("urn:ldp:") & F.forall("sources", lambda s: s.startswith("urn:ldp:")))
    return keyed(only_urns).join(keyed(observed).select("k", "t", "edge_type").distinct(), ["k", "t", "edge_type"], "left_semi").drop("k", "t")


def corroborated_endpoints(observed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between a service endpoint and a name, observed in either direction: two equi-joins, no OR."""
    both = observed.select("endpoint", "name").distinct()
    out = edges.join(both, (edges["source"] == both["endpoint"]) & (edges["target"] == both["name"]), "left_semi")
    return out.unionByName(edges.join(both, (edges["target"] == both["endpoint"]) & (edges["source"] == both["name"]), "left_semi")).distinct()


def verify_static(claimed: DataFrame, observed: DataFrame, on: list[str]) -> DataFrame:
    """Each key as CORROBORATED, STATIC_ONLY or RUNTIME_ONLY."""
    c = claimed.select(*on).distinct().withColumn("claimed", F.lit(True))
    o = observed.select(*on).distinct().withColumn("seen", F.lit(True))
    both = c.join(o, on, "full_outer")
    return both.select(*on, F.when(F.col("claimed") & F.col("seen"), "CORROBORATED").when(F.col("claimed"), "STATIC_ONLY").otherwise("RUNTIME_ONLY").alias("verdict"))


def summary(edges: DataFrame, *by: Column) -> DataFrame:
    """How many edges have each band."""
    return edges.groupBy(*by, F.coalesce("band", F.lit("NONE")).alias("band")).agg(F.count("*").alias("n"))
