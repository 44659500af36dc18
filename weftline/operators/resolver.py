"""Resolving raw names against a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(keys: DataFrame, locators: DataFrame, key: str = "key", locator: str = "locator") -> DataFrame:
    """Each key with its longest locator (equal, or followed by ``/``); ties at that length all stay.

    The key's prefixes at ``/`` are exploded and equi-joined, so neither side is compared with all of the other.
    """
    parts = F.split(F.col(key), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = keys.select(key, F.explode(prefixes).alias(locator)).distinct()
    hits = each.join(locators, locator)
    longest = hits.groupBy(key).agg(F.max(F.length(locator)).alias("longest"))
    return hits.join(longest, key).where(F.length(locator) == F.col("longest")).drop("longest")


def resolve(raw: DataFrame, catalog: DataFrame, env: str = "staging") -> DataFrame:
    """Raw (name, platform, system, elements) as RESOLVED, or quarantined with a reason.

    catalog: (ref, platform, system, dataset, aliases, elements). The first tier with a match counts: ref,
    then alias, then (dataset, platform, and system if given). Several matches are AMBIGUOUS, with sorted candidates;
    a requested element that the dataset lacks is UNKNOWN_ELEMENT.
    """
    wanted = raw.select("name", "platform", "system", "elements").distinct()
    by_ref = wanted.join(catalog.select(F.col("ref").alias("name"), "ref"), "name").withColumn("tier", F.lit(1))
    by_alias = wanted.join(catalog.select(F.explode("aliases").alias("name"), "ref"), "name").withColumn("tier", F.lit(2))
    names = catalog.select(F.col("dataset").alias("name"), "platform", F.col("system").alias("own"), "ref")
    by_name = wanted.join(names, ["name", "platform"]).where(F.col("system").isNull() | (F.col("system") == F.col("own"))).drop("own").withColumn("tier", F.lit(3))
    columns = ["name", "platform", "system", "elements", "ref", "tier"]
    hits = by_ref.select(columns).unionByName(by_alias.select(columns)).unionByName(by_name.select(columns)).distinct()
    key = ["name", "platform", "system"]
    best = hits.groupBy(*key, "elements").agg(F.min("tier").alias("tier"), F.collect_set(F.struct("tier", "ref")).alias("all"))
    best = best.withColumn("refs", F.array_sort(F.transform(F.filter("all", lambda x: x["tier"] == F.col("tier")), lambda x: x["ref"])))
    left = wanted.alias("w").join(best.alias("b"), [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key] + [F.col("w.elements") == F.col("b.elements")], "left")
    left = left.select("w.*", "b.tier", "b.refs")
    one = F.when(F.size("refs") == 1, F.col("refs")[0])
    joined = left.withColumn("ref", one).join(catalog.select("ref", F.col("platform").alias("p"), F.col("system").alias("s"), F.col("dataset").alias("d"), F.col("elements").alias("has")), "ref", "left")
    missing = F.array_sort(F.array_except("elements", "has"))
    base = F.concat(F.lit(f"urn:ldp:{env}:"), F.col("p"), F.lit(":"), F.col("s"), F.lit(":"), F.col("d"))
    reason = F.when(F.coalesce(F.size("refs"), F.lit(0)) <= 0, "UNKNOWN_DATASET").when(F.size("refs") > 1, "AMBIGUOUS").when(F.size(missing) > 0, "UNKNOWN_ELEMENT")
    return joined.select(
        "name", "platform", "system",
        F.when(reason.isNull(), "RESOLVED").otherwise("QUARANTINED").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), base).alias("urn"),
        F.when(reason.isNull(), F.array_join(F.transform("elements", lambda e: F.concat(base, F.lit("#"), e)), ",")).alias("element_urns"),
        F.when(reason == "AMBIGUOUS", F.array_join("refs", ",")).alias("candidates"),
        F.when(reason == "UNKNOWN_ELEMENT", F.array_join(missing, ",")).alias("missing"),
    )


def in_vocabulary(rows: DataFrame, column: str, vocabulary: DataFrame, value: str) -> DataFrame:
    """Rows whose value the vocabulary has."""
    return rows.join(vocabulary.select(F.col(value).alias(column)).distinct(), column, "left_semi")
