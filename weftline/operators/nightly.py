"""The night's reconciliation from tables (C12, N1 to N6; A25): every step gives one row for each system, and the last turns them into alerts.

Systems are independent, so a night over all of them is a few joins and aggregates, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import publication

_SIDES = ("accepted", "receipt", "archive")
#: Sides are bits 1, 2 and 4: the one that has an id, and the one that lacks it.
DIFFERENCES = {"missing_receipts": (1, 2), "missing_archives": (1, 4), "orphan_receipts": (2, 1), "orphan_archives": (4, 1)}


def event_reconciliation(accepted: DataFrame, receipts: DataFrame, archived: DataFrame, by: list[str], event: str = "event_id") -> DataFrame:
    """Counts of the ids that each side has, their differences, how many ids a side has more than once, and the status, for each ``by``.

    The three tables are one union whose ids are shuffled once. Where the sides come from one table, ``sides_reconciliation`` shuffles its rows once, not thrice.
    """
    tables = [df.select(*by, F.col(event).alias("event_"), F.lit(1 << i).alias("sides")) for i, df in enumerate((accepted, receipts, archived))]
    return sides_reconciliation(reduce(DataFrame.unionByName, tables), by, ["event_"])


def sides_reconciliation(events: DataFrame, by: list[str], event: list[str]) -> DataFrame:
    """``event_reconciliation`` of rows (by, event, sides) that tell of any number of sides: sides is the sum of the bits of those that have the event once more. Each id becomes a mask of the sides that have it."""
    on = lambda c, bit: F.col(c).bitwiseAND(bit) != 0
    count = lambda i: F.sum(on("sides", 1 << i).cast("int"))
    each = events.groupBy(*by, *event).agg(F.bit_or("sides").alias("mask_"), F.greatest(*[count(i) for i in range(3)]).alias("most_"))
    has = lambda bit: on("mask_", bit)
    number = lambda cond: F.sum(cond.cast("bigint"))
    differences = {name: number(has(there) & ~has(lacking)) for name, (there, lacking) in DIFFERENCES.items()}
    out = each.groupBy(*by).agg(*[number(has(1 << i)).alias(f"{side}_count") for i, side in enumerate(_SIDES)], *[c.alias(name) for name, c in differences.items()], number(F.col("most_") > 1).alias("repeated"))
    drift = (F.col("missing_receipts") > 0) | (F.col("missing_archives") > 0) | (F.col("orphan_receipts") > 0)
    return out.withColumn("status", F.when(drift, "DRIFT").otherwise("RECONCILED"))


def bottom_sample(rows: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """For each ``by`` the ``size`` keys of the smallest hashes: the same sample on every run, and a new key changes it by one at most."""
    keys = rows.select(by, key).withColumn("hash_", F.sha2(F.col(key), 256))
    # a key that comes again has its rank again; ranks beyond size are dropped before the shuffle, if there is one
    return keys.withColumn("nth_", F.dense_rank().over(Window.partitionBy(by).orderBy("hash_", key))).where(F.col("nth_") <= size).select(by, key).distinct()


_ROW = ("edge_id", "source", "target", "type")


def row_checksum(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, total): the number of projection rows and the sum of their digests, which no order changes."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(c, F.lit("\1")) for c in _ROW]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(digest).alias("total"))


def projection_drift(clean: DataFrame, projection: DataFrame, scope: DataFrame, pinned: DataFrame, pointers: DataFrame, system: str = "system") -> DataFrame:
    """(system, missing, unexpected, sample_drift, checksum_ok, env_changed).

    clean: rows of a clean consolidation, projection: those published, both (system, edge_id, source, target, type); scope: (system, urn) sampled, rows of either side count where their source
    or target is in it; pinned: (system, n, total) when the night began; pointers: (system, pinned_version, pinned_fence, version, fence).
    """
    # a sample is small: as one row for each system it needs rows by their system only, not by each of their ends
    urns = scope.groupBy(system).agg(F.collect_set("urn").alias("urns_"))

    def inside(rows: DataFrame) -> DataFrame:
        end = lambda c: F.coalesce(F.array_contains("urns_", F.col(c)), F.lit(False))
        return rows.join(urns, system).where(end("source") | end("target")).select(*rows.columns).distinct()

    mark = lambda rows, bit: rows.select(system, *_ROW, F.lit(bit).alias("bit_"))
    both = mark(inside(clean), 1).unionByName(mark(inside(projection), 2)).groupBy(system, *_ROW).agg(F.bit_or("bit_").alias("mask_"))
    drift = both.groupBy(system).agg(F.sum((F.col("mask_") == 1).cast("bigint")).alias("missing"), F.sum((F.col("mask_") == 2).cast("bigint")).alias("unexpected"))
    now = row_checksum(projection, system).select(system, F.col("n").alias("now_n"), F.col("total").alias("now_total"))
    sums = pinned.join(now, system, "full_outer").select(system, (F.col("n").eqNullSafe(F.col("now_n")) & F.col("total").eqNullSafe(F.col("now_total"))).alias("checksum_ok"))
    moved = pointers.select(system, (~(F.col("pinned_version").eqNullSafe(F.col("version")) & F.col("pinned_fence").eqNullSafe(F.col("fence")))).alias("env_changed"))
    out = pointers.select(system).join(drift, system, "left").join(sums, system, "left").join(moved, system)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(system, zero("missing").alias("missing"), zero("unexpected").alias("unexpected"), (zero("missing") + zero("unexpected")).alias("sample_drift"), F.coalesce("checksum_ok", F.lit(True)).alias("checksum_ok"), "env_changed")


def cache_drain(entries: DataFrame, cache: DataFrame, limits: DataFrame, system: str = "system") -> DataFrame:
    """(system, requested, processed, drain_truncated): stale entries are invalidated in the order of their keys, up to each system's limit.

    entries: (system, key, version); cache: (key, version, invalid); limits: (system, cache_limit). A drain is incomplete (drain_truncated) beyond its limit, or where an entry is missing or superseded.
    """
    by = Window.partitionBy(system).orderBy("key")
    ranked = entries.withColumns({"nth_": F.row_number().over(by), "last_": F.lead(F.lit(1)).over(by).isNull()}).join(limits, system)
    # the last one tells how many there are
    some = ranked.withColumn("done_", F.col("nth_") <= F.col("cache_limit")).where(F.col("done_") | F.col("last_")).select(system, "key", "version", "nth_", "done_")
    told = publication.cache_disposition(some, cache, system, "nth_", "done_")
    odd = F.col("done_") & ~F.col("disposition").isin("INVALIDATED", "DUPLICATE")
    results = told.groupBy(system).agg(F.max("nth_").alias("requested"), F.count_if("done_").alias("processed"), F.max(odd.cast("int")).alias("odd_"))
    out = limits.join(results, system, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(system, zero("requested").alias("requested"), zero("processed").alias("processed"), ((zero("requested") > F.col("cache_limit")) | (zero("odd_") > 0)).alias("drain_truncated"))


def publish_audit(samples: DataFrame, system: str = "system") -> DataFrame:
    """(system, samples, unsafe) of audited decisions (system, status, coverage, static_exact, mechanisms)."""
    return samples.groupBy(system).agg(F.count("*").alias("samples"), F.count_if(publication.unsafe()).alias("unsafe"))


def report(events: DataFrame, drift: DataFrame, drain: DataFrame, audit: DataFrame, system: str = "system") -> DataFrame:
    """The checks of each system that N1 to N5 gave, and its alerts, as ``publication.alerts`` has them; night is the system."""
    zero: Column = F.lit(0)
    open_ = events.select(system, (F.col("status") == "DRIFT").cast("int").alias("archive_drift"))
    checks = drift.join(open_, system, "left").join(drain.select(system, "drain_truncated"), system, "left").join(audit.select(system, "unsafe"), system, "left")
    checks = checks.select(F.col(system).alias("night"), F.coalesce("archive_drift", zero).alias("archive_drift"), "sample_drift", "checksum_ok", "env_changed", F.coalesce("drain_truncated", F.lit(False)).alias("drain_truncated"), F.coalesce("unsafe", zero).alias("unsafe"))
    return publication.alerts(checks)
