"""Numbering, running totals, and what comes before and after each row, over a whole order, without putting all rows into one task.

Rows are dealt into ranges of the order; each range is numbered by itself, and the totals of the ranges before it are added. Only one row for each
range (and group) is ever put into one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.checkpoints import cut


#: Groups are counted by as many hashes; those of a hash with more rows than CROWD are numbered by ranges, the others by one window.
HASHES = 1 << 16
CROWD = 1_000_000
#: A task that sorts or hashes whole rows takes about as many of them.
ROWS_A_TASK = 500_000


def shares(spark: SparkSession, n: int) -> int:
    """Into how many tasks n rows go, so that a task's memory does not grow with them."""
    return max(spark.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK))


def _hash(by: list) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(HASHES))


def crowds(rows: DataFrame, by: list, most: int | None = None) -> tuple[int, Column | None]:
    """How many rows there are, and whether a row's ``by`` has one of the hashes that more than ``most`` (CROWD, unless given) rows have; none if no hash has."""
    counts = rows.select(_hash(by).alias("h")).groupBy("h").count()
    n, many = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.collect_list(F.when(F.col("count") > (CROWD if most is None else most), F.col("h")))).first()
    return n, _hash(by).isin(many) if many else None


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None, value: str | None = None, name: str = "nth", counted: DataFrame | None = None, once: bool = False) -> DataFrame:
    """rows with the running number (or, with ``value``, the running sum of it) in order, for each group of ``by``.

    order must tell any two rows of a group apart. counted: (by) at least as often as in rows, if that is easier to read than rows are. once: rows may
    come again, which counts once.
    """
    if not by:
        return _ranged(rows.distinct() if once else rows, order, [], value, name)
    _, crowded = crowds(rows if counted is None else counted, by)
    each = F.lit(1).cast("bigint") if value is None else F.col(value)
    # one shuffle serves the repeats and the window
    one = lambda df: (df.repartition(*by).distinct() if once else df).withColumn(name, F.sum(each).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if crowded is None:
        return one(rows)
    rest = rows.where(crowded)
    return one(rows.where(~crowded)).unionByName(_ranged(rest.distinct() if once else rest, order, by, value, name))


def _ranged(rows: DataFrame, order: list[str], by: list[str], value: str | None, name: str) -> DataFrame:
    """``numbered`` for groups of any size. The ranges are checkpointed, so that each row keeps its range."""
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()))
    each = F.lit(1).cast("bigint") if value is None else F.col(value)
    totals = dealt.groupBy(*by, "range_").agg(F.sum(each).alias("total_"))
    # as many rows as there are ranges, and at most two more for each group
    earlier = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range_").alias("range_of"), F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("before_"))
    inside = F.sum(each).over(Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by], F.col("range_") == F.col("range_of"))
    return dealt.withColumn("inside_", inside).join(before, same).withColumn(name, F.col("before_") + F.col("inside_")).select(*rows.columns, name)


def scanned(rows: DataFrame, order: list[str], by: list[str], wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with a column for each of ``wanted``: name: (kind, value), over the order of each group of ``by``.

    kind: lag or lead, the value of the row before or after, null where there is none; high, the greatest value of all rows before, nulls aside. order must tell any two
    rows of a group apart. A group of any size is as many tasks as it has ranges: each range is scanned by itself, and gets from the others one row.
    """
    values = {name: f"{name}_of_" for name in wanted}
    dealt = cut(rows.withColumns({values[name]: F.struct(v.alias("v")) for name, (_, v) in wanted.items()}).repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()))
    place = F.struct(*order)
    whole = {"lag": lambda v: F.max_by(v, place), "lead": lambda v: F.min_by(v, place), "high": lambda v: F.max(F.when(v["v"].isNotNull(), v))}
    totals = dealt.groupBy(*by, "range_").agg(*[whole[kind](F.col(values[name])).alias(f"{name}_all_") for name, (kind, _) in wanted.items()])
    # as many rows as there are ranges, and at most two more for each group
    ranges, inside = Window.partitionBy(*by).orderBy("range_"), Window.partitionBy(*by, "range_").orderBy(*order)
    step = {"lag": lambda c, w: F.lag(c).over(w), "lead": lambda c, w: F.lead(c).over(w), "high": lambda c, w: F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))}
    carried = totals.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range_").alias("range_of"), *[step[kind](F.col(f"{name}_all_"), ranges).alias(f"{name}_far_") for name, (kind, _) in wanted.items()])
    value = lambda name, kind: F.when(F.col(f"{values[name]}.v").isNotNull(), F.col(values[name])) if kind == "high" else F.col(values[name])
    near = dealt.withColumns({f"{name}_near_": step[kind](value(name, kind), inside) for name, (kind, _) in wanted.items()})
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by], F.col("range_") == F.col("range_of"))
    joined = near.join(carried, same)
    take = {"high": lambda n: F.greatest(f"{n}_near_", f"{n}_far_")}
    both = lambda n: F.coalesce(f"{n}_near_", f"{n}_far_")
    return joined.select(*rows.columns, *[take.get(kind, both)(name)["v"].alias(name) for name, (kind, _) in wanted.items()])


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, nth, row) of named tables: their rows, as texts, numbered in the order of all columns; nulls are left out of a row's text. Equal rows follow one another."""
    each = []
    for name, df in tables.items():
        rows = numbered(df, list(df.columns), name="nth_")
        each.append(rows.select(F.lit(name).alias("name"), F.col("nth_").alias("nth"), F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).alias("row")))
    return reduce(DataFrame.unionByName, each)
