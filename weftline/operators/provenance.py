"""What the columns of a statement's common table expressions come from, by joins over projection rows.

A projection row says that output ``position`` of a query (of a branch of it, where it is a union), called ``column``, reads ``source_column`` of ``source``: a table, or another
query of the same statement. What a column comes from is the closure of that relation, ended where tables begin; its steps double each round, so a chain of any depth takes as many
rounds as its length has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.checkpoints import cut

_OWN, _FROM = ["statement", "query", "column"], ["source", "source_column"]


def _named(projections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projections under their output's name, which a union has from its first branch; and those beyond that branch's width.

    Windows, all of which one shuffle by statement (or by statement and query) serves.
    """
    whole, place = Window.partitionBy("statement", "query"), Window.partitionBy("statement", "query", "position")
    keyed = F.col("statement").isNotNull() & F.col("query").isNotNull() & F.col("position").isNotNull()
    first = keyed & (F.col("branch") == F.col("first"))
    own = projections.withColumn("first", F.min("branch").over(whole)).withColumns({"names": F.collect_set(F.when(first, F.col("column"))).over(place), "unnamed": F.max(F.coalesce(first, F.lit(False)) & F.col("column").isNull()).over(place)})
    named = own.select("statement", "query", F.explode("names").alias("column"), *_FROM)
    return named.distinct(), own.where((F.size("names") == 0) | F.col("unnamed")).select(*_OWN, *_FROM)


def _judged(projections: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named projections with inner, whether they read a query, and code; and those beyond a union's width.

    What a statement makes and what it reads are rows beside one another, so that what is read is found by windows, without a join.
    """
    named, wide = _named(projections)
    sides = F.array(F.struct(F.col("query").alias("name"), F.col("column").alias("item"), F.lit(True).alias("made")), F.struct(F.col("source").alias("name"), F.col("source_column").alias("item"), F.lit(False).alias("made")))
    keyed = F.col("statement").isNotNull() & F.col("name").isNotNull()
    beside = named.select(*_OWN, *_FROM, F.inline(sides))
    found = beside.withColumns({"inner": F.max(F.col("made") & keyed).over(Window.partitionBy("statement", "name")), "there": F.max("made").over(Window.partitionBy("statement", "name", "item"))})
    tables = columns.groupBy(F.col("table").alias("source")).agg(F.collect_set("column").alias("held"))
    judged = found.where("NOT made").join(tables, "source", "left")
    inner, lacks = F.col("inner"), ~F.coalesce(F.array_contains("held", F.col("source_column")), F.lit(False))
    code = F.when(inner & ~F.col("there"), "unknown-query-column").when(~inner & F.col("held").isNull(), "unknown-table").when(~inner & lacks, "unknown-table-column")
    return judged.select(*_OWN, *_FROM, inner.alias("inner"), code.alias("code")), wide


def _told(judged: DataFrame, wide: DataFrame) -> DataFrame:
    return judged.where("code IS NOT NULL").select(*_OWN, *_FROM, "code").unionByName(wide.withColumn("code", F.lit("union-width")))


def residue(projections: DataFrame, columns: DataFrame) -> DataFrame:
    """The residue of ``column_provenance`` alone: it is told where it is written, so nothing is walked."""
    return cut(_told(*_judged(projections, columns)))


def column_provenance(projections: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statement, query, column, source, source_column) down to columns of tables, and residue with a code.

    projections: (statement, query, branch, position, column, source, source_column). columns: (table, column) of all known tables. A name of a query of the
    statement hides a table's. Residue is told where it is written: unknown-query-column, unknown-table, unknown-table-column, union-width (a branch has more
    columns than the first). A column that has only residue under it has no row; a query that reads itself ends by itself.
    """
    judged, wide = _judged(projections, columns)
    judged = cut(judged)
    good = judged.where("code IS NULL")
    # reach: what is read over fewer than 2**k queries; steps: the ways over just 2**k, so ways between queries are not kept
    reach, steps = good.where("NOT inner").select(*_OWN, *_FROM), good.where("inner").select(*_OWN, *_FROM)
    size = reach.count()
    on = lambda further: steps.join(further.select("statement", F.col("query").alias("source"), F.col("column").alias("source_column"), F.col("source").alias("next"), F.col("source_column").alias("next_column")), ["statement", *_FROM])
    longer = lambda further: on(further).select(*_OWN, F.col("next").alias("source"), F.col("next_column").alias("source_column"))
    while not steps.isEmpty():
        reach = cut(reach.unionByName(longer(reach)).distinct())
        before, size = size, reach.count()
        # what is not reached yet ends in a way over just 2**k that would be new
        if size == before:
            break
        steps = cut(longer(steps).distinct())
    return reach, _told(judged, wide)
