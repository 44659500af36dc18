"""Liquibase changelogs in XML, from files to the tables they leave.

The structure of a document is cut at its elements' tags, what an element says is read by Spark's XML functions. Includes are joins: of one file by its path, of all
files under a prefix by the prefixes that each path has. The walk over them is in the order of a depth-first one that reads each file once.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import schema_history
from weftline.operators.checkpoints import cut

#: Changes that leave the tables' columns as they are, without a word (SILENT) and as residue that leaves a replay complete (NEUTRAL).
SILENT = ("createIndex", "dropIndex", "comment", "rollback", "preConditions")
NEUTRAL = (
    "loadData", "loadUpdateData", "addForeignKeyConstraint", "dropForeignKeyConstraint", "addPrimaryKey", "dropPrimaryKey", "addNotNullConstraint", "dropNotNullConstraint", "addDefaultValue", "dropDefaultValue",
    "addUniqueConstraint", "dropUniqueConstraint", "createSequence", "dropSequence", "alterSequence", "tagDatabase",
)

_ATTRIBUTES = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
_ROOT = rf"(?s)<([\w.:-]+){_ATTRIBUTES}>(.*)</\1\s*>\s*$"
_ELEMENT = rf"(?s)<([\w.:-]+){_ATTRIBUTES}(?:/>|>.*?</\1\s*>)"
_SHAPE = "_tableName string, _columnName string, column array<struct<_name: string, _type: string, constraints: struct<_primaryKey: string>>>"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}


def _place(n: Column) -> Column:
    return F.lpad(n.cast("string"), 9, "0")


def _children(xml: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(xml, _ROOT, 2), F.lit(_ELEMENT), 0)


def _tag(xml: Column) -> Column:
    return F.regexp_extract(xml, r"^<(?:[\w.-]+:)?([\w.-]+)", 1)


def _attribute(xml: Column, name: str) -> Column:
    return F.xpath_string(xml, F.lit(f"/*/@{name}"))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (repository, path, xml) of (repository, path, content), without comments, and residue of files that are not XML."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    each = files.withColumn("suffix", kind).withColumn("xml", F.regexp_replace("content", r"(?s)<!--.*?-->", ""))
    parsed = F.from_xml("xml", "any string, corrupt string", _OPTIONS)
    each = each.withColumn("bad", F.col("xml").isNull() | (F.trim("xml") == "") | F.coalesce(parsed["corrupt"].isNotNull(), F.lit(True)))
    odd = F.col("suffix").isin(".yaml", ".yml", ".json")
    told = lambda rows, code, symbol: rows.select("repository", "path", F.lit(code).alias("code"), symbol.alias("symbol"))
    residue = told(each.where(odd), "unsupported-changelog-format", F.col("suffix")).unionByName(told(each.where(~odd & F.col("bad")), "malformed-changelog", F.lit("")))
    return each.where(~odd & ~F.col("bad")).select("repository", "path", "xml"), residue


def elements(documents: DataFrame) -> DataFrame:
    """(repository, path, position, tag, xml): the elements under each document's root, in their order."""
    return documents.select("repository", "path", F.posexplode(_children(F.col("xml"))).alias("position", "xml")).select("repository", "path", "position", _tag(F.col("xml")).alias("tag"), "xml")


def include_steps(parts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (repository, path, child, step) from a file to those it includes, in order of step; and the first kind's (repository, child) alone, known or not."""
    single = parts.where("tag = 'include'").select("repository", "path", _attribute(F.col("xml"), "file").alias("child"), _place(F.col("position")).alias("step"))
    # every prefix of a path is one row: a path is short
    prefixes = documents.select("repository", F.col("path").alias("child"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("prefix"))
    under = parts.where("tag = 'includeAll'").select("repository", "path", _attribute(F.col("xml"), "path").alias("prefix"), _place(F.col("position")).alias("step"))
    under = under.join(prefixes, ["repository", "prefix"]).select("repository", "path", "child", F.concat("step", F.lit("/"), "child").alias("step"))
    return single.unionByName(under), single.select("repository", "child").distinct()


def walk(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """(repository, path, at): each file that roots (repository, path) lead to; ``at`` orders them as a depth-first walk does that enters each file once.

    Of several ways to a file the smallest counts. A way that is not the smallest to where it leads cannot become part of a smaller one, so each round
    follows only those that are new or smaller than before: cycles and diamonds end by themselves.
    """
    best = cut(roots.select("repository", "path", F.array("path").alias("at")))
    front = best
    for _ in itertools.count():
        ways = front.join(steps, ["repository", "path"]).select("repository", F.col("child").alias("path"), F.concat("at", F.array("step")).alias("at")).groupBy("repository", "path").agg(F.min("at").alias("at"))
        known = best.select("repository", "path", F.col("at").alias("was"))
        front = cut(ways.join(known, ["repository", "path"], "left").where(F.col("was").isNull() | (F.col("at") < F.col("was"))).drop("was"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("repository", "path").agg(F.min("at").alias("at")))
    return best


def replay(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables' columns, as ``schema_history.replayed`` has them, and residue (repository, path, code, symbol), of changelogs (repository, path, content)."""
    documents, residue = read(files)
    documents = cut(documents)
    parts = cut(elements(documents))
    steps, included = include_steps(parts, documents)
    roots = documents.select("repository", "path").join(included.withColumnRenamed("child", "path"), ["repository", "path"], "left_anti")
    order = walk(roots, steps)
    lost = order.join(documents.select("repository", "path"), ["repository", "path"], "left_anti").select("repository", "path", F.lit("missing-changelog-include").alias("code"), F.col("path").alias("symbol"))

    sets = parts.where("tag = 'changeSet'").join(order, ["repository", "path"])
    changes = sets.select("repository", "path", "at", "position", F.posexplode(_children(F.col("xml"))).alias("nth", "xml"))
    changes = changes.select("repository", "path", F.concat("at", F.array(_place(F.col("position")), _place(F.col("nth")))).alias("at"), _tag(F.col("xml")).alias("tag"), "xml")
    read_ = changes.withColumn("x", F.from_xml(F.regexp_replace("xml", r"<(/?)[\w.-]+:", "<$1"), _SHAPE, _OPTIONS)).withColumn("table", F.coalesce("x._tableName", F.lit("")))
    text = lambda c: F.coalesce(c, F.lit(""))
    columns = F.coalesce(F.col("x.column"), F.array())
    action = lambda what, name, kind=F.lit(""), primary=F.lit(False): F.struct(F.lit(what).alias("what"), text(name).alias("name"), text(kind).alias("type"), F.coalesce(primary, F.lit(False)).alias("primary"))
    made = F.transform(columns, lambda c: action("add", c["_name"], c["_type"], F.lower(c["constraints"]["_primaryKey"]) == "true"))
    added = F.transform(columns, lambda c: action("add", c["_name"], c["_type"]))
    removed = F.concat(F.array(action("remove", F.col("x._columnName"))), F.transform(columns, lambda c: action("remove", c["_name"])))
    named = F.col("table") != ""
    is_ = lambda *tags: F.col("tag").isin(*tags)
    kind = F.when(is_("createTable") & named, "create").when(is_("addColumn", "dropColumn"), "alter").when(is_("dropTable") & named, "drop")
    actions = F.when(is_("createTable"), made).when(is_("addColumn"), added).when(is_("dropColumn"), removed).otherwise(F.array().cast(f"array<{schema_history.ACTION}>"))
    typed = read_.withColumn("kind", kind)
    events = typed.where(F.col("kind").isNotNull()).select("repository", "table", "at", "path", "kind", actions.alias("actions"), F.lit("unmodelled-changelog-change").alias("missing"), F.col("tag").alias("symbol"))
    code = F.when(is_(*NEUTRAL), "ignored-changelog-change").otherwise("unmodelled-changelog-change")
    odd = typed.where(F.col("kind").isNull() & ~is_("sql", *SILENT)).select("repository", "path", code.alias("code"), F.col("tag").alias("symbol"))
    by_sql, odd_sql = schema_history.ddl(typed.where("tag = 'sql'").select("repository", "path", "at", F.xpath_string("xml", F.lit("/*")).alias("text")))
    left, unknown = schema_history.replayed(events.unionByName(by_sql))
    return left, reduce(DataFrame.unionByName, [residue, lost, odd, odd_sql, unknown])


def complete(files: DataFrame, residue: DataFrame) -> DataFrame:
    """(repository, complete): whether nothing but neutral changes is residue."""
    open_ = residue.where(F.col("code") != "ignored-changelog-change").select("repository").distinct().withColumn("open", F.lit(True))
    return files.select("repository").distinct().join(open_, "repository", "left").select("repository", F.col("open").isNull().alias("complete"))
