"""Tables as a history of schema changes leaves them.

A change names one table; what it does depends on whether the table is there. So a table's changes are folded in their order, each table by itself: what
is gathered is as long as the history that people wrote for one table of one repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = "struct<name: string, type: string, primary: boolean>"
ACTION = "struct<what: string, name: string, type: string, primary: boolean>"
#: (repository, table, at, path, kind, actions, missing, symbol): kind is create, create_if, drop or alter; missing and symbol: the residue if an altered table is not there.
EVENT = ("repository", "table", "at", "path", "kind", "actions", "missing", "symbol")

_NAME = r"""(?:[\w$]+|"[^"]+"|`[^`]+`)"""
_TABLE = rf"((?:{_NAME}\.)?{_NAME})"
_TYPE = r"(?i)^\s*(double\s+precision|character\s+varying|timestamp\s+with(?:out)?\s+time\s+zone|[a-z_]\w*)(\s*\([^)]*\))?"
#: Commas outside of brackets.
_COMMA = r",(?![^()]*\))"


def bare(name: Column) -> Column:
    """The last part of a qualified name, without quotes."""
    return F.regexp_replace(F.regexp_extract(name, rf"({_NAME})\s*$", 1), '["`]', "")


def _definition(what: str, text: Column) -> Column:
    """A column definition as an action."""
    rest = F.regexp_replace(text, rf"^\s*{_NAME}\s*", "")
    kind = F.regexp_replace(F.upper(F.concat(F.regexp_extract(rest, _TYPE, 1), F.regexp_extract(rest, _TYPE, 2))), r"\s+(?=\()|(?<=[(,])\s+|\s+(?=[),])", "")
    return F.struct(F.lit(what).alias("what"), bare(F.regexp_extract(text, rf"^\s*({_NAME})", 1)).alias("name"), F.regexp_replace(kind, r"\s+", " ").alias("type"), text.rlike(r"(?i)\bprimary\s+key\b").alias("primary"))


def _action(text: Column) -> Column:
    """One action of ALTER TABLE; ``other`` if it is not modelled."""
    plain = lambda what, name: F.struct(F.lit(what).alias("what"), bare(name).alias("name"), F.lit("").alias("type"), F.lit(False).alias("primary"))
    add, drop, touch = (rf"(?i)^\s*{verb}" for verb in (r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?", r"drop\s+(?:column\s+)?(?:if\s+exists\s+)?", r"alter\s+(?:column\s+)?"))
    other = text.rlike(r"(?i)^\s*(?:add|drop)\s+(?:constraint|primary|foreign|unique|check|index|key|partition)\b")
    value = F.when(other, plain("other", F.lit("")))
    value = value.when(text.rlike(add), _definition("add", F.regexp_replace(text, add, "")))
    value = value.when(text.rlike(drop), plain("remove", F.regexp_extract(text, rf"{drop}({_NAME})", 1)))
    return value.when(text.rlike(touch), plain("touch", F.regexp_extract(text, rf"{touch}({_NAME})", 1))).otherwise(plain("other", F.lit("")))


def statements(texts: DataFrame) -> DataFrame:
    """(repository, path, at, sql): the statements of (repository, path, at, text), without comments; ``at`` gets the statement's place."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    split = texts.select("repository", "path", "at", F.posexplode(F.split(plain, ";")).alias("place", "sql")).where(F.trim(F.regexp_replace("sql", r"\s+", " ")) != "")
    return split.select("repository", "path", F.concat("at", F.array(F.lpad(F.col("place").cast("string"), 9, "0"))).alias("at"), F.regexp_replace("sql", r"^\s+|\s+$", "").alias("sql"))


def ddl(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and residue (repository, path, code, symbol), of SQL texts (repository, path, at, text).

    Statements on indexes, views, sequences, schemas, and those that change rows, leave tables as they are. What is not modelled (a rename, a
    constraint of ALTER TABLE, CREATE TABLE AS and the like) is residue, and changes nothing.
    """
    s = statements(texts)
    part = lambda pattern, i: F.regexp_extract("sql", pattern, i)
    create = rf"(?is)^create\s+(?:temp\w*\s+|unlogged\s+)?table\s+(if\s+not\s+exists\s+)?{_TABLE}\s*\((.*)\)[^)]*$"
    drop, alter = rf"(?is)^drop\s+table\s+(?:if\s+exists\s+)?{_TABLE}", rf"(?is)^alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{_TABLE}\s+(.*)$"
    neutral = r"(?is)^(?:create\s+(?:unique\s+)?(?:or\s+replace\s+)?(?:index|database|schema|view|sequence)|drop\s+(?:index|view|sequence)|alter\s+sequence|insert|update|delete)\b"
    constraint = r"(?i)^\s*(?:primary|foreign|unique|constraint|check|exclude|key|index|like)\b"
    verb = F.when(F.col("sql").rlike(create), "create").when(F.col("sql").rlike(drop), "drop").when(F.col("sql").rlike(alter), "alter").when(F.col("sql").rlike(neutral), "neutral").otherwise("other")
    made = F.transform(F.filter(F.split(part(create, 3), _COMMA), lambda x: ~x.rlike(constraint)), lambda x: _definition("add", x))
    changed = F.transform(F.split(part(alter, 2), _COMMA), _action)
    s = s.withColumn("verb", verb)
    s = s.withColumn("actions", F.when(F.col("verb") == "create", made).when(F.col("verb") == "alter", changed).otherwise(F.array().cast(f"array<{ACTION}>")))
    s = s.withColumn("odd", (F.col("verb") == "other") | F.exists("actions", lambda a: a["what"] == "other"))
    name = bare(F.when(F.col("verb") == "create", part(create, 2)).when(F.col("verb") == "drop", part(drop, 1)).otherwise(part(alter, 1)))
    kind = F.when((F.col("verb") == "create") & (part(create, 1) != ""), "create_if").otherwise(F.col("verb"))
    events = s.where(~F.col("odd") & (F.col("verb") != "neutral")).select("repository", name.alias("table"), "at", "path", kind.alias("kind"), "actions", F.lit("unknown-migration-table").alias("missing"), name.alias("symbol"))
    # the odd statement of an unknown table is residue of its own kind only once the table is known; what it is called is all that is told here
    residue = s.where("odd").select("repository", "path", F.lit("unmodelled-migration-statement").alias("code"), F.upper(F.regexp_extract("sql", r"^(\w*)", 1)).alias("symbol"))
    return events.select(*EVENT), residue


def _applied(columns: Column, actions: Column) -> Column:
    new = lambda a: F.array(F.struct(a["name"].alias("name"), a["type"].alias("type"), a["primary"].alias("primary")))
    step = lambda cs, a: F.when(a["what"] == "add", F.concat(cs, new(a))).when(a["what"] == "remove", F.filter(cs, lambda c: c["name"] != a["name"])).otherwise(cs)
    return F.aggregate(actions, columns, step)


def replayed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns (repository, table, nth, column, data_type, primary_key) of the tables that are left, and residue (repository, path, code, symbol).

    A change of a table that is not there, or of a column that it lacks, is residue and changes nothing.
    """
    none = F.array().cast(f"array<{COLUMN}>")
    zero = F.struct(F.lit(False).alias("there"), none.alias("columns"), F.array().cast("array<struct<path: string, code: string, symbol: string>>").alias("residue"))

    def step(s: Column, e: Column) -> Column:
        create = (e["kind"] == "create") | ((e["kind"] == "create_if") & ~s["there"])
        unknown = F.filter(e["actions"], lambda a: (a["what"] == "touch") & ~F.exists(s["columns"], lambda c: c["name"] == a["name"]))
        lost = (e["kind"] == "alter") & (~s["there"] | (F.size(unknown) > 0))
        symbol = F.when(s["there"] & (F.size(unknown) > 0), F.get(unknown, F.lit(0))["name"]).otherwise(e["symbol"])
        there = F.when(create, True).when(e["kind"] == "drop", False).otherwise(s["there"])
        columns = F.when(create, _applied(none, e["actions"])).when(e["kind"] == "drop", none).when((e["kind"] == "alter") & ~lost, _applied(s["columns"], e["actions"])).otherwise(s["columns"])
        told = F.concat(s["residue"], F.when(lost, F.array(F.struct(e["path"].alias("path"), e["missing"].alias("code"), symbol.alias("symbol")))).otherwise(F.array().cast("array<struct<path: string, code: string, symbol: string>>")))
        return F.struct(there.alias("there"), columns.alias("columns"), told.alias("residue"))

    ordered = events.groupBy("repository", "table").agg(F.array_sort(F.collect_list(F.struct("at", "path", "kind", "actions", "missing", "symbol"))).alias("events"))
    done = ordered.select("repository", "table", F.aggregate("events", zero, step).alias("s"))
    columns = done.where("s.there").select("repository", "table", F.posexplode("s.columns").alias("nth", "c"))
    residue = done.select("repository", F.explode("s.residue").alias("r")).select("repository", "r.path", "r.code", "r.symbol")
    return columns.select("repository", "table", "nth", F.col("c.name").alias("column"), F.col("c.type").alias("data_type"), F.col("c.primary").alias("primary_key")), residue


def ddl_facts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S9e: what schema files (repository, path, at, text) declare: (repository, path, statement, table, nth, column, data_type, primary_key), and residue (repository, path, statement, code, symbol).

    Only CREATE TABLE of a plain name declares columns. Indexes and session statements are ignored-schema-statement; a name with a placeholder is dynamic-sql-identifier; all else is unsupported-sql. A
    primary key may be a column's own, or the table's.
    """
    s = statements(texts).withColumn("statement", F.element_at("at", -1).cast("int"))
    create = rf"(?is)^create\s+(?:temp\w*\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?{_TABLE}\s*\((.*)\)[^)]*$"
    constraint = r"(?i)^\s*(?:primary|foreign|unique|constraint|check|exclude|key|index|like)\b"
    parts = F.split(F.regexp_extract("sql", create, 2), _COMMA)
    keys = F.flatten(F.transform(F.filter(parts, lambda x: x.rlike(r"(?i)^\s*(?:constraint\s+\S+\s+)?primary\s+key\b")), lambda x: F.transform(F.split(F.regexp_extract(x, r"\(([^)]*)\)", 1), ","), bare)))
    columns = F.transform(F.filter(parts, lambda x: ~x.rlike(constraint)), lambda x: _definition("add", x))
    made = s.where(F.col("sql").rlike(create)).select("repository", "path", "statement", bare(F.regexp_extract("sql", create, 1)).alias("table"), keys.alias("keys"), F.posexplode(columns).alias("nth", "c"))
    facts = made.select("repository", "path", "statement", "table", "nth", F.col("c.name").alias("column"), F.col("c.type").alias("data_type"), (F.col("c.primary") | F.array_contains("keys", F.col("c.name"))).alias("primary_key"))
    dynamic = F.col("sql").rlike(r"(?is)^create\s+table\s+[^(]*(\$\{|:\w|#\{)")
    code = F.when(dynamic, "dynamic-sql-identifier").when(F.col("sql").rlike(r"(?is)^(?:create\s+(?:unique\s+)?index\b.*\bon\b.*\(.*\)|create\s+(?:database|schema)\b|use\b)"), "ignored-schema-statement").otherwise("unsupported-sql")
    residue = s.where(~F.col("sql").rlike(create)).select("repository", "path", "statement", code.alias("code"), F.upper(F.regexp_extract("sql", r"^(\w*)", 1)).alias("symbol"))
    return facts, residue
