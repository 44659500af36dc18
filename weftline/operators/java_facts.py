"""From syntax facts of Spring code to edges (S9b-S9d, S10, J10, J17). Facts in, edges and residue out."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators.checkpoints import cut
from weftline.operators.graph import CUT_LEVELS
from weftline.operators.ordered import numbered

#: Methods that every repository inherits, and how many arguments each may have.
INHERITED = {
    "count": (0,),
    "delete": (1,),
    "deleteAll": (0, 1),
    "deleteAllById": (1,),
    "deleteAllByIdInBatch": (1,),
    "deleteAllInBatch": (0, 1),
    "deleteById": (1,),
    "existsById": (1,),
    "findAll": (0, 1),
    "findAllById": (1,),
    "findById": (1,),
    "getById": (1,),
    "getOne": (1,),
    "getReferenceById": (1,),
    "save": (1,),
    "saveAll": (1,),
    "saveAllAndFlush": (1,),
    "saveAndFlush": (1,),
}
#: Of those, the methods whose only argument is an id, and those whose only argument is an entity.
BY_ID = ("deleteById", "existsById", "findById", "getById", "getOne", "getReferenceById")
BY_ENTITY = ("delete", "save", "saveAndFlush")
#: First words of derived methods: those that read, write and delete.
DERIVED_READS, DERIVED_WRITES, DERIVED_DELETES = ("find", "get", "read", "count", "exists"), ("save", "insert", "update"), ("delete", "remove")


def snake(field: Column) -> Column:
    return F.lower(F.regexp_replace(field, r"([a-z0-9])([A-Z])", "$1_$2"))


def inherited(method: Column, arity: Column) -> Column:
    """Whether the usual base repository has this method with so many arguments."""
    pairs = [f"{m}/{n}" for m, ns in INHERITED.items() for n in ns]
    return F.concat_ws("/", method, arity.cast("string")).isin(*pairs)


def derived(method: Column) -> Column:
    """READS or WRITES by a method's first word; null for others."""
    begins = lambda words: F.lower(method).rlike("^(" + "|".join(words) + ")")
    return F.when(begins(DERIVED_READS), "READS").when(begins(DERIVED_WRITES + DERIVED_DELETES), "WRITES")


def explicit_query(statement: Column, native: Column) -> Column:
    """Struct (edge_type, target, language, joined) of a query's text; null if it is not one of the forms that prove what is read or written.

    Native SQL must name one table. JPQL must have one root; it may join its root's associations (``alias.attribute``) and, with ON, other entities, which
    are ``joined``; it selects a property, the root, or a tuple of properties.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(statement, r"'(?:[^']|'')*'", "''"), r"\s+", " "))
    # JPQL: FETCH after a join, and NEW with the name of a type before a bracket, say nothing about tables
    silent = r"(?i)(?<=\bjoin) fetch\b|\bnew [^\s()]+ ?(?=\()"
    text = F.when(native, text).otherwise(F.regexp_replace(text, silent, ""))
    find = lambda pattern, i=1: F.regexp_extract(text, pattern, i)
    verb = F.upper(find(r"(?i)^(select|insert|update|delete|from)\b"))
    way = F.when(verb.isin("SELECT", "FROM"), "READS").when(verb.isin("INSERT", "UPDATE", "DELETE"), "WRITES")
    many = text.contains(";") | text.rlike(r"(?i)\b(union|with)\b|\( ?select\b") | text.rlike(r"(?i)\bfrom [\w.$\"]+( (as )?(?!(where|join|left|right|inner|outer|order|group|on|set)\b)\w+)? ?,")
    named = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update) ([\w.$\"]+)"), 1)
    whole = F.when(verb == "SELECT", text.rlike(r"(?i)^select .+ from ")).when(verb == "INSERT", text.rlike(r"(?i)^insert into [\w.$\"]+ ?(\(.*\) ?)?(values|select)\b")).when(verb == "UPDATE", text.rlike(r"(?i)^update .+ set .*=")).otherwise(verb == "DELETE")
    sql = F.when(~many & (verb != "FROM") & whole & (F.size(named) == 1), F.struct(way.alias("edge_type"), F.replace(named[0], F.lit('"'), F.lit("")).alias("target"), F.lit("SQL").alias("language"), F.array().cast("array<string>").alias("joined")))
    root = F.when(verb == "UPDATE", find(r"(?i)^update (\w+)")).when(verb == "DELETE", find(r"(?i)^delete (?:from )?(\w+)")).otherwise(find(r"(?i)\bfrom (\w+)(?= |$)"))
    alias = find(r"(?i)\bfrom \w+ (?:as )?(?!(?:where|join|left|right|inner|outer|order|group)\b)(\w+)")
    joins = F.regexp_extract_all(text, F.lit(r"(?i)\bjoin ([\w.]+(?: (?:as )?(?!on\b)\w+)?(?: on\b)?)"), 1)
    over = lambda j: F.regexp_extract(j, r"^([\w.]+)", 1)
    association = lambda j: F.startswith(over(j), F.concat(alias, F.lit("."))) & (F.size(F.split(over(j), r"\.")) == 2)
    entity = lambda j: over(j).rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & (over(j) != root) & F.lower(j).rlike(r" on$")
    proven = (F.size(joins) == 0) | ((verb.isin("SELECT", "FROM")) & (alias != "") & F.forall(joins, lambda j: association(j) | entity(j)))
    joined = F.array_distinct(F.transform(F.filter(joins, lambda j: ~association(j)), over))
    shown = find(r"(?i)^select (?:distinct )?(.*?) from ")
    projected = (verb != "SELECT") | shown.rlike(r"^\w+(\.\w+)*$") | shown.rlike(r"^\( ?\w+(\.\w+)*( ?, ?\w+(\.\w+)*)* ?\)$")
    shaped = F.when(verb == "UPDATE", text.rlike(r"(?i)\bset .*=")).otherwise(verb.isin("SELECT", "FROM", "DELETE"))
    jpql = F.when(~many & shaped & proven & projected & root.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.struct(way.alias("edge_type"), root.alias("target"), F.lit("JPQL").alias("language"), joined.alias("joined")))
    return F.when(native, sql).otherwise(jpql)


def unique_facts(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """S10d: keys with exactly one value."""
    g = facts.groupBy(*key).agg(F.countDistinct(value).alias("n"), F.min(value).alias(value))
    return g.where(F.col("n") == 1).drop("n")


def entity_columns(fields: DataFrame, supers: DataFrame, columns: DataFrame) -> DataFrame:
    """(entity, table, field, column, code): each entity's own and inherited fields, grounded in the schema.

    fields: (owner, field, explicit); supers: (entity, owner, table) with the entity itself and its mapped superclasses as owners;
    columns: (table, column). An explicit column that is not there is residue; an implied one that is not there is dropped.
    """
    all_ = fields.join(supers, "owner").withColumn("column", F.coalesce("explicit", snake(F.col("field"))))
    known = columns.select("table", "column", F.lit(True).alias("known"))
    out = all_.join(known, ["table", "column"], "left")
    code = F.when(F.col("known").isNull(), "unmapped-entity-column")
    return out.where(F.col("known") | F.col("explicit").isNotNull()).select("entity", "table", "field", "column", code.alias("code"))


def query_columns(methods: DataFrame, grounded: DataFrame) -> DataFrame:
    """Columns that a derived query names: the properties after ``By``, joined by And and Or.

    A property that the entity lacks is residue (unresolved-query-property).
    """
    tail = F.regexp_extract("method", r"By([A-Z]\w*?)(OrderBy\w*)?$", 1)
    parts = F.transform(F.filter(F.split(tail, r"(?<=[a-z0-9])(And|Or)(?=[A-Z])"), lambda p: p != ""), lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 999)))
    each = methods.select("entity", "method", F.explode(parts).alias("field"))
    out = each.join(grounded.where(F.col("code").isNull()).select("entity", "field", "column"), ["entity", "field"], "left")
    return out.select("entity", "method", "field", "column", F.when(F.col("column").isNull(), "unresolved-query-property").alias("code"))


def resolve_operations(invocations: DataFrame, methods: DataFrame) -> DataFrame:
    """Invocations with ``way`` (READS or WRITES) or ``op_code``, and the target of an explicit query.

    invocations: (receiver, method, arity, base, entity, id_type, ...); methods: (receiver, method, arity, mode, parameter_types, query, native,
    delegates_to, delegate_arity). A declared method must be the only one of its name and arity, and abstract; a default method that hands on to one such
    counts as that one. An inherited method that is declared again must have the very types.
    """
    key = ["receiver", "method", "arity"]
    one = methods.groupBy(*key).agg(F.count("*").alias("n_methods"), F.min(F.struct("mode", "parameter_types", "query", "native", "delegates_to", "delegate_arity")).alias("m"))
    own = one.select(*key, "n_methods", "m")
    handed = one.where((F.col("n_methods") == 1) & (F.col("m.mode") == "abstract-interface")).select("receiver", F.col("method").alias("to_method"), F.col("arity").alias("to_arity"), F.col("m").alias("to"))
    j = invocations.join(own, key, "left")
    default = F.col("m.mode") == "default"
    j = j.withColumn("to_method", F.when(default, F.col("m.delegates_to"))).withColumn("to_arity", F.when(default, F.col("m.delegate_arity"))).join(handed, ["receiver", "to_method", "to_arity"], "left")
    j = j.withColumn("d", F.coalesce("to", F.when(F.col("m.mode") == "abstract-interface", F.col("m")))).withColumn("called", F.when(F.col("to").isNotNull(), F.col("to_method")).otherwise(F.col("method"))).withColumn("with", F.when(F.col("to").isNotNull(), F.col("to_arity")).otherwise(F.col("arity")))
    q = explicit_query(F.col("d.query"), F.coalesce("d.native", F.lit(False)))
    asked = F.col("d.query").isNotNull()
    base = F.coalesce(F.col("base") == "JPA", F.lit(False))
    given = inherited(F.col("called"), F.col("with")) & base
    expected = F.when(F.col("called").isin(*BY_ID), F.col("id_type")).when(F.col("called").isin(*BY_ENTITY), F.col("entity"))
    again = (F.size("d.parameter_types") == 0) | F.coalesce(F.col("d.parameter_types") == F.array(expected), F.lit(False))
    declared = F.col("n_methods").isNotNull()
    code = (
        F.when(F.col("n_methods") > 1, "ambiguous-operation-overload").when(declared & F.col("d").isNull(), "unsupported-operation").when(declared & given & ~again, "ambiguous-operation-overload")
        .when(asked & q.isNull(), "unsupported-query").when(~declared & ~given & (F.col("method") == "flush") & (F.col("arity") == 0) & base, "ignored-repository-operation")
        .when((~declared & ~given) | (~asked & derived(F.col("called")).isNull()), "unsupported-operation")
    )
    return j.withColumn("q", F.when(asked, q)).withColumn("op_code", code).withColumn("way", F.when(F.col("op_code").isNull(), F.coalesce("q.edge_type", derived(F.col("called"))))).drop("m", "d", "to", "to_method", "to_arity", "n_methods", "called", "with")


def compile_edges(invocations: DataFrame, repositories: DataFrame, tables: DataFrame, methods: DataFrame) -> DataFrame:
    """Invocation > repository > entity > table > operation, as an edge or the first step that fails.

    invocations: (caller, receiver, method, arity, path, line); repositories: (receiver, entity, id_type, base), of which several entities are
    ambiguous; tables: (entity, table); methods as in ``resolve_operations``. A query on another entity goes to that entity's table, if it has one; a native
    query on another table is a conflict.
    """
    known = repositories.groupBy("receiver").agg(F.countDistinct("entity").alias("n"), F.min(F.struct("entity", "id_type", "base")).alias("r")).select("receiver", "n", "r.entity", "r.id_type", "r.base")
    mapped = tables.groupBy("entity").agg(F.countDistinct("table").alias("k"), F.min("table").alias("table"))
    j = invocations.join(known, "receiver", "left").join(mapped, "entity", "left")
    j = resolve_operations(j, methods)
    others = mapped.where(F.col("k") == 1).select(F.col("entity").alias("asked"), F.col("table").alias("other"))
    j = j.withColumn("asked", F.when(F.col("q.language") == "JPQL", F.col("q.target"))).join(others, "asked", "left")
    sql = F.col("q.language") == "SQL"
    conflict = F.when(sql, F.lower("q.target") != F.lower("table")).otherwise((F.col("asked") != F.col("entity")) & F.col("other").isNull())
    code = (
        F.when(F.col("n").isNull(), "unknown-repository").when(F.col("n") > 1, "ambiguous-repository").when(F.col("k").isNull(), "unmapped-entity").when(F.col("k") > 1, "ambiguous-entity-table")
        .when(F.col("op_code").isNotNull(), F.col("op_code")).when(F.coalesce(conflict, F.lit(False)), "query-table-conflict")
    )
    out = j.withColumn("code", code)
    return out.select("caller", "method", F.when(F.col("code").isNull(), F.coalesce("other", "table")).alias("table"), F.when(F.col("code").isNull(), F.col("way")).alias("edge_type"), "code", "path", "line")


def collapse(candidates: DataFrame) -> DataFrame:
    """Equal candidates as one, with all their citations in order."""
    cite = F.concat_ws(":", "path", F.col("line").cast("string"))
    return candidates.groupBy("caller", "table", "edge_type").agg(F.array_join(F.array_sort(F.collect_set(cite)), ",").alias("citations"))


def witnessed(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Edges that an observation of the same table and operation witnesses by a matching field (F16).

    A field matches a column's name, or that without underscores, in any case: two joins by equal names, no pair of them is compared.
    """
    each = observed.select(F.col("table").alias("t"), F.col("operation").alias("o"), F.explode("fields").alias("f"))
    seen = each.select("t", "o", F.lower("f").alias("f")).distinct()
    low, out = F.lower("column"), edges
    for name, flag in ((low, "as_it_is"), (F.replace(low, F.lit("_"), F.lit("")), "plain")):
        same = (F.col("table") == F.col("t")) & (F.col("operation") == F.col("o")) & (name == F.col("f"))
        out = out.join(seen.withColumn(flag, F.lit(True)), same, "left").drop("t", "o", "f")
    return out.where(F.coalesce("as_it_is", "plain", F.lit(False))).drop("as_it_is", "plain")


def changelog_order(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, at) in the order of a depth-first walk from the files that none includes; each file once.

    includes: (file, child, position). ``at`` is the path of positions; the first of several paths counts.
    """
    roots = files.join(includes.select(F.col("child").alias("file")).distinct(), "file", "left_anti")
    level = roots.select("file", F.array(F.col("file")).alias("at"), F.array("file").alias("seen"))
    out = level
    for depth in itertools.count(1):
        nested = level.join(includes, "file").where(~F.array_contains("seen", F.col("child")))
        level = nested.select(F.col("child").alias("file"), F.concat("at", F.array(F.lpad(F.col("position").cast("string"), 6, "0"))).alias("at"), F.concat("seen", F.array("child")).alias("seen"))
        level = cut(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
        if depth % CUT_LEVELS == 0:
            out = cut(out)
    first = out.groupBy("file").agg(F.min("at").alias("at"))
    return numbered(first.select("file", F.array_join("at", "/").alias("at")), ["at"])
