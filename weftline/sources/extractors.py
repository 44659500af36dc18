"""Extractors that read (path, content) files row by row: Python pipelines, migrations, bindings, Spark jobs, HTTP clients.

Each is a function of one file and a mapInPandas over the files, so files are read in parallel; what cannot be proven
is a residue row (kind ``residue``), never a guess.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import queues, schema_history

EDGE = "path string, line int, kind string, source string, source_field string, target string, target_field string, detail string"


def _over(files: DataFrame, read: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in EDGE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *r) for path, text in zip(frame["path"], frame["content"], strict=True) for r in read(path, text or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, EDGE)


def _text(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def read_python(path: str, text: str) -> list[tuple]:
    """read_dataset(name, elements=[...]) and write_dataset(name, sources=[...], mappings={target: transform})."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return [(e.lineno or 0, "residue", None, None, None, None, "malformed-python")]
    reads: dict[str, tuple[str, list[str]]] = {}
    out: list[tuple] = []
    calls = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            calls.append((node.value, node.targets[0].id))
        elif isinstance(node, ast.Call):
            calls.append((node, None))
    named = {id(c) for c, n in calls if n}
    for call, variable in sorted(calls, key=lambda x: (x[0].lineno, x[1] is None)):
        f = call.func.attr if isinstance(call.func, ast.Attribute) else getattr(call.func, "id", None)
        if f not in ("read_dataset", "write_dataset") or (variable is None and id(call) in named):
            continue
        name = _text(call.args[0]) if call.args else None
        options = {k.arg: k.value for k in call.keywords}
        if name is None:
            out.append((call.lineno, "residue", None, None, None, None, "dynamic-name"))
            continue
        if f == "read_dataset":
            listed = options.get("elements")
            reads[variable or name] = name, [t for e in getattr(listed, "elts", []) if (t := _text(e))]
            continue
        given = [s.id if isinstance(s, ast.Name) else _text(s) for s in getattr(options.get("sources"), "elts", [])]
        known = [reads[s] for s in given if s in reads]
        mappings = options.get("mappings")
        for key, value in zip(getattr(mappings, "keys", []), getattr(mappings, "values", []), strict=True):
            target, transform = _text(key), _text(value)
            if target is None or transform is None:
                out.append((call.lineno, "residue", None, None, name, None, "dynamic-mapping"))
                continue
            # the first identifier that is an element of a source
            hit = next(((d, w) for w in re.findall(r"[A-Za-z_]\w*", transform) for d, elements in known if w in elements), None)
            out.append((call.lineno, "edge", *hit, name, target, transform) if hit else (call.lineno, "residue", None, None, name, target, "unresolved-element"))
    return out


def python_edges(files: DataFrame) -> DataFrame:
    return _over(files, read_python)


_FLAT = "struct<line: int, key: string, value: string>"


def flattened(content: Column) -> Column:
    """The settings of a properties or YAML file, flat or nested: (line, key, value) each, keys joined by dots. Comments, blank lines and list items are left out.

    A fold over the file's own lines: what stands open above a line are the keys without a value that are less indented.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = F.transform(F.split(content, "\n"), lambda raw, i: F.struct((i + 1).alias("line"), F.regexp_replace(F.substring_index(raw, "#", 1), r"\s+$", "").alias("text")))
    kept = F.filter(text, lambda x: (strip(x["text"]) != "") & ~strip(x["text"]).startswith("-"))
    none = F.array().cast(f"array<{_FLAT}>")
    zero = F.struct(F.array().cast("array<struct<indent: int, key: string>>").alias("open"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        bare = strip(x["text"])
        mark = F.when(bare.contains("="), "=").when(bare.contains(":"), ":")
        place = F.when(mark == "=", F.instr(bare, "=")).otherwise(F.instr(bare, ":"))
        key, value = strip(F.substring(bare, F.lit(1), place - 1)), strip(F.substring(bare, place + 1, F.length(bare)))
        indent = F.length(x["text"]) - F.length(F.regexp_replace(x["text"], r"^\s+", ""))
        above = F.filter(s["open"], lambda o: o["indent"] < indent)
        path = F.array_join(F.concat(F.transform(above, lambda o: o["key"]), F.array(key)), ".")
        row = lambda k, v: F.array(F.struct(x["line"].cast("int").alias("line"), k.alias("key"), v.alias("value")))
        nested = mark == ":"
        open_ = F.when(nested & (value == ""), F.concat(above, F.array(F.struct(indent.alias("indent"), key.alias("key"))))).when(nested, above).otherwise(s["open"])
        out = F.when(mark == "=", F.concat(s["out"], row(key, value))).when(nested & (value != ""), F.concat(s["out"], row(path, F.regexp_replace(value, "^['\"]+|['\"]+$", "")))).otherwise(s["out"])
        return F.struct(open_.alias("open"), out.alias("out"))

    return F.aggregate(kept, zero, step, lambda s: s["out"])


def binding_edges(files: DataFrame) -> DataFrame:
    """Stream bindings of properties and YAML: ``-in-N`` reads, ``-out-N`` writes; (path, line, kind, source, target, detail), natively."""
    rows = files.select("path", F.explode(flattened(F.col("content"))).alias("s")).select("path", "s.line", "s.key", "s.value")
    name = F.regexp_extract("key", r"^spring\.cloud\.stream\.bindings\.([^.]+)\.destination$", 1)
    way = F.when(name.rlike(r"-in-\d+|^input$"), "READS").when(name.rlike(r"-out-\d+|^output$"), "WRITES")
    odd = F.when(way.isNull(), "unrecognised-binding-name").when(F.col("value").contains("${"), "dynamic-destination")
    found = rows.where(name != "")
    return found.select("path", "line", F.when(odd.isNull(), "edge").otherwise("residue").alias("kind"), F.when(odd.isNull(), name).alias("source"), F.col("value").alias("target"), F.coalesce(odd, way).alias("detail"))


_METHOD = re.compile(r"(?:public|private|protected|static|\s)+[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*(?:throws [\w, ]+)?\{")


def _argument(text: str, at: int) -> str:
    """From a place inside a call up to the call's closing bracket."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if depth < 0:
                return text[at:i].strip()
    return text[at:].strip()


def read_spark_job(path: str, text: str) -> list[tuple]:
    """By method: the last batch read or first subscription, the sinks, and withColumn mappings."""
    out: list[tuple] = []
    starts = [*((m.start(), m[1]) for m in _METHOD.finditer(text)), (len(text), None)]
    for (a, method), (b, _) in zip(starts[:-1], starts[1:], strict=True):
        body = text[a:b]
        source = None
        for m in re.finditer(r"\.(read|readStream)\(\)", body):
            chain = body[m.end() : (body.find(";", m.end()) + 1 or len(body))]
            named = re.search(r'\.option\("subscribe",\s*"([^"]+)"\)|\.(?:parquet|json|csv|orc|load|table)\("([^"]+)"\)', chain)
            if named and (named[2] or source is None):
                source = named[1] or named[2]
        for m in re.finditer(r"\.(write|writeStream)\(\)", body):
            line = text[: a + m.start()].count("\n") + 1
            chain = body[m.end() : (body.find(";", m.end()) + 1 or len(body))]
            sink = re.search(r'\.(?:parquet|json|csv|orc|save|start|saveAsTable)\("([^"]+)"\)|\.option\("(?:path|topic)",\s*"([^"]+)"\)', chain)
            if not sink or source is None:
                out.append((line, "residue", source, None, None, None, "dynamic-sink" if not sink else "unknown-source"))
                continue
            target = sink[1] or sink[2]
            out.append((line, "edge", source, None, target, None, method))
            for w in re.finditer(r'\.withColumn\("([^"]+)",', body):
                transform = _argument(body, w.end())
                for c in dict.fromkeys(re.findall(r'col\("([^"]+)"\)', transform)):
                    out.append((text[: a + w.start()].count("\n") + 1, "edge", source, c, target, w[1], " ".join(transform.split())))
    return out


def spark_job_edges(files: DataFrame) -> DataFrame:
    return _over(files, read_spark_job)


def http_calls(files: DataFrame) -> DataFrame:
    """Client calls with a literal url (native): service, host and route."""
    calls = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r'\.(?:getForObject|getForEntity|postForObject|exchange|uri)\("([a-z]+://[^"]+)"'), 1)).alias("url"))
    from weftline.functions.names import service_url

    s = service_url(F.col("url"))
    return calls.select("path", "url", s["host"].alias("host"), s["route"].alias("route"))


def replay(files: DataFrame) -> DataFrame:
    """The columns that versioned migrations leave: (table, column, data_type), natively; other files are not read."""
    return migrated(files)[0].select("table", "column", "data_type")


def migrated(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables' columns and the residue of versioned migrations (path, content), each repository by itself if files have that column."""
    name = F.element_at(F.split("path", "/"), -1)
    repository = F.col("repository") if "repository" in files.columns else F.lit("")
    each = files.withColumn("version", rules.version_tuple(name)).where(F.col("version").isNotNull())
    at = F.transform("version", lambda n: F.lpad(n.cast("string"), 20, "0"))
    events, odd = schema_history.ddl(each.select(repository.alias("repository"), "path", F.array(F.array_join(at, ".")).alias("at"), F.col("content").alias("text")))
    left, unknown = schema_history.replayed(events)
    return left, odd.unionByName(unknown)


def ambiguous_versions(files: DataFrame) -> DataFrame:
    """Versions that more than one migration of a repository has."""
    name = rules.version_tuple(F.element_at(F.split("path", "/"), -1))
    rows = files.select("repository", "path", name.alias("version")).where(F.col("version").isNotNull())
    several = rows.groupBy("repository", "version").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(several, ["repository", "version"]).select("repository", "path", F.lit("ambiguous-migration-version").alias("code"))


def pair_projections(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Target and source columns of a statement by position; statements of unequal numbers are residue."""
    t = targets.select("statement", F.posexplode("columns").alias("i", "target"))
    s = sources.select("statement", F.posexplode("columns").alias("i", "source"))
    return t.join(s, ["statement", "i"], "full_outer").select("statement", "i", "target", "source", (F.col("target").isNull() | F.col("source").isNull()).alias("unpaired"))


CATALOG = """snapshotId string, resolverVersion string, datasets array<struct<catalogRef:string,env:string,platform:string,system:string,name:string,aliases:array<string>,kind:string,locator:string,
elements:array<struct<name:string,type:string>>>>"""


def catalog(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The datasets of catalog documents, as ``resolver.resolve`` takes them: (snapshot, ref, env, platform, system, dataset, aliases, elements, kind, locator)."""
    d = spark.read.schema(CATALOG).option("multiLine", multi_line).json(path).select(F.col("snapshotId").alias("snapshot"), F.explode("datasets").alias("d"))
    elements = F.transform("d.elements", lambda e: e["name"])
    return d.select("snapshot", F.col("d.catalogRef").alias("ref"), "d.env", "d.platform", "d.system", F.col("d.name").alias("dataset"), "d.aliases", elements.alias("elements"), "d.kind", "d.locator")


def derivation_edges(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """S6f: shapes (target_table, target_column, source_table, source_column, ...) as DERIVES edges between elements, or residue.

    known: (name, urn, elements) of resolved tables. Either table unknown: unresolved-dataset; a column that its table lacks: unresolved-element.
    """
    side = lambda p: known.select(F.col("name").alias(f"{p}_table"), F.col("urn").alias(f"{p}_urn"), F.col("elements").alias(f"{p}_elements"))
    j = shapes.join(side("source"), "source_table", "left").join(side("target"), "target_table", "left")
    lacks = lambda p: ~F.array_contains(f"{p}_elements", F.col(f"{p}_column"))
    code = F.when(F.col("source_urn").isNull() | F.col("target_urn").isNull(), "unresolved-dataset").when(lacks("source") | lacks("target"), "unresolved-element")
    source, target = (F.concat_ws("#", f"{p}_urn", f"{p}_column") for p in ("source", "target"))
    key = F.when(F.col("code").isNull(), rules.edge_key(F.array(source), target, F.lit("DERIVES")))
    return j.withColumn("code", code).withColumn("edge_key", key).drop("source_urn", "target_urn", "source_elements", "target_elements")


def merged_edges(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, source, document): one row for each source of an edge; a new document replaces the old one, a null one does not."""
    rows = lambda df: df.select(*key, F.explode("sources").alias("source"), "document").groupBy(*key, "source").agg(F.max("document").alias("document"))
    return queues.upsert(rows(old), rows(new), [*key, "source"], ["document"])
