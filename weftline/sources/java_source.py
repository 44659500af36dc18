"""Syntax facts of Java sources, read by tokens (S9, S11, S12a): types, fields, methods and calls, with their annotations.

Comments and strings are tokens of their own, so nothing inside them is taken for code, and brackets are matched. A file is read by itself, in Arrow
batches on the executors; what facts mean together is left to joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names
from weftline.operators import java_facts

FACT = "path string, kind string, owner string, name string, line int, attributes map<string,string>"
_TOKEN = re.compile(r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>""".*?"""|"(?:[^"\\\n]|\\.)*")|(?P<char>\'(?:[^\'\\\n]|\\.)+\')|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>->|::|.)', re.S)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "default", "synchronized", "native", "strictfp", "transient", "volatile", "sealed"}
_FORMS = {"class", "interface", "enum", "record"}
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "super", "this", "try", "throw", "assert"}
#: Mapping annotations of web handlers, and the method of each.
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
#: Calls of a stream topology, what each does, and the package that a file must import for it.
TOPOLOGY = {"stream": "READS", "table": "READS", "globalTable": "READS", "to": "WRITES"}
STREAMS_PACKAGE = "org.apache.kafka.streams"
#: Repository bases.
BASES = {"JpaRepository": "JPA", "Repository": "MARKER"}


class _Reader:
    def __init__(self, path: str, content: str) -> None:
        self.path, self.facts = path, []
        self.kinds, self.texts, self.lines = [], [], []
        line = 1
        for m in _TOKEN.finditer(content):
            if m.lastgroup != "skip":
                self.kinds.append(m.lastgroup)
                self.texts.append(m[0])
                self.lines.append(line)
            line += m[0].count("\n")
        self.n = len(self.texts)

    def at(self, i: int) -> str:
        return self.texts[i] if 0 <= i < self.n else ""

    def after(self, i: int) -> int:
        """Behind the bracket that closes the one at i; the end if none does."""
        depth = 0
        while i < self.n:
            if self.kinds[i] == "mark":
                depth += self.texts[i] in _CLOSES
                depth -= self.texts[i] in _CLOSES.values()
                if not depth:
                    return i + 1
            i += 1
        return self.n

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """The stretches between commas outside brackets, generic ones too."""
        out, depth, start = [], 0, a
        for i in range(a, b):
            t = self.texts[i] if self.kinds[i] == "mark" else ""
            depth += t in _CLOSES or t == "<"
            depth -= t in _CLOSES.values() or t == ">"
            if t == "," and depth <= 0:
                out.append((start, i))
                start = i + 1
        return [*out, (start, b)] if b > start or out else []

    def literal(self, a: int, b: int) -> str | None:
        """The text of string literals joined by ``+``; None if anything else is there."""
        if b <= a or any(self.kinds[i] != ("text" if (i - a) % 2 == 0 else "mark") for i in range(a, b)) or (b - a) % 2 == 0 or any(self.texts[i] != "+" for i in range(a + 1, b, 2)):
            return None
        return "".join(self.texts[i][3:-3] if self.texts[i].startswith('"""') else self.texts[i][1:-1] for i in range(a, b, 2))

    def fact(self, kind: str, owner: str, name: str, i: int, **attributes: str | None) -> None:
        self.facts.append((self.path, kind, owner, name, self.lines[i], [(k, v) for k, v in attributes.items() if v is not None]))

    def annotations(self, i: int) -> tuple[int, dict[str, dict[str, str]]]:
        """Annotations and modifiers from i on: name, and its literal arguments (``value`` without a name)."""
        found: dict[str, dict[str, str]] = {}
        while i < self.n:
            if self.at(i) == "@" and self.at(i + 1) != "interface":
                i += 1
                while self.at(i + 1) == ".":
                    i += 2
                name, arguments = self.at(i), {}
                i += 1
                if self.at(i) == "(":
                    end = self.after(i)
                    for a, b in self.parts(i + 1, end - 1):
                        key, start = (self.at(a), a + 2) if self.at(a + 1) == "=" else ("value", a)
                        if self.at(start) == "{" and b - start > 1:
                            start, b = start + 1, b - 1
                        text = self.literal(start, b)
                        arguments[key] = text if text is not None else "".join(self.texts[start:b]) if all(self.kinds[k] != "text" for k in range(start, b)) else "?"
                    i = end
                found[name] = arguments
            elif self.at(i) in _MODIFIERS:
                found.setdefault("", {})[self.at(i)] = ""
                i += 1
            else:
                return i, found
        return i, found

    def file(self) -> list[tuple]:
        i = 0
        while i < self.n:
            if self.at(i) in ("import", "package"):
                end = i
                while end < self.n and self.at(end) != ";":
                    end += 1
                self.fact(self.at(i), "", "".join(t for t in self.texts[i + 1 : end] if t != "static"), i)
                i = end + 1
            else:
                i = self.member(i, "", "")
        return self.facts

    def member(self, i: int, owner: str, form: str) -> int:
        """One member of a type (or of the file) from i on; gives where the next begins."""
        begin, (i, notes) = i, self.annotations(i)
        if self.at(i) == "@":
            i += 1  # the declaration of an annotation is read as an interface
        if self.at(i) in _FORMS and self.kinds[i] == "word" and i + 1 < self.n and self.kinds[i + 1] == "word":
            return self.type(i, owner, notes)
        start = i
        while i < self.n and self.at(i) not in ("(", "=", ";", "{", "}"):
            i += 1
        t = self.at(i)
        if t == "(" and i > start and owner:
            return self.method(start, i, owner, form, notes)
        if t in ("=", ";") and i - start > 1 and owner:
            column = (notes.get("Column") or notes.get("JoinColumn") or {}).get("name")
            self.fact("field", owner, self.at(i - 1), i - 1, type="".join(self.texts[start : i - 1]), column=column, annotations=",".join(sorted(k for k in notes if k)))
        while i < self.n and self.at(i) not in (";", "}"):
            i = self.after(i) if self.at(i) in _CLOSES else i + 1
            if t == "{":
                return i
        return max(i + 1, begin + 1)

    def type(self, i: int, owner: str, notes: dict) -> int:
        form, name, line = self.at(i), self.at(i + 1), i
        full = f"{owner}.{name}" if owner else name
        i += 2
        if self.at(i) == "(":  # a record's components
            for a, b in self.parts(i + 1, self.after(i) - 1):
                self.fact("field", full, self.at(b - 1), a, type="".join(self.texts[a : b - 1]), annotations="")
            i = self.after(i)
        heads: dict[str, list[str]] = {"": []}
        word = ""
        while i < self.n and self.at(i) not in ("{", ";"):
            if self.at(i) in ("extends", "implements", "permits") and self.kinds[i] == "word":
                word = self.at(i)
                heads[word] = []
            else:
                heads[word].append(self.at(i))
            i += 1
        request, feign = notes.get("RequestMapping", {}), notes.get("FeignClient", {})
        self.fact(
            "type", owner, full, line, form=form, extends="".join(heads.get("extends", [])) or None, implements="".join(heads.get("implements", [])) or None, annotations=",".join(sorted(k for k in notes if k)),
            table=notes.get("Table", {}).get("name"), route=request.get("value", request.get("path")), client=feign.get("name", feign.get("value")),
        )
        if self.at(i) != "{":
            return i + 1
        end = self.after(i)
        i += 1
        if form == "enum":
            while i < end - 1 and self.at(i) != ";":
                i = self.after(i) if self.at(i) in _CLOSES else i + 1
            i += 1
        while i < end - 1:
            i = self.member(i, full, form)
        return end

    def method(self, start: int, i: int, owner: str, form: str, notes: dict) -> int:
        name, line, end = self.at(i - 1), i - 1, self.after(i)
        types = []
        for a, b in self.parts(i + 1, end - 1):
            a, _ = self.annotations(a)
            types.append("".join(self.texts[a : b - 1]))
        i = end
        while i < self.n and self.at(i) not in ("{", ";", "}"):
            i += 1
        body = self.at(i) == "{"
        mode = "default" if "default" in notes.get("", {}) else "abstract-interface" if form == "interface" and not body else "class"
        query = notes.get("Query", {})
        stop = self.after(i) if body else i + 1
        calls = self.calls(i + 1, stop - 1, owner, f"{name}/{len(types)}") if body else []
        # a default method that only returns a call of its own
        handed = [c for c in calls if c[0] in ("", "this")]
        to = handed[0] if mode == "default" and len(handed) == 1 and self.at(i + 1) == "return" else None
        verb = next((v for k, v in MAPPINGS.items() if k in notes), None) or (notes.get("RequestMapping", {}).get("method", "").rsplit(".", 1)[-1] or None)
        mapped = next((notes[k] for k in (*MAPPINGS, "RequestMapping") if k in notes), None)
        listens = notes.get("KafkaListener", {}).get("topics", notes.get("RabbitListener", {}).get("queues"))
        self.fact(
            "method", owner, name, line, arity=str(len(types)), types="|".join(types), mode=mode, annotations=",".join(sorted(k for k in notes if k)), query=query.get("value"), native="true" if query.get("nativeQuery") == "true" else None,
            to=to and to[1], to_arity=to and str(to[2]), verb=verb, route=None if mapped is None else mapped.get("value", mapped.get("path", "")), listens=listens,
        )
        return stop

    def calls(self, a: int, b: int, owner: str, caller: str) -> list[tuple[str, str, int]]:
        out = []
        for i in range(a, b - 1):
            if self.kinds[i] != "word" or self.at(i + 1) != "(" or self.at(i) in _NO_CALL or self.at(i - 1) == "new":
                continue
            receiver = ""
            if self.at(i - 1) == ".":
                receiver = self.at(i - 2) if self.kinds[i - 2] == "word" else "?"
                if self.at(i - 3) == "." and self.at(i - 4) != "this":
                    receiver = "?"
            end = self.after(i + 1)
            arguments = self.parts(i + 2, end - 1)
            first = self.literal(*arguments[0]) if arguments else None
            self.fact("call", owner, self.at(i), i, receiver=receiver, caller=caller, arity=str(len(arguments)), literal=first, given="true" if arguments else None)
            out.append((receiver, self.at(i), len(arguments)))
        return out


def read_java(path: str, content: str | None) -> list[tuple]:
    """The facts of one file: (path, kind, owner, name, line, attributes). What cannot be read as Java gives what was read up to there."""
    return _Reader(path, content or "").file()


def facts(files: DataFrame) -> DataFrame:
    """The facts of every file (path, content); a null or empty file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
        for batch in batches:
            rows = [f for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in read_java(path, content)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FACT.split(", ")])

    return files.select("path", "content").mapInArrow(run, FACT)


def _of(facts_: DataFrame, kind: str) -> DataFrame:
    return facts_.where(F.col("kind") == kind)


def attribute(name: str) -> Column:
    return F.element_at("attributes", F.lit(name))


def repositories(facts_: DataFrame) -> DataFrame:
    """(receiver, entity, id_type, base): interfaces that extend a repository base of an entity."""
    form = r"\b(" + "|".join(BASES) + r")<([\w$.]+),([\w$.]+)>"
    part = lambda i: F.regexp_extract(attribute("extends"), form, i)
    base = F.when(part(1) == "JpaRepository", BASES["JpaRepository"]).otherwise(BASES["Repository"])
    return _of(facts_, "type").where((attribute("form") == "interface") & attribute("extends").rlike(form)).select(F.col("name").alias("receiver"), part(2).alias("entity"), part(3).alias("id_type"), base.alias("base"))


def tables(facts_: DataFrame) -> DataFrame:
    """(entity, table): entities with the table that they name, else their own name in snake case."""
    held = F.array_contains(F.split(attribute("annotations"), ","), "Entity")
    return _of(facts_, "type").where(held).select(F.col("name").alias("entity"), F.coalesce(attribute("table"), java_facts.snake(F.col("name"))).alias("table"))


def methods(facts_: DataFrame) -> DataFrame:
    types = F.filter(F.split(attribute("types"), r"\|"), lambda t: t != "")
    return _of(facts_, "method").select(
        F.col("owner").alias("receiver"), F.col("name").alias("method"), attribute("arity").cast("int").alias("arity"), attribute("mode").alias("mode"), types.alias("parameter_types"), attribute("query").alias("query"),
        F.coalesce(attribute("native") == "true", F.lit(False)).alias("native"), attribute("to").alias("delegates_to"), attribute("to_arity").cast("int").alias("delegate_arity"),
    )


def invocations(facts_: DataFrame) -> DataFrame:
    """(caller, receiver, method, arity, path, line): calls on fields of their class; the receiver is the field's type."""
    calls = _of(facts_, "call").where(~attribute("receiver").isin("", "?")).select("path", "owner", attribute("receiver").alias("field"), "name", attribute("arity").cast("int").alias("arity"), attribute("caller").alias("caller"), "line")
    fields = _of(facts_, "field").select("path", "owner", F.col("name").alias("field"), attribute("type").alias("type"))
    return calls.join(fields, ["path", "owner", "field"]).select(F.concat_ws("#", "owner", F.regexp_replace("caller", "/.*", "")).alias("caller"), F.col("type").alias("receiver"), F.col("name").alias("method"), "arity", "path", "line")


def spring_edges(facts_: DataFrame) -> DataFrame:
    """From the facts of a code base to its READS and WRITES, or the step that fails; only calls on repositories count."""
    known = repositories(facts_)
    asked = invocations(facts_).join(known.select("receiver").distinct(), "receiver", "left_semi")
    return java_facts.compile_edges(asked, known, tables(facts_), methods(facts_))


def inbound(facts_: DataFrame) -> DataFrame:
    """(channel, operation, handler, path, line) of web handlers and listeners; a Feign client's methods are no handlers."""
    types = _of(facts_, "type").select("path", F.col("name").alias("owner"), attribute("route").alias("prefix"), attribute("client").alias("client"))
    m = _of(facts_, "method").join(types, ["path", "owner"]).where(F.col("client").isNull())
    route = F.when(F.col("prefix").isNull(), attribute("route")).otherwise(names.join_route(F.col("prefix"), attribute("route")))
    handler = F.concat_ws("#", "owner", "name")
    web = m.where(attribute("route").isNotNull()).select(F.lit("REST").alias("channel"), F.concat_ws(" ", F.coalesce(attribute("verb"), F.lit("ANY")), route).alias("operation"), handler.alias("handler"), "path", "line")
    heard = m.where(attribute("listens").isNotNull()).select(F.lit("ASYNC_EVENT").alias("channel"), attribute("listens").alias("operation"), handler.alias("handler"), "path", "line")
    return web.unionByName(heard)


def outbound(facts_: DataFrame) -> DataFrame:
    """(to_service, channel, operation, handler, path, line) of Feign clients' methods."""
    clients = _of(facts_, "type").where(attribute("client").isNotNull()).select("path", F.col("name").alias("owner"), attribute("client").alias("to_service"), attribute("route").alias("prefix"))
    m = _of(facts_, "method").join(clients, ["path", "owner"]).where(attribute("route").isNotNull())
    route = F.when(F.col("prefix").isNull(), attribute("route")).otherwise(names.join_route(F.col("prefix"), attribute("route")))
    return m.select("to_service", F.lit("REST").alias("channel"), F.concat_ws(" ", F.coalesce(attribute("verb"), F.lit("ANY")), route).alias("operation"), F.concat_ws("#", "owner", "name").alias("handler"), "path", "line")


def stream_topology(facts_: DataFrame) -> DataFrame:
    """(path, line, called, method, topic, edge_type, code): topics of stream topologies, in files that import their API; no literal is residue."""
    importing = _of(facts_, "import").where(F.col("name").startswith(STREAMS_PACKAGE)).select("path").distinct()
    calls = _of(facts_, "call").where(F.col("name").isin(*TOPOLOGY) & (attribute("given") == "true")).join(importing, "path", "left_semi")
    way = F.when(F.col("name").isin(*[k for k, v in TOPOLOGY.items() if v == "READS"]), "READS").otherwise("WRITES")
    topic = attribute("literal")
    return calls.select("path", "line", F.col("name").alias("called"), F.regexp_replace(attribute("caller"), "/.*", "").alias("method"), topic.alias("topic"), F.when(topic.isNotNull(), way).alias("edge_type"), F.when(topic.isNull(), "dynamic-destination").alias("code"))
