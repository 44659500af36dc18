"""Rules: identities, normalised transforms, bands, severities and small ladders (Column functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands, weakest first.
BANDS = ("LOWEST", "SINGLE", "MEDIUM", "HIGH", "HIGHEST")
CORROBORATION = ("NONE", "DATASET", "ELEMENT")
#: Changes that break readers.
DESTRUCTIVE = ("COLUMN_DROP", "COLUMN_TYPE_CHANGE", "DATASET_REMOVAL")
OTHER_CHANGES = ("COLUMN_RENAME", "TRANSFORM_CHANGE", "FINGERPRINT_DRIFT")
#: SQL words whose case does not count in a transform, and what a transform's tokens look like.
KEYWORDS = ("AS", "AVG", "CASE", "CAST", "COUNT", "DATE", "ELSE", "END", "MAX", "MIN", "SUM", "THEN", "WHEN")
TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\w\s]"
#: Keys that no runtime payload may have, whatever their case, and marks of secrets in its values.
PROHIBITED_KEYS = ("authorization", "bind", "db.query.text", "db.statement", "literalvalue", "password", "secret", "token", "value", "values")
SECRET_MARKS = ("bearer ", "password=", "secret=", "sk-")
#: The same for a span's attributes, where a part of a key is enough.
SPAN_KEY_PARTS = ("authorization", "credential", "db.query", "db.statement", "header", "parameter", "password", "payload", "secret", "token", "value")
SPAN_SECRET_MARKS = ("bearer ", "password=", "secret=", "sk-", "token=")
#: First words of methods that read, and of those that write.
READ_VERBS = ("find", "get", "read", "query", "count", "exists", "search", "stream")
WRITE_VERBS = ("save", "insert", "update", "delete", "remove", "persist", "flush")
#: Database operations of a span that read, and those that write.
SPAN_READS = ("SELECT", "READ", "GET")
SPAN_WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE", "WRITE", "PUT")


def ordinal(value: Column, names: tuple[str, ...]) -> Column:
    """Place of a name in an ordered vocabulary; null if it is not there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value) - 1, F.lit(-1))


def named(place: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (place + 1).cast("int"))


def normal_transform(text: Column) -> Column:
    """tokens without white space, keywords in lower case."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    return F.array_join(F.transform(tokens, lambda t: F.when(F.upper(t).isin(*KEYWORDS), F.lower(t)).otherwise(t)), "")


def is_escaped(text: Column) -> Column:
    """Whether a text has what a JSON string in ASCII does not hold as it is. Plain searches: a class of all such characters takes some ten times as long."""
    return text.contains('"') | text.contains("\\") | (F.octet_length(text) != F.length(text)) | text.rlike(r"\p{Cntrl}")


def json_text(text: Column) -> Column:
    """The inside of a JSON string in ASCII: quotes, backslashes, control characters and all beyond ASCII are escaped, those beyond 16 bits as two halves."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def escaped(c: Column) -> Column:
        n = F.ascii(c).cast("bigint")
        own = F.when((n < 32) | (n.between(127, 65535)), unit(n)).when(n > 65535, F.concat(unit(F.lit(0xD800) + F.shiftright(n - 65536, 10)), unit(F.lit(0xDC00) + (n - 65536) % 1024)))
        return F.coalesce(*[F.when(c == k, v) for k, v in short.items()], own, c)

    characters = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))
    return F.when(~is_escaped(text), text).otherwise(F.array_join(F.transform(characters, escaped), ""))


def edge_key(sources: Column, target: Column, edge_type: Column) -> Column:
    """identity of an edge, from its canonical JSON. Names that JSON escapes are few: the others are joined as they are."""
    listed = F.array_sort(sources)

    def body(names: Column, text) -> Column:
        return F.concat(F.lit('{"edgeType":"'), text(edge_type), F.lit('","from":["'), F.array_join(names, '","'), F.lit('"],"to":"'), text(target), F.lit('"}'))

    odd = is_escaped(F.concat(F.array_join(listed, ""), target, edge_type))
    whole = F.when(odd, body(F.transform(listed, json_text), json_text)).otherwise(body(listed, lambda c: c))
    return F.concat(F.lit("edge-"), F.substring(F.sha2(whole, 256), 1, 24))


def band(sca: Column, llm: Column, runtime: Column) -> Column:
    """A1: band of a set of mechanisms; null for none."""
    return (
        F.when(sca & llm & runtime, "HIGHEST")
        .when(sca & runtime, "HIGH")
        .when(llm & (sca | runtime), "MEDIUM")
        .when(sca | runtime, "SINGLE")
        .when(llm, "LOWEST")
    )


def severity(change: Column, name: Column) -> Column:
    """BLOCK, WARN or INFO; null for an unknown change or band."""
    at = ordinal(name, BANDS)
    known = change.isin(*DESTRUCTIVE, *OTHER_CHANGES) & at.isNotNull()
    return F.when(known, F.when(change.isin(*DESTRUCTIVE) & (at >= 3), "BLOCK").when(at >= 2, "WARN").otherwise("INFO"))


def hop_severity(hops: Column) -> Column:
    """F21."""
    return F.when(hops == 0, "SOURCE").when(hops == 1, "BREAK").otherwise("WARN")


def displayed(name: Column, provenance: Column) -> Column:
    """(display, percent, signals, last_observed) of a band, from its provenance array<struct<mechanism, observed_at>>.

    Signals are the distinct mechanisms, ascending; only a runtime claim observes. Null for an unknown band.
    """
    mechanisms = F.filter(F.transform(provenance, lambda x: x["mechanism"]), lambda m: m.isNotNull() & (m != ""))
    seen = F.filter(provenance, lambda x: (x["mechanism"] == "RUNTIME") & x["observed_at"].isNotNull())
    return F.when(
        name.isin(*BANDS),
        F.struct(
            F.when(name.isin("HIGHEST", "HIGH"), "VERIFIED").when(name.isin("MEDIUM", "SINGLE"), "PROBABLE").otherwise("INFERRED").alias("display"),
            F.when(name == "HIGHEST", 96).when(name == "HIGH", 92).when(name == "MEDIUM", 78).when(name == "SINGLE", 70).otherwise(55).alias("percent"),
            F.array_sort(F.array_distinct(mechanisms)).alias("signals"),
            F.array_max(F.transform(seen, lambda x: x["observed_at"])).alias("last_observed"),
        ),
    )


def operation(method: Column) -> Column:
    """WRITE, READ or UNKNOWN, by the method's first word."""
    begins = lambda words: F.lower(method).rlike("^(" + "|".join(words) + ")")
    return F.when(begins(WRITE_VERBS), "WRITE").when(begins(READ_VERBS), "READ").otherwise("UNKNOWN")


def db_edge_type(op: Column) -> Column:
    """F18."""
    up = F.upper(op)
    return F.when(up.isin(*SPAN_READS), "READS").when(up.isin(*SPAN_WRITES), "WRITES").otherwise("CONNECTS")


def evidence_class(mechanisms: Column) -> Column:
    """runtime before llm before static."""
    return F.when(F.array_contains(mechanisms, "RUNTIME"), "runtime").when(F.array_contains(mechanisms, "LLM"), "llm").otherwise("static")


def liveness(count: Column) -> Column:
    """A11's ladder."""
    return F.when(count >= 100, "HOT").when(count >= 10, "WARM").when(count >= 1, "COLD").otherwise("UNOBSERVED")


def age_seconds(then: Column, now: Column) -> Column:
    """whole seconds, not below 0; null if either is."""
    age = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(age.isNotNull(), F.greatest(F.lit(0).cast("bigint"), age))


def version_tuple(name: Column) -> Column:
    """``V1_2__x.sql`` as [1, 2]; null for other names."""
    found = F.regexp_extract(name, r"^V([0-9]+(?:[._][0-9]+)*)__.*\.sql$", 1)
    return F.when(found != "", F.transform(F.split(found, "[._]"), lambda s: s.cast("int")))


def stage_number(stage: Column) -> Column:
    """``B7`` as 7."""
    return F.expr("null").cast("int") if stage is None else F.nullif(F.regexp_extract(stage, r"^[A-Z]+([0-9]+)$", 1), F.lit("")).cast("int")


def cursor(*values: Column) -> Column:
    """F32: base64url of a canonical JSON array, without padding."""
    body = F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit('"'), json_text(v.cast("string")), F.lit('"')) for v in values]), F.lit("]"))
    return F.rtrim(F.translate(F.base64(body.cast("binary")), "+/=\r\n", "-_"))


def cursor_values(text: Column, n: int) -> Column:
    """F32: the n texts that a cursor was made of; null for what no cursor of n texts is."""
    plain = F.translate(text, "-_", "+/")
    body = F.try_to_binary(F.rpad(plain, F.length(plain) + F.pmod(-F.length(plain), F.lit(4)), F.lit("=")), F.lit("base64"))
    values = F.from_json(F.when(text.rlike("^[A-Za-z0-9_-]+$"), F.try_validate_utf8(body)), "array<string>")
    return F.when((F.size(values) == n) & ~F.exists(values, lambda v: v.isNull()), values)


#: Final states of a run that need nothing more.
SETTLED = ("NO_LINEAGE_IMPACT", "NO_LINEAGE", "BLOCK", "PASS", "WARN", "REJECTED", "RECONCILED", "PROPOSALS_RAISED")


def run_category(state: Column) -> Column:
    """awaiting, failed, published, settled or running."""
    up = F.upper(state)
    failed = up.contains("FAILED") | up.isin("QUARANTINED", "ROLLED_BACK", "LINEAGE_OUT_OF_SYNC")
    return F.when(up.isin("AWAITING_APPROVAL", "IN_REVIEW"), "awaiting").when(failed, "failed").when(up.isin("PUBLISHED", "PROMOTED"), "published").when(up.isin(*SETTLED), "settled").otherwise("running")


def holds_mark(value: Column, marks: tuple[str, ...] = SECRET_MARKS) -> Column:
    """Whether a text holds the mark of a secret, in any case."""
    low = F.lower(value)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), F.lit(False))


#: A string of canonical JSON with the colon that makes it a key. Between two keys the scan can also begin at the end of a
#: string, but what it takes for a key then begins with a comma or bracket.
_KEY = r'"((?:[^"\\]|\\.)*)":'


def prohibited(json: Column) -> Column:
    """what makes a payload inadmissible, at any depth: MALFORMED, PROHIBITED_FIELD or SECRET_VALUE; null if nothing does."""
    body = F.to_json(F.try_parse_json(json))
    keys = F.transform(F.regexp_extract_all(body, F.lit(_KEY), 1), F.lower)
    values = F.regexp_replace(body, _KEY, ":")
    forbidden = F.arrays_overlap(keys, F.array(*map(F.lit, PROHIBITED_KEYS)))
    return F.when(body.isNull(), "MALFORMED").when(forbidden, "PROHIBITED_FIELD").when(holds_mark(values), "SECRET_VALUE")


def span_prohibited(key: Column, value: Column) -> Column:
    """F22 of a span's attribute: its key has a forbidden part, or its value the mark of a secret."""
    low = F.lower(key)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p) for p in SPAN_KEY_PARTS]), F.lit(False)) | holds_mark(value, SPAN_SECRET_MARKS)


def only_allowed(attributes: Column, allowed: tuple[str, ...]) -> Column:
    """the attributes on an allow-list."""
    return F.map_filter(attributes, lambda k, _: k.isin(*allowed))


def unknown_fields(json: Column, allowed: tuple[str, ...]) -> Column:
    """a document's fields that its closed schema does not have."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed))))
