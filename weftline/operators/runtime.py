"""The runtime plane in batch: adapters, duplicates, sequences, liveness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules

OPENLINEAGE = """struct<eventType:string,eventTime:string,run:struct<runId:string>,job:struct<namespace:string,name:string>,
inputs:array<struct<namespace:string,name:string>>,outputs:array<struct<namespace:string,name:string,
facets:struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>,transformationDescription:string>>>>>>>"""
OTLP = """struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,startTimeUnixNano:string,
attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>>>>>>>"""
#: Event types of a run.
EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "FAIL")
#: Attribute keys of a span.
LINEAGE_KEYS = ("lineage.source.dataset", "lineage.source.field", "lineage.target.dataset", "lineage.target.field")
CONTRACT_KEY, PROFILE_KEY = "lineage.contract.schema_url", "lineage.profile.version"
DB_KEYS = ("db.system.name", "db.namespace", "db.collection.name")
OPERATION_KEY, ADDRESS_KEY, PEER_KEY = "db.operation.name", "server.address", "peer.service"
INTERACTION_KEYS = ("http.route", "rpc.method", "graphql.operation.name", "messaging.destination.name")
#: Channel, keys that it needs, and what joins them; the first whose keys are all there counts.
CHANNELS = (
    ("REST", ("http.request.method", "http.route"), " "),
    ("GRPC", ("rpc.service", "rpc.method"), "/"),
    ("GRAPHQL", ("graphql.operation.type", "graphql.operation.name"), " "),
    ("ASYNC_EVENT", ("messaging.destination.name",), ""),
)
#: The fields of an SDK payload; the actor whose revoked sessions are no evidence.
SDK_FIELDS = ("schemaVersion", "observationId", "sequence", "artifactDigest", "source", "target", "endpoint", "edgeType", "transform", "observedAt")
OWN_ACTOR = "collection-orchestrator"
#: Counters, and fields, of a window manifest.
COUNTERS = ("attempted", "accepted", "rejected", "duplicates", "retried", "buffered", "dropped", "quarantined", "drained")
TEXT_FIELDS = ("manifestId", "windowId", "leaseId", "profileId", "profileVersion", "workloadId", "repo", "environment")
DIGEST_FIELDS = ("artifactDigest", "sourceChecksum", "observationChecksum")
MANIFEST_FIELDS = ("schemaVersion", *TEXT_FIELDS, *DIGEST_FIELDS, "mechanism", "outcome", *COUNTERS, "reasons", "reasonCounts", "emitterCounts", "closedAt")
MECHANISMS = ("OPENLINEAGE", "SDK", "OTEL", "DASK")
OUTCOMES = ("COMPLETE", "INCOMPLETE", "EXPIRED", "REVOKED", "DISABLED")
#: Counters of a producer that must be zero for a complete window.
LOSSES = ("buffered", "rejected", "dropped", "transport_rejected", "retry_exhausted", "enqueue_timeouts", "lease_noops", "internal_errors", "lost_on_restart")
#: An observation's fate, as judged here.
STATUSES = ("ACCEPTED", "DUPLICATE", "CONFLICT", "OUT_OF_SEQUENCE")


def from_openlineage(raw: DataFrame, column: str = "body") -> DataFrame:
    """Events as observations, or as one quarantined row with a reason.

    An output with column lineage gives an ELEMENT observation for each field, its inputs sorted; else one DATASET
    observation over all sorted inputs.
    """
    e = raw.select(F.from_json(column, OPENLINEAGE).alias("e"), column)
    bad = F.when(F.length(column) > 1_000_000, "SOURCE_TOO_LARGE").when(F.col("e").isNull() | ~F.coalesce(F.col("e.eventType").isin(*EVENT_TYPES), F.lit(False)), "EVENT_TYPE").when(F.col("e.run.runId").isNull() | F.col("e.job.name").isNull(), "RUN_OR_JOB").when(F.coalesce(F.size("e.inputs"), F.lit(0)) <= 0, "INPUTS").when(F.coalesce(F.size("e.outputs"), F.lit(0)) <= 0, "OUTPUTS")
    checked = e.withColumn("reason", bad)
    whole = lambda x: F.concat(x["namespace"], F.lit("/"), x["name"])
    out = checked.where(F.col("reason").isNull()).select("e", F.explode("e.outputs").alias("o"))
    fields = F.col("o.facets.columnLineage.fields")
    has = F.coalesce(F.size(fields), F.lit(0)) > 0
    elements = out.where(has).select("e", "o", F.explode(F.map_entries(fields)).alias("f"))
    elements = elements.select(
        F.col("e.run.runId").alias("run_id"), F.lit("ELEMENT").alias("granularity"), whole(F.col("o")).alias("target_dataset"), F.col("f.key").alias("target_field"),
        F.array_join(F.array_sort(F.transform("f.value.inputFields", lambda x: F.concat(whole(x), F.lit("#"), x["field"]))), ",").alias("sources"),
        F.col("f.value.transformationDescription").alias("transform"), F.lit(None).cast("string").alias("reason"),
    )
    none = F.lit(None).cast("string")
    datasets = out.where(~has).select(F.col("e.run.runId").alias("run_id"), F.lit("DATASET").alias("granularity"), whole(F.col("o")).alias("target_dataset"), none.alias("target_field"), F.array_join(F.array_sort(F.array_distinct(F.transform("e.inputs", whole))), ",").alias("sources"), none.alias("transform"), none.alias("reason"))
    refused = checked.where(F.col("reason").isNotNull()).select(F.col("e.run.runId").alias("run_id"), F.lit("QUARANTINED").alias("granularity"), none.alias("target_dataset"), none.alias("target_field"), none.alias("sources"), none.alias("transform"), "reason")
    return elements.unionByName(datasets).unionByName(refused)


def spans(raw: DataFrame, column: str = "body") -> DataFrame:
    """OTLP documents as spans (trace_id, span_id, observed_at, attributes).

    Attributes without a key or a value of a known type are left out; of several with one key the last counts.
    """
    r = raw.select(F.explode(F.from_json(column, OTLP)["resourceSpans"]).alias("r"))
    s = r.select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    pairs = F.transform(F.coalesce("x.attributes", F.array()), lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value")))
    s = s.withColumn("pairs", F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull()))
    keys = F.array_distinct(F.transform("pairs", lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter("pairs", lambda p: p["key"] == k), -1)["value"])
    nanos = F.coalesce(F.expr("try_cast(x.startTimeUnixNano AS DECIMAL(38,0))"), F.lit(0))
    return s.select(F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.timestamp_micros((nanos / 1000).cast("bigint")).alias("observed_at"), F.map_from_arrays(keys, last).alias("attributes"))


def classify_spans(rows: DataFrame, contract: tuple[str, str] | None = None, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The first case that a span's admissible attributes meet.

    plane is ELEMENT, DATASET, INTERACTION, CONNECTIVITY, or REFUSED with a reason. contract: (schema url, profile version) that
    spans with lineage attributes must name; without one all of those are refused. allowed: the attributes that are read; None: all.
    Prohibited attributes are left out before any case is tested; holds_prohibited tells that there were some.
    """
    bad = lambda k, v: rules.span_prohibited(k, v)
    safe = F.map_filter("attributes", lambda k, v: ~bad(k, v))
    if allowed is not None:
        safe = rules.only_allowed(safe, (*allowed, CONTRACT_KEY, PROFILE_KEY))
    rows = rows.withColumn("safe", safe)
    get = lambda k: F.element_at("safe", F.lit(k))
    present = lambda k: F.map_contains_key("safe", F.lit(k))
    every = lambda keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key("safe", k))
    some = lambda keys: F.exists(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key("safe", k))
    full = lambda k: F.coalesce(get(k) != "", F.lit(False))
    channel = operation = F.lit(None).cast("string")
    for name, keys, between in reversed(CHANNELS):
        test = full(keys[0]) if len(keys) == 1 else full(keys[0]) & full(keys[1])
        channel, operation = F.when(test, name).otherwise(channel), F.when(test, F.concat_ws(between, *map(get, keys))).otherwise(operation)
    peer = F.coalesce(F.nullif(get(PEER_KEY), F.lit("")), F.nullif(get(ADDRESS_KEY), F.lit("")))
    unapproved = F.lit(True) if contract is None else ~F.coalesce(get(CONTRACT_KEY) == contract[0], F.lit(False))
    other_version = F.lit(False) if contract is None else ~F.coalesce(get(PROFILE_KEY) == contract[1], F.lit(False))
    lineage, db, called = some(LINEAGE_KEYS), every(DB_KEYS), some(INTERACTION_KEYS)
    reason = (
        F.when(lineage & unapproved, "OTEL_ATTRIBUTE_CONTRACT_UNAPPROVED").when(lineage & other_version, "OTEL_PROFILE_VERSION_UNSUPPORTED").when(lineage & ~every(LINEAGE_KEYS), "OTEL_ATTRIBUTE_CONTRACT_UNAPPROVED")
        .when(~lineage & ~db & called & channel.isNull(), "OTEL_INTERACTION_NOT_MAPPABLE").when(~lineage & ~db & called & peer.isNull(), "OTEL_INTERACTION_TARGET_UNKNOWN")
        .when(~lineage & ~db & ~called & ~present(ADDRESS_KEY), "OTEL_LINEAGE_NOT_MAPPABLE")
    )
    plane = F.when(F.col("reason").isNotNull(), "REFUSED").when(lineage, "ELEMENT").when(db, "DATASET").when(called, "INTERACTION").otherwise("CONNECTIVITY")
    rows = rows.withColumn("reason", reason).withColumn("plane", plane)
    case = F.col("plane")
    return rows.select(
        "trace_id", "span_id", "observed_at", "plane", "reason",
        F.when(case == "INTERACTION", channel).alias("channel"), F.when(case == "INTERACTION", operation).alias("operation"),
        F.when(case == "DATASET", rules.db_edge_type(F.coalesce(get(OPERATION_KEY), F.lit("")))).when(case == "ELEMENT", "DERIVES").when(case == "CONNECTIVITY", "CONNECTS").alias("edge_type"),
        F.when(case == "DATASET", F.concat(get(DB_KEYS[0]), F.lit("://"), get(DB_KEYS[1]), F.lit("/"), get(DB_KEYS[2]))).when(case == "ELEMENT", F.concat_ws("#", get(LINEAGE_KEYS[2]), get(LINEAGE_KEYS[3]))).when(case == "INTERACTION", peer).when(case == "CONNECTIVITY", F.concat(F.lit("https://"), get(ADDRESS_KEY))).alias("target"),
        F.exists(F.map_entries("attributes"), lambda e: bad(e["key"], e["value"])).alias("holds_prohibited"),
    )


def from_legacy_spans(raw: DataFrame, parsers: tuple[str, ...], column: str = "body") -> DataFrame:
    """Spans in the older envelope: CONNECTIVITY, or ELEMENT if an approved parser's field mapping comes with it.

    Refused: OTEL_SHAPE_INVALID without attributes, or with a parser but no mapping; OTEL_PARSER_NOT_APPROVED.
    """
    schema = "struct<attributes:map<string,string>,traceId:string,spanId:string,observedAt:string,parserContract:string,fieldMapping:map<string,string>>"
    e = raw.select(F.from_json(column, schema).alias("e"))
    at = lambda m, k: F.coalesce(F.element_at(F.col(f"e.{m}"), F.lit(k)), F.lit(""))
    parser = F.col("e.parserContract")
    reason = F.when(F.col("e.attributes").isNull(), "OTEL_SHAPE_INVALID").when(parser.isNotNull() & ~parser.isin(*parsers), "OTEL_PARSER_NOT_APPROVED").when(parser.isNotNull() & F.col("e.fieldMapping").isNull(), "OTEL_SHAPE_INVALID")
    ok, mapped = F.col("reason").isNull(), F.col("reason").isNull() & parser.isNotNull()
    return e.withColumn("reason", reason).select(
        F.col("e.spanId").alias("span_id"), "reason", F.when(mapped, "ELEMENT").when(ok, "CONNECTIVITY").alias("granularity"),
        F.when(ok, at("attributes", "lineage.source.dataset")).alias("source_dataset"), F.when(mapped, at("fieldMapping", "sourceField")).alias("source_field"),
        F.when(ok, at("attributes", "lineage.target.dataset")).alias("target_dataset"), F.when(mapped, at("fieldMapping", "targetField")).alias("target_field"),
        F.when(mapped, "DERIVES").when(ok, "CONNECTS").alias("edge_type"), F.when(ok, mapped).alias("exact"),
    )


def from_sdk(raw: DataFrame, column: str = "body") -> DataFrame:
    """SDK payloads as ELEMENT observations, or refused.

    A payload has a target or an endpoint, not both; with an endpoint the source stands as the target too. RUNTIME_PROHIBITED_FIELD,
    RUNTIME_UNKNOWN_FIELD (a field outside the closed schema, at the top or inside), RUNTIME_SHAPE_INVALID.
    """
    schema = "struct<observationId:string,sequence:bigint,source:struct<dataset:string,field:string>,target:struct<dataset:string,field:string>,endpoint:struct<service:string>,edgeType:string,transform:string,observedAt:string>"
    part = lambda k: F.get_json_object(column, f"$.{k}")
    known = lambda json, names: F.size(rules.unknown_fields(json, names)) > 0
    top = F.json_object_keys(column)
    has = lambda k: F.coalesce(F.array_contains(top, k), F.lit(False))
    inside = F.coalesce(known(part("source"), ("dataset", "field")), F.lit(False)) | F.coalesce(known(part("target"), ("dataset", "field")), F.lit(False)) | F.coalesce(known(part("endpoint"), ("service",)), F.lit(False))
    e = raw.withColumn("e", F.from_json(column, schema)).withColumn("bad", rules.prohibited(F.col(column)))
    end = has("endpoint")
    incomplete = F.col("e.source.dataset").isNull() | F.col("e.source.field").isNull() | F.when(end, F.col("e.endpoint.service").isNull()).otherwise(F.col("e.target.dataset").isNull() | F.col("e.target.field").isNull())
    reason = (
        F.when(F.col("bad") == "MALFORMED", "RUNTIME_SHAPE_INVALID").when(F.col("bad").isNotNull(), "RUNTIME_PROHIBITED_FIELD").when(top.isNull(), "RUNTIME_SHAPE_INVALID")
        .when((F.size(rules.unknown_fields(F.col(column), SDK_FIELDS)) > 0) | inside, "RUNTIME_UNKNOWN_FIELD").when(has("target") == end, "RUNTIME_SHAPE_INVALID").when(incomplete, "RUNTIME_SHAPE_INVALID")
    )
    ok = F.col("reason").isNull()
    other = lambda name: F.when(ok, F.when(end, F.col(f"e.source.{name}")).otherwise(F.col(f"e.target.{name}")))
    return e.withColumn("reason", reason).select(
        F.col("e.observationId").alias("observation_id"), "reason", F.when(ok, F.col("e.source.dataset")).alias("source_dataset"), F.when(ok, F.col("e.source.field")).alias("source_field"),
        other("dataset").alias("target_dataset"), other("field").alias("target_field"), F.when(ok, F.col("e.endpoint.service")).alias("endpoint"), F.when(ok, F.col("e.edgeType")).alias("edge_type"),
    )


class Judge:
    """Z2, Z3 for one session: observations in their order of arrival, each a payload of its own.

    A known observation_id is a DUPLICATE if its checksum is the one that was accepted, else a CONFLICT. A sequence that is not above
    the highest accepted one of its dataset is OUT_OF_SEQUENCE, and leaves no trace: the same id may still be accepted later.
    """

    def __init__(self, seen: dict | None = None, high: dict | None = None) -> None:
        self.seen, self.high = seen or {}, high or {}

    def take(self, observation_id: str, dataset: str, sequence: int, checksum: str) -> str:
        known = self.seen.get(observation_id)
        if known is not None:
            return "DUPLICATE" if known == checksum else "CONFLICT"
        if sequence <= self.high.get(dataset, sequence - 1):
            return "OUT_OF_SEQUENCE"
        self.seen[observation_id], self.high[dataset] = checksum, sequence
        return "ACCEPTED"


def deduplicate(observed: DataFrame) -> DataFrame:
    """Z2, Z3 in batch: (session_id, arrival, sequence, observation_id, dataset, status) by ``Judge``.

    Whether an observation is accepted depends on those accepted before it, so a session's rows are read in order of arrival by
    one task; they are streamed, and what is held is the ids of the session at hand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, judge = object(), Judge()
        for batch in batches:
            out = []
            for own, _, sequence, observation_id, dataset, checksum in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != session:
                    session, judge = own, Judge()
                out.append(judge.take(observation_id, dataset, sequence, checksum))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.string())], names=[*batch.schema.names[:5], "status"])

    rows = observed.select("session_id", "arrival", "sequence", "observation_id", "dataset", "checksum")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])
    return rows.repartition("session_id").sortWithinPartitions("session_id", "arrival").mapInArrow(run, f"{kinds}, status string")


def session_outcome(accepted: Column, rejected: Column, closing: Column) -> Column:
    """COMPLETE if all that was expected was accepted and drained, and nothing was rejected, buffered or dropped.

    closing: struct<expected, drained, buffered, dropped>; null for a session that nobody closed.
    """
    whole = closing["drained"] & (accepted == closing["expected"]) & (rejected == 0) & (closing["buffered"] == 0) & (closing["dropped"] == 0)
    return F.when(F.coalesce(whole, F.lit(False)), "COMPLETE").otherwise("INCOMPLETE")


def session_manifest(judged: DataFrame, closings: DataFrame) -> DataFrame:
    """Counters of each session and its outcome. closings: (session_id, expected, drained, buffered, dropped)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counted = judged.groupBy("session_id").agg(F.count("*").alias("attempted"), n("ACCEPTED").alias("accepted"), n("DUPLICATE").alias("duplicates"), n("CONFLICT", "OUT_OF_SEQUENCE").alias("rejected"), F.max("sequence").alias("last_sequence"))
    closed = closings.select("session_id", F.struct("expected", "drained", "buffered", "dropped").alias("closing"))
    return counted.join(closed, "session_id", "left").withColumn("outcome", session_outcome(F.col("accepted"), F.col("rejected"), F.col("closing"))).drop("closing")


def window_close(windows: DataFrame, now: Column) -> DataFrame:
    """A producer window's outcome: its lease's state if that ended it, else COMPLETE if nothing was lost.

    windows: (window_id, lease_state, lease_id, held_lease_id, expires_at, accepted, drained, *LOSSES).
    """
    lost = F.greatest(*[F.col(c) for c in LOSSES]) > 0
    outcome = (
        F.when(F.col("lease_state").isin("DISABLED", "REVOKED", "EXPIRED"), F.col("lease_state")).when(now >= F.col("expires_at"), "EXPIRED").when(F.col("lease_id") != F.col("held_lease_id"), "REVOKED")
        .when((F.col("accepted") == F.col("drained")) & ~lost, "COMPLETE").otherwise("INCOMPLETE")
    )
    return windows.select("window_id", outcome.alias("outcome"))


def watermark(pointers: DataFrame, now: Column, limit_s: int = 300) -> DataFrame:
    """The age of each environment's pointer, and CURRENT, STALE or, without one, NOT_AVAILABLE."""
    age = rules.age_seconds(F.col("updated_at"), now)
    return pointers.select("env", age.alias("age_s"), F.when(age.isNull(), "NOT_AVAILABLE").when(age > limit_s, "STALE").otherwise("CURRENT").alias("watermark"))


def in_group_order(messages: DataFrame, group: list[str], order: str) -> DataFrame:
    """Messages so that one task has all of a group, in order; nothing is gathered."""
    return messages.repartition(*group).sortWithinPartitions(*group, order)


def edge_liveness(edges: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Every edge with how often it was observed, and its liveness; counts are made before the join."""
    counts = observed.groupBy(key).agg(F.count("*").alias("n_observed"))
    return edges.join(counts, key, "left").withColumn("n_observed", F.coalesce("n_observed", F.lit(0))).withColumn("liveness", rules.liveness(F.col("n_observed")))


def evidence_status(artifacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """NOT_PROVIDED, VALIDATED (any complete session) or INCOMPLETE for each artifact.

    sessions: (artifact, outcome, actor). What the engine's own actor revoked is no evidence; other revoked sessions are incomplete ones.
    """
    own = F.coalesce((F.col("outcome") == "REVOKED") & (F.col("actor") == OWN_ACTOR), F.lit(False))
    complete = F.coalesce(F.bool_or(F.col("outcome") == "COMPLETE"), F.lit(False))
    seen = sessions.where(~own).groupBy("artifact").agg(complete.alias("complete"), F.count("*").alias("n_sessions"))
    status = F.when(F.col("n_sessions").isNull(), "NOT_PROVIDED").when(F.col("complete"), "VALIDATED").otherwise("INCOMPLETE")
    return artifacts.join(seen, "artifact", "left").select("artifact", status.alias("status"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"))


def coverage(manifests: DataFrame, by: str) -> DataFrame:
    """QUARANTINED if any manifest is invalid, else INCOMPLETE if any is, else VALIDATED; sums only then."""
    worst = F.max(F.when(F.col("state") == "INVALID", 2).when(F.col("state") == "INCOMPLETE", 1).otherwise(0))
    g = manifests.groupBy(by).agg(worst.alias("worst"), F.sum("accepted").alias("a"))
    return g.select(by, F.when(F.col("worst") == 2, "QUARANTINED").when(F.col("worst") == 1, "INCOMPLETE").otherwise("VALIDATED").alias("state"), F.when(F.col("worst") == 0, F.col("a")).otherwise(0).alias("accepted"))


def manifest_errors(raw: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, errors): the sorted, distinct errors of window manifests, given as JSON.

    A document with other fields than a manifest's has SCHEMA_FIELDS alone. Counters that are not whole numbers from 0 on end the
    examination with INVALID_COUNTERS; else the arithmetic of the counters, of each emitter's and of the reasons is examined too.
    """
    counter = "struct<" + ",".join(f"{c}:string" for c in COUNTERS) + ">"
    schema = f"struct<{','.join(f'{c}:string' for c in MANIFEST_FIELDS if c not in ('reasons', 'reasonCounts', 'emitterCounts'))},reasons:array<string>,reasonCounts:map<string,string>,emitterCounts:map<string,{counter}>>"
    m = raw.select(F.col(key), F.col(column).alias("body"), F.from_json(column, schema).alias("m"))
    field = lambda c: F.col(f"m.{c}")
    text = lambda v: F.coalesce((F.trim(v) != "") & (F.octet_length(v) <= 2048), F.lit(False))
    # numbers come as their text, so that 1.0, "1" and true are told from 1
    raw_number = lambda json: F.coalesce(json.rlike(r"^(0|[1-9][0-9]*)$"), F.lit(False))
    number = lambda v: v.try_cast("bigint")
    n = {c: number(field(c)) for c in COUNTERS}
    quoted = F.col("body").rlike('"(' + "|".join(COUNTERS) + r')"\s*:\s*"')
    bad_counters = reduce(lambda a, b: a | b, [~raw_number(field(c)) for c in COUNTERS]) | quoted
    emitters = F.map_values(field("emitterCounts"))
    whole = lambda e: reduce(lambda a, b: a & b, [raw_number(e[c]) for c in COUNTERS])
    names_ok = F.forall(F.map_keys(field("emitterCounts")), text)
    fits = lambda e: (number(e["attempted"]) == number(e["accepted"]) + number(e["rejected"]) + number(e["duplicates"])) & (number(e["drained"]) <= number(e["accepted"]))
    count = F.coalesce(F.size(field("emitterCounts")), F.lit(0))
    shaped = (count >= 1) & (count <= 128)
    valid = F.filter(emitters, whole)
    total = lambda c: F.aggregate(valid, F.lit(0).cast("bigint"), lambda a, e: a + number(e[c]))
    differ = reduce(lambda a, b: a | b, [total(c) != n[c] for c in COUNTERS])
    reasons, given = field("reasons"), field("reasonCounts")
    distinct = F.size(F.array_distinct(reasons)) == F.size(reasons)
    same = (F.size(F.array_except(reasons, F.map_keys(given))) == 0) & (F.size(F.array_except(F.map_keys(given), reasons)) == 0)
    positive = F.forall(F.map_values(given), lambda v: v.rlike("^[1-9][0-9]*$"))
    reasons_ok = F.coalesce((F.size(reasons) <= 64) & F.forall(reasons, text) & distinct & same & positive, F.lit(False))
    classified = n["rejected"] + n["buffered"] + n["dropped"] + n["quarantined"] + F.when(field("outcome").isin("EXPIRED", "REVOKED", "DISABLED"), 1).otherwise(0)
    told = F.aggregate(F.map_values(given), F.lit(0).cast("bigint"), lambda a, v: a + number(v))
    lost = (n["rejected"] + n["buffered"] + n["dropped"] + n["quarantined"] > 0) | (n["accepted"] != n["drained"]) | (F.coalesce(F.size(reasons), F.lit(0)) > 0) | (F.coalesce(F.size(given), F.lit(0)) > 0)
    complete = F.coalesce(field("outcome") == "COMPLETE", F.lit(False))
    heads = [
        *[(f"INVALID_{c.upper()}", ~text(field(c))) for c in TEXT_FIELDS],
        ("SCHEMA_VERSION", ~field("schemaVersion").eqNullSafe("1.0.0")),
        *[(f"INVALID_{c.upper()}", ~F.coalesce(field(c).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))) for c in DIGEST_FIELDS],
        ("INVALID_MECHANISM", ~F.coalesce(field("mechanism").isin(*MECHANISMS), F.lit(False))),
        ("INVALID_OUTCOME", ~F.coalesce(field("outcome").isin(*OUTCOMES), F.lit(False))),
        ("INVALID_CLOSED_AT", ~F.coalesce(field("closedAt").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.lit(False)) | F.try_to_timestamp(field("closedAt")).isNull()),
        ("INVALID_COUNTERS", bad_counters),
    ]
    sums = [
        ("ATTEMPTED_ARITHMETIC", n["attempted"] != n["accepted"] + n["rejected"] + n["duplicates"]),
        ("DRAINED_ARITHMETIC", n["drained"] > n["accepted"]),
        ("INVALID_EMITTER_COUNTS", ~shaped | ~names_ok | F.exists(emitters, lambda e: ~whole(e))),
        ("INVALID_EMITTER_ARITHMETIC", shaped & F.exists(valid, lambda e: ~fits(e))),
        ("EMITTER_TOTAL_MISMATCH", shaped & differ),
        ("INVALID_REASON_COUNTS", ~reasons_ok),
        ("REASON_TOTAL_MISMATCH", reasons_ok & (told != classified)),
        ("COMPLETE_CONTAINS_LOSS", complete & lost),
        ("INCOMPLETE_WITHOUT_REASON", ~complete & (F.coalesce(F.size(reasons), F.lit(0)) <= 0)),
    ]
    codes = lambda tests, on=None: [F.when(t if on is None else on & t, code) for code, t in tests]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*codes(heads), *codes(sums, ~bad_counters)))))
    keys = F.json_object_keys("body")
    fields = F.array(*map(F.lit, MANIFEST_FIELDS))
    schema_ok = F.coalesce((F.size(F.array_except(keys, fields)) == 0) & (F.size(F.array_except(fields, keys)) == 0), F.lit(False))
    return m.select(key, F.when(schema_ok, found).otherwise(F.array(F.lit("SCHEMA_FIELDS"))).alias("errors"))
