"""Constraints, legal transitions and policy switches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a proposal, and those that may follow.
TRANSITIONS = {
    "IN_REVIEW": ("APPROVED", "REJECTED", "SUPERSEDED"),
    "APPROVED": ("FINALIZED",),
    "REJECTED": (),
    "SUPERSEDED": (),
    "FINALIZED": (),
}
#: Kinds and outcomes of deployment events.
EVENT_TYPES, EVENT_OUTCOMES = ("DEPLOYMENT", "ROLLBACK", "MERGE"), ("SUCCEEDED", "FAILED")
#: Mechanisms, environment classes, install modes and granularities of a runtime profile; the scopes of a kill switch.
PROFILE_MECHANISMS, ENVIRONMENT_CLASSES = ("OPENLINEAGE", "SDK", "OTEL", "DASK"), ("PRODUCTION", "ATDD", "NON_PRODUCTION")
INSTALL_MODES = ("EMBEDDED", "SHARED_COLLECTOR", "SIDECAR", "FRAMEWORK_PLUGIN", "EXISTING_COLLECTOR")
GRANULARITIES = ("CONNECTIVITY", "DATASET", "ELEMENT")
KILL_SCOPES = ("GLOBAL", "ENVIRONMENT", "WORKLOAD", "MECHANISM", "PROFILE", "DATASET")
#: Edge types of an assertion, mechanisms, scopes of a runtime claim.
EDGE_TYPES, MECHANISMS, SCOPES = ("DERIVES", "READS", "WRITES", "CONNECTS"), ("SCA", "LLM", "RUNTIME"), ("DATASET", "ELEMENT")
#: Dispositions of a coverage manifest's scope, and those that a complete one may not have.
DISPOSITIONS = ("completedScope", "reusedScope", "skippedScope", "unsupportedScope", "quarantinedScope", "failedScope")
UNFINISHED = ("unsupportedScope", "quarantinedScope", "failedScope")

def _count(bad: DataFrame, name: str, kind: str) -> DataFrame:
    return bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n")


def foreign_key(rows: DataFrame, column: str, parents: DataFrame, key: str, name: str) -> DataFrame:
    return _count(rows.select(F.col(column).alias("k")).join(parents.select(F.col(key).alias("k")).distinct(), "k", "left_anti"), name, "FOREIGN_KEY")


def unique(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return _count(rows.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1), name, "UNIQUE")


def check(rows: DataFrame, holds: Column, name: str) -> DataFrame:
    return _count(rows.where(~holds), name, "CHECK")


def legal_moves(rows: DataFrame) -> DataFrame:
    """V5: whether a proposal may go from before to after; null if ``before`` is no state of a proposal."""
    pair = F.concat_ws(">", "before", "after")
    legal = pair.isin(*[f"{a}>{b}" for a, to in TRANSITIONS.items() for b in to])
    return rows.withColumn("legal", F.when(F.col("before").isin(*TRANSITIONS), legal))


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state of each proposal after a decision on it: (proposal, state, lock, result).

    proposals: (proposal, state, lock); decisions: (proposal, requested, lock): LOCK_CONFLICT if the decision was made on another version of the
    row, INVALID_TRANSITION if V5 forbids it, NOT_FOUND without the proposal, else APPLIED.
    """
    j = decisions.select("proposal", "requested", F.col("lock").alias("expected")).join(proposals, "proposal", "left")
    legal = legal_moves(j.select("*", F.col("state").alias("before"), F.col("requested").alias("after")))
    result = F.when(F.col("state").isNull(), "NOT_FOUND").when(F.col("lock") != F.col("expected"), "LOCK_CONFLICT").when(~F.coalesce("legal", F.lit(False)), "INVALID_TRANSITION").otherwise("APPLIED")
    done = legal.withColumn("result", result)
    return done.select("proposal", F.when(F.col("result") == "APPLIED", F.col("requested")).otherwise(F.col("state")).alias("state"), (F.col("lock") + (F.col("result") == "APPLIED").cast("int")).alias("lock"), "result")


def _first(tests: list[tuple[str, Column]]) -> Column:
    """The code of the first test that holds; a test that is null holds too."""
    return reduce(lambda c, t: c.when(F.coalesce(t[1], F.lit(True)), t[0]), tests, F)


def deployment_event_error(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, error) of each deployment event; null if it is valid."""
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    succeeded = F.col("outcome") == "SUCCEEDED"
    tests = [
        ("IDENTITY", ~(given("event_id") & given("provider") & given("system") & given("environment") & given("correlation_id") & given("audit_ref"))),
        ("ORDER", (F.col("provider_sequence") < 1) | (F.col("attempt") < 1)),
        ("EVENT_TYPE", ~F.col("event_type").isin(*EVENT_TYPES)),
        ("OUTCOME", ~F.col("outcome").isin(*EVENT_OUTCOMES)),
        ("ROLLBACK_OUTCOME", (F.col("event_type") == "ROLLBACK") & ~succeeded),
        ("ARTIFACT_DIGEST", F.col("event_type").isin("DEPLOYMENT", "ROLLBACK") & succeeded & ~given("artifact_digest")),
        ("OCCURRED_AT", ~F.coalesce(F.col("occurred_at").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.lit(False)) | F.try_to_timestamp("occurred_at").isNull()),
    ]
    return events.select(F.col(key).alias(key), _first(tests).alias("error"))


def profile_error(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """(key, error) of each runtime profile; null if it is valid.

    profiles: schema_version, mechanism, environment_class, identity_strategy, owner, workload, repo, environment, profile_version, package_digest,
    install_mode, criticality, framework struct<name, version_range>, datasets, attributes, parsers, granularities array<string>, buffer
    struct<max_records, max_bytes, drain_timeout_s, enqueue_timeout_ms, max_retries>, overhead struct<cpu_percent, memory_bytes, p95_ms>, canary.
    """
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))

    def names(c: str, empty: bool) -> Column:
        ok = (F.size(F.array_distinct(c)) == F.size(c)) & F.forall(c, lambda x: F.coalesce(x != "", F.lit(False)))
        return F.coalesce(ok & (F.lit(True) if empty else F.size(c) > 0), F.lit(False))

    b, o = (lambda f: F.col(f"buffer.{f}")), (lambda f: F.col(f"overhead.{f}"))
    tests = [
        ("SCHEMA_VERSION", F.col("schema_version") != "1.0.0"),
        ("MECHANISM", ~F.col("mechanism").isin(*PROFILE_MECHANISMS)),
        ("ENVIRONMENT_CLASS", ~F.col("environment_class").isin(*ENVIRONMENT_CLASSES)),
        ("IDENTITY_STRATEGY", F.col("identity_strategy") != "DIGEST"),
        ("IDENTITY", ~(given("profile_id") & given("owner") & given("workload") & given("repo") & given("environment"))),
        ("PROFILE_VERSION", ~F.col("profile_version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")),
        ("PACKAGE_DIGEST", ~F.col("package_digest").rlike("^sha256:[0-9a-f]{64}$")),
        ("INSTALL_MODE", ~F.col("install_mode").isin(*INSTALL_MODES)),
        ("CRITICALITY", ~F.col("criticality").isin("REQUIRED", "OPTIONAL")),
        ("FRAMEWORK", ~(given("framework.name") & given("framework.version_range"))),
        ("DATASETS", ~names("datasets", False)), ("ATTRIBUTES", ~names("attributes", True)), ("PARSERS", ~names("parsers", True)),
        ("GRANULARITY", ~names("granularities", False) | (F.size(F.array_except("granularities", F.array(*map(F.lit, GRANULARITIES)))) > 0)),
        ("BUFFER_BUDGET", (b("max_records") < 1) | (b("max_bytes") < 1) | (b("drain_timeout_s") < 1) | (b("enqueue_timeout_ms") < 0) | (b("max_retries") < 0)),
        ("OVERHEAD_BUDGET", (o("cpu_percent") <= 0) | (o("cpu_percent") > 100) | (o("memory_bytes") < 1) | (o("p95_ms") < 0)),
        ("CANARY", ~F.col("canary").between(0, 100)),
    ]
    return profiles.select(F.col(key).alias(key), _first(tests).alias("error"))


def assertion_error(assertions: DataFrame, key: str = "provenance_id") -> DataFrame:
    """V6: (key, error) of each lineage assertion; null if it is valid.

    assertions: provenance_id, sources, target, edge_type, mechanism, exact, session_complete, scope, transform, line.
    """
    from weftline.functions import names

    text = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    valid = lambda u: F.coalesce(u.rlike(names.URN), F.lit(False))
    runtime = F.col("mechanism") == "RUNTIME"
    tests = [
        ("PROVENANCE_ID", ~text("provenance_id")),
        ("SOURCES", ~F.size("sources").between(1, 64)),
        ("URN", ~(F.forall("sources", valid) & valid(F.col("target")))),
        ("EDGE_TYPE", ~F.col("edge_type").isin(*EDGE_TYPES)),
        ("MECHANISM", ~F.col("mechanism").isin(*MECHANISMS)),
        ("FLAGS", F.col("exact").isNull() | F.col("session_complete").isNull()),
        ("RUNTIME_SCOPE", F.when(runtime, ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False))).otherwise(F.col("scope").isNotNull())),
        ("TRANSFORM", F.col("transform").isNotNull() & ~text("transform")),
        ("CITATION", F.col("line").isNotNull() & ~F.col("line").between(1, 10_000_000)),
    ]
    return assertions.select(F.col(key).alias(key), _first(tests).alias("error"))


def coverage_errors(manifests: DataFrame, key: str = "manifest_id") -> DataFrame:
    """V2, V3: (key, errors) of coverage manifests: (key, state, expectedScope, and each of DISPOSITIONS as array<string>).

    UNACCOUNTED unless every expected path has one disposition (a planned manifest need not); UNFINISHED if a complete one left something.
    """
    listed = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in DISPOSITIONS])
    differ = F.array_sort("expectedScope") != F.array_sort(listed)
    left = reduce(lambda a, b: a | b, [F.coalesce(F.size(c), F.lit(0)) > 0 for c in UNFINISHED])
    found = F.array_compact(F.array(F.when((F.col("state") != "PLANNED") & differ, "UNACCOUNTED"), F.when((F.col("state") == "COMPLETE") & left, "UNFINISHED")))
    return manifests.select(key, found.alias("errors"))


def written_and_removed(added: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Ids that a publication both writes and removes; there must be none."""
    return added.select(key).unionByName(changed.select(key)).distinct().join(removed.select(key), key, "left_semi")


def unsorted_arrays(rows: DataFrame, key: str, column: str) -> DataFrame:
    """V8: rows whose array is not ascending without repeats."""
    return rows.where(~F.coalesce(F.col(column) == F.array_sort(F.array_distinct(column)), F.lit(True))).select(key)


def denied(environment: Column) -> Column:
    """Production is never observed."""
    return F.lower(environment).like("prod%")


def stopped(leases: DataFrame, switches: DataFrame, key: str) -> DataFrame:
    """Leases that active kill switches stop, with those switches, ascending as scope:value.

    leases: (key, environment, workload, mechanism, profile, datasets array<string>); switches: (scope, value, active). Each lease gives the
    few scopes that it is in, which are equi-joined: no OR.
    """
    pair = lambda scope, value: F.struct(F.lit(scope).alias("scope"), value.alias("value"))
    own = F.array(pair("GLOBAL", F.lit("*")), *[pair(c.upper(), F.col(c)) for c in ("environment", "workload", "mechanism", "profile")])
    each = leases.select(key, F.inline(F.concat(own, F.transform(F.array_distinct("datasets"), lambda v: pair("DATASET", v)))))
    hits = each.join(switches.where("active").select("scope", "value").distinct(), ["scope", "value"])
    return hits.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "scope", "value"))), ",").alias("stopped_by"))


def lease_error(requests: DataFrame, profiles: DataFrame, attestations: DataFrame, switches: DataFrame, now: Column, key: str = "request_id") -> DataFrame:
    """Why a lease is refused, the first cause: PROFILE_NOT_FOUND, PROFILE_DISABLED, PRODUCTION, ATTESTATION_MISSING, SCOPE, COLLECTION_DISABLED; else null.

    requests: (key, profile, artifact_digest, environment, workload, mechanism, datasets); profiles: (profile, state, datasets); attestations:
    (profile, artifact_digest, state, expires_at). ``profile`` is id@version.
    """
    p = profiles.select("profile", F.col("state").alias("profile_state"), F.col("datasets").alias("permitted"))
    a = attestations.where((F.col("state") == "APPROVED") & (F.col("expires_at") > now)).select("profile", "artifact_digest", F.lit(True).alias("attested")).distinct()
    j = requests.join(p, "profile", "left").join(a, ["profile", "artifact_digest"], "left").join(stopped(requests, switches, key), key, "left")
    error = (
        F.when(F.col("profile_state").isNull(), "PROFILE_NOT_FOUND").when(F.col("profile_state") != "ENABLED", "PROFILE_DISABLED").when(denied(F.col("environment")), "PRODUCTION")
        .when(F.col("attested").isNull(), "ATTESTATION_MISSING").when(F.size(F.array_except("datasets", "permitted")) > 0, "SCOPE").when(F.col("stopped_by").isNotNull(), "COLLECTION_DISABLED")
    )
    return j.select(key, error.alias("error"))


def identity_conflicts(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """V9: keys with more than one value."""
    return rows.groupBy(*key).agg(F.countDistinct(value).alias("n")).where(F.col("n") > 1)


def disposition(path: Column) -> Column:
    """What source scope makes of a path: selected, skipped or unsupported."""
    nested = path.contains("/")
    return (
        F.when(path.rlike(r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$"), F.when(nested, "skipped").otherwise("selected"))
        .when(path.rlike(r"db/changelog/.*\.xml$"), "selected")
        .when(path.rlike(r"(^|/)src/(test|fixture)[^/]*/.*\.java$"), "skipped")
        .when(path.rlike(r"(^|/)src/main/.*\.java$"), "selected")
        .when(path.rlike(r"db/migration/V[^/]*\.sql$|schema\.sql$"), "selected")
        .when(path.rlike(r"(^|/)(data|user)\.sql$|fixtures?/"), "skipped")
        .when(path.rlike(r"\.(java|sql)$"), "unsupported")
        .otherwise("skipped")
    )
