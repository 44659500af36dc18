"""The workflows' stages, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of each workflow its stage prefix, timeout in seconds, final states, the one after success, the one after an error, and its
#: stages in order: name, timeout in seconds, side effect.
WORKFLOWS = {
    "BASELINE": ("B", 43_200, ("PUBLISHED", "AWAITING_APPROVAL", "NO_LINEAGE", "REJECTED", "QUARANTINED", "FAILED_REDRIVABLE", "FAILED_TERMINAL"), "PUBLISHED", "FAILED_REDRIVABLE", (
        ("ACCEPT_AND_DEDUPLICATE_INTENT", 30, "IDEMPOTENT_WRITE"),
        ("PIN_REPOSITORY_AND_DETERMINANTS", 120, "IDEMPOTENT_WRITE"),
        ("CLASSIFY_REPOSITORY_AND_PATHS", 300, "IDEMPOTENT_WRITE"),
        ("BUILD_COVERAGE_PLAN", 120, "IDEMPOTENT_WRITE"),
        ("RUN_BOUNDED_STATIC_ANALYSIS", 7_200, "IMMUTABLE_WRITE"),
        ("VALIDATE_OPTIONAL_RUNTIME_EVIDENCE", 900, "IMMUTABLE_WRITE"),
        ("ANALYZE_RESIDUE_WITH_POLICY", 3_600, "IMMUTABLE_WRITE"),
        ("CONSOLIDATE_AND_VERIFY_COVERAGE", 1_800, "IDEMPOTENT_WRITE"),
        ("CREATE_PROPOSAL_OR_AUTOPUBLISH_DECISION", 300, "IDEMPOTENT_WRITE"),
        ("STAGE_VERIFY_FENCE_AND_ACTIVATE", 600, "FENCED_WRITE"),
    )),
    "INCREMENTAL": ("I", 1_800, ("PUBLISHED", "AWAITING_APPROVAL", "NO_LINEAGE_IMPACT", "REJECTED", "QUARANTINED", "FAILED_REDRIVABLE", "FAILED_TERMINAL"), "PUBLISHED", "FAILED_REDRIVABLE", (
        ("DEDUPLICATE_AND_PIN_ACTIVE_BASE", 30, "IDEMPOTENT_WRITE"),
        ("COMPUTE_CHANGED_PATHS_AND_CLOSURE", 120, "PURE"),
        ("BUILD_DIFFERENTIAL_COVERAGE_PLAN", 60, "IDEMPOTENT_WRITE"),
        ("FETCH_REQUIRED_IMMUTABLE_ARTIFACTS", 180, "READ_ONLY"),
        ("PROVE_NO_IMPACT_OR_EXTRACT_EVIDENCE", 600, "IMMUTABLE_WRITE"),
        ("VALIDATE_OPTIONAL_RUNTIME_EVIDENCE", 180, "IMMUTABLE_WRITE"),
        ("CONSOLIDATE_DELTAS_AND_TOMBSTONES", 300, "IDEMPOTENT_WRITE"),
        ("RECHECK_BASE_AND_COVERAGE", 60, "READ_ONLY"),
        ("CREATE_DELTA_PROPOSAL", 120, "IDEMPOTENT_WRITE"),
        ("PUBLISH_WITH_FENCED_PROTOCOL", 150, "FENCED_WRITE"),
    )),
    "PR_GATE": ("P", 120, ("PASS", "WARN", "BLOCK"), "PASS", "WARN", (
        ("PIN_SIGNED_PR_HEAD_AND_POLICY", 5, "READ_ONLY"),
        ("FETCH_OR_BUILD_EXACT_CANDIDATE", 30, "READ_ONLY"),
        ("PIN_DEPLOYED_ARTIFACT_AND_GRAPH", 5, "READ_ONLY"),
        ("ANALYZE_RELEVANT_CHANGED_PATHS", 35, "PURE"),
        ("RUN_BOUNDED_IMPACT_TRAVERSAL", 15, "READ_ONLY"),
        ("EVALUATE_VERSIONED_GATE_POLICY", 10, "PURE"),
        ("RECHECK_HEAD_AND_ENVIRONMENT_POINTER", 5, "READ_ONLY"),
        ("UPSERT_STABLE_GITHUB_CHECK", 5, "CHECK_AND_AUDIT_WRITE"),
    )),
    "DEPLOYMENT": ("D", 600, ("PROMOTED", "FAILED_NO_CHANGE", "ROLLED_BACK", "LINEAGE_OUT_OF_SYNC", "FAILED_TERMINAL"), "PROMOTED", "FAILED_TERMINAL", (
        ("AUTHENTICATE_AND_DEDUPLICATE_OUTCOME", 30, "IDEMPOTENT_WRITE"),
        ("ESTABLISH_AUTHORITATIVE_ORDERING", 30, "IDEMPOTENT_WRITE"),
        ("RECORD_ACTUAL_DEPLOYED_DIGEST", 60, "IDEMPOTENT_WRITE"),
        ("RESOLVE_EXACT_APPROVED_LINEAGE_PACKAGE", 120, "READ_ONLY"),
        ("RESERVE_FENCE_AND_PROMOTE", 240, "FENCED_WRITE"),
        ("READ_BACK_AND_VERIFY_CORRELATION", 120, "READ_ONLY"),
    )),
    "NIGHTLY": ("N", 14_400, ("RECONCILED", "PROPOSALS_RAISED", "FAILED_REDRIVABLE", "FAILED_TERMINAL"), "RECONCILED", "FAILED_REDRIVABLE", (
        ("RECONCILE_EVENTS_RECEIPTS_AND_ARCHIVES", 1_800, "IDEMPOTENT_WRITE"),
        ("SAMPLE_PUBLISHED_LINEAGE_AGAINST_CLEAN_ANALYSIS", 7_200, "IMMUTABLE_WRITE"),
        ("VERIFY_PROJECTION_CHECKSUMS", 1_800, "READ_ONLY"),
        ("DRAIN_BOUNDED_STALE_LLM_CACHE", 1_800, "IDEMPOTENT_WRITE"),
        ("EVALUATE_AUTOPUBLISH_AUDIT_SAMPLE", 900, "READ_ONLY"),
        ("EMIT_PROPOSALS_ALERTS_AND_EVIDENCE", 300, "IDEMPOTENT_WRITE"),
    )),
}
#: How often a stage with a side effect is tried, and the class of its retries.
RETRIES = (("PURE", 1, "NONE"), *((effect, 3, "BOUNDED_TRANSIENT") for effect in ("READ_ONLY", "IMMUTABLE_WRITE", "IDEMPOTENT_WRITE", "FENCED_WRITE", "CHECK_AND_AUDIT_WRITE")))


def definitions(spark: SparkSession) -> DataFrame:
    """(kind, prefix, entry, timeout_s, terminals, good, bad)."""
    rows = spark.createDataFrame([(kind, *w[:5]) for kind, w in WORKFLOWS.items()], "kind string, prefix string, timeout_s int, terminals array<string>, good string, bad string")
    return rows.select("kind", "prefix", F.concat("prefix", F.lit("1")).alias("entry"), "timeout_s", "terminals", "good", "bad")


def stages(spark: SparkSession) -> DataFrame:
    """(kind, stage, nth, name, timeout_s, max_attempts, retry_class, side_effect, on_success, on_error, begins_s): what follows a stage is the next row of its workflow."""
    named = spark.createDataFrame([(kind, w[5]) for kind, w in WORKFLOWS.items()], "kind string, own array<struct<name: string, timeout_s: int, side_effect: string>>")
    each = named.select("kind", F.posexplode("own").alias("place", "s")).select("kind", (F.col("place") + 1).alias("nth"), "s.*")
    rows = each.join(definitions(spark).select("kind", "prefix", "good", "bad"), "kind").join(spark.createDataFrame(RETRIES, "side_effect string, max_attempts int, retry_class string"), "side_effect")
    order = Window.partitionBy("kind").orderBy("nth")  # ten stages at most
    rows = rows.withColumn("stage", F.concat("prefix", F.col("nth").cast("string")))
    follows = F.coalesce(F.lead("stage").over(order), F.concat(F.lit("terminal:"), "good"))
    begins = F.sum("timeout_s").over(order) - F.col("timeout_s")
    return rows.select("kind", "stage", "nth", "name", "timeout_s", "max_attempts", "retry_class", "side_effect", F.array(follows).alias("on_success"), F.array(F.concat(F.lit("terminal:"), "bad")).alias("on_error"), begins.cast("int").alias("begins_s"))


def latest_stage(runs: DataFrame) -> DataFrame:
    """Of runs (run_id, kind, elapsed_s) the stage whose time it is, or the state after an error where the workflow's own time is over: (run_id, kind, stage, max_attempts, state)."""
    spark = runs.sparkSession
    # fixed tables
    times = F.broadcast(stages(spark).select("kind", "stage", "nth", "begins_s", "timeout_s", "max_attempts"))
    limits = F.broadcast(definitions(spark).select("kind", F.col("timeout_s").alias("most"), "bad"))
    met = runs.join(limits, "kind").join(times, "kind").where((F.col("begins_s") <= F.col("elapsed_s")) | (F.col("nth") == 1))
    last = met.groupBy("run_id", "kind", "elapsed_s", "most", "bad").agg(F.max(F.struct("nth", "stage", "max_attempts")).alias("s"))
    late = F.col("elapsed_s") > F.col("most")
    return last.select("run_id", "kind", F.when(~late, F.col("s.stage")).alias("stage"), F.when(~late, F.col("s.max_attempts")).alias("max_attempts"), F.when(late, F.col("bad")).otherwise("RUNNING").alias("state"))
