"""Operational observations and the health that follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import rules

#: The states of a command that is waiting.
WAITING = ("QUEUED", "RUNNING", "RETRY_WAIT", "FAILED_REDRIVABLE")
#: Limits in seconds.
QUEUE_S, BASELINE_S, APPROVAL_S, PUBLISH_S, WATERMARK_S = 60, 86_400, 300, 60, 300


def observations(env: str, commands: DataFrame, attempts: DataFrame, messages: DataFrame, outbox: DataFrame, coverage: DataFrame, proposals: DataFrame, publications: DataFrame, correlated: list[DataFrame]) -> DataFrame:
    """For each ``env`` one row of counts and ages over seven kinds of tables; each is aggregated by itself before they meet.

    commands: (env, status, attempt, created_at); attempts: (env, lease_epoch); messages: (env, status, attempts, published_at); outbox: (env, status,
    created_at); coverage: (env, workflow, state, runtime_status, updated_at, manifest_id); proposals: (env, state, created_at); publications:
    (env, operation_id, outcome, created_at, terminal_at); correlated: tables with (env, correlation_id). A table without rows of an env counts as 0.
    """
    one = lambda df, *aggs: df.groupBy(env).agg(*aggs)
    n = lambda test, name: F.count_if(test).alias(name)
    queued = reduce(DataFrame.unionByName, [
        commands.where(F.col("status").isin(*WAITING)).select(env, F.col("created_at").alias("at")), messages.where(F.col("status").isin("AVAILABLE", "IN_FLIGHT")).select(env, F.col("published_at").alias("at")),
        outbox.where(F.col("status") == "PENDING").select(env, F.col("created_at").alias("at")),
    ])
    whole = F.col("state") == "COMPLETE"
    baseline = F.max_by(F.struct("state", "updated_at"), F.when(F.col("workflow") == "BASELINE", F.struct("updated_at", "manifest_id"))).alias("baseline")
    done = F.max_by(F.struct("created_at", "terminal_at"), F.when(F.col("outcome") == "SUCCEEDED", F.struct("terminal_at", "operation_id"))).alias("published")
    parts = [
        one(queued, F.count("*").alias("queue_depth"), F.min("at").alias("oldest_queued")),
        one(commands, n(F.col("attempt") > 1, "retried_commands"), n(F.col("status") == "FAILED_TERMINAL", "dead_commands")),
        one(messages, n((F.col("attempts") > 1) & (F.col("status") != "DEAD"), "retried_messages"), n(F.col("status") == "DEAD", "dead_messages")),
        one(attempts, n(F.col("lease_epoch") > 1, "lease_steals")),
        one(coverage, F.count("*").alias("manifests"), n(~whole, "incomplete"), n(F.col("runtime_status") == "VALIDATED", "joined"), baseline),
        one(proposals, F.min(F.when(F.col("state") == "IN_REVIEW", F.col("created_at"))).alias("oldest_approval")),
        one(publications, F.min(F.when(F.col("outcome").isNull(), F.col("created_at"))).alias("publishing_since"), done),
        one(reduce(DataFrame.unionByName, [t.select(env, "correlation_id") for t in correlated]), F.count("*").alias("tracked"), n(F.col("correlation_id") == "", "uncorrelated")),
    ]
    out = reduce(lambda a, b: a.join(b, env, "full_outer"), parts)
    count = lambda *cs: reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cs])
    return out.select(
        env, count("queue_depth").alias("queue_depth"), "oldest_queued", count("retried_commands", "retried_messages").alias("retries"), count("dead_commands", "dead_messages").alias("dead_letters"),
        count("lease_steals").alias("lease_steals"), count("manifests").alias("manifests"), count("incomplete").alias("incomplete"), count("joined").alias("joined"), "baseline", "oldest_approval",
        "publishing_since", "published", count("tracked").alias("tracked"), count("uncorrelated").alias("uncorrelated"),
    )


def resilience(observed: DataFrame, projection: DataFrame, env: str, now: Column) -> DataFrame:
    """The seven states that follow from ``observations``, and the overall one.

    projection: (env, sync, watermark_at), see ``queues.sync_status``. OUT_OF_SYNC goes before DEGRADED, which any degraded, incomplete or stale part makes.
    """
    o = observed.join(projection.select(env, "sync", "watermark_at"), env, "left")
    age = lambda c: rules.age_seconds(c, now)
    over = lambda a, limit: F.coalesce(a > limit, F.lit(False))
    queue = F.when((F.col("retries") > 0) | (F.col("dead_letters") > 0) | (F.col("lease_steals") > 0) | over(age(F.col("oldest_queued")), QUEUE_S), "DEGRADED").otherwise("HEALTHY")
    coverage = F.when(F.col("manifests") == 0, "NOT_AVAILABLE").when(F.col("incomplete") > 0, "INCOMPLETE").otherwise("COMPLETE")
    runtime = F.when(F.col("manifests") == 0, "NOT_AVAILABLE").when(F.col("joined") == F.col("manifests"), "COMPLETE").otherwise("INCOMPLETE")
    baseline = F.when(F.col("baseline").isNull(), "NOT_AVAILABLE").when(F.col("baseline.state") != "COMPLETE", "INCOMPLETE").when(over(age(F.col("baseline.updated_at")), BASELINE_S), "STALE").otherwise("CURRENT")
    review = F.when(over(age(F.col("oldest_approval")), APPROVAL_S), "DEGRADED").otherwise("HEALTHY")
    lag = F.when(F.col("publishing_since").isNotNull(), age(F.col("publishing_since"))).otherwise(rules.age_seconds(F.col("published.created_at"), F.col("published.terminal_at")))
    sync = F.coalesce("sync", F.lit("NOT_AVAILABLE"))
    publication = F.when(sync == "OUT_OF_SYNC", "OUT_OF_SYNC").when(lag.isNull(), "NOT_AVAILABLE").when(lag > PUBLISH_S, "DEGRADED").otherwise("HEALTHY")
    mark = age(F.col("watermark_at"))
    watermark = F.when(mark.isNull(), "NOT_AVAILABLE").when(mark > WATERMARK_S, "STALE").otherwise("CURRENT")
    correlation = F.when(F.col("tracked") == 0, "NOT_AVAILABLE").when(F.col("uncorrelated") > 0, "INCOMPLETE").otherwise("COMPLETE")
    names = ("queue", "coverage", "runtime", "baseline", "review", "publication", "watermark", "correlation")
    states = o.select(env, *[c.alias(n) for n, c in zip(names, (queue, coverage, runtime, baseline, review, publication, watermark, correlation), strict=True)], lag.alias("publish_lag_s"), F.when(F.col("manifests") > 0, F.col("joined") / F.col("manifests")).alias("runtime_rate"))
    bad = F.exists(F.array(*names), lambda s: s.isin("DEGRADED", "INCOMPLETE", "STALE"))
    return states.withColumn("overall", F.when(F.col("publication") == "OUT_OF_SYNC", "OUT_OF_SYNC").when(bad, "DEGRADED").otherwise("HEALTHY"))


def overview(runs: DataFrame, quarantines: DataFrame) -> DataFrame:
    """Runs by category, and quarantines that are not resolved."""
    tally = runs.groupBy(rules.run_category(F.col("state")).alias("category")).agg(F.count("*").alias("n"))
    return tally.unionByName(quarantines.where(F.col("resolved_at").isNull()).agg(F.count("*").alias("n")).select(F.lit("quarantined").alias("category"), "n"))


def freshness(runs: DataFrame) -> DataFrame:
    """Each system's latest run, and its latest published baseline. runs: (system, run_id, workflow, state, updated_at)."""
    at = F.struct("updated_at", "run_id")
    published = (F.col("workflow") == "BASELINE") & (F.col("state") == "PUBLISHED")
    return runs.groupBy("system").agg(F.max_by("run_id", at).alias("last_run"), F.max_by("run_id", F.when(published, at)).alias("last_published"))


def durations(stages: DataFrame) -> DataFrame:
    """Of each run the sum of its stages' seconds, the first start and the last end. stages: (run_id, started_at, ended_at)."""
    took = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    return stages.groupBy("run_id").agg(F.sum(F.greatest(took, F.lit(0))).alias("busy_s"), F.min("started_at").alias("started"), F.max("ended_at").alias("ended"))


def stage_sequence(stages: DataFrame) -> DataFrame:
    """The first of each stage of a run, numbered by its start. A run has a stage for each step of its workflow, so its window is short."""
    first = stages.groupBy("run_id", "stage").agg(F.min("at").alias("at"))
    return first.select("run_id", "stage", F.row_number().over(Window.partitionBy("run_id").orderBy("at", "stage")).alias("sequence"))


def verdicts(parts: DataFrame) -> DataFrame:
    """Whether all that was provided of a run is corroborated; null if nothing was. parts: (run_id, verdict)."""
    given = F.when(F.col("verdict") != "NOT_PROVIDED", F.col("verdict") == "CORROBORATED")
    return parts.groupBy("run_id").agg(F.bool_and(given).alias("corroborated"))


def newest(rows: DataFrame, at: str, key: str, n: int | None = None) -> DataFrame:
    """By time, the newest first, then by key; of them the first n."""
    out = rows.orderBy(F.desc(at), key)
    return out if n is None else out.limit(n)


def run_proposals(runs: DataFrame, proposals: DataFrame) -> DataFrame:
    """The proposal of each run: its command is the run, or its correlation is the run's; one in review goes first, then the smallest id.

    runs: (run_id, correlation_id); proposals: (proposal, command_id, correlation_id, state). The best proposal of each command and of each correlation is found before the joins, so a run
    meets two at most.
    """
    p = proposals.select(F.struct((F.col("state") != "IN_REVIEW").cast("int").alias("later"), "proposal").alias("p"), "command_id", F.col("correlation_id").alias("p_correlation"))
    by_command = p.groupBy(F.col("command_id").alias("run_id")).agg(F.min("p").alias("by_command"))
    by_correlation = p.where(~F.col("p_correlation").isin("", "unavailable")).groupBy(F.col("p_correlation").alias("correlation_id")).agg(F.min("p").alias("by_correlation"))
    found = runs.join(by_command, "run_id", "left").join(by_correlation, "correlation_id", "left")
    return found.groupBy("run_id").agg(F.min(F.least("by_command", "by_correlation")).alias("p")).where(F.col("p").isNotNull()).select("run_id", "p.proposal")
