"""Scans over ranges against plain windows, and plans without a window by a hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import rules
from weftline.operators import operations, queues
from weftline.operators.ordered import scanned


@pytest.mark.parametrize("parts", [1, 7])
def test_scans(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), i, rng.choice([None, 1, 5, 9, 2]), (rng.randint(0, 9), i)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, at int, v int, s struct<a: int, b: int>").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = scanned(df, ["at"], ["k"], {"before": ("lag", F.col("v")), "after": ("lead", F.col("v")), "most": ("high", F.col("v")), "most_s": ("high", F.when(F.col("v") > 1, F.col("s")))}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    w = Window.partitionBy("k").orderBy("at")
    high = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), F.max("v").over(high).alias("most"), F.max(F.when(F.col("v") > 1, F.col("s"))).over(high).alias("most_s")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_no_window_by_the_group_alone(spark):
    messages = spark.createDataFrame([("bulk", "g", i, "AVAILABLE") for i in range(50)], "lane string, key string, sequence int, status string")
    plans = [queues.superseded(messages, "key"), queues.chain(messages, "key", "sequence"), queues.lease_steals(messages.select(F.col("key").alias("command_id"), F.col("sequence").alias("epoch"), "status"))]
    for p in plans:
        windows = [x for x in p._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
        # over the rows by group and range, over the ranges by group
        assert any("range_" in x.split("], [")[1] for x in windows if "], [" in x)
        assert len(windows) >= 2
    assert [tuple(r) for r in queues.superseded(messages, "key").orderBy("sequence").limit(2).collect()] == [("bulk", "g", 0, 1), ("bulk", "g", 1, 2)]


def test_one_proposal_for_each_run(spark):
    runs = spark.createDataFrame([("r1", "c"), ("r2", "c"), ("r3", "unavailable"), ("r4", ""), ("r5", "d")], "run_id string, correlation_id string")
    rows = [("p9", "r1", "x", "FINALIZED"), ("p5", "zz", "c", "IN_REVIEW"), ("p4", "zz", "c", "FINALIZED"), ("p6", "zz", "c", "IN_REVIEW"), ("p1", "r3", "unavailable", "FINALIZED"), ("p0", "zz", "unavailable", "IN_REVIEW"), ("p2", "zz", "", "IN_REVIEW")]
    got = operations.run_proposals(runs, spark.createDataFrame(rows, "proposal string, command_id string, correlation_id string, state string"))
    assert sorted(tuple(r) for r in got.collect()) == [("r1", "p5"), ("r2", "p5"), ("r3", "p1")]


def test_cursors_round_trip(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices('ab"\\é中😀\n /+', k=rng.randint(0, 9))), str(rng.randint(0, 10**9))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    made = df.select("*", rules.cursor(F.col("a"), F.col("b")).alias("c"))
    assert [(r["a"], r["b"]) for r in made.collect()] == [tuple(r["v"]) for r in made.select(rules.cursor_values(F.col("c"), 2).alias("v")).collect()]
    bad = spark.createDataFrame([("!",), ("",), ("W10",), ("bm8",), ("_w",), ("WzFd",), (None,), ("WyJhIixudWxsXQ",)], "c string")
    assert [r[0] for r in bad.select(rules.cursor_values(F.col("c"), 2)).collect()] == [None] * 8
