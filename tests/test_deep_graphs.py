"""Chains deeper than any registered table's."""

from pyspark.sql import functions as F

from weftline.operators import graph, java_facts


def test_closure_of_a_deep_chain(spark):
    n = 53
    steps = spark.createDataFrame([(k, k + 1) for k in range(n)], "node bigint, parent bigint")
    got = {(r["node"], r["ancestor"], r["hops"]) for r in graph.closure(steps).collect()}
    assert got == {(a, b, b - a) for a in range(n) for b in range(a + 1, n + 1)}


def test_changelog_of_deep_includes(spark):
    n = 23
    files = spark.createDataFrame([(f"f{k:02}",) for k in range(n + 1)], "file string")
    includes = spark.createDataFrame([(f"f{k:02}", f"f{k + 1:02}", 1) for k in range(n)], "file string, child string, position int")
    got = {r["file"]: r["nth"] for r in java_facts.changelog_order(includes, files).collect()}
    assert got == {f"f{k:02}": k + 1 for k in range(n + 1)}


def test_pairs_are_reached_over_cycles_and_chains(spark):
    steps = [(f"n{i}", f"n{i + 1}") for i in range(20)] + [("a", "b"), ("b", "c"), ("c", "a"), ("b", "n18")]
    pairs = [("n0", "n20"), ("n5", "n4"), ("a", "c"), ("c", "n20"), ("a", "a"), ("x", "y"), ("n0", "n20")]
    got = graph.reaches(spark.createDataFrame(steps, "node string, parent string"), spark.createDataFrame(pairs, "node string, ancestor string"))
    assert sorted((r["node"], r["ancestor"], r["hops"]) for r in got.collect() if r["hops"]) == [("a", "a", 3), ("a", "c", 2), ("c", "n20", 5), ("n0", "n20", 20)]
    assert got.count() == 6 and got.where("hops IS NULL").count() == 2


def test_both_ways_keeps_no_pairs(spark, monkeypatch):
    n, held = 50, []
    monkeypatch.setattr(graph, "cut", lambda df: (held.append((made := df.checkpoint()).count()), made)[1])
    chain = spark.range(n).select(F.col("id").cast("string").alias("node"), (F.col("id") + 1).cast("string").alias("parent")).union(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "7")], "node string, parent string"))
    one = lambda x: spark.createDataFrame([(x,)], "node string")
    ahead, back = graph.both_ways(chain, one("a"), one("20"))
    assert {r["node"] for r in ahead.collect()} == {"a", "b", "c", *map(str, range(7, n + 1))}
    assert {r["node"] for r in back.collect()} == {"a", "b", "c", *map(str, range(21))}
    assert max(held) <= 3 * n
