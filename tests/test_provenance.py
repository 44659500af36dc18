"""Provenance of columns through queries, on statements whose sources are plain."""

from weftline.operators import provenance

SCHEMA = "statement string, query string, branch int, position int, column string, source string, source_column string"


def found(spark, rows, columns=(("t", "a"), ("t", "b"), ("u", "a"))):
    reach, residue = provenance.column_provenance(spark.createDataFrame([("s", *r) for r in rows], SCHEMA), spark.createDataFrame(list(columns), "table string, column string"))
    return sorted(f"{r['query']}.{r['column']} < {r['source']}.{r['source_column']}" for r in reach.collect()), sorted(f"{r['query']}.{r['column']} {r['code']}" for r in residue.collect())


def test_a_deep_chain(spark):
    rows = [("c0", 0, 0, "v", "t", "a")] + [(f"c{i}", 0, 0, "v", f"c{i - 1}", "v") for i in range(1, 60)]
    reach, residue = found(spark, rows)
    assert reach == sorted(f"c{i}.v < t.a" for i in range(60)) and residue == []


def test_unions_take_names_from_their_first_branch(spark):
    rows = [("q", 1, 0, "x", "t", "a"), ("q", 1, 1, "y", "t", "b"), ("q", 2, 0, "other", "u", "a"), ("q", 2, 2, "wide", "u", "a"), ("r", 0, 0, "z", "q", "x"), ("r", 0, 1, "w", "q", "other")]
    reach, residue = found(spark, rows)
    assert reach == ["q.x < t.a", "q.x < u.a", "q.y < t.b", "r.z < t.a", "r.z < u.a"]
    assert residue == ["q.wide union-width", "r.w unknown-query-column"]


def test_recursion_shadowing_and_unknown_names(spark):
    # a query that reads itself and another that reads it back; a query called as a table; names that nothing has
    rows = [("a", 0, 0, "n", "t", "a"), ("a", 1, 0, "n", "b", "n"), ("b", 0, 0, "n", "c", "n"), ("c", 0, 0, "n", "a", "n"), ("u", 0, 0, "a", "t", "b"), ("d", 0, 0, "p", "u", "a"), ("d", 0, 1, "q", "t", "none"), ("d", 0, 2, "r", "none", "a"), ("d", 0, 0, "p", "t", "a")]
    reach, residue = found(spark, rows)
    assert reach == ["a.n < t.a", "b.n < t.a", "c.n < t.a", "d.p < t.a", "d.p < t.b", "u.a < t.b"]
    assert residue == ["d.q unknown-table-column", "d.r unknown-table"]
    assert found(spark, []) == ([], [])


def test_chains_keep_no_ways_between_queries(spark, monkeypatch):
    n, held = 40, []
    rows = [("q0", 0, 0, "v", "t", "a"), ("q0", 0, 1, "w", "t", "none"), *[(f"q{i}", 0, 0, "v", f"q{i - 1}", "v") for i in range(1, n)]]
    monkeypatch.setattr(provenance, "cut", lambda df: (held.append((made := df.checkpoint()).count()), made)[1])
    reach, residue = found(spark, rows)
    assert reach == sorted(f"q{i}.v < t.a" for i in range(n)) and residue == ["q0.w unknown-table-column"]
    # all ways would be n * (n + 1) / 2
    assert max(held) <= 2 * n and len(held) <= 16
    held.clear()
    told = provenance.residue(spark.createDataFrame([("s", *r) for r in rows], SCHEMA), spark.createDataFrame([("t", "a")], "table string, column string"))
    assert [(r["query"], r["column"], r["code"]) for r in told.collect()] == [("q0", "w", "unknown-table-column")] and len(held) == 1


def test_what_is_read_is_judged_without_joins(spark):
    rows = [("s", "q", 1, 0, "x", "t", "a"), ("s", "q", 1, 0, "y", "t", "b"), ("s", "q", 2, 0, "z", "u", "a"), ("s", "r", 1, 0, "v", "q", "y"), ("s", None, 1, 0, "v", None, "v"), ("s", "n", 1, None, "v", "t", "a"), ("s", "m", 1, 0, None, "t", "a")]
    judged, wide = provenance._judged(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "table string, column string"))
    # a position of two names has both; where a key is null nothing has a name
    assert sorted((r["query"], r["column"], r["source"], r["inner"], r["code"]) for r in judged.collect()) == sorted([("q", n, t, False, None) for n in "xy" for t in "tu"] + [("q", n, "t", False, None) for n in "xy"] + [("r", "v", "q", True, None)])
    assert sorted((r["query"] or "", r["source"] or "") for r in wide.collect()) == [("", ""), ("m", "t"), ("n", "t")]
    # the tables' columns come by the only join
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
