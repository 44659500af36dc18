"""The manifest and its proofs, against a tree that is built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= 16
    return out


def brute(rows):
    """(row, leaf, subroot, root, siblings) of each row."""
    key = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    sources = sorted({r[1] for r in rows}, key=key)
    own = [sorted((r for r in rows if r[1] == s), key=lambda r: (key(r[0]), leaf_of(r))) for s in sources]
    trees = [tree_of([leaf_of(r) for r in some]) for some in own]
    top = tree_of([t[-1][0] for t in trees])
    return [(r, leaf_of(r), t[-1][0], top[-1][0], siblings(t, i) + siblings(top, k)) for k, (some, t) in enumerate(zip(own, trees, strict=True)) for i, r in enumerate(some)]


def audited(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("leaf", F.lit(0))
    return merkle.audit(docs, F.when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))).collect()


def fold(leaf, steps):
    for before, after in steps:
        leaf = sha("".join(before) + leaf + "".join(after))
    return leaf


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"a": 300, None: 5, "é": 33, "z": 256}, {f"s{i}": 1 + i % 3 for i in range(40)}], ids=str)
def test_trees(spark, sizes):
    rows = [(i * 7 % n, s, None if i % 5 == 0 else "en", None if i % 4 == 0 else i, [None, "", "A text", "ÄB" * i][i % 4]) for s, n in sizes.items() for i in range(n)]
    got = sorted((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in audited(spark, rows))
    want = []
    for r, leaf, subroot, root, steps in brute(rows):
        changed = (*r[:4], r[4].lower() if r[4] and r[0] % 3 == 0 else r[4])
        folded = fold(leaf_of(changed), steps)
        assert (folded == root) == (changed == r)
        want.append((r[0], leaf, subroot, root, sha("".join("".join(b) + "".join(a) for b, a in steps)), folded, folded == root))
    assert got == sorted(want)


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "en", 1, "x")] * 40 + [(1, "a", "en", 1, "y")]
    got = audited(spark, rows)
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    assert sorted(r["proof_sha256"] for r in got) == sorted(sha("".join("".join(b) + "".join(a) for b, a in steps)) for *_, steps in brute(rows))
    assert audited(spark, []) == []


def test_node_table(spark):
    rows = [(i, "ab"[i % 2], "en", i, str(i)) for i in range(70)]
    docs = spark.createDataFrame(rows, SCHEMA)
    manifest = merkle.build(docs, merkle.leaf_digest(*[F.col(f) for f in merkle.FIELDS]))
    nodes = {(r["above"], r["tree"], r["level"], r["at"]): r["digest"] for r in manifest.nodes().collect()}
    assert len(nodes) == 70 + 2 * 3 + 2 * 1 + 2 + 1
    assert nodes[True, 0, 1, 0] == manifest.root and nodes[True, 0, 0, 1] == nodes[False, 1, 2, 0]


def test_leaves_are_numbered_over_ranges(spark):
    """A source that holds all rows is dealt to many tasks: no window by the source alone."""
    docs = spark.createDataFrame([(i, "one", "en", 1, str(i)) for i in range(5000)], SCHEMA)
    manifest = merkle.build(docs, merkle.leaf_digest(*[F.col(f) for f in merkle.FIELDS]))
    assert manifest.levels[0].groupBy("tree", "n").count().collect() == [(0, 5000, 5000)] and len(manifest.levels) == 5
    plan = merkle.proofs(manifest)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan
