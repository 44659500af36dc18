"""Limits of repetition, of batches and of ids, and what is spread in a shard."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from weftline.llm import chat_format, decontamination, minimax_shards, mixing


def test_entropy_does_not_lift_the_limit_of_repeats(spark):
    """A source of one token beside one of 200,000: by entropy alone it would be given 73,825 times."""
    rows = spark.createDataFrame([(i, "big", 1000) for i in range(200)] + [(1000, "tiny", 1)], "doc_id bigint, source string, tokens bigint")
    for whole in (False, True):
        mix = mixing.plan(rows, entropy_share=0.95, max_repeats=4.0, whole=whole)
        given = collections.Counter(r["row"]["source"] for r in mixing.realise(rows, mix).collect())
        assert max(s.passes for s in mix.shares) <= 4 and 1 <= given["tiny"] <= 5 and 190 <= given["big"] <= 801
        assert max(s.budget / s.tokens for s in mix.shares) <= 4.0 + 1e-6
    # where entropy asks for less, it decides
    counts = [1000, 900, 800]
    a = mixing.exponent_for_entropy(counts, 1.0985)
    assert a > 0 and mixing.exponent_for_repeats(counts, 2700, 4.0, a) == a
    assert mixing.repeats([1000, 10], 1.0, None) == pytest.approx(1.0) and mixing.repeats([1000, 10], 0.0, None) == pytest.approx(100.0)


QUOTE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of winter jasmine"


@pytest.mark.parametrize(("kind", "ids"), [("bigint", [None, 3, 1]), ("string", [None, "b", "a"])])
def test_item_ids_of_any_type_and_null(spark, kind, ids):
    items = spark.createDataFrame([(i, QUOTE) for i in ids] + [(ids[1], None)], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, f"before {QUOTE} after"), (2, "nothing of it"), (None, QUOTE)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: [ids[2], ids[1], None], 2: [], None: [ids[2], ids[1], None]}
    assert decontamination.contaminated_rows(docs, items).where(F.size("items") > 0).count() == 2


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_batches_are_cut_by_bytes(spark, most):
    rows = [(c, t, "assistant" if t % 2 else "user", ("<" * (7 * t) + "é" * t) if t != 3 else None) for c in (None, 1, 2) for t in range(6)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    made = chat_format.format_chats(turns, slice_bytes=most)
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    for c in (None, 1, 2):
        own = [(role, text or "") for i, _, role, text in rows if i == c]
        learned = "".join(t for r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest() and got[c]["n_turns"] == 6
    assert made.count() == 3 if most == 10_000 else made.count() > 3


def test_nothing_is_rejected_where_no_language_is_known(spark, small):
    rows = [(1, "some words", None), (2, None, None), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(tuple(r) for r in p.identify_language(spark, docs, small).collect()) == rows


def test_repeats_are_spread_in_a_shard(spark):
    """Of 40 documents that come 50 times each the copies do not lie side by side, and every quarter of a shard holds both sources."""
    rows = [(i, f"text {i} " * 3, "even" if i % 2 else "odd") for i in range(40) for _ in range(50)]
    got = minimax_shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), 2).orderBy("shard", "slot").collect()
    for shard in (0, 1):
        ids = [r["doc_id"] for r in got if r["shard"] == shard]
        assert sum(a == b for a, b in zip(ids, ids[1:], strict=False)) < len(ids) / 8
        whole = sum(i % 2 for i in ids) / len(ids)
        for k in range(4):
            some = ids[k * len(ids) // 4 : (k + 1) * len(ids) // 4]
            assert abs(sum(i % 2 for i in some) / len(some) - whole) < 0.15
    plan = minimax_shards.shard(spark.createDataFrame(rows[:10], "doc_id bigint, text string, source string"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
