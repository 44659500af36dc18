"""Packing against the library's ids, and each window against the proportions it should hold."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import packing, queries

ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "One, two", "b"), (4, "One, two", "b"), (None, "x", None), (5, "word " * 30_000, "long"), (6, "ß" * 5000, "a"), (7, "<|endoftext|>a <|startoftext|> 's't", "b")]
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(queries.WORD_MODEL))
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers

    return packing.ChunkedTokens(public_tokenizers.path(queries.WORD_MODEL))


def whole(pieces, want):
    """Every id of every document is in one piece, sequences have no gap, and no padding."""
    docs, at = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        docs[r["doc_id"]].append(r)
        at[r["sequence_id"]].append(r)
    assert collections.Counter(docs.keys()) == collections.Counter(want.keys())
    for i, own in docs.items():
        ids = want[i][0]
        ends = collections.Counter((r["start"], r["start"] + r["length"]) for r in own)
        for copy in range(len(want[i])):  # repeated rows are cut each by itself
            place = 0
            while place < len(ids):
                a, b = next(e for e in ends if e[0] == place and ends[e] > 0)
                ends[a, b] -= 1
                place = b
            assert place == len(ids) and copy < len(want[i])
        assert not +ends and {r["doc_tokens"] for r in own} == {len(ids)}
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    size = {}
    for k, own in at.items():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place and r["length"] > 0
            place += r["length"]
        size[k] = place
    assert sorted(size) == list(range(len(size)))
    assert all(n == packing.WINDOW or n & (n - 1) == 0 for n in size.values())
    assert sum(n < packing.WINDOW for n in size.values()) <= 12
    return size


def test_op12(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    whole(queries.op12_packing(spark, small).collect(), {r["doc_id"]: [library(r["text"])] for r in rows})


def test_odd_rows(spark, library):
    docs = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("ids", "n", "part", "round", "at", "offset", "length", "start", "first")])
    want = collections.defaultdict(list)
    for i, text, _ in ODD:
        want[i].append(library(text))
    whole(packing.digests(packing.pack(docs, queries.WORD_MODEL, end_id=2)).collect(), want)
    assert packing.pack(docs.where("false"), queries.WORD_MODEL, end_id=2).collect() == []


def test_ids_are_the_library_s(library, tokens, monkeypatch):
    assert tokens.splits
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "é", "́", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "'s", "'", "1", "Σ", "ΑΣ", "!", "<|endoftext|>", "<|", "|>", "İ", "ﬁ", "中", "‍", "😀", "\r", "the", "Å", "ḍ̇"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)]
    assert all(tokens.ids(t) == library(t)[:-1] for t in texts)
    words = ["".join(rng.choices("abcXYZéÉñßǅıİſ.,;:!?'-", k=rng.randint(1, 9))) for _ in range(4000)]
    assert all(tokens.ids(f"{w} {v}") == library(f"{w} {v}")[:-1] for w, v in zip(words, words[1:], strict=False))
    monkeypatch.setattr(packing, "BLOCK", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    latin = ["".join(rng.choices(["Ab", "É", "ß", "ÿ", "×", ". ", ", ", ".\n", "!? ", "...", "!! ", "&&& ", ".) ", "\". ", ". ", "'s. ", " . ", "1. ", "ĳ. ", "Ⱥ", "Ŀ, ", "DŽ "], k=rng.randint(1, 12))) for _ in range(4000)] + ["Σ. ΑΣ. ", "<|ENDOFTEXT|>. A. ", "<|endoftext|>. A. ", "a. ", "a.", "É. b́. "]
    assert all(tokens.ids(t) == library(t)[:-1] for t in latin)
    tokens.clear()
    assert all(tokens.ids(t) == library(t)[:-1] for t in [*texts[:1000], *words, *latin]) and len(tokens) <= 20


def test_rounds_are_a_deficit_round_robin():
    """A queue served round by round, its credit carried, sends the same grains in the same rounds; the quanta here are exact in binary."""
    rng = random.Random(2)
    for _ in range(200):
        quantum, grain, n = rng.choice([0.375, 5.0, 64.0, 900.25, 4096.0]), rng.choice([1, 8, 64]), rng.randint(1, 3000)
        phase = rng.randrange(grain)
        credit, sent, turn, want = float(phase), 0, 0, []
        while sent < n:
            turn += 1
            credit += quantum
            grains = int(credit // grain)
            credit -= grains * grain
            want += [turn] * min(grains * grain, n - sent)
            sent += grains * grain
        first = rng.randint(0, n - 1)
        many = [np.array([x, x]) for x in (first, n - first, quantum, phase)]
        row, rounds, start = (x[: len(x) // 2] for x in packing._rounds(*many, grain))
        assert not row.any()
        got = np.repeat(rounds, np.diff(np.append(start, n - first)))
        assert got.tolist() == want[first:]


@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.3, "c": 0.2}], ids=["by tokens", "by targets"])
def test_windows_hold_the_proportions(spark, targets):
    rng = random.Random(4)
    lengths = {"a": 150_000, "b": 60_000, "c": 30_000}
    rows = []
    for name, n in lengths.items():
        while n > 0:
            k = min(n, int(rng.paretovariate(1.2) * 60))
            rows.append((len(rows), "word " * (k - 1), name))
            n -= k
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    pieces = packing.pack(docs, queries.WORD_MODEL, end_id=2, targets=targets)
    held = collections.defaultdict(collections.Counter)
    for r in pieces.collect():
        held[r["sequence_id"]][r["source"]] += r["length"]
    weights = targets or {k: n / sum(lengths.values()) for k, n in lengths.items()}
    # until the first queue ends
    windows = int(min(lengths[k] / w for k, w in weights.items()) // packing.WINDOW) - 1
    assert windows > 20
    for k in range(windows):
        for name, w in weights.items():
            assert abs(held[k][name] - w * packing.WINDOW) <= 2 * packing.GRAIN * len(weights)
    for name, w in weights.items():  # deficits are carried: over all windows the proportions are exact
        assert abs(sum(held[k][name] for k in range(windows)) - w * packing.WINDOW * windows) <= 2 * packing.GRAIN * len(weights)
    with pytest.raises(ValueError, match="above 0"):
        packing.pack(docs, queries.WORD_MODEL, end_id=2, targets={"a": 0.0})


def test_sequences_are_the_ids(spark, library):
    rows = [(i, f"text number {i} " * (i % 40), f"s{i % 3}") for i in range(200)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA), queries.WORD_MODEL, end_id=2).cache()
    want = {i: library(t) for i, t, _ in rows}
    by = collections.defaultdict(list)
    for r in pieces.collect():
        by[r["sequence_id"]].append((r["offset"], want[r["doc_id"]][r["start"] : r["start"] + r["length"]]))
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(pieces).collect()}
    assert got == {k: [x for _, ids in sorted(v) for x in ids] for k, v in by.items()}


def test_ids_of_two_widths_are_cut_where_sequences_end(spark):
    """Rows of two and of four bytes an id, over windows of 8 and a rest of 7."""
    rows, at = [], 0
    ids = list(range(70_000, 70_000 + 8 * 5 + 7))
    for k, n in enumerate([3, 10, 1, 17, 6, 10]):
        own = [i if k % 2 else i - 70_000 for i in ids[at : at + n]]
        rows.append((k, "s", 100 * k, n, bytearray(np.array(own, "<u4" if k % 2 else "<u2").tobytes()), 1000, at))
        at += n
    df = spark.createDataFrame(rows, "doc_id bigint, source string, start bigint, length bigint, ids binary, doc_tokens bigint, at bigint").coalesce(1)
    got = packing._cut(df, at, 8, "doc_id").collect()
    place = {0: 0, 1: 8, 2: 16, 3: 24, 4: 32, 5: 40, 6: 44, 7: 46}
    size = collections.Counter()
    for r in got:
        begin = place[r["sequence_id"]] + r["offset"]
        own = next(x for x in rows if x[0] == r["doc_id"])
        assert begin - own[6] == r["start"] - own[2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == [i if own[0] % 2 else i - 70_000 for i in ids[begin : begin + r["length"]]]
        size[r["sequence_id"]] += r["length"]
    assert [size[k] for k in range(8)] == [8, 8, 8, 8, 8, 4, 2, 1]
