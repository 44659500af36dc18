"""The registered queries on whole small tables: what their contracts say, by SQL where there is some and by brute force elsewhere."""

import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import shingles_of
from tests.test_queries import TABLES, plain
from weftline.llm import decontamination, mixing, queries


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, small):
    """The rows of a registered query, by name."""
    known = {}

    def rows(name):
        if name not in known:
            known[name] = queries.queries()[name](spark, small).collect()
        return known[name]

    return rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(run, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(small, t)}.parquet'")
    rows = run(name)
    columns = sorted(rows[0].asDict())
    found = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(plain(r[k]) for k in columns) for r in rows) == sorted(tuple(map(plain, r)) for r in found)


def test_op1(run, docs):
    rows, ids = {r["doc_id"]: r for r in run("op1_fingerprints")}, sorted(docs)
    assert sorted(rows) == ids
    misses = []
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):  # after the last comes the first
        text, after, r = docs[a]["text"], docs[b]["text"], rows[a]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles_of(text), shingles_of(after)
        true = len(x & y) / len(x | y) if x | y else 1.0
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        misses.append(abs(r["near_next"] - true))
    assert np.mean(misses) < 0.02 and max(misses) < 0.3
    same = collections.defaultdict(set)
    for i, r in rows.items():
        same[docs[i]["text"]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in same.values())


def test_op2(run, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.MODEL))
    tokens = collections.Counter()
    for r in docs.values():
        tokens[r["source"]] += len(model.encode(r["text"]))
    names = sorted(tokens)
    ws = mixing.weights([tokens[n] for n in names], mixing.exponent_for_entropy([tokens[n] for n in names], queries.ENTROPY_SHARE * math.log(len(names))))
    used = collections.Counter()
    for r in run("op2_mixing"):
        assert r["source"] == docs[r["doc_id"]]["source"] and r["n_tokens"] == len(model.encode(docs[r["doc_id"]]["text"]))
        used[r["source"]] += r["n_tokens"]
    for n, w in zip(names, ws, strict=True):
        longest = max(len(model.encode(r["text"])) for r in docs.values() if r["source"] == n)
        assert w * sum(tokens.values()) - longest - 1 <= used[n] <= w * sum(tokens.values()) + 1
    assert max(collections.Counter((r["doc_id"], r["mix_pass"]) for r in run("op2_mixing")).values()) == 1


def test_op3(run, docs):
    rows = {r["doc_id"]: r for r in run("op3_language_id")}
    assert sorted(rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert np.mean([r["lang_pred"] == docs[i]["lang"] for i, r in rows.items() if r["held_out"]]) > 0.97
    assert {r["lang_pred"] for r in rows.values()} <= {r["lang"] for r in docs.values()} | {"und"}


def test_op4(run, docs, spark, small):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in run("op4_decontamination")}
    normal = {i: decontamination.normalise(r["text"]) for i, r in docs.items()}
    whole = {(i, k) for k, v in items.items() for i, t in normal.items() if decontamination.normalise(v) in t}
    assert whole and whole <= got
    # what is not a copy is near: some window of the item is within its edits
    for i, k in sorted(got - whole)[:5]:
        item = decontamination.normalise(items[k])
        w = min(decontamination.WINDOW, len(item))
        assert any(decontamination.distance(item[a : a + w], normal[i], int(w * decontamination.EDITS), at) <= int(w * decontamination.EDITS) for a in range(len(item) - w + 1) for at in [normal[i].find(item[a : a + 12]) - 0] if at >= 0)


def test_op5(run, docs):
    rows = {r["doc_id"]: r for r in run("op5_toxicity")}
    assert sorted(rows) == sorted(docs)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op6(run, docs):
    rows = run("op6_sharding")
    slots = collections.defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(docs) and sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op7(run, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run("op7_token_counts"):
        text = docs[r["doc_id"]]["text"]
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    assert len(run("op7_token_counts")) == len(docs)


def test_op8(run, spark, small):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    turns[-1] = [("user", said), ("assistant", said)]
    rows = {r["conv_id"]: r for r in run("op8_chat_format")}
    assert sorted(rows) == sorted(turns)
    for c, ts in turns.items():
        learned = "".join(t for role, t in ts if role == "assistant")
        r = rows[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(ts), len(learned)) and r["formatted_chars"] >= sum(len(a) + len(b) for a, b in ts)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()


def test_op6_without_ids(spark):
    from weftline.llm import minimax_shards

    rows = [(None, "a"), (None, "a"), (None, None), (1, "a"), (1, "a"), (2, "b" * 500_000)] * 3
    got = minimax_shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit(9)), 3).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
