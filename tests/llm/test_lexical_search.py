"""Ranked search against scores that are computed one document at a time."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=20):
    found = [(i, collections.Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:top], 1)]
    return out


def got(spark, docs, items, **options):
    clash = {c: F.lit(1) for c in ("term", "shard", "df", "rank", "score", "ids")}
    index = ls.build_index(spark.createDataFrame(docs, SCHEMA).withColumns(clash), **{k: v for k, v in options.items() if k == "shard_chars"})
    rows = ls.search(index, spark.createDataFrame(items, ITEMS).withColumns(clash), **{k: v for k, v in options.items() if k != "shard_chars"})
    key = lambda r: tuple((v is None, v or 0) for v in r)
    return sorted((tuple(r) for r in rows.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("options", [{}, {"shard_chars": 300}, {"shard_chars": 2000, "pass_chars": 10, "top": 3}], ids=str)
def test_ranks(spark, options):
    rng = random.Random(3)
    vocabulary = [*"abcdefghij", "é", "É", "中文", "x1", "ß", "w-w"]
    text = lambda n: rng.choice([" ", ", ", "\n", "\0"]).join(rng.choices(vocabulary, [2.0**-k for k in range(len(vocabulary))], k=rng.randint(0, n)))
    docs = [(i * 37 % 1009, text(60)) for i in range(400)] + [(5000 + i, None) for i in range(3)] + [(6000, ""), (6001, " ,; "), (None, "a é b"), (6002, "A " * 5000)]
    items = [(i, text(12)) for i in range(12)] + [(50, None), (51, ""), (52, "unknown"), (53, "a a a b b c"), (None, "c d")]
    assert got(spark, docs, items, **options) == ordered(brute(docs, items, options.get("top", 20)))


def test_equal_scores_and_repeated_rows(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(7, "same words here")] * 3 + [(200, "others")] * 80
    items = [(1, "same"), (1, "same"), (2, "others words")]
    rows = got(spark, docs, items, shard_chars=200)
    assert [r[2] for r in rows if r[0] == 1] == sorted([1, 2, 3, 4, 5, 6, 7, 7, 7, 7, *range(8, 18)] * 2)
    assert rows == ordered(brute(docs, items))
    assert got(spark, [], items) == [] and got(spark, docs, []) == []


def test_pruned_lists_lose_nothing():
    rng = random.Random(9)
    for _ in range(300):
        lists = {}
        for term in range(rng.randint(1, 9)):
            docs = sorted(rng.sample(range(200), rng.randint(1, 150)))
            adds = [rng.randint(1, rng.choice([3, 50, 1000])) for _ in docs]
            lists[term] = (max(adds), docs, adds)
        wanted = [(term, rng.randint(1, 3)) for term in range(9) if rng.random() < 0.8]
        sums = collections.Counter()
        for term, times in wanted:
            for d, a in zip(*lists.get(term, (0, [], []))[1:], strict=True):
                sums[d] += a * times
        top = rng.choice([1, 3, 20])
        assert ls.search_shard(lists, wanted, top) == [(s, d) for d, s in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:top]]


def test_numbers_round_trip(monkeypatch):
    rng = np.random.default_rng(1)
    values = np.append(rng.integers(0, 1 << rng.integers(1, 60, 2000)), [0, 127, 128, 1 << 62])
    data, size = ls.pack_numbers(values)
    assert ls.unpack_numbers(data.tobytes()).tolist() == values.tolist() and size.sum() == len(data)
    assert ls.unpack_numbers(b"").tolist() == [] and len(ls.pack_numbers(np.empty(0, np.int64))[0]) == 0
    texts = ["A b. c-D " * 50 + "é" * i for i in range(5)] + [None, "", "."]
    whole = ls._shard(list(range(8)), texts)
    monkeypatch.setattr(ls, "BLOCK", 11)
    cut = ls._shard(list(range(8)), texts)
    assert whole[0] == cut[0] == [0, 1, 2, 3, 4] and [x.tolist() if hasattr(x, "tolist") else x for x in whole] == [x.tolist() if hasattr(x, "tolist") else x for x in cut]
