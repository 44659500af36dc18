"""A line that very many texts share: it must not bring them all into one group, and no link may be lost."""

import random

import numpy as np

from tests.llm.test_llm import brute_components
from weftline.llm import parity_join as pj


def corpus():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = "all rights reserved by the owners of this page and its friends"
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):  # short texts, and longer ones, with a common line or passage; some have a near copy
        common, own = (line, [word() for _ in range(8)]) if i % 2 else (passage, [word() for _ in range(14)])
        rows.append((len(rows), f"{common} {' '.join(own)}"))
        if i % 10 < 2:
            rows.append((len(rows), f"{common} {' '.join(own)} more"))
    for i in range(40):  # nearly all common: these are near copies of each other
        rows.append((len(rows), f"{passage} {word()}"))
    return rows


def test_no_link_is_lost(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(pj, "HOT", 20)
    monkeypatch.setattr(pj, "GROUP", 10)
    asked = []
    places = pj._places
    monkeypatch.setattr(pj, "_places", lambda docs, targets, text, hot: (asked.append(len(hot)), places(docs, targets, text, hot))[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in pj.link_components(df).collect()}
    assert got == brute_components(rows)
    assert asked[0] == 0 and asked[-1] > 0  # there was something to put last


def test_hot_places_come_last():
    rng = np.random.default_rng(3)
    bands = pj.Bands()
    for n in (12, 60, 300):
        hashes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for band, places, d in bands.of(len(hashes)):
            plain = pj.place_keys(hashes, band, places, d)
            moved = pj.place_keys(hashes, band, places, d, np.sort(plain[:1]))
            assert len(plain) == len(moved) == d + 1 and plain[0] not in moved and set(plain[1:].tolist()) <= set(moved.tolist())
            every = pj.place_keys(hashes, band, places, len(np.unique(hashes)) - 1) if not places else None
            if every is not None:  # where all are hot the order is as it was
                assert pj.place_keys(hashes, band, places, d, np.sort(every)).tolist() == plain.tolist()
