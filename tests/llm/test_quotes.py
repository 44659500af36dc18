"""Quotes of a part of a benchmark item, and short items."""

import random

from weftline.llm import decontamination as d


def prose(seed, n):
    r = random.Random(seed)
    text = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))
    return text[:n].strip()


def test_quotes_wherever_they_begin(spark):
    items = [(1, prose(1, 224)), (2, prose(2, 200)), (3, prose(3, 900))]
    texts = [items[0][1][15:165], items[1][1][:105]]
    cuts = [(i, t, a) for i, t in items for a in range(0, len(t) - d.WINDOW + 1, 7)]
    rows = [(k, t) for k, t in enumerate([*texts, *(f"{prose(k + 9, 90)} {t[a : a + d.WINDOW]}{prose(k + 7, 90)}" for k, (_, t, a) in enumerate(cuts)), prose(4, 5000), items[2][1][100 : 100 + d.WINDOW // 2]])]
    got = d.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    found = {r["doc_id"]: r["items"] for r in got.collect()}
    assert [found[k] for k in range(len(rows))] == [[1], [2], *([i] for i, _, _ in cuts), [], []]


def test_edits_of_a_quote_and_of_a_whole_item():
    r = random.Random(5)
    for n in (40, 59, 60, 61, 90, 119, 120, 121, 200):
        item = prose(n, n)
        index = d.Index([(1, item)], d.Q, d.EDITS, d.WINDOW)
        length = min(2 * d.WINDOW, len(item))
        for _ in range(40):
            a = r.randint(0, len(item) - length)
            part = list(item[a : a + length])
            for _ in range(next(m for m in range(int(d.EDITS * length), -1, -1) if length + 1 - d.Q * (m + 1) >= 1)):
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], ["0"], [part[at], "0"]])
            assert index.hits(d.normalise(f"{prose(n + 1, 50)} {''.join(part)} {prose(n + 2, 50)}")) == {1}


def test_short_items_match_as_a_whole(monkeypatch):
    monkeypatch.setattr(d, "BLOCK", 16)
    items = [(1, "How tall is it?"), (2, "art"), (3, "北京是首都"), (4, "..."), (5, "how TALL is it"), (6, "a" * 39)]
    index = d.Index(items, d.Q, d.EDITS, d.WINDOW)
    hits = lambda t: index.hits(d.normalise(t))
    assert hits("they asked: how tall is it, then") == {1, 5}
    assert hits("how tall is its tower") == set() and hits("how tal is it") == set() and hits("...") == set() and hits("") == set()
    assert hits("a party starts") == set() and hits("starting with art") == {2} and hits("art") == {2}
    assert hits("我知道北京是首都吗") == {3} and hits("b" * 50 + " " + "a" * 39) == {6}
