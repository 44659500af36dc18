"""The toxicity model against a plain optimiser, and its scores against sums over a dictionary of each text's words."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import toxicity as t


def dense(rows):
    out = np.zeros((rows.n, rows.width))
    np.add.at(out, (rows.owner, rows.columns), rows.values)
    return out


@pytest.mark.parametrize("penalty", [0.0, 1.0, 10.0])
def test_fit_is_the_optimum_of_the_penalised_loss(penalty):
    rng = np.random.default_rng(4)
    x = t.Rows([(c := np.flatnonzero(rng.random(12) < 0.3), np.ones(len(c))) for _ in range(80)], 12)
    y = (rng.random(80) < 0.3).astype(int)
    swaps = t.Rows([(c := rng.choice(12, 3, replace=False), np.array([-1.0, 1.0, 1.0])) for _ in range(20)], 12)
    l2 = 0.01
    w, b = t._fit(x, y, swaps, l2, penalty, steps=4000)
    a, s = np.hstack([dense(x), np.ones((80, 1))]), np.hstack([dense(swaps), np.zeros((20, 1))])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    ridge = np.diag([l2] * 12 + [0.0]) + 2 * penalty / 20 * s.T @ s

    def loss(v):
        z = a @ v
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + v @ ridge @ v / 2

    v = np.zeros(13)
    for _ in range(60):  # Newton's method on the whole, dense problem
        p = 1 / (1 + np.exp(-(a @ v)))
        v -= np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + ridge, a.T @ (weight * (p - y)) + ridge @ v)
    assert loss(np.append(w, b)) <= loss(v) + 1e-6 and np.abs(np.append(w, b) - v).max() < 1e-2
    if penalty == 10.0:  # swaps move scores less than they do without the penalty
        free, _ = t._fit(x, y, swaps, l2, 0.0, steps=4000)
        assert np.abs(swaps.times(w)).mean() < 0.5 * np.abs(swaps.times(free)).mean()


def test_scores_are_sums_over_a_text_s_words(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = t.train(t.labelled_sample(docs, labels), features=300)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    odd = [(-1, None), (-2, ""), (-3, "ÄÖ Éa WOMEN women's"), (-4, "word-word_x " * 3), (-5, "x" * 400_000 + " people")]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in t.score(rows, model).collect()}
    assert any(weight.values())
    for r in rows.collect():
        text = (r["text"] or "").encode()
        seen = set()
        for word in set(re.findall(rb"[A-Za-z\x80-\xff]+", text)):
            seen |= set(t._hashes(np.frombuffer(word, np.uint8))[0].tolist())
        total = model.offset + sum(weight.get(h, 0.0) for h in seen)
        want = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9) and got[r["doc_id"]]["predicted"] == int(want >= 0.5)


def test_labels_of_no_document_and_labels_without_a_value_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, "good words"), (None, "bad")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, None), (None, 0)], "doc_id bigint, toxic int")
    sample = t.labelled_sample(docs, labels).orderBy(F.desc("label"))
    assert [tuple(r) for r in sample.collect()] == [(1, "bad words"), (0, "good words")]
