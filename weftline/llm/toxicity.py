"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and the first bytes of longer words, by presence. The
most telling ones are chosen by chi-squared on the training sample; on these a logistic regression is
fitted with two penalties: the usual one on the weights, and one on the change of a score when an
identity term of a labelled sentence is swapped for others of its kind (or for a plain word for a person).
So mentioning a group, and which one, moves no score, and neutral mentions aren't held against a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import textblocks as tb
from weftline.llm.shared import hold_batches, kept

#: Kinds of words that may stand for each other. The first of each kind is the plain word.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "lesbians", "gays", "blacks", "whites", "asians", "africans", "mexicans"),
    ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "lesbian"),
    ("young", "old", "gay", "straight", "black", "white", "asian", "african", "jewish", "islamic", "catholic", "transgender", "disabled", "deaf", "blind"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "ausländer", "flüchtlinge", "schwule", "schwarze"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "étrangers", "réfugiés", "noirs", "blancs"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "extranjeros", "refugiados", "negros", "blancos"),
)
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled texts of each class at most that are fitted on; features kept; lowest count in a class.
TRAIN_TEXTS, FEATURES, LEAST = 2500, 3000, 4
L2, SWAP_PENALTY = 5e-4, 1.0
#: Labelled sentences of each term that are swapped at most, and swaps that are fitted on at most, in even shares of the kinds.
SWAP_SENTENCES, SWAPS = 20, 6000

_GAP = np.ones(256, bool)
_GAP[[*range(97, 123), *range(65, 91), *range(128, 256)]] = False
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in small letters; each keeps its number of bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of one block of text, and where in it the word of each begins."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = _lowered(data)
    gap = _GAP[data]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = tb._POWERS.get(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[: len(data)])])
    length = end - begin
    out, at = [tb.mix((total[end] - total[begin]) * down[begin] + length.astype(np.uint64))], [begin]
    for k in PREFIXES:
        b = begin[length > k]
        out.append(tb.mix((total[b + k] - total[b]) * down[b] + np.uint64(1000 + k)))
        at.append(b)
    return np.concatenate(out), np.concatenate(at)


def term_features(term: str) -> np.ndarray:
    return np.unique(_hashes(np.frombuffer(term.encode(), np.uint8))[0])


_SENTENCE, _WORD = re.compile(r"[.!?\n]+"), re.compile(r"[^\W\d_]+")
_KIND_OF: dict[str, list[int]] = {}
for _i, _kind in enumerate(IDENTITY_TERMS):
    for _term in _kind:
        _KIND_OF.setdefault(_term, []).append(_i)


def mentions(text: str) -> Iterator[tuple[str, str]]:
    """(term, sentence) for each identity term of each sentence of a text, in small letters."""
    for sentence in _SENTENCE.split(text.lower()):
        for term in sorted(_KIND_OF.keys() & set(_WORD.findall(sentence))):
            yield term, sentence.strip()


def swapped(sentence: str, term: str, other: str) -> str:
    return re.sub(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", other, sentence)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, end, bytes) with a break between texts; a long text comes in several blocks."""
    data, off = tb.utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + tb.BLOCK, "right")) - 1)
        a = off[i]
        while j == i + 1 and off[j] - a > tb.BLOCK:  # cut where a word ends
            gaps = np.flatnonzero(_GAP[data[a : a + tb.BLOCK]])
            b = a + (int(gaps[-1]) + 1 if len(gaps) else tb.BLOCK)
            yield i, j, data[a:b]
            a = b
        yield i, j, data[a : off[j]]
        i = j


def text_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct feature hashes) of each text, in parts if it is long."""
    _, off = tb.utf8(column)
    for i, j, data in _blocks(column):
        if j == i + 1:
            yield i, np.unique(_hashes(data)[0])
            continue
        starts = off[i:j] - off[i]
        # texts in one block: a break between them keeps their words apart
        shifted = np.full(len(data) + (j - i), 0x20, np.uint8)
        owner = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
        shifted[np.arange(len(data)) + owner] = data
        h, at = _hashes(shifted)
        row = np.searchsorted(starts + np.arange(j - i), at, "right") - 1
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(j - i + 1))
        for k in range(j - i):
            yield i + k, np.unique(h[order[cuts[k] : cuts[k + 1]]])


class Model:
    """Chosen features, ascending, their weights, and the offset."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, offset: float) -> None:
        self.features, self.weights, self.offset = features, weights, offset

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.empty(0, np.int64)
        i = np.searchsorted(self.features, hashes)
        i[i == len(self.features)] = 0
        return i[self.features[i] == hashes]


class Rows:
    """A sparse matrix by rows, each a list of columns with their values."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        self.width, self.n = width, len(rows)
        self.columns = np.concatenate([c for c, _ in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        self.values = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.empty(0)
        self.owner = np.repeat(np.arange(self.n), [len(c) for c, _ in rows])

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * v[self.columns], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transpose times r."""
        return np.bincount(self.columns, self.values * r[self.owner], self.width)

    def largest(self, weight: np.ndarray, steps: int = 30) -> float:
        """An upper estimate of the squared spectral norm of the rows, each times the root of its weight, by power iteration."""
        v = np.ones(self.width) / max(1, self.width) ** 0.5
        size = 0.0
        for _ in range(steps):
            v = self.back(weight * self.times(v))
            size = float(np.linalg.norm(v))
            if not size:
                return 0.0
            v /= size
        return 1.1 * size


def _fit(x: Rows, y: np.ndarray, swaps: Rows, l2: float, swap_penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression by Nesterov's gradient steps. swaps: rows of feature changes."""
    w, b = np.zeros(x.width), 0.0
    v, c = w.copy(), b
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    each = 2 * swap_penalty / max(1, swaps.n)
    top = x.largest(weight) / 4 + 0.25 + l2 + each * swaps.largest(np.ones(swaps.n))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.times(v) + c, -40, 40)))
        r = weight * (p - y)
        g = x.back(r) + l2 * v + each * swaps.back(swaps.times(v))
        w2, b2 = v - g / top, c - r.sum() / top
        m = k / (k + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def labelled_sample(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", id_col: str = "doc_id", seed: int = 5, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(label, text) of about train_texts labelled rows of each class, chosen by a hash of their id.

    The sample is drawn from the labels alone, so no more texts than that are joined. A null
    label teaches nothing; an id with two labels counts with both.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(id_col, F.col(label).cast("int").alias("label"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, train_texts / totals.get(1, 1))).otherwise(min(1.0, train_texts / totals.get(0, 1)))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 20)) / (1 << 20)
    # by the bound on train_texts this side is small, whatever the input
    chosen = F.broadcast(known.where(draw < share))
    return kept(docs.where(F.col(text).isNotNull()).select(id_col, text).join(chosen, id_col).select("label", text))


def train(sample: DataFrame, *, text: str = "text", features: int = FEATURES, l2: float = L2, swap_penalty: float = SWAP_PENALTY, swap_sentences: int = SWAP_SENTENCES, most_swaps: int = SWAPS) -> Model:
    """Fits on a bounded sample (label, text), see labelled_sample.

    Counts and feature lists are made on the executors; the driver gets at most ``features``
    hashes, the sample's places in them, and swap_sentences sentences for each identity term. Of their swaps at most most_swaps are fitted on, even
    shares of every kind of terms. With one class, or none, that class is always given (none: 0).
    """
    hold_batches(sample.sparkSession)
    size = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(size) < 2:
        return Model(np.empty(0, np.uint64), np.empty(0), 40.0 if size.get(1) else -40.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist())
            for want in (0, 1):
                some = batch.filter(pa.array(labels == want))
                found = [h for _, h in text_features(some.column(1))]
                if found:
                    values, n = np.unique(np.concatenate(found), return_counts=True)
                    n = n.astype(np.int64)
                    zero = np.zeros_like(n)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n if want else zero), pa.array(zero if want else n)], names=["feature", "n1", "n0"])

    n1, n0 = F.sum("n1"), F.sum("n0")
    counts = sample.mapInArrow(count, "feature bigint, n1 bigint, n0 bigint").groupBy("feature").agg(n1.alias("n1"), n0.alias("n0")).where(F.greatest("n1", "n0") >= LEAST)
    a, b = size[1], size[0]
    p1, p0 = F.col("n1") / a, F.col("n0") / b
    mean = (F.col("n1") + F.col("n0")) / (a + b)
    telling = (p1 - p0) * (p1 - p0) / (mean * (1 - mean) + 1e-9)
    best = counts.withColumn("chi2", telling).orderBy(F.desc("chi2"), "feature").limit(features)
    terms = np.unique(np.concatenate([term_features(t) for kind in IDENTITY_TERMS for t in kind]))
    chosen = np.array([r["feature"] for r in best.select("feature").collect()], np.int64).view(np.uint64)
    chosen = np.unique(np.concatenate([chosen, terms]))
    model = Model(chosen, np.zeros(len(chosen)), 0.0)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[set] = [set() for _ in range(batch.num_rows)]
            for i, h in text_features(batch.column(1)):
                rows[i].update(model.places(h).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(r) for r in rows], pa.list_(pa.int32()))], names=["label", "places"])

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for t in batch.column(1).to_pylist() for m in mentions(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["term", "sentence"])

    table = sample.mapInArrow(places, "label int, places array<int>").toArrow()
    x = Rows([(np.array(p, np.int64), np.ones(len(p))) for p in table.column(1).to_pylist()], len(chosen))
    y = np.array(table.column(0).to_pylist())
    order = Window.partitionBy("term").orderBy(F.xxhash64("sentence"), "sentence")
    some = sample.mapInArrow(said, "term string, sentence string").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= swap_sentences)
    sentences = [(r["term"], r["sentence"]) for r in some.orderBy("term", "nth").collect()]
    weights, offset = _fit(x, y, _swaps(model, sentences, most_swaps), l2, swap_penalty)
    return Model(chosen, weights, offset)


def _swaps(model: Model, sentences: list[tuple[str, str]], most: int = SWAPS, seed: int = 3) -> Rows:
    """Changes of features when an identity term of a labelled sentence is swapped for each other of its kind.

    Every term is also swapped on its own, whether a labelled text mentions it or not, so a shared prefix with a telling word
    can't mark it; and the plain word of each kind is held against none.
    """
    own = lambda text: set(model.places(np.unique(_hashes(np.frombuffer(text.encode(), np.uint8))[0])).tolist())
    rng = np.random.default_rng(seed)
    kinds: list[list[tuple[tuple[int, ...], tuple[int, ...]]]] = []
    for i, kind in enumerate(IDENTITY_TERMS):
        found = {((), tuple(sorted(own(kind[0]))))}
        said = [*((t, t) for t in kind), *((t, s) for t, s in sentences if i in _KIND_OF[t])]
        for term, sentence in said:
            before = own(sentence)
            for other in kind:
                if other != term:
                    after = own(swapped(sentence, term, other))
                    found.add((tuple(sorted(before - after)), tuple(sorted(after - before))))
        changes = sorted(found)
        kinds.append([changes[k] for k in rng.permutation(len(changes))])
    left, rows = most, []
    for n, changes in enumerate(sorted(kinds, key=len)):
        some = changes[: max(1, left // (len(kinds) - n))]
        left -= len(some)
        rows += [(np.array(gone + come, np.int64), np.array([-1.0] * len(gone) + [1.0] * len(come))) for gone, come in some]
    return Rows(rows, len(model.features))


def score(docs: DataFrame, model: Model, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The toxicity of every whole text.

    Returns (id_col, score, predicted): score from 0 to 1, predicted 1 from 0.5 on. A null
    text scores as the empty one, by the offset alone. One row for each row of docs; an empty
    table gives an empty one; other columns are not read, whatever their names.
    """
    hold_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, model.offset)
            part: tuple[int, set] = (-1, set())
            for i, h in text_features(batch.column(1)):
                p = model.places(h)
                if part[0] == i:  # a further block of a long text: what was seen counts once
                    p = p[~np.isin(p, list(part[1]))]
                    part[1].update(p.tolist())
                else:
                    part = (i, set(p.tolist()))
                total[i] += model.weights[p].sum()
            value = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
