"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in lower case, runs of anything but letters and digits as one
space. Every stretch of w characters of an item, wherever it begins, is a window. If a part of a text is within e edits of a window, the two
share at least w + 1 - q (e + 1) q-grams, whose diagonals (place in the text less place in the item) lie in
a band of 2 e + 1. So: look up each q-gram of a text in the index of all items, take the overlapping bands of
diagonals with enough hits, in them the windows that meet the bound, and verify those by an alignment in the band alone.
A quote of WINDOW characters is thus found whatever its place. An item of less than two windows counts as one window too, so that no
part with the edits of the whole is lost; one under SHORTEST characters is searched for as it is, as whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from weftline.llm.shared import hold_batches, kept

Q = 12
#: Edits allowed, as a share of a window's length.
EDITS = 0.05
#: The least characters of an item that a text must quote, some 11 words.
WINDOW = 60
#: With edits, shorter items are told from chance resemblance no more; they match exactly, as a whole.
SHORTEST = 40
#: Windows that are aligned at once.
ALIGNED = 2048
#: Code points of a text that are searched at once, and of the benchmark that are indexed at once.
BLOCK, INDEX_CHARS = 1 << 18, 4 << 20
#: Parts of the benchmark that one plan searches for; after so many the lists found so far are checkpointed.
PARTS = 8
#: Pairs of equal q-grams that are counted at once, and beyond which a text is searched in smaller blocks.
PAIRS, MANY_PAIRS = 1 << 18, 1 << 23
_MARKS = re.compile(r"[\W_]+")
#: Thai, Lao, Burmese, Khmer, kana and Han set no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return _MARKS.sub(" ", (text or "").lower()).strip()


def grams(text: str, q: int = Q) -> np.ndarray:
    """A hash of each q-gram."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.empty(0, np.uint64)
    # doubling: hashes of 1, 2, 4, ... code points, put together to q
    out, have, bits, h, width = None, 0, q, codes * _MULTIPLIER + np.uint64(1), 1
    while bits:
        if bits & 1:
            piece = h[have:]
            out = piece if out is None else out[: len(piece)] * np.uint64(pow(int(_MULTIPLIER), 3 * width, 1 << 64)) + piece[: len(out)]
            have += width
        bits >>= 1
        if bits:
            h = h[: len(h) - width] * np.uint64(pow(int(_MULTIPLIER), 3 * width, 1 << 64)) + h[width:]
            width *= 2
    out = out[: len(codes) - q + 1]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def distances(windows: np.ndarray, part: np.ndarray, most: int, shifts: np.ndarray) -> np.ndarray:
    """For each row of windows the least edits to any stretch of part, on diagonals from its shift - most to shift + most.

    most + 1 if there are more. All are code points. One numpy step for each character of a window.
    """
    length, width = windows.shape[1], 2 * most + 1
    places = (shifts - most)[:, None] + np.arange(length + width + 1)
    padded = np.zeros(places.shape, np.uint32)  # padded[j, i + k] stands at place shifts[j] - most + i + k of part
    inside = (places >= 0) & (places < len(part))
    padded[inside] = part[places[inside]]
    ramp = np.arange(width)
    row = np.where((places[:, :width] >= 0) & (places[:, :width] <= len(part)), 0, most + 1)
    for i in range(length):
        step = row + (padded[:, i : i + width] != windows[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        if row.min() > most:
            break
    return np.minimum(row.min(axis=1), most + 1)


def distance(window: str, part: str, most: int, shift: int) -> int:
    """``distances`` of one window."""
    return int(distances(codes(window)[None], codes(part), most, np.array([shift]))[0])


def stands_alone(text: str, at: int, end: int) -> bool:
    """Whether text[at:end] begins and ends where words of a normalised text do."""
    joined = lambda a, b: a != " " and b != " " and not _UNSPACED.match(a) and not _UNSPACED.match(b)
    return not (at and joined(text[at - 1], text[at])) and not (end < len(text) and joined(text[end - 1], text[end]))


class Index:
    """The q-grams of some benchmark items, and the items too short for them. Items of one normalised text are one entry."""

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float, window: int) -> None:
        self.q = q
        texts: dict[str, set[int]] = {}
        for item, text in items:
            texts.setdefault(normalise(text), set()).add(item)
        # items, code points, q-gram hashes, characters of a window, edits, q-grams to share
        self.windows: list[tuple[set[int], np.ndarray, np.ndarray, int, int, int]] = []
        self.short: dict[int, dict[str, set[int]]] = {}
        for text, own in texts.items():
            if len(text) < SHORTEST:
                if text:
                    self.short.setdefault(len(text), {})[text] = own
                continue
            hashes, points = grams(text, q), codes(text)
            for length in sorted({min(window, len(text))} | ({len(text)} if len(text) < 2 * window else set())):
                most = int(edits * length)
                while most and length + 1 - q * (most + 1) < 1:
                    most -= 1
                self.windows.append((own, points, hashes, length, most, length + 1 - q * (most + 1)))
        each = [w[2] for w in self.windows]
        flat = np.concatenate(each) if each else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(each), dtype=np.int32), [len(h) for h in each])
        place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in each]) if each else np.empty(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner, self.place = flat[order], owner[order], place[order]
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.hashes >> np.uint64(64 - self.bits)] = True
        self.longest = max((len(w[1]) for w in self.windows), default=0)
        self.length = np.array([w[3] for w in self.windows], np.int64)
        self.band = np.array([w[4] for w in self.windows], np.int64)
        self.bound = np.array([w[5] for w in self.windows], np.int64)
        self.over = int((self.length + 2 * self.band).max()) + q if self.windows else 0
        self.short_hashes = {n: np.unique(np.concatenate([grams(t, n) for t in known])) for n, known in self.short.items()}

    def hits(self, text: str) -> set[int]:
        """Items of which a window is within its edits of a part of this normalised text, and short ones that it holds."""
        found: set[int] = set()
        for at in range(0, len(text), BLOCK) if self.windows else ():
            self._block(text[at : at + BLOCK + self.over], found)
        for n, known in self.short.items():
            for at in range(0, len(text), BLOCK):
                h = grams(text[at : at + BLOCK + n - 1], n)
                for i in (np.flatnonzero(np.isin(h, self.short_hashes[n])) + at).tolist():
                    same = known.get(text[i : i + n], set())
                    if not same <= found and stands_alone(text, i, i + n):
                        found |= same
        return found

    def _block(self, text: str, found: set[int]) -> None:
        h = grams(text, self.q)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - self.bits)])
        if not len(at):
            return
        low = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return
        if n.sum() > MANY_PAIRS and len(text) > 8 * self.over:
            half = len(text) // 2
            self._block(text[: half + self.over], found)
            self._block(text[half:], found)
            return
        part = codes(text)
        # bands of 2 e + 2 diagonals that overlap by half hold any e + 1 neighbours
        for half in (0, 1):
            for code in self._bands(at, low, n, half).tolist():
                i, band = code >> 40, code & (1 << 40) - 1
                items, whole, hashes, length, most, bound = self.windows[i]
                if items <= found:
                    continue
                first = (2 * band - half) * (most + 1) - self.longest
                places = self._places(h, hashes, first, 2 * (most + 1))
                starts = self._starts(places, len(whole), length, bound) if len(places) >= bound else places[:0]
                shift = first + most
                # one from the middle first: where much is quoted it is enough
                for some in [starts[len(starts) // 2 :][:1], *[starts[k : k + ALIGNED] for k in range(0, len(starts), ALIGNED)]]:
                    if len(some) and distances(whole[some[:, None] + np.arange(length)], part, 2 * most + 1, some + shift).min() <= most:
                        found |= items
                        break

    def _bands(self, at: np.ndarray, low: np.ndarray, n: np.ndarray, half: int) -> np.ndarray:
        """window << 40 | band of each band with hits enough. Pairs of equal q-grams are counted in parts; only counts are held, one for each band."""
        values, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1, [len(n)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            rows = np.repeat(low[a:b], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            w = self.owner[rows].astype(np.int64)
            diagonal = np.repeat(at[a:b], n[a:b]) - self.place[rows] + self.longest
            width = self.band[w] + 1
            own, k = np.unique(w << 40 | (diagonal + half * width) // (2 * width), return_counts=True)
            if not len(values):
                values, counts = own, k
                continue
            both = np.concatenate([values, own])
            values, of = np.unique(both, return_inverse=True)
            counts = np.bincount(of, np.concatenate([counts, k]), len(values)).astype(np.int64)
        return values[counts >= self.bound[values >> 40]]

    @staticmethod
    def _places(h: np.ndarray, hashes: np.ndarray, first: int, width: int) -> np.ndarray:
        """Places of an item, ascending, whose q-gram the text has on one of these diagonals."""
        same = np.zeros(len(hashes), bool)
        for d in range(first, first + width):
            a, b = max(0, -d), min(len(hashes), len(h) - d)
            if a < b:
                same[a:b] |= hashes[a:b] == h[a + d : b + d]
        return np.flatnonzero(same)

    def _starts(self, places: np.ndarray, whole: int, length: int, bound: int) -> np.ndarray:
        """Where a window of an item can begin so that it holds bound of these ascending places' q-grams."""
        a, b = places[: len(places) - bound + 1], places[bound - 1 :]
        near = b - a <= length - self.q
        low, high = np.maximum(b[near] + self.q - length, 0), np.minimum(a[near], whole - length)
        if not len(low):
            return np.empty(0, np.int64)
        base = int(low[0])
        steps = np.zeros(int(high[-1]) - base + 2, np.int64)
        np.add.at(steps, low - base, 1)
        np.add.at(steps, high - base + 1, -1)
        return np.flatnonzero(np.cumsum(steps)) + base


def _parts(benchmark: DataFrame, item_text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of at most INDEX_CHARS (or one item); one part is held at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.where(F.col(item_text).isNotNull()).select(item_id, item_text).orderBy(item_id, item_text).toLocalIterator():
        if part and size + len(r[1]) > INDEX_CHARS:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", q: int = Q, edits: float = EDITS, window: int = WINDOW) -> DataFrame:
    """(id_col, items): for every whole text the ids, ascending, null last, of the items it holds a window of; ids may be of any type.

    One row for each row of docs, with an empty list for a clean text, a null or an empty one. A null item, or one
    without a letter or digit, matches nothing; one under SHORTEST characters matches as a whole, exactly. Empty tables give
    empty lists or no rows; other columns are not read, whatever their names.

    The benchmark goes to the executors in parts of INDEX_CHARS, and each part is a pass over the texts. After PARTS of them the lists are
    checkpointed, so neither the driver nor a plan ever holds more of it, however large it is.
    """
    packed = docs.select(F.struct(F.col(id_col).alias("id"), F.col(text).alias("text")).alias("row"))
    found = _searched(packed, "text", _parts(benchmark, item_text, item_id), q, edits, window, benchmark.schema[item_id].dataType)
    return found.select(F.col("row.id").alias(id_col), "items")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_id: str = "item_id", q: int = Q, edits: float = EDITS, window: int = WINDOW) -> DataFrame:
    """(row, items): as ``contamination``, with each row of docs, whole, as a struct: so its columns may have any names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _searched(packed, text, _parts(benchmark, item_text, item_id), q, edits, window, benchmark.schema[item_id].dataType)


def _searched(packed: DataFrame, text: str, parts: Iterator[list[tuple[int, str]]], q: int, edits: float, window: int, id_type: DataType) -> DataFrame:
    hold_batches(packed.sparkSession)
    kind = f"array<{id_type.simpleString()}>"
    found = packed.withColumn("items", F.array().cast(kind))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, items {kind}"
    for i, items in enumerate(parts, 1):
        found = found.mapInArrow(_search(items, text, q, edits, window, pa.list_(to_arrow_type(id_type))), schema)
        if i % PARTS == 0:
            found = kept(found)
    return found


def _search(items: list[tuple], text: str, q: int, edits: float, window: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Index(items, q, edits, window)
            lists = []
            for value, before in zip(batch.column(0).field(text), batch.column(1).to_pylist(), strict=True):
                lists.append(sorted(index.hits(normalise(value.as_py())).union(before), key=lambda i: (i is None, i if i is not None else 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], names=["row", "items"])

    return run
