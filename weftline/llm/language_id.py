"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. A trigram's vector binds
(multiplies) the vectors of its letters after permuting them by their place: twice, once and not
at all rotated. A text's vector bundles (adds) its trigrams' vectors, a language's prototype
bundles its training texts, and a text gets the language whose prototype has the largest cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import hold_batches

DIMENSIONS = 2048
SEED = 20240
#: Training texts for each language at most; more would not change a prototype's direction.
TRAIN_TEXTS = 3000
#: Training texts are bundled from at most this many code points at a time; texts are cut into such blocks.
BLOCK = 1 << 17
UNKNOWN = "und"


class Alphabet:
    """Lower-cased letters by code point; anything else is one gap between words."""

    def __init__(self) -> None:
        self.small = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                self.small[c] = ord(low) if len(low) == 1 else c

    def codes(self, text: str) -> np.ndarray:
        """The lower-cased code point of each letter, 0 for anything else."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes) or codes.max() < 1 << 16:
            return self.small[codes]
        big = codes >= 1 << 16
        out = np.zeros(len(codes), np.uint32)
        out[~big] = self.small[codes[~big]]
        values, where = np.unique(codes[big], return_inverse=True)
        out[big] = np.array([ord(chr(v).lower()) if chr(v).isalpha() and len(chr(v).lower()) == 1 else 0 for v in values.tolist()], np.uint32)[where]
        return out

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """A text's letters in blocks: 0 for each run of others and at both ends of the text, and at a block's head the last two of the block before.

        So every trigram of the text is in one block, once, wherever the blocks are cut.
        """
        tail = np.zeros(1, np.uint32)
        for i in range(0, max(1, len(text)), BLOCK):
            out = np.concatenate([tail, self.codes(text[i : i + BLOCK]), np.zeros(int(i + BLOCK >= len(text)), np.uint32)])
            out = out[np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])]
            yield out
            tail = out[-2:]


class Vectors:
    """Letter vectors, each in its three rotations, made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.rows: dict[int, int] = {}
        self.table = np.empty((64, 3, dimensions), np.int8)

    def row(self, letter: int) -> int:
        i = self.rows.get(letter)
        if i is None:
            i = self.rows[letter] = len(self.rows)
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            drawn = hashlib.shake_128(f"{self.seed}:{letter}".encode()).digest(self.dimensions // 8)
            signs = np.unpackbits(np.frombuffer(drawn, np.uint8)).astype(np.int8) * 2 - 1
            for k in range(3):
                self.table[i, k] = np.roll(signs, 2 - k)
        return i

    def trigrams(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, given as rows of three letters."""
        if len(self.rows) > 1 << 14:  # a worker's table stays bounded; vectors are drawn again
            self.rows, self.table = {}, np.empty((64, 3, self.dimensions), np.int8)
        letters, where = np.unique(grams, return_inverse=True)
        rows = np.array([self.row(int(c)) for c in letters])[where.reshape(grams.shape)]
        return self.table[rows[:, 0], 0] * self.table[rows[:, 1], 1] * self.table[rows[:, 2], 2]


def trigram_counts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of some texts' letters, as rows of three, and a row of counts for each text."""
    if sum(map(len, texts)) < 3:
        return np.empty((0, 3), np.uint32), np.zeros((len(texts), 0), np.int64)
    codes = np.concatenate(texts)
    letters, rank = np.unique(codes, return_inverse=True)
    k, rank = len(letters), rank.astype(np.int64)
    packed = (rank[:-2] * k + rank[1:-1]) * k + rank[2:]
    ends = np.cumsum([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[:-2]
    inside = np.ones(len(packed), bool)  # trigrams that reach into the next text do not count
    for back in (1, 2):
        at = ends[:-1] - back
        inside[at[at >= 0]] = False
    packed, owner = packed[inside], owner[inside]
    if k**3 <= 1 << 22:
        present = np.bincount(packed, minlength=k**3) > 0
        grams = np.flatnonzero(present)
        column = (np.cumsum(present) - 1)[packed]
    else:
        grams, column = np.unique(packed, return_inverse=True)
    counts = np.bincount(owner * len(grams) + column, minlength=len(texts) * len(grams)).reshape(len(texts), len(grams))
    return letters[np.stack([grams // (k * k), grams // k % k, grams % k], 1)], counts


class Bundler:
    """Bundles texts into hyperdimensional vectors, many at a time."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED) -> None:
        self.vectors, self.alphabet = Vectors(dimensions, seed), Alphabet()

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The vector of each text, and whether it has a letter."""
        out = np.zeros((len(texts), self.vectors.dimensions), np.float32)
        letter = np.zeros(len(texts), bool)
        owners: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(texts):
            for codes in self.alphabet.blocks(text or ""):
                if codes.any():
                    letter[i] = True
                    owners.append(i)
                    held.append(codes)
                    size += len(codes)
                if held and (size >= BLOCK or len(held) >= 64):
                    self._add(out, owners, held)
                    owners, held, size = [], [], 0
        if held:
            self._add(out, owners, held)
        return out, letter

    def _add(self, out: np.ndarray, owners: list[int], held: list[np.ndarray]) -> None:
        grams, counts = trigram_counts(held)
        for i in range(0, len(grams), 2048):
            part = counts[:, i : i + 2048].astype(np.float32) @ self.vectors.trigrams(grams[i : i + 2048]).astype(np.float32)
            np.add.at(out, owners, part)


def _rows(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", order: str = "doc_id", dimensions: int = DIMENSIONS, seed: int = SEED, train_texts: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """The languages, ascending, and their prototype vectors.

    Learns from a sample of about train_texts rows for each non-null lang, chosen by a hash of
    ``order``; a language with fewer is used whole. The sums are made on the executors; the driver
    gets one vector for each language.
    """
    hold_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    languages = sorted(totals)
    if not languages:
        return [], np.zeros((0, dimensions), np.float32)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, train_texts / totals[name])))])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.lit(1 << 20)) / (1 << 20)
    sample = known.where(draw < share[F.col(lang)]).select(lang, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in _rows(batch):
                vectors, _ = bundler.bundle(rows.column(1).to_pylist())
                for name, v in zip(rows.column(0).to_pylist(), vectors, strict=True):
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)], names=["lang", "i", "v"])

    sums = sample.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    bundles = np.zeros((len(languages), dimensions))
    place = {name: k for k, name in enumerate(languages)}
    for r in sums.collect():
        bundles[place[r["lang"]], r["i"]] = r["v"]
    return languages, bundles


class _Labels:
    """What a worker needs to label texts."""

    def __init__(self, languages: list[str], bundles: np.ndarray, dimensions: int, seed: int) -> None:
        lengths = np.linalg.norm(bundles, axis=1, keepdims=True)
        self.languages, self.unit = languages, (bundles / np.where(lengths > 0, lengths, 1)).astype(np.float32)
        self.dimensions, self.seed = dimensions, seed

    def of(self, bundler: Bundler, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        vectors, letter = bundler.bundle(texts)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            cosine = vectors @ self.unit.T / np.where(norm > 0, norm, 1)
            best = cosine.argmax(1)
            score = np.where(letter, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            found = [self.languages[b] if has else UNKNOWN for b, has in zip(best, letter, strict=True)]
        return pa.array(found, pa.string()), pa.array(score, pa.float64())


def identify(docs: DataFrame, languages: list[str], bundles: np.ndarray, *, text: str = "text", id_col: str = "doc_id", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """The language of every whole text.

    Returns (id_col, lang_pred, score): the language of the prototype with the largest
    cosine (ties: the first by name) and that cosine, 0 if negative. ``und`` with score 0 for a null text, one
    without a letter, or if no language was learned. One row for each row of docs; an empty
    table gives an empty one; other columns are not read, whatever their names.
    """
    hold_batches(docs.sparkSession)
    labels = _Labels(languages, bundles, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions, seed)
        for batch in batches:
            for rows in _rows(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), *labels.of(bundler, rows.column(1).to_pylist())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def labelled_rows(docs: DataFrame, languages: list[str], bundles: np.ndarray, *, text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """(row, lang_pred, score): as ``identify``, with each row of docs, whole, as a struct: so its columns may have any names."""
    hold_batches(docs.sparkSession)
    labels = _Labels(languages, bundles, dimensions, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions, seed)
        for batch in batches:
            for rows in _rows(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), *labels.of(bundler, rows.column(0).field(text).to_pylist())], names=["row", "lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
