"""Document fingerprints by a threshold-scaled sketch.

A fingerprint keeps every hash of a five-word shingle below a fixed fraction of the hash range, and,
so that short texts have one too, never fewer than the KEEP smallest. Both rules are those of a set, so
fingerprints merge: the sketch of a union is the sketch of the two sketches' union. A sketch is complete
up to a level that it shows itself (all hashes if it has fewer than KEEP, else the larger of the threshold and its
largest hash), and two sketches are compared below the lower of their levels; so documents of very
unequal length have unbiased likeness and containment.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textblocks as tb
from weftline.llm.shared import hold_batches, parts

FRACTION = 1 / 16
KEEP = 64
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(hashes: np.ndarray, fraction: float = FRACTION, keep: int = KEEP) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (or of a union of sketches), ascending."""
    limit = np.uint64(int(fraction * 2.0**64))
    low = np.unique(hashes[hashes < limit])
    if len(low) >= keep:
        return low
    if len(hashes) > 8 * keep:  # the smallest are wanted: no need to sort the rest
        hashes = np.unique(hashes)
        return hashes[:keep]
    return np.unique(hashes)[:keep]


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, keep: int = KEEP) -> np.ndarray:
    return sketch(np.concatenate([a, b]), fraction, keep)


def level(s: np.ndarray, fraction: float = FRACTION, keep: int = KEEP) -> np.uint64:
    """The hash up to which, itself included, a sketch is complete."""
    if len(s) < keep:
        return _ALL
    return max(np.uint64(int(fraction * 2.0**64) - 1), s[-1])


def _below(a: np.ndarray, b: np.ndarray, fraction: float, keep: int) -> tuple[int, int, int]:
    top = min(level(a, fraction, keep), level(b, fraction, keep))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, keep: int = KEEP) -> float:
    """Estimated Jaccard likeness, 0 to 1. Two empty sketches are alike (1), an empty and another not (0)."""
    n, m, both = _below(a, b, fraction, keep)
    return both / (n + m - both) if n + m else 1.0


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, keep: int = KEEP) -> float:
    """Estimated share of a's shingles that b has; 1 if a's sketch is empty."""
    n, _, both = _below(a, b, fraction, keep)
    return both / n if n else 1.0


def write(s: np.ndarray) -> str:
    """A sketch as text: base64 of its hashes, 8 bytes each, smallest first."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(column: pa.Array, fraction: float = FRACTION, keep: int = KEEP) -> list[np.ndarray]:
    return [sketch(tb.shingles(w), fraction, keep) for w in tb.word_hashes(column)]


def fingerprint(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", fraction: float = FRACTION, keep: int = KEEP) -> DataFrame:
    """(id_col, fingerprint) of every whole text; a null text has the empty text's, which is empty.

    Equal texts have equal fingerprints. One row for each row of docs; an empty table gives an
    empty one; other columns are not read, whatever their names.
    """
    hold_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(s) for s in sketches(batch.column(1), fraction, keep)], pa.string())], names=[id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, ahead): rows dealt into ranges of numeric ids, one a task, and sorted; each range is
    followed by the first row of the next (ahead true), the last one by the very first.

    So each row's successor is in its task. The range bounds are approximate quantiles: their number,
    and what the driver gets, follow the number of partitions, not of rows. Null ids come
    first; rows with equal ids are in the order of a hash of their texts.
    """
    spark = docs.sparkSession
    n = parts(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    bounds = sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    place = F.lit(0)
    if bounds:
        # in two steps of about the root of the number of bounds each
        width = math.isqrt(len(bounds) - 1) + 1
        listed = lambda bs: F.array(*[F.lit(b).cast(kind) for b in bs])
        upto = lambda bs: F.size(F.filter(bs, lambda b: b <= F.col("id")))
        coarse = upto(listed(bounds[width - 1 :: width])) if len(bounds) >= width else F.lit(0)
        place = coarse * width + upto(F.slice(listed(bounds), coarse * width + 1, F.lit(width)))
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), 0).otherwise(place).cast("int")).withColumn("hash", F.xxhash64("text"))
    key = F.struct(F.col("id").isNotNull().alias("has"), "id", "hash")
    least = {r["range"]: r["least"] for r in rows.groupBy("range").agg(F.min(key).alias("least")).collect()}
    used = sorted(least)
    firsts = spark.createDataFrame([(r, least[r]["id"], least[r]["hash"], used[i - 1]) for i, r in enumerate(used)], f"range int, first {kind.simpleString()}, hash bigint, before int")
    same = (rows["range"] == firsts["range"]) & rows["id"].eqNullSafe(firsts["first"]) & (rows["hash"] == firsts["hash"])
    own = F.struct(rows["range"].alias("to"), F.lit(False).alias("ahead"))
    both = F.when(firsts["before"].isNull(), F.array(own)).otherwise(F.array(own, F.struct(firsts["before"].alias("to"), F.lit(True).alias("ahead"))))
    dealt = rows.join(F.broadcast(firsts), same, "left").select(rows["id"], rows["text"], rows["hash"], F.inline(both))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("to"))
    return dealt.sortWithinPartitions("to", "ahead", F.col("id").isNotNull(), "id", "hash").select("id", "text", "ahead")


def compare_with_edits(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", fraction: float = FRACTION, keep: int = KEEP) -> DataFrame:
    """Fingerprints of every whole text and of an edit of it, and their likeness.

    The edit replaces the last floor(n / 2) of a text's n code points by the first as many (or all)
    of the next text, by id; after the last comes the first. Returns (id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next). A null text is an empty one; rows with equal ids follow
    one another, each a row of the result; an empty table gives an empty one; a lone row follows itself.
    """
    hold_batches(docs.sparkSession)
    step = 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (id, text, sketch) of the row that waits for its successor
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                ids, ahead = rows.column(0).to_pylist(), rows.column(2).to_pylist()
                texts = [t or "" for t in rows.column(1).to_pylist()]
                found = sketches(rows.column(1), fraction, keep)
                done = []
                for row in zip(ids, texts, found, ahead, strict=True):
                    if last is not None:
                        done.append((*last, row[1], row[2]))
                    last = None if row[3] else row[:3]
                if not done:
                    continue
                edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, _, after, _ in done]
                changed = sketches(pa.array(edited, pa.large_string()), fraction, keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in done], batch.schema.field(0).type),
                        pa.array([len(d[1]) for d in done], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array([write(d[2]) for d in done]),
                        pa.array([write(c) for c in changed]),
                        pa.array([likeness(d[2], c, fraction, keep) for d, c in zip(done, changed, strict=True)], pa.float64()),
                        pa.array([likeness(d[2], d[4], fraction, keep) for d in done], pa.float64()),
                    ],
                    names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return in_order(docs, id_col=id_col, text=text).mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
