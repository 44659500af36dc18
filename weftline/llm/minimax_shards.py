"""Sharding by a minimax contiguous partition, in DataFrame functions alone.

Equal texts are one atomic group. Groups are ordered by a 60-bit hash of their text and cut
into contiguous shards so that the largest shard is as small as can be: the capacity is
binary-searched, and each capacity is tested by filling shards greedily.

The driver never sees the groups, only byte sums of hash ranges: first of 2**16 ranges, then,
where a cut could fall inside a range, of that range's 2**12 parts, until every cut is known
to the group. A capacity is proven feasible when whole ranges alone allow it, and infeasible when
even divisible ranges do not; what lies between asks for finer ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import kept

BITS, FIRST, STEP = 60, 16, 12
#: Rows of a shard are numbered in independent parts of about so many rows, and at least in so many parts.
PART_ROWS, SLOT_PARTS = 100_000, 64


class Ranges:
    """Hash ranges in order: (first key, bytes, bits below, whether one group)."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]) -> None:
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if rows else 0

    def cut(self, limit: int, divisible: bool) -> int:
        """Bytes before the last cut that is not beyond limit."""
        if limit >= self.total:
            return self.total
        i = bisect_right(self.ends, limit)
        start = self.ends[i - 1] if i else 0
        return limit if divisible and not self.rows[i][3] else start

    def fill(self, capacity: int, shards: int, divisible: bool = False, start: int = 0) -> list[int]:
        """Cuts of greedy filling; the last is the total if the capacity is feasible."""
        cuts, at = [], start
        for _ in range(shards):
            at = self.cut(at + capacity, divisible)
            cuts.append(at)
        return cuts

    def smallest(self, shards: int, divisible: bool) -> int:
        """The smallest feasible capacity, by binary search."""
        low, high = max(1, -(-self.total // shards)), max(1, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.fill(mid, shards, divisible)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> list[int]:
        """Indexes of ranges inside which a cut may fall for capacities from low to high."""
        out: set[int] = set()
        for a, b in zip(self.fill(low, shards), self.fill(high, shards, True), strict=True):
            i, j = bisect_right(self.ends, a), min(bisect_left(self.ends, b), len(self.rows) - 1)
            out |= {k for k in range(i, j + 1) if not self.rows[k][3]}
        return sorted(out)


def _sums(rows: DataFrame, below: int) -> list[tuple[int, int, int, bool]]:
    ranges = rows.groupBy(F.shiftright("key", below).alias("range")).agg(F.sum("size").alias("bytes"), F.min("key").alias("first"), F.max("key").alias("last"))
    return [(r["first"], r["bytes"], below, r["first"] == r["last"]) for r in ranges.select("first", "bytes", "last").collect()]


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of shards 1, 2, ... and the capacity. rows: key (60 bits) and size."""
    ranges = Ranges(_sums(rows, BITS - FIRST))
    if not ranges.rows:
        return [], 0
    while True:
        high, low = ranges.smallest(shards, False), ranges.smallest(shards, True)
        finer = [] if low == high else ranges.unsure(low, high, shards)
        if not finer:
            break
        old = [ranges.rows[i] for i in finer]
        new: list[tuple[int, int, int, bool]] = []
        for below in sorted({r[2] for r in old}):
            some = [r[0] >> below for r in old if r[2] == below]
            new += _sums(rows.where(F.shiftright("key", below).isin(some)), max(0, below - STEP))
        gone = set(finer)
        ranges = Ranges([r for i, r in enumerate(ranges.rows) if i not in gone] + new)
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        # the cut nearest to an even rest, if the capacity still holds for what follows
        limit = ranges.cut(at + high, False)
        even = at + (ranges.total - at) // (left + 1)
        i = bisect_right(ranges.ends, even)
        near = min((ranges.ends[k] for k in (i - 1, i) if 0 <= k < len(ranges.ends) and at <= ranges.ends[k] <= limit), key=lambda e: abs(e - even), default=limit)
        at = near if ranges.fill(high, left, start=near)[-1] >= ranges.total else limit
        cuts.append(at)
    firsts = [ranges.rows[k][0] if (k := bisect_right(ranges.ends, c)) < len(ranges.rows) else 1 << BITS for c in cuts]
    return firsts, high


def shard(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Puts all documents into contiguous shards of least largest size; equal texts stay together.

    Returns (id_col, size, text_crc32, law, shard, slot, grown_shard): size is UTF-8 bytes plus 1, law is
    ``bytes``, slot numbers the rows of a shard from 0 without gaps, in a random order, so what a mixture repeats is spread over the shard; grown_shard is null. A null
    text is an empty one, and of one group with it; repeated rows get slots of their own; a
    null id is placed like any other; an empty table gives an empty one. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = kept(docs.select(F.col(id_col), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(body), 64 - BITS).alias("key")))
    firsts, _ = minimax_cuts(rows, n_shards)
    number = F.lit(0)
    for first in firsts:
        number = number + (F.col("key") >= first).cast("int")
    parts = max(SLOT_PARTS, -(-rows.count() // PART_ROWS))
    # rows are a checkpoint, so each keeps its number; copies of a row are spread like other rows
    place = F.xxhash64(id_col, "key", F.monotonically_increasing_id())
    placed = rows.withColumn("shard", number).withColumn("place", place).withColumn("part", F.pmod("place", F.lit(parts)).cast("int"))
    # one row for each PART_ROWS rows of a shard
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "part").orderBy("place")
    out = placed.withColumn("row", F.row_number().over(order)).join(before, ["shard", "part"])
    return out.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("row") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
