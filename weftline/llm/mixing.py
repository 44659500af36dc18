"""Mixing sources to target weights by temperature.

A source with share p of the tokens gets a weight in proportion to p ** a. The exponent is
bisected, either so that the weights have a wanted entropy, or to be the smallest (the most even
mixture) by which no source is repeated more often than allowed. Weights times the token budget are
each source's tokens; they are realised as whole passes over the source, each in a permutation of its own,
and a last pass that its budget cuts short. Each row also gets the block of the mixed output it belongs to,
so that every block holds the sources in their weights, and a place in its block's permutation; ``laid_out`` puts the rows in that order.

Rows are placed by hashes of their ids: nothing but the cut of the last pass needs sums, and those are made over
hash buckets, then over finer and finer buckets inside the one that holds the cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import kept

#: Bits of a place, and those that one round of sums tells apart.
BITS, STEP = 62, 10
#: Tokens of one block of the mixed output.
BLOCK_TOKENS = 1_000_000
#: How often a source is given at most.
MAX_REPEATS = 4.0
SEED = 17


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the token shares; a source without tokens has weight 0."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [p / sum(powers) for p in powers] if total else [0.0 for _ in tokens]


def entropy(ws: list[float]) -> float:
    return -sum(w * math.log(w) for w in ws if w > 0)


def exponent_for_entropy(tokens: list[int], target: float, steps: int = 100) -> float:
    """The exponent from 0 (even) to 1 (as found) whose weights have this entropy in nats.

    Where even weights have less, 0; where the shares as found have more, 1.
    """
    low, high = 0.0, 1.0
    if entropy(weights(tokens, low)) <= target:
        return low
    if entropy(weights(tokens, high)) >= target:
        return high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(weights(tokens, mid)) > target else (low, mid)
    return high


def repeats(tokens: list[int], exponent: float, budget: int | None) -> float:
    """How often the most repeated source is given; without a budget as many tokens are as it takes to give each source whole."""
    per = [w / t for w, t in zip(weights(tokens, exponent), tokens, strict=True) if t]
    return (max(per) * budget if budget is not None else max(per) / min(per)) if per else 0.0


def exponent_for_repeats(tokens: list[int], budget: int | None, most: float, least: float = 0.0, steps: int = 100) -> float:
    """The smallest exponent from ``least`` to 1 by which no source is repeated more often; 1 if none is."""
    low, high = least, 1.0
    if repeats(tokens, low, budget) <= most or repeats(tokens, high, budget) > most:
        return low if repeats(tokens, low, budget) <= most else high
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if repeats(tokens, mid, budget) > most else (low, mid)
    return high


@dataclass(frozen=True)
class Share:
    """What one source gives: whole passes, and of one more the rows whose hash is below the cut."""

    source: str | None
    tokens: int
    weight: float
    budget: int
    passes: int
    cut: int | None


@dataclass(frozen=True)
class Mix:
    exponent: float
    shares: list[Share]
    blocks: int
    seed: int


def _place(number: Column, row_id: Column, seed: int) -> Column:
    """A row's place in a pass: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), number.cast("bigint"), row_id), 2)


def plan(rows: DataFrame, budget: int | None = None, *, whole: bool = False, entropy_share: float | None = None, max_repeats: float = MAX_REPEATS, id_col: str = "doc_id", source: str = "source", tokens: str = "tokens", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> Mix:
    """The mixture for rows (id_col, source, tokens).

    budget: tokens to give; the default is as many as there are, or with ``whole`` the fewest by which every
    source is given at least once as a whole. With entropy_share the weights get that share of the entropy of
    even weights; the exponent is then raised until no source is given more than max_repeats times, by the budget that is used in the end. The driver gets a row for each source.
    A null source is a source of its own. A source whose texts have no tokens takes up no budget: it is given whole, once, as it costs nothing. Without
    rows the plan is empty.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"))
    totals = sorted(((r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    counts = [n for _, n in totals]
    budget = sum(counts) if budget is None else budget
    used = sum(n > 0 for n in counts)
    a = 0.0 if entropy_share is None else exponent_for_entropy(counts, entropy_share * math.log(max(1, used)))
    a = exponent_for_repeats(counts, None if whole else budget, max_repeats, a)
    if whole:
        budget = math.ceil(max((n / w for n, w in zip(counts, weights(counts, a), strict=True) if w), default=0) * (1 + 1e-9))
    shares = []
    for (name, n), w in zip(totals, weights(counts, a), strict=True):
        own = math.floor(w * budget)
        shares.append(Share(name, n, w, own, own // n if n else 1, None))
    rest = [(i, s.source, s.passes, s.budget - s.passes * s.tokens) for i, s in enumerate(shares) if s.tokens and s.budget % s.tokens]
    if rest:
        cuts = _cuts(rows, rest, seed)
        shares = [Share(s.source, s.tokens, s.weight, s.budget, s.passes, cuts.get(i)) for i, s in enumerate(shares)]
    return Mix(a, shares, max(1, math.ceil(budget / block_tokens)), seed)


def _cuts(rows: DataFrame, rest: list[tuple], seed: int) -> dict[int, int]:
    """For each source, the first place in its last pass at which its rest is used up.

    Each round sums the buckets of STEP bits inside the bucket that the last one found for each source: the driver gets that bucket only, so no row is
    sorted and nothing grows with the input.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, name, number) for i, name, number, _ in rest], "i int, name string, pass bigint")
    own = kept(rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["name"])).where(F.col("n") > 0).select("i", "n", _place(F.col("pass"), F.col("id"), seed).alias("place")))
    at, left = {i: 0 for i, *_ in rest}, {i: r for i, _, _, r in rest}
    for below in range(BITS, 0, -STEP):
        step = min(STEP, below)
        here = spark.createDataFrame([(i, p) for i, p in at.items()], "i int, upper bigint")
        if below < BITS:  # of each source the bucket found before is left, and no more is read again
            own = kept(own.join(F.broadcast(here), "i").where(F.shiftright("place", below) == F.col("upper")).drop("upper"))
        sums = own.groupBy("i", F.shiftright("place", below - step).alias("bucket")).agg(F.sum("n").alias("n"))
        for i, got in _grouped(sums.collect()).items():
            for bucket, n in sorted(got):
                if n > left[i]:
                    at[i] = bucket
                    break
                left[i] -= n
    return at


def _grouped(rows: list) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        out.setdefault(r["i"], []).append((r["bucket"], r["n"]))
    return out


def realise(docs: DataFrame, mix: Mix, *, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """(row, mix_pass, mix_block, mix_place): every row of docs, whole, as a struct, as often as its source's passes take it.

    No shuffle: a row's places depend on its id and its source's share. Rows with equal ids go
    together. mix_place orders a block's rows by a hash. The columns of docs may have any names.
    """
    table = docs.sparkSession.createDataFrame([(s.source, s.passes, s.cut) for s in mix.shares], "mix_source string, mix_whole bigint, mix_cut bigint")
    whole, cut = F.col("mix_whole"), F.col("mix_cut")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own_id = F.col("row").getField(id_col)
    # one row for each source: as many as the plan holds
    out = packed.join(F.broadcast(table), F.col("row").getField(source).eqNullSafe(F.col("mix_source")))
    out = out.withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("bigint"), whole)))
    out = out.withColumn("mix_place", _place(F.col("mix_pass"), own_id, mix.seed))
    out = out.where((F.col("mix_pass") < whole) | (F.col("mix_place") < F.coalesce(cut, F.lit(0))))
    share = 1.0 / (1 << BITS)
    length = whole + F.coalesce(cut, F.lit(0)) * share
    block = F.floor((F.col("mix_pass") + F.col("mix_place") * share) / length * mix.blocks)
    out = out.withColumn("mix_block", F.least(block, F.lit(mix.blocks - 1)).cast("int"))
    out = out.withColumn("mix_place", F.xxhash64(F.lit(mix.seed), F.lit("block"), "mix_pass", own_id))
    return out.select("row", "mix_pass", "mix_block", "mix_place")


def laid_out(mixed: DataFrame, *, shuffle: bool = False) -> DataFrame:
    """The rows of ``realise`` in the order of blocks and of places in them, with their own columns.

    Each task's rows are put in that order where they are, so every file that is written holds its part of block after block, in the block's
    permutation, and a reader that merges the files by block has the mixture; rows do not move. With shuffle the files themselves follow one another in that order, at the
    price of moving every text.
    """
    dealt = mixed.repartitionByRange("mix_block", "mix_place") if shuffle else mixed
    return dealt.sortWithinPartitions("mix_block", "mix_place").select("row.*")
