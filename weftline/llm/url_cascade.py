"""URL filters by a Bloom filter cascade, in DataFrame functions alone.

A rule is a host and a path prefix with a verdict. Each url has the candidate keys that a
rule for it could have: each suffix of its host at a dot, with each prefix of its path whose
length some rule has. Over the distinct candidates of the whole corpus (the universe) one
cascade for each verdict encodes which are rules: level 1 holds the listed keys, level 2 the
universe's keys that level 1 takes in wrongly, level 3 the listed keys that level 2 takes in,
and so on until nothing is taken in wrongly. Walking the levels is then exact for every key of the
universe, so a url is judged by bit probes, without a join.

Rules of any number are dealt by a hash of their key to cascades of a bounded size, one pass over the urls for each.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import kept

#: Bytes of bit words that may be put into a plan; more rules are judged in more passes.
MAX_FILTER_BYTES = 8 << 20
#: Levels after the first let this share of the other side through.
RATE = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of keys, host suffix + path prefix, that a rule for this url could have."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    paths = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\x00"), p))))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


class Level:
    """One Bloom filter: bit words in rows of 64, and its seeds."""

    def __init__(self, words: list[int], probes: int, seed: int) -> None:
        self.words, self.probes, self.seed = words, probes, seed

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        """Words and probes for n keys of which others pass at this rate."""
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        return -(-bits // 64), max(1, round(-math.log2(rate)))

    @staticmethod
    def bits(key: Column, words: int, probes: int, seed: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(words * 64)) for i in range(probes)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, seed: int) -> Level:
        words, probes = cls.shape(n, rate)
        bit = keys.select(F.explode(F.array(*cls.bits(F.col("key"), words, probes, seed))).alias("bit"))
        rows = bit.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("v")).collect()
        held = [0] * words
        for r in rows:
            held[r["word"]] = r["v"]
        return cls(held, probes, seed)

    def has(self, key: Column) -> Column:
        # the words stand in the plan once, whatever the number of probes; the optimiser turns them into an array
        held = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        places = F.array(*self.bits(key, len(self.words), self.probes, self.seed))
        return F.forall(places, lambda b: F.getbit(F.get(held, F.floor(b / 64).cast("int")), (b % 64).cast("int")) == 1)


class Cascade:
    """Exact membership of universe keys in a listed set."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int, seed: int) -> Cascade:
        """listed, universe: distinct ``key`` each. Keys listed but not in the universe are never asked for."""
        if not n_listed or not n_universe:
            return cls([])
        others = universe.join(listed, "key", "left_anti")
        first = min(RATE, max(1e-6, n_listed * math.sqrt(RATE) / n_universe))
        levels, inside, outside, n = [], listed, others, n_listed
        while n:
            level = Level.build(inside, n, first if not levels else RATE, seed + len(levels))
            levels.append(level)
            wrong = outside.where(level.has(F.col("key")))
            n = wrong.count()
            inside, outside = wrong, inside
        return cls(levels)

    def has(self, key: Column) -> Column:
        """The first level that keeps a key out decides: an even one means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
        return out

    @property
    def size(self) -> int:
        return sum(8 * len(x.words) for x in self.levels)


def _those(keys: Column, shard_of: Callable[[Column], Column], shard: int) -> Column:
    return F.filter(keys, lambda k: shard_of(k) == shard)


def _hits(keys: Column, verdict: str, kind: str) -> Column:
    """Keys as structs that order them: the longest, then that with the longest host."""
    return F.transform(keys, lambda k: F.struct(F.length(k).alias("all"), F.instr(k, "\x00").alias("host"), F.lit(verdict).alias("verdict"), k.alias("key")).cast(kind))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", id_col: str = "page_id", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Judges every url by the longest rule that fits it.

    rules: (host, path, verdict), verdict allow or block; if a (host, path) has both, block holds.
    A rule fits its host and all its subdomains where the url's path starts with the rule's;
    the longest host + path wins, then the longer host. Returns (id_col, host, path, rule, verdict); without a
    rule, rule is null and the verdict is ``default``: the cascades say the url is not listed.
    A null url, or one without ``://``, has an empty host and path and fits no rule. Repeated
    rows are judged one by one; an empty table gives an empty one; other columns are not read.

    The filters' size grows with the rules, not with the corpus. Beyond max_filter_bytes the rules are dealt by a hash of their
    key to as many sets of cascades as are needed; each is a pass that keeps the better of its own and the earlier finds.
    """
    lower = F.translate(F.coalesce(F.col("host"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = kept(rules.select(F.concat(lower, F.lit("\x00"), F.coalesce(F.col("path"), F.lit(""))).alias("key"), F.length(F.coalesce(F.col("path"), F.lit(""))).alias("n"), F.col("verdict")).groupBy("key").agg(F.max("n").alias("n"), F.max("verdict").alias("verdict")))
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    host, path = split_url(F.col(url))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not lengths:
        return split.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), lengths)
    total = listed.count()
    # some 29 bits a key in the first level and 8 in those that follow
    shards = max(1, math.ceil(total * (-math.log(1e-6) / math.log(2) ** 2 + 8) / 8 / max(1, max_filter_bytes)))
    shard_of = lambda k: F.pmod(F.xxhash64(F.lit("shard"), k), F.lit(shards)).cast("int")
    universe = kept(split.select(F.explode(keys).alias("key")).distinct().withColumn("shard", shard_of(F.col("key"))))
    sizes = {r["shard"]: r["count"] for r in universe.groupBy("shard").count().collect()}
    counts = {(r["shard"], r["verdict"]): r["count"] for r in listed.groupBy(shard_of(F.col("key")).alias("shard"), "verdict").count().collect()}
    found = "struct<all:int,host:int,verdict:string,key:string>"
    judged = split.withColumn("best", F.lit(None).cast(found))
    for shard in range(shards):
        own_keys = keys if shards == 1 else _those(keys, shard_of, shard)
        best = [F.col("best")]
        for k, verdict in enumerate(sorted({v for s, v in counts if s == shard})):
            own = listed.where((F.col("verdict") == verdict) & (shard_of(F.col("key")) == shard)).select("key")
            c = Cascade.build(own, universe.where(F.col("shard") == shard).select("key"), counts[shard, verdict], sizes.get(shard, 0), 1000 * (k + 1))
            best.append(F.array_max(_hits(F.filter(own_keys, c.has), verdict, found)))
        judged = judged.withColumn("best", F.array_max(F.array_compact(F.array(*best))))
        if shards > 1:
            judged = kept(judged)
    return judged.select(id_col, "host", "path", F.translate("best.key", "\x00", "").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
