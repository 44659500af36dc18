"""N-gram Jaccard join by parity sketches, and the components of its links.

Each document is its set of distinct word shingles. Sizes fall into bands. For a band, shingles are
dealt by hash to P places, and a place has a sketch of 2**32 bits, each the parity of the shingles that hash to
it; as nearly all are 0, it is held as the XOR of the hashes of its odd bits. The Hamming distance of two sketches is
at most the symmetric difference of the sets, and two sets of sizes a and b with the wanted likeness differ in at most
d = a + b - 2 * least intersection shingles; so of the first d + 1 places that hold something in one
sketch, one is the same in the other (pigeonhole).

1. ``sized`` hashes every text once: its set's size and 64-bit identity. Equal sets are one set from here on.
2. ``_places`` gives each set's first d + 1 filled places as keys, in the bands that a partner can share. They travel as
   packed blocks, one for each task and target, not as rows.
3. ``_groups`` sorts the keys of a target: sets that share one are a candidate group. Equal groups are merged. A key that more than HOT sets
   share, as those of a common line or passage are, makes no group at first: all keys are given once more, with such places last in
   everyone's order (the pigeonhole holds for any order that all share), so texts meet by what is rare in them. Only what is mostly common
   still meets in a large group, which is cut into blocks that are paired.
4. ``_routed`` sends groups to tasks by their smallest member, and there each of their sets once. ``_near`` does so with
   sketches of 4 to 8 bits a shingle and leaves in a group the members that have a pair in it whose distance is not above
   d. ``_links`` does so with the exact sets of what is left: a pair of sets not yet in one component is tested by sketches,
   then exactly, nearest pairs first. Only links that join components of the task come out: a spanning forest, not the
   pairs of a group, and no link between components is lost.
5. Components are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import textblocks as tb
from weftline.llm.shared import hold_batches, kept, parts

#: Likeness as a fraction: intersection * DOWN >= UP * union.
UP, DOWN = 80, 100
WORDS = 5
#: Bands grow by this factor; below SMALL each shingle is a place of its own.
GROWTH, SMALL = 1.6, 24
#: Keys that a task holds before it hands its blocks on; sets of a group that are compared at once.
HELD_KEYS, GROUP = 1 << 21, 1024
#: Sets of a key that is put last; rounds of keys at most; keys that may be put last, 8 bytes each (more of them are cut into blocks at once).
HOT, ROUNDS, MOST_HOT = 2048, 3, 1 << 20
#: Groups of one hub for each task; ids of documents that may be broadcast, 16 to 32 bytes each.
HUB_GROUPS, BROADCAST_IDS = 2048, 400_000


def most_different(a: np.ndarray | int, b: np.ndarray | int, up: int = UP, down: int = DOWN) -> np.ndarray | int:
    """The largest symmetric difference of linked sets of these sizes; negative if none can be linked."""
    least = -(-(up * (a + b)) // (up + down))
    return np.where(least <= np.minimum(a, b), a + b - 2 * least, -1)


class Bands:
    """Size bands [edges[i], edges[i + 1]). A pair is compared in the band of its smaller set."""

    def __init__(self, up: int = UP, down: int = DOWN) -> None:
        self.up, self.down = up, down
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
        self.edges = np.array(edges)
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def places(self, band: int) -> int:
        """How many places; 0: each shingle is a place of its own."""
        if self.edges[band] < SMALL:
            return 0
        top = int(self.edges[band + 1]) - 1
        return int((top * (self.down - self.up) / self.up + 3) * 1.2) + 4

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """(band, places, d) for a set of n: its own band, and those below in which partners can lie.

        d is the largest difference from any partner in that band. Without one over 0 the band is left out:
        only an equal set could be linked there.
        """
        if n not in self.known:
            own, out = self.band(n), []
            for band in range(self.band(-(-self.up * n // self.down)), own + 1):
                low = max(-(-self.up * n // self.down), int(self.edges[band]))
                high = n * self.down // self.up if band == own else int(self.edges[band + 1]) - 1
                d = int(most_different(n, np.arange(low, high + 1), self.up, self.down).max(initial=-1))
                if d > 0:
                    out.append((band, self.places(band), d))
            self.known[n] = out
        return self.known[n]


def identity(hashes: np.ndarray) -> int:
    """A 64-bit identity of a set of distinct hashes; 0 only for the empty set."""
    if not len(hashes):
        return 0
    value = int(tb.mix(np.array([(tb.mix(hashes + np.uint64(0x51)).sum() + np.uint64(len(hashes)))], np.uint64))[0])
    return (value or 1) - (1 << 64 if value >= 1 << 63 else 0)


def place_keys(hashes: np.ndarray, band: int, places: int, d: int, hot: np.ndarray | None = None) -> np.ndarray | None:
    """Keys of the first d + 1 filled places, those that are hot (ascending keys) coming last; None if fewer are filled."""
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    wanted = d + 1 if hot is None or not len(hot) else len(hashes)
    if not places:
        if len(hashes) <= d:
            return None
        keys = tb.mix(hashes[:wanted] + salt)
    else:
        place = ((hashes >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)  # ascending, as the hashes are
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        # a place's sketch has 2**32 bits, a shingle's bit is its hash's low half; the key is the XOR of its odd bits' hashes
        word = np.bitwise_xor.reduceat(tb.mix((hashes & np.uint64(0xFFFFFFFF)) + np.uint64(0x9E37)), first)
        filled = np.flatnonzero(word)[:wanted]
        if len(filled) <= d:
            return None
        keys = tb.mix(tb.mix(word[filled]) + place[first[filled]] * np.uint64(0xD6E8FEB86659FD93) + salt)
    if len(keys) > d + 1:
        at = np.searchsorted(hot, keys)
        at[at == len(hot)] = 0
        keys = keys[np.argsort(hot[at] == keys, kind="stable")][: d + 1]
    return keys


def sketch_words(n: int) -> int:
    """64-bit words of a verification sketch for a set of n: a power of two; 4 to 8 bits a shingle, 512 at least."""
    return 1 << max(3, int(n * 4 - 1).bit_length() - 6)


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parities of the set's shingles in words * 64 bits. Halves fold: XOR gives the sketch of half the size."""
    bits = (tb.mix(hashes ^ np.uint64(0xA5)) & np.uint64(words * 64 - 1)).astype(np.int64)
    odd = np.bincount(bits, minlength=words * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(s: np.ndarray, words: int) -> np.ndarray:
    while len(s) > words:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for w in tb.word_hashes(column):
        yield tb.shingle_set(w, WORDS)


def sized(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, set_id): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = [], []
            for hashes in _sets(batch.column(1)):
                n.append(len(hashes))
                ids.append(identity(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["id", "n", "set_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, n bigint, set_id bigint")


def _places(docs: DataFrame, targets: int, text: str, hot: np.ndarray) -> DataFrame:
    """(target, keys, sets): packed blocks of keys and the sets that have them, hot keys last. Without keys: a set with too
    few filled places, see _short."""
    bands = Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def blocks() -> pa.RecordBatch:
            k, s = np.concatenate(keys), np.concatenate(ids)
            target = ((k >> np.uint64(32)) * np.uint64(targets)) >> np.uint64(32)
            order = np.argsort(target, kind="stable")
            k, s = k[order], s[order]
            cuts = np.searchsorted(target[order], np.arange(targets + 1).astype(np.uint64))
            rows = [(t, k[a:b].tobytes(), s[a:b].tobytes()) for t, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            t, kb, sb = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(kb, pa.binary()), pa.array(sb, pa.binary())], names=["target", "keys", "sets"])

        for batch in batches:
            for hashes in _sets(batch.column(0)):
                own = identity(hashes)
                if own in seen or not own:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(own)
                for band, places, d in bands.of(len(hashes)):
                    found = place_keys(hashes, band, places, d, hot)
                    if found is None:
                        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.array([own], np.int64).tobytes()], pa.binary())], names=["target", "keys", "sets"])
                        continue
                    keys.append(found)
                    ids.append(np.full(len(found), own, np.int64))
                    held += len(found)
                if held >= HELD_KEYS:
                    yield blocks()
                    keys, ids, held = [], [], 0
        if held:
            yield blocks()

    return docs.select(text).mapInArrow(run, "target int, keys binary, sets binary")


def _groups(blocks: DataFrame, targets: int, defer: bool = False) -> DataFrame:
    """(gid, members): the distinct groups of sets that share a key, members ascending, at most 2 * GROUP.

    A group of one is a set with too few filled places. With defer a key of more than HOT sets gives no group but a row without members, whose gid is the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = [], []
        for batch in batches:
            for k, s in zip(batch.column(0), batch.column(1), strict=True):
                s = np.frombuffer(s.as_buffer(), np.int64)
                if len(k.as_buffer()):
                    keys.append(np.frombuffer(k.as_buffer(), np.uint64))
                    ids.append(s)
                else:
                    yield _group_rows([s])
        if not keys:
            return
        k, s = np.concatenate(keys), np.concatenate(ids)
        del keys, ids
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        k, s = k[some], s[order[some]]
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        k, s = k[fresh], s[fresh]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([first, [len(k)]]))
        done: set[int] = set()
        out: list[np.ndarray] = []
        for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            members = s[a : a + n]
            if defer and n > HOT:
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 1].view(np.int64)), pa.array([[]], pa.list_(pa.int64()))], names=["gid", "members"])
                continue
            pieces = [members] if n <= 2 * GROUP else [np.concatenate([members[i : i + GROUP], members[j : j + GROUP]]) for i in range(0, n, GROUP) for j in range(i + GROUP, n, GROUP)]
            for m in pieces:
                if (g := identity(m.view(np.uint64))) not in done:
                    done.add(g)
                    out.append(m)
            if len(out) >= 4096:
                yield _group_rows(out)
                out = []
        if out:
            yield _group_rows(out)

    dealt = blocks.repartitionById(targets, F.col("target")).select("keys", "sets")
    rows = dealt.mapInArrow(run, "gid bigint, members array<bigint>")
    return rows.groupBy("gid").agg(F.first("members").alias("members"))


def _group_rows(groups: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32)
    members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(groups)))
    return pa.RecordBatch.from_arrays([pa.array([identity(g.view(np.uint64)) for g in groups], pa.int64()), members], names=["gid", "members"])


class Union:
    """Disjoint sets of numbers; a set's root is its smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def joined(members: list[int], sets: dict[int, np.ndarray], sketches: dict[int, np.ndarray], held: Union) -> list[tuple[int, int]]:
    """Links that join the sets of a group which held does not join yet; nearest pairs are tested first."""
    roots = np.array([held.root(x) for x in members])
    names, place, counts = np.unique(roots, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    for x in members:
        if x not in sketches:
            sketches[x] = sketch(sets[x], sketch_words(len(sets[x])))
    sizes = np.array([len(sets[x]) for x in members])
    words = min(len(sketches[x]) for x in members)
    table = np.stack([fold(sketches[x], words) for x in members])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = np.zeros(len(members), bool)
    for i in np.flatnonzero(place != counts.argmax()).tolist():  # only pairs of different roots, each once
        done[i] = True
        others = np.flatnonzero((place != place[i]) & ~done)
        h = np.bitwise_count(table[others] ^ table[i]).sum(1).astype(np.int64)
        ok = h <= most_different(sizes[i], sizes[others])
        if ok.any():
            found.append((h[ok], np.full(int(ok.sum()), i), others[ok]))
    if not found:
        return []
    h, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = members[x], members[y]
        if held.root(a) != held.root(b) and linked(sets[a], sets[b]):
            held.join(a, b)
            out.append((a, b))
    return out


def every(members: list[int], sets: dict[int, np.ndarray], sketches: dict[int, np.ndarray]) -> list[tuple[int, int]]:
    """All links between the sets of a group."""
    for x in members:
        if x not in sketches:
            sketches[x] = sketch(sets[x], sketch_words(len(sets[x])))
    sizes = np.array([len(sets[x]) for x in members])
    words = min(len(sketches[x]) for x in members)
    table = np.stack([fold(sketches[x], words) for x in members])
    out = []
    for i in range(len(members) - 1):
        h = np.bitwise_count(table[i + 1 :] ^ table[i]).sum(1).astype(np.int64)
        near = np.flatnonzero(h <= most_different(sizes[i], sizes[i + 1 :])) + i + 1
        out += [(members[i], members[j]) for j in near.tolist() if linked(sets[members[i]], sets[members[j]])]
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test, on ascending distinct hashes."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return DOWN * both >= UP * (len(x) + len(y) - both)


def _routed(groups: DataFrame, sets: DataFrame, value: str, targets: int) -> DataFrame:
    """(kind, key, n, value, members): in each task first its sets (kind 0), each once, then its groups (kind 1).

    Groups go to a task by their hub, the smallest member; a hub with many groups is dealt to more tasks.
    """
    hubs = groups.withColumn("hub", F.array_min("members"))
    counts = hubs.groupBy("hub").agg(F.count("*").alias("n"))
    salt = F.pmod("gid", F.floor(F.col("n") / HUB_GROUPS) + 1)
    routed = kept(hubs.join(counts, "hub").select(F.pmod(F.xxhash64("hub", salt), F.lit(targets)).cast("int").alias("route"), "gid", "members"))
    asked = routed.select("route", F.explode("members").alias("set_id")).distinct()
    given = asked.join(sets, "set_id").select("route", F.lit(0).alias("kind"), F.col("set_id").alias("key"), "n", F.col(value).alias("value"), F.lit(None).cast("array<bigint>").alias("members"))
    rows = given.unionByName(routed.select("route", F.lit(1).alias("kind"), F.col("gid").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("value"), "members"))
    return rows.repartitionById(targets, F.col("route")).sortWithinPartitions("kind", "key").drop("route")


def near(members: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """The members that have a pair in their group which the sketches allow."""
    words = min(map(len, sketches))
    table = np.stack([fold(s, words) for s in sketches])
    keep = np.zeros(len(members), bool)
    for i in range(len(members)):
        if not keep[i]:  # one that is kept already needs no pairs of its own: its partners find it
            h = np.bitwise_count(table ^ table[i]).sum(1).astype(np.int64)
            ok = h <= most_different(sizes[i], sizes)
            ok[i] = False
            if ok.any():
                keep |= ok
                keep[i] = True
    return members[keep]


def _near(groups: DataFrame, sketches: DataFrame, targets: int) -> DataFrame:
    """(gid, members): the groups, and in them the members, that have a pair which the sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, np.ndarray]] = {}
        done: set[int] = set()
        for batch in batches:
            out = []
            for kind, key, n, value, members in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4), strict=True):
                if not kind:
                    sets[key] = n, np.frombuffer(value.as_buffer(), np.uint64)
                    continue
                m = np.array(members.as_py(), np.int64)
                left = near(m, np.array([sets[x][0] for x in m.tolist()]), [sets[x][1] for x in m.tolist()])
                if len(left) > 1 and (g := identity(left.view(np.uint64))) not in done:
                    done.add(g)
                    out.append(left)
            if out:
                yield _group_rows(out)

    rows = _routed(groups, sketches, "sketch", targets).mapInArrow(run, "gid bigint, members array<bigint>")
    return rows.groupBy("gid").agg(F.first("members").alias("members"))


def _links(groups: DataFrame, sets: DataFrame, targets: int, whole: bool = False) -> DataFrame:
    """(a, b): verified links that join what the groups of a task can join, or if whole all of each group. sets: (set_id, n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        sketches: dict[int, np.ndarray] = {}
        held = Union()
        for batch in batches:
            out: list[tuple[int, int]] = []
            for kind, key, hashes, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if kind:
                    out += every(members.as_py(), sets, sketches) if whole else joined(members.as_py(), sets, sketches, held)
                else:
                    sets[key] = np.frombuffer(hashes.as_buffer(), np.uint64)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return _routed(groups, sets, "hashes", targets).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node reachable.

    First each task joins its own links; then large and small stars by turns: each round is two grouped minima, made before the shuffle, and joins, through
    which the links of a node are streamed, never held.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Union()

        def stars() -> pa.RecordBatch:
            nodes = list(held.up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([held.root(x) for x in nodes], pa.int64())], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.join(a, b)
            if len(held.up) > 1 << 20:
                yield stars()
                held = Union()
        if held.up:
            yield stars()

    own = links.select("a", "b").mapInArrow(join, "u bigint, v bigint")
    edges = kept(own.where(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select("u", F.col("m").alias("v")).unionByName(tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = kept(small.where(F.col("u") != F.col("v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _values(docs: DataFrame, wanted: DataFrame, text: str, id_col: str, whole: bool) -> DataFrame:
    """(set_id, n, hashes or sketch) of the documents whose ids are wanted: the set, if whole, or its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(_sets(batch.column(0).slice(at, 256)))
                values = [h.tobytes() if whole else sketch(h, sketch_words(len(h))).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([pa.array([identity(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(values, pa.binary())], names=["set_id", "n", name])

    name = "hashes" if whole else "sketch"
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("id"), text)
    some = rows.join(side, rows["id"].eqNullSafe(side["id"]), "left_semi")
    return some.select(text).mapInArrow(run, f"set_id bigint, n bigint, {name} binary")


def _short(docs: DataFrame, short: DataFrame, text: str, block: int = 4096) -> DataFrame | None:
    """(a, b) links of the sets with too few filled places, against all sets.

    These are next to none: the places are so many that a set fills too few with a chance of
    about one in millions. They are a query set, compared block by block with every text.
    """
    ids = [r[0] for r in short.toLocalIterator()]
    links = None
    for at in range(0, len(ids), block):
        some = set(ids[at : at + block])

        def fetch(batches: Iterator[pa.RecordBatch], some: set = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = {identity(h): h for h in _sets(batch.column(0))}
                own = {k: h for k, h in own.items() if k in some}
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([h.tobytes() for h in own.values()], pa.binary())], names=["set_id", "hashes"])

        asked = {r["set_id"]: np.frombuffer(r["hashes"], np.uint64) for r in docs.select(text).mapInArrow(fetch, "set_id bigint, hashes binary").groupBy("set_id").agg(F.first("hashes").alias("hashes")).collect()}
        names = sorted(asked)
        flat = np.concatenate([asked[k] for k in names])
        owner = np.repeat(np.arange(len(names)), [len(asked[k]) for k in names])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]

        def search(batches: Iterator[pa.RecordBatch], names: list = names, flat: np.ndarray = flat, owner: np.ndarray = owner) -> Iterator[pa.RecordBatch]:
            sizes = np.bincount(owner, minlength=len(names))
            for batch in batches:
                a, b = [], []
                for h in _sets(batch.column(0)):
                    low, high = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
                    hit = np.flatnonzero(high > low)
                    if not len(hit):
                        continue
                    both = np.bincount(np.concatenate([owner[low[i] : high[i]] for i in hit]), minlength=len(names))
                    own = identity(h)
                    for k in np.flatnonzero(DOWN * both >= UP * (sizes + len(h) - both)):
                        if names[k] != own:
                            a.append(names[k])
                            b.append(own)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        found = docs.select(text).mapInArrow(search, "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
    return links


def _all_groups(docs: DataFrame, targets: int, text: str) -> DataFrame:
    """The candidate groups; in each round but the last, keys that prove hot are put last in the next one."""
    hot = np.empty(0, np.uint64)
    for left in range(ROUNDS - 1, -1, -1):
        groups = kept(_groups(_places(docs, targets, text, hot), targets, defer=left > 0))
        found = [r["gid"] for r in groups.where(F.size("members") == 0).select("gid").limit(MOST_HOT).collect()] if left else []
        if not found:
            break
        hot = np.union1d(hot, np.array(found, np.int64).view(np.uint64))
    return groups


def link_components(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", count_links: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id): the components of the links between near documents.

    Words are runs of anything but space and U+0009 to U+000D, A-Z in lower case; a document's set is its
    distinct five-word shingles, with fewer words the whole sequence. Two documents are linked when 100 * intersection
    >= 80 * union. component_id is the smallest id reachable by links. A null, empty or blank text has an empty
    set and is linked with nothing: its component is its own id. One row for each row of docs, repeated rows
    included; an empty table gives an empty one; other columns are not read, whatever their names.

    With count_links there is one more column, n_links: the number of other rows that a row is linked with, equal sets
    among them. All links are then verified, not a spanning forest; they are as many as the pairs of a cluster.
    """
    hold_batches(docs.sparkSession)
    spark = docs.sparkSession
    targets = parts(spark)
    rows = kept(sized(docs, text=text, id_col=id_col))
    filled = rows.where(F.col("n") > 0)
    each = kept(filled.groupBy("set_id").agg(F.min("id").alias("rep")))
    groups = _all_groups(docs, targets, text)
    short = groups.where(F.size("members") == 1).select(F.explode("members").alias("set_id")).distinct()
    groups = groups.where(F.size("members") > 1)

    def ids_of(some: DataFrame) -> DataFrame:
        return kept(some.select(F.explode("members").alias("set_id")).distinct().join(each, "set_id").select(F.col("rep").alias("id")))

    groups = kept(_near(groups, _values(docs, ids_of(groups), text, id_col, whole=False), targets))
    links = _links(groups, _values(docs, ids_of(groups), text, id_col, whole=True), targets, whole=count_links)
    if not short.isEmpty():
        links = links.unionByName(_short(docs, short, text))
    if count_links:
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = kept(links)
    labels = None if links.isEmpty() else components(links)
    if labels is None:
        named = each.select("set_id", F.col("rep").alias("component"))
    else:
        rooted = each.select("set_id", "rep").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
        named = rooted.join(least, "root").select("set_id", "component")
    found = filled.select("id", "n", "set_id").join(named, "set_id")
    alone = rows.where(F.col("n") == 0).select("id", "n", F.col("id").alias("component"))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")]
    if count_links:
        copies = filled.groupBy("set_id").agg(F.count("*").alias("copies"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(copies.withColumnRenamed("set_id", "b"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("others"))
        n_links = copies.join(others, "set_id", "left").select("set_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        found = found.join(n_links, "set_id")
        alone = alone.withColumn("n_links", F.lit(0).cast("bigint"))
        columns.append(F.col("n_links"))
    return found.drop("set_id").unionByName(alone).select(*columns)
