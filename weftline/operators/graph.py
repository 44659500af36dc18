"""Traversals (T1-T11): one join a level, with what was reached before anti-joined; each level is a reliable checkpoint."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import names, rules
from weftline.operators.checkpoints import cut, stored
from weftline.operators.ordered import crowds, numbered, shares

MAX_DEPTH = 5
#: After so many levels the union of them is cut, so that a deep chain's plan stays short.
CUT_LEVELS = 16


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, target, ...) with one row for each source of an edge."""
    return edges.withColumn("source", F.explode("sources")).drop("sources")


class Lineage(NamedTuple):
    """nodes: (node, hops); edges: the selected edges; truncated: whether edges lead on from the last level."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _depth(depth: int) -> None:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")


def _steps(edges: DataFrame, direction: str, key: str) -> DataFrame:
    """(a, down, key, sources, target): from a node over an edge, in the direction asked for, to the ends that ``_ahead`` gives; one row for each node and edge."""
    if direction not in ("down", "up", "both"):
        raise ValueError("direction must be up, down or both")
    own = edges.select(key, "sources", "target")
    down = own.select(F.explode("sources").alias("a"), F.lit(True).alias("down"), key, "sources", "target")
    up = own.select(F.col("target").alias("a"), F.lit(False).alias("down"), key, "sources", "target")
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


def _ahead() -> Column:
    """The ends that a step of ``_steps`` leads to."""
    return F.when(F.col("down"), F.array("target")).otherwise(F.col("sources"))


#: Nodes of a frontier that are broadcast to the edges; of a larger one a bitmap is broadcast, and what passes is joined.
FRONTIER = 100_000
#: Most bits of such a bitmap: 32 MB.
BITS = 1 << 28


def sifted(rows: DataFrame, on: str, nodes: DataFrame, size: int) -> DataFrame:
    """All rows whose ``on`` is one of nodes (node), and few others: those whose hash has the place of a node's in a bitmap, which is broadcast. size: about how many nodes there are.

    What a join would drop is not shuffled to it. A bitmap for many more nodes than it has bits for lets more rows pass, it loses none.
    """
    bits = min(BITS, max(1 << 15, 1 << (16 * size).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    # as functions of SQL make and number them, 2**15 bits a row; dealt out in pieces of 64 bytes, as a row's piece is copied to be looked into
    maps = nodes.select(place("node").alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("map"))
    pieces = maps.select("part", "map", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select((F.col("part") * 64 + F.col("i")).alias("part_"), F.substring("map", F.col("i") * 64 + 1, F.lit(64)).alias("map_"))
    found = rows.withColumn("p_", place(on)).withColumn("part_", F.shiftright("p_", 9)).join(F.broadcast(pieces), "part_")
    bit = F.col("p_").bitwiseAND(511).cast("int")
    byte = F.conv(F.hex(F.substring("map_", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, bit.bitwiseAND(7)) == 1).select(*rows.columns)


def among(rows: DataFrame, on: str, nodes: DataFrame, size: int) -> DataFrame:
    """The rows whose ``on`` is one of nodes (node), each once, of which there are about ``size``."""
    if size <= FRONTIER:
        return rows.join(F.broadcast(nodes), F.col(on) == F.col("node"), "left_semi")
    # an inner join: the optimizer would put a semi join before the bitmap's
    return sifted(rows, on, nodes, size).join(nodes.select(F.col("node").alias("node_")), F.col(on) == F.col("node_")).select(*rows.columns)


class Level(NamedTuple):
    """met: (key, down, sources, target) of the steps of one hop, stored; frontier: (node) that are walked on from; size: how many ends they lead to at most."""

    met: DataFrame
    frontier: DataFrame
    size: int


def _nodes(level: Level) -> DataFrame:
    return level.met.select(F.explode(F.concat("sources", F.array("target"))).alias("node"))


def _levels(edges: DataFrame, subject: str, direction: str, depth: int, key: str) -> list[Level]:
    """What each hop met; the last one may have met nothing."""
    steps = _steps(edges, direction, key)
    frontier = edges.sparkSession.createDataFrame([(subject,)], "node string")
    out, seen, size = [], [frontier], 1
    for _ in range(depth):
        # a step's own row has its edge's ends: the graph is read once a level, and only what is met is moved
        met = stored(among(steps, "a", frontier, size).select(key, "down", "sources", "target"))
        size = met.agg(F.coalesce(F.sum(F.size(_ahead())), F.lit(0))).first()[0]
        known = reduce(DataFrame.unionByName, seen)
        frontier = met.select(F.explode(_ahead()).alias("node")).distinct().join(known, "node", "left_anti")
        out.append(Level(met, frontier, size))
        seen.append(_nodes(out[-1]))
        if not size:
            break
    return out


def lineage(edges: DataFrame, subject: str, direction: str = "down", depth: int = 3, key: str = "edge_key") -> Lineage:
    """What lies within depth of a subject; direction down, up or both.

    edges: (key, sources, target, ...). An edge that is touched is selected, and all its ends are nodes; but only the ends on the
    side walked to are walked on from, unless they were nodes of an earlier level. The subject has hops 0, a node the level that it first came in.
    """
    _depth(depth)
    levels = _levels(edges, subject, direction, depth, key)
    start = edges.sparkSession.createDataFrame([(subject, 0)], "node string, hops int")
    every = reduce(DataFrame.unionByName, [start, *[_nodes(level).withColumn("hops", F.lit(hop)) for hop, level in enumerate(levels, 1)]])
    nodes = every.groupBy("node").agg(F.min("hops").alias("hops"))
    touched = reduce(DataFrame.unionByName, [level.met.select(F.col(key).alias("node")) for level in levels]).distinct()
    return Lineage(nodes, among(edges, key, touched, sum(level.size for level in levels)), len(levels) == depth and _leads_on(edges, levels[-1], direction, key))


def _leads_on(edges: DataFrame, last: Level, direction: str, key: str) -> bool:
    return last.size > 0 and not among(_steps(edges, direction, key).select("a"), "a", last.frontier, last.size).isEmpty()


def truncated(edges: DataFrame, subject: str, direction: str = "down", depth: int = MAX_DEPTH, key: str = "edge_key") -> list[bool]:
    """Whether a lineage of depth 1, 2, ... would be truncated, from one walk."""
    _depth(depth)
    levels = _levels(edges, subject, direction, depth, key)
    # edges lead on from a level's frontier just where the next level met some
    inside = [level.size > 0 for level in levels[1:]]
    last = len(levels) == depth and _leads_on(edges, levels[-1], direction, key)
    return (inside + [last] + [False] * depth)[:depth]


class Paths(NamedTuple):
    """rows: (node, path_length, via, band_at); truncated: whether there are more than the limit."""

    rows: DataFrame
    truncated: bool


def paths(edges: DataFrame, subject: str, depth: int, limit: int, direction: str = "down", key: str = "edge_key", *, trails: bool = True, by_via: bool = False) -> Paths:
    """The first ``limit`` paths from a subject, shorter ones first, then by node (by_via: by their edges).

    edges: (key, sources, target, band_at). With trails no path has an edge twice. As shorter paths come first, no level is extended once the
    limit is reached: a level that is has at most ``limit`` paths.
    """
    _depth(depth)
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be from 1 to 10000")
    steps = _steps(edges, direction, key).select("a", F.explode(_ahead()).alias("b"), key).join(edges.select(key, F.col("band_at").alias("own")), key)
    level = edges.sparkSession.createDataFrame([(subject, [], len(rules.BANDS) - 1)], "node string, via array<string>, band_at int")
    out, left, more = level.where(F.lit(False)).withColumn("path_length", F.lit(0)), limit, False
    order = ["via", "node"] if by_via else ["node", "via"]
    for length in range(1, depth + 1):
        f = level.withColumnRenamed("node", "a")
        on = f.join(steps, "a")
        if trails:
            on = on.where(~F.array_contains("via", F.col(key)))
        on = on.select(F.col("b").alias("node"), F.concat("via", F.array(key)).alias("via"), F.least("band_at", "own").cast("int").alias("band_at"))
        level = cut(on.orderBy(*order).limit(left + 1))
        n = level.count()
        if n > left:
            more = True
            level = cut(level.orderBy(*order).limit(left)) if left else level.where(F.lit(False))
        out = out.unionByName(level.withColumn("path_length", F.lit(length)))
        left -= min(n, left)
        if n == 0 or more:
            break
    return Paths(out.select("node", "path_length", "via", "band_at"), more)


def path_lineage(edges: DataFrame, subject: str, depth: int, limit: int, direction: str = "down", key: str = "edge_key") -> Lineage:
    """T4: the nodes and edges of the first paths, by ``paths``; of the edges the first ``limit`` by key."""
    found = paths(edges, subject, depth, limit, direction, key)
    keys = found.rows.select(F.explode("via").alias(key)).distinct()
    chosen = edges.join(keys, key, "left_semi")
    nodes = chosen.select(F.explode(F.concat("sources", F.array("target"))).alias("node"))
    start = edges.sparkSession.createDataFrame([(subject,)], "node string")
    on_path = found.rows.select("node").distinct().unionByName(start)
    over = chosen.count() > limit
    return Lineage(nodes.distinct().join(on_path, "node", "left_semi").unionByName(start).distinct(), chosen.orderBy(key).limit(limit), found.truncated or over)


def path_impact(edges: DataFrame, subject: str, change: str, depth: int, limit: int, key: str = "edge_key", *, trails: bool = True, by_via: bool = False) -> Paths:
    """Each target of the first paths by its shortest one (ties: the first in order): its weakest band and severity."""
    found = paths(edges, subject, depth, limit, "down", key, trails=trails, by_via=by_via)
    best = found.rows.groupBy("node").agg(F.min(F.struct("path_length", "via", "band_at")).alias("p"))
    band = rules.named(F.col("p.band_at"), rules.BANDS)
    return Paths(best.select("node", "p.path_length", "p.via", band.alias("band"), rules.severity(F.lit(change), band).alias("severity")), found.truncated)


def impact(adjacent: DataFrame, subjects: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """T3 for many changes at once.

    subjects: (change_id, change_type, subject). adjacent: (source, target, edge_key, band_at, corroboration_at).
    Returns for each affected target the shortest path; of those the one with the smallest list of edge
    keys; the weakest band and corroboration on it; severity and owner. Nodes may be service endpoints.
    """
    steps = adjacent.select("source", "target", "edge_key", "band_at", "corroboration_at")
    start = subjects.select("change_id", "change_type", F.col("subject").alias("node"), F.array().cast("array<string>").alias("via"), F.lit(len(rules.BANDS) - 1).alias("band_at"), F.lit(len(rules.CORROBORATION) - 1).alias("corroboration_at"))
    visited = start.select("change_id", "node")
    frontier, out = start, None
    for hop in range(1, depth + 1):
        f = frontier.select("change_id", "change_type", F.col("node").alias("source"), "via", F.col("band_at").alias("b"), F.col("corroboration_at").alias("c"))
        next_ = f.join(steps, "source").select("change_id", "change_type", F.col("target").alias("node"), F.concat("via", F.array("edge_key")).alias("via"), F.least("b", "band_at").cast("int").alias("band_at"), F.least("c", "corroboration_at").cast("int").alias("corroboration_at"))
        next_ = next_.join(visited, ["change_id", "node"], "left_anti")
        first = F.min_by(F.struct("change_type", "via", "band_at", "corroboration_at"), F.col("via")).alias("best")
        frontier = cut(next_.groupBy("change_id", "node").agg(first).select("change_id", "node", "best.*"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("change_id", "node"))
        level = frontier.withColumn("path_length", F.lit(hop))
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = start.where(F.lit(False)).withColumn("path_length", F.lit(0))
    band = rules.named(F.col("band_at"), rules.BANDS)
    return out.select("change_id", F.col("node").alias("target"), "path_length", F.col("via").alias("via_edges"), band.alias("band"), rules.named(F.col("corroboration_at"), rules.CORROBORATION).alias("corroboration"), rules.severity(F.col("change_type"), band).alias("severity"), F.concat(F.lit("team-"), names.system_of(F.col("node"))).alias("owner"), names.node_kind(F.col("node")).alias("kind"))


def impact_truncated(adjacent: DataFrame, subjects: DataFrame, affected: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Whether each change has a node at the depth limit with any edge onwards, be it to one that was visited."""
    last = affected.where(F.col("path_length") == depth).select("change_id", F.col("target").alias("source"))
    cut_off = last.join(adjacent.select("source").distinct(), "source", "left_semi").select("change_id").distinct().withColumn("truncated", F.lit(True))
    return subjects.select("change_id").distinct().join(cut_off, "change_id", "left").select("change_id", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def blast_radius(adjacent: DataFrame, seed: str) -> DataFrame:
    """(node, dataset, hops, severity, via) of everything that a seed reaches, to the fixpoint; via: the transforms on the way.

    adjacent: (source, target, transform), read once a level. A dataset also reaches the targets of its elements (one way). Of several ways of the fewest hops that of the
    parent found first counts, of one parent the smallest transform: so each level is ranked by (parent's rank, node).
    """
    spark = adjacent.sparkSession
    # only the steps that a frontier takes are moved; of one parent's steps to a node the smallest way is that of the smallest transform
    own = adjacent.select("source", "target", F.coalesce("transform", F.lit("")).alias("transform"))
    bridge = own.where(F.col("source").contains("#")).withColumn("source", names.dataset_of(F.col("source")))
    sets = "#" not in seed  # whether there are datasets in the frontier
    reached = spark.createDataFrame([(seed, 0, [])], "node string, hops int, via array<string>")
    frontier, size = reached.select("node", "via").withColumn("rank", F.lit(1).cast("bigint")), 1
    for hop in itertools.count(1):
        few, steps = size <= FRONTIER, own.unionByName(bridge) if sets else own
        taken = steps if few else sifted(steps, "source", frontier.select("node"), size)
        ahead = frontier.withColumnRenamed("node", "source")
        met = taken.join(F.broadcast(ahead) if few else ahead, "source").select(F.col("target").alias("node"), "rank", F.concat("via", F.array("transform")).alias("via"))
        best = met.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("rank", "via")).alias("best"))
        level = cut(best.select("node", F.col("best.via").alias("via"), F.col("best.rank").alias("parent")))
        size, sets = level.agg(F.count("*"), F.coalesce(F.bool_or(~F.col("node").contains("#")), F.lit(False))).first()
        if not size:
            break
        frontier = numbered(level, ["parent", "node"], name="rank").select("node", "via", "rank")
        reached = reached.unionByName(level.select("node", F.lit(hop).alias("hops"), "via"))
        if hop % CUT_LEVELS == 0:
            reached = cut(reached)
    return reached.select("node", names.dataset_of(F.col("node")).alias("dataset"), "hops", rules.hop_severity(F.col("hops")).alias("severity"), "via")


def closure(steps: DataFrame) -> DataFrame:
    """(node, ancestor, hops) of the transitive closure of (node, parent), with the fewest hops.

    Pairs are joined with themselves, so a chain of n steps takes log n rounds.
    """
    reached = cut(steps.select("node", F.col("parent").alias("ancestor")).distinct().withColumn("hops", F.lit(1)))
    before = None
    while True:
        now = tuple(reached.agg(F.count("*"), F.sum("hops")).first())
        if now == before:
            return reached
        before = now
        half = reached.select("node", F.col("ancestor").alias("mid"), F.col("hops").alias("h"))
        rest = reached.select(F.col("node").alias("mid"), "ancestor", F.col("hops").alias("k"))
        longer = half.join(rest, "mid").select("node", "ancestor", (F.col("h") + F.col("k")).alias("hops"))
        reached = cut(reached.unionByName(longer).groupBy("node", "ancestor").agg(F.min("hops").alias("hops")))


def both_ways(steps: DataFrame, ahead: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) that the nodes of ``ahead`` lead to over (node, parent), and (node) that lead to those of ``back``; these themselves included.

    Steps double each round, so a chain of n takes log n; only ways of just 2**k steps are kept, not all pairs.
    """
    steps = cut(steps.select("node", "parent").distinct())
    met = cut(ahead.select(F.lit(0).alias("side"), "node").unionByName(back.select(F.lit(1).alias("side"), "node")).distinct())
    size = met.count()
    while not steps.isEmpty():
        ways = steps.select(F.lit(0).alias("side"), "node", F.col("parent").alias("to")).unionByName(steps.select(F.lit(1).alias("side"), F.col("parent").alias("node"), F.col("node").alias("to")))
        met = cut(met.unionByName(met.join(ways, ["side", "node"]).select("side", F.col("to").alias("node"))).distinct())
        before, size = size, met.count()
        # a node further on would have one before it that just so many steps lead to, which is new
        if size == before:
            break
        steps = cut(steps.join(steps.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent").select("node", F.col("next").alias("parent")).distinct())
    return met.where("side = 0").select("node"), met.where("side = 1").select("node")


def reaches(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """T10 for given pairs (node, ancestor): (node, ancestor, hops), hops null where the ancestor is not reached over (node, parent).

    Each pair walks up by itself, one join a level, never twice over one node, and ends where it is found: nothing is made of pairs that nobody asks for.
    """
    asked = pairs.select("node", "ancestor").distinct()
    front = asked.withColumn("at", F.col("node"))
    visited, found = front.limit(0), None  # a pair may lead back to its own node
    for hop in itertools.count(1):
        up = steps.select(F.col("node").alias("at"), F.col("parent").alias("next"))
        met = front.join(up, "at").select("node", "ancestor", F.col("next").alias("at")).distinct()
        level = cut(met.join(visited, ["node", "ancestor", "at"], "left_anti").withColumn("hops", F.lit(hop)))
        if level.isEmpty():
            break
        hit = level.where(F.col("at") == F.col("ancestor")).select("node", "ancestor", "hops")
        found = hit if found is None else found.unionByName(hit)
        visited = visited.unionByName(level.drop("hops"))
        front = level.drop("hops").join(hit, ["node", "ancestor"], "left_anti")
        if hop % CUT_LEVELS == 0:
            visited, found = cut(visited), cut(found)
    none = asked.withColumn("hops", F.lit(None).cast("int"))
    return none if found is None else asked.join(found, ["node", "ancestor"], "left").select("node", "ancestor", "hops")


def distances(pairs: DataFrame, subject: str, name: str) -> DataFrame:
    """(node, name): the fewest steps from a subject over (a, b), to the fixpoint."""
    reached = pairs.sparkSession.createDataFrame([(subject, 0)], f"node string, {name} int")
    frontier = reached.select("node")
    for hop in itertools.count(1):
        frontier = cut(frontier.join(pairs, frontier["node"] == pairs["a"]).select(F.col("b").alias("node")).distinct().join(reached, "node", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier.withColumn(name, F.lit(hop)))
        if hop % CUT_LEVELS == 0:
            reached = cut(reached)


def canvas_ranks(pairs: DataFrame, subject: str | None) -> DataFrame:
    """(node, rank) of a drawing's columns, the leftmost being 0. pairs: (a, b), a before b.

    With a subject: its distance downwards, or less than zero upwards; where both are known the smaller, downwards if they are equal. What it does
    not reach settles beside a ranked neighbour (round by round; the one before it by the smallest name, else the one after), else at 0. Without
    one: the longest way from a node that nothing precedes; what only a cycle leads to keeps the rank that settled nodes give it.
    """
    pairs = cut(pairs.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    nodes = cut(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    if subject is None:
        return _longest(nodes, pairs)
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    d, u = F.col("d"), F.col("u")
    both = nodes.join(distances(pairs, subject, "d"), "node", "left").join(distances(back, subject, "u"), "node", "left")
    rank = F.when(d.isNotNull() & (u.isNull() | (d <= u)), d).when(u.isNotNull(), -u)
    ranked = cut(both.select("node", rank.alias("rank")))
    while True:
        open_ = ranked.where(F.col("rank").isNull()).select("node")
        known = ranked.where(F.col("rank").isNotNull())
        side = lambda p, near, own, by: open_.join(p.select(F.col(own).alias("node"), F.col(near).alias("n")), "node").join(known.select(F.col("node").alias("n"), "rank"), "n").groupBy("node").agg((F.min_by("rank", "n") + by).alias("rank"))
        before, after = side(pairs, "a", "b", 1), side(pairs, "b", "a", -1)
        settled = cut(open_.join(before.withColumnRenamed("rank", "x"), "node", "left").join(after.withColumnRenamed("rank", "y"), "node", "left").select("node", F.coalesce("x", "y").alias("rank")))
        if settled.where(F.col("rank").isNotNull()).isEmpty():
            break
        ranked = cut(known.unionByName(settled))
    ranked = ranked.withColumn("rank", F.coalesce("rank", F.lit(0)))
    least = ranked.agg(F.min("rank")).first()[0] or 0
    return ranked.select("node", (F.col("rank") - least).cast("int").alias("rank"))


def _longest(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ranks by Kahn's order, a level at a time: a node is settled once all before it are."""
    ranked = cut(nodes.select("node", F.lit(0).alias("rank")))
    left = pairs
    ready = cut(nodes.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
    while not ready.isEmpty():
        gone = ready.withColumnRenamed("node", "a")
        pushed = left.join(gone, "a", "left_semi").join(ranked.select(F.col("node").alias("a"), "rank"), "a").groupBy("b").agg((F.max("rank") + 1).alias("r"))
        ranked = cut(ranked.join(pushed.withColumnRenamed("b", "node"), "node", "left").select("node", F.greatest("rank", F.coalesce("r", F.lit(0))).alias("rank")))
        met = left.join(gone, "a", "left_semi").select(F.col("b").alias("node")).distinct()
        left = cut(left.join(gone, "a", "left_anti"))
        ready = cut(met.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
    return ranked


#: Workflows of a hash with more stages are walked by joins, all others each by one task.
WORKFLOW = 100_000


def workflow_errors(stages: DataFrame, workflows: DataFrame) -> DataFrame:
    """(kind, stage, error) of workflow definitions: routes, bounds, reachability.

    stages: (kind, stage, timeout_s, max_attempts, retry_class, side_effect, on_success, on_error array<string>); workflows: (kind, entry,
    timeout_s, terminals array<string>). A route goes to a stage of its workflow or to ``terminal:`` and a declared state.

    No route leaves its workflow, so stages are shuffled once, by kind, however long the ways are. Stages that already are in ``ordered.shares`` by kind are not shuffled again.
    """
    n, crowded = crowds(stages, ["kind"], WORKFLOW)
    if crowded is None:
        return _errors_by_workflow(stages, workflows, n)
    return _errors_by_workflow(stages.where(~crowded), workflows.where(~crowded), n).unionByName(_errors_by_joins(stages.where(crowded), workflows.where(crowded)))


def _codes(tests: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(t, c) for c, t in tests]))


def _stage_codes() -> Column:
    """What a stage's own row tells."""
    return _codes([
        ("ATTEMPTS", ~F.col("max_attempts").between(1, 5)), ("RETRY_CLASS", ~F.col("retry_class").isin("NONE", "BOUNDED_TRANSIENT")),
        ("SIDE_EFFECT", ~F.col("side_effect").isin("PURE", "READ_ONLY", "IMMUTABLE_WRITE", "IDEMPOTENT_WRITE", "FENCED_WRITE", "CHECK_AND_AUDIT_WRITE")),
        ("NO_SUCCESS_ROUTE", F.size("on_success") == 0), ("NO_ERROR_ROUTE", F.size("on_error") == 0),
    ])


def _workflow_codes(w: Callable[[str], Column], n: Column, distinct: Column, there: Column, path_s: Column) -> Column:
    """What a workflow's definition tells, beside its number of stages and of their names, whether its entry is there, and the sum of their times."""
    return _codes([
        ("REPEATED_STAGE", n != distinct), ("UNKNOWN_ENTRY", ~there), ("TIMEOUT", w("timeout_s") < 1),
        ("CRITICAL_PATH", path_s > w("timeout_s")), ("NO_TERMINAL", F.size(w("terminals")) == 0),
    ])


def _errors_by_workflow(stages: DataFrame, workflows: DataFrame, n: int) -> DataFrame:
    """``workflow_errors`` of workflows of moderate size: each is a row, whose routes one task walks."""
    own = F.struct("stage", "timeout_s", _stage_codes().alias("codes"), "on_success", "on_error").alias("s")
    whole = stages.repartition(shares(stages.sparkSession, n), "kind").select("kind", "timeout_s", own).groupBy("kind").agg(F.collect_list("s").alias("stages"), F.sum("timeout_s").alias("path_s"))
    # a kind may be defined more than once
    defined = workflows.groupBy("kind").agg(F.collect_list(F.struct("entry", "timeout_s", "terminals")).alias("defs"))
    some = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    each = whole.join(defined, "kind", "full_outer").select("kind", "path_s", some(whole, "stages"), some(defined, "defs"))
    names = F.col("stages.stage")
    of_workflow = F.transform("defs", lambda d: _workflow_codes(lambda c: d[c], F.size("stages"), F.size(F.array_distinct(F.array_compact(names))), F.coalesce(F.array_contains(names, d["entry"]), F.lit(False)), F.col("path_s")))

    def of_stage(s: Column) -> Column:
        lost = lambda to: to.startswith("terminal:") & F.exists("defs", lambda d: ~F.array_contains(d["terminals"], F.regexp_replace(to, "^terminal:", "")))
        tests = [("STAGE_TIMEOUT", F.exists("defs", lambda d: ~s["timeout_s"].between(1, d["timeout_s"]))), ("UNDECLARED_TERMINAL", F.exists(s["on_success"], lost) | F.exists(s["on_error"], lost))]
        return F.when(F.size("defs") > 0, F.concat(s["codes"], _codes(tests))).otherwise(F.array().cast("array<string>"))

    rows = each.select("kind", F.flatten(of_workflow).alias("of_workflow"), names.alias("names"), F.transform("stages", of_stage).alias("of_stage"), F.col("stages.on_success"), F.col("stages.on_error"), F.col("defs.entry").alias("entries"), F.col("defs.terminals").alias("terminals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found = [], []
            for kind, of_workflow, names, of_stage, *routes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                errors = {(None, c) for c in of_workflow} | {(name, c) for name, codes in zip(names, of_stage, strict=True) for c in codes} | _route_errors(names, *routes)
                kinds += [kind] * len(errors)
                found += errors
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, batch.schema.types[0]), *(pa.array(c, t) for c, t in zip(columns, (batch.schema.types[2].value_type, pa.string()), strict=True))], names=["kind", "stage", "error"])

    return rows.mapInArrow(run, f"kind {stages.schema['kind'].dataType.simpleString()}, stage {stages.schema['stage'].dataType.simpleString()}, error string")


def _walk(found: set, ways: dict) -> set:
    """What is reached from found, itself included."""
    todo = list(found)
    while todo:
        new = set(ways.get(todo.pop(), ())) - found
        found |= new
        todo += new
    return found


def _route_errors(names: list, on_success: list, on_error: list, entries: list, terminals: list) -> set[tuple]:
    """(stage, error) of the routes of one workflow. Nulls are as in ``_errors_by_joins``: a route to none is to no stage, and may end well or not, as one to a terminal does where no definition tells all its terminals."""
    known = set(names) - {None}
    ends = {f"terminal:{t}" for own in terminals for t in own or () if t is not None}
    unsure = all(own is None or None in own for own in terminals)
    after, before, well = defaultdict(list), defaultdict(list), set()
    for name, *ways in zip(names, on_success, on_error, strict=True):
        for to in itertools.chain(*(way or () for way in ways)):
            if to in known:
                after[name].append(to)
                before[to].append(name)
            if to in ends:
                well.add(name)
    reached, well = _walk(set(entries), after), _walk(well, before)
    out = {(name, "UNREACHABLE") for name in names if name not in reached}
    if not entries:  # no definition says where a route may go
        return out
    led: dict[tuple, bool] = {}
    for name, *ways in zip(names, on_success, on_error, strict=True):
        for way, routes in zip(("SUCCESS", "ERROR"), ways, strict=True):
            for to in routes or ():
                end = to is not None and to.startswith("terminal:")
                if not end and to not in known:
                    out.add((name, "UNKNOWN_STAGE"))
                ok = to in ends or to in well
                if ok or not (to is None or end and unsure):
                    led[name, way] = led.get((name, way), False) or ok
    return out | {(name, f"{way}_WITHOUT_TERMINAL") for (name, way), ok in led.items() if not ok}


def _errors_by_joins(stages: DataFrame, workflows: DataFrame) -> DataFrame:
    """``workflow_errors`` of workflows of any size: no task holds one."""
    whole = F.lit(None).cast("string")
    key = lambda c: F.concat_ws("\0", "kind", c)
    routes = stages.select("kind", "stage", F.inline(F.array(F.struct(F.lit("success").alias("way"), F.col("on_success").alias("to")), F.struct(F.lit("error").alias("way"), F.col("on_error").alias("to")))))
    each = routes.select("kind", "stage", "way", F.explode("to").alias("to")).join(workflows.select("kind", "terminals"), "kind")
    ends = F.col("to").startswith("terminal:")
    declared = F.array_contains("terminals", F.regexp_replace("to", "^terminal:", ""))
    known = stages.select("kind", F.col("stage").alias("to"), F.lit(True).alias("known")).distinct()
    each = cut(each.join(known, ["kind", "to"], "left").select("kind", "stage", "way", "to", ends.alias("ends"), (ends & declared).alias("declared"), F.coalesce("known", F.lit(False)).alias("known")))
    at_once = each.where("declared").select(key("stage").alias("node"))
    entry = workflows.select(key("entry").alias("node"))
    inside, ends_well = both_ways(each.where("known").select(key("stage").alias("node"), key("to").alias("parent")), entry, at_once)
    # stages from which some declared terminal is reached, at once or over others
    good = ends_well.select(F.col("node").alias("to_key"), F.lit(True).alias("good"))
    led = each.withColumn("to_key", key("to")).join(good, "to_key", "left").groupBy("kind", "stage", "way").agg(F.bool_or(F.col("declared") | F.coalesce("good", F.lit(False))).alias("ok"))
    unreached = stages.select("kind", "stage", key("stage").alias("node")).join(inside, "node", "left_anti")
    sums = stages.groupBy("kind").agg(F.sum("timeout_s").alias("path_s"), F.count("*").alias("n"), F.countDistinct("stage").alias("k"))
    w = workflows.join(sums, "kind", "left").join(stages.select("kind", F.col("stage").alias("entry"), F.lit(True).alias("there")).distinct(), ["kind", "entry"], "left")
    of_workflow = _workflow_codes(F.col, F.col("n"), F.col("k"), F.col("there").isNotNull(), F.col("path_s"))
    s = stages.join(workflows.select("kind", F.col("timeout_s").alias("most")), "kind")
    of_stage = F.concat(_codes([("STAGE_TIMEOUT", ~F.col("timeout_s").between(1, F.col("most")))]), _stage_codes())
    found = w.select("kind", whole.alias("stage"), F.explode(of_workflow).alias("error")).unionByName(s.select("kind", "stage", F.explode(of_stage).alias("error")))
    bad = each.where(F.when(F.col("ends"), ~F.col("declared")).otherwise(~F.col("known"))).select("kind", "stage", F.when(F.col("ends"), "UNDECLARED_TERMINAL").otherwise("UNKNOWN_STAGE").alias("error"))
    dead = led.where(~F.col("ok")).select("kind", "stage", F.concat(F.upper("way"), F.lit("_WITHOUT_TERMINAL")).alias("error"))
    return found.unionByName(bad).unionByName(dead).unionByName(unreached.select("kind", "stage", F.lit("UNREACHABLE").alias("error"))).distinct()


def weakest_incident(adjacent: DataFrame) -> DataFrame:
    """The weakest band on any edge of a node, and its edges."""
    ends = adjacent.select(F.explode(F.array("source", "target")).alias("node"), "band_at")
    return ends.groupBy("node").agg(F.min("band_at").alias("band_at"), F.count("*").alias("n_edges"))


def impact_summary(affected: DataFrame) -> DataFrame:
    """A10."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return affected.groupBy("change_id").agg(n("BLOCK").alias("block"), n("WARN").alias("warn"), n("INFO").alias("info"))


def page(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next page in the order of keys, after a cursor."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*[F.lit(v).cast(rows.schema[k].dataType) for k, v in zip(keys, after, strict=True)]))
    return rows.orderBy(*keys).limit(limit)


def within_budget(affected: DataFrame, most: int) -> DataFrame:
    """changes' results in turn while their running number is within a budget shared by all."""
    counts = affected.groupBy("change_id").agg(F.count("*").alias("n"))
    return numbered(counts, ["change_id"], value="n", name="upto").select("change_id", "n", (F.col("upto") > most).alias("truncated"))


def edge_detail(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The row of each edge and version that is asked for, with code NOT_FOUND where there is none. versions: (edge_key, version, ...), one row each; asked: (edge_key, version, ...)."""
    own = versions.withColumn("there", F.lit(True))
    code = F.when(F.col("there").isNull(), "NOT_FOUND")
    return asked.join(own, ["edge_key", "version"], "left").withColumn("code", code).drop("there")
