"""A Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources' roots, and coordinate lookup proofs.

A node has a coordinate: its tree, its level and its index there. Level 0 holds the leaves; every FANOUT nodes in a row are one node of
the next level. So the coordinates that a proof needs follow from an index and the tree's number of leaves alone: each node explodes the coordinates of its run,
joins the materialised table of nodes, orders what it got, and concatenates it. The proof of a node above is looked up once for all nodes below it, so a
coordinate is asked for by FANOUT nodes at most: no join has a hot key, however large a source or high a tree.

Leaves are numbered over ranges of their order, so a source of any size is many tasks; the driver gets the largest size and the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import kept
from weftline.operators.ordered import numbered

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """The leaf of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(f) for f in fields]), 256))


def text_of(digest: Column) -> Column:
    """A digest as lowercase hex."""
    return F.lower(F.hex(digest))


def combined(*parts: Column) -> Column:
    """The digest, in hex, of digests in hex that follow one another."""
    return F.sha2(F.concat(*parts), 256)


@dataclass(frozen=True)
class Manifest:
    """levels: of the sources' trees, (tree, at, digest, n) each, level 0 with the columns of the rows; tops: the levels of the tree over them; root: hex."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    root: str | None

    def nodes(self) -> DataFrame:
        """The whole table of nodes: (above, tree, level, at, digest); above tells the tree over the sources from theirs."""
        tables = [(above, k, level) for above, levels in ((False, self.levels), (True, self.tops)) for k, level in enumerate(levels)]
        rows = [level.select(F.lit(above).alias("above"), "tree", F.lit(k).alias("level"), "at", text_of(F.col("digest")).alias("digest")) for above, k, level in tables]
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out


def _run() -> Column:
    return F.floor(F.col("at") / FANOUT).cast("bigint")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels over leaves (tree, at, digest, n), up to the one where each tree that is left is one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("n > 1").groupBy("tree", _run().alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("own"))  # FANOUT at most
        digest = F.unhex(F.sha2(F.array_join(F.transform("own", lambda x: text_of(x["digest"])), ""), 256))
        levels.append(kept(runs.select("tree", F.col("run").alias("at"), digest.alias("digest"), F.ceil(F.col("n") / FANOUT).cast("bigint").alias("n"))))
        most = -(-most // FANOUT)
    return levels


def build(docs: DataFrame, leaf: Column, *, source: str = "source", order: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of all rows of docs. leaf: each row's digest; keep: what a row takes along with its leaf, by name.

    In a source leaves ascend by ``order`` (null first), then by leaf, so repeated rows are leaves of their own side by side; sources ascend bytewise,
    null first. An empty table has no node and no root. Names in keep must not be tree, source_, order_, at, digest, n.
    """
    keep = keep or {}
    rows = kept(docs.select(F.col(source).alias("source_"), F.col(order).alias("order_"), leaf.alias("digest"), *[c.alias(name) for name, c in keep.items()]))
    sizes = numbered(rows.groupBy("source_").agg(F.count("*").alias("n")), ["source_"], name="tree")
    sizes = kept(sizes.select("n", (F.col("tree") - 1).alias("tree"), F.col("source_").alias("of_source")))
    placed = numbered(rows, ["order_", "digest", *keep], by=["source_"], name="at")
    leaves = placed.join(sizes, F.col("source_").eqNullSafe(F.col("of_source")))
    levels = _levels(kept(leaves.select("tree", (F.col("at") - 1).alias("at"), "digest", "n", *keep)))
    ends = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        ends = ends.unionByName(level.where("n = 1").select("tree", "digest"))
    tops = _levels(kept(ends.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(sizes.count()).cast("bigint").alias("n"))))
    last = tops[-1].select(text_of(F.col("digest"))).first()
    return Manifest(levels, tops, last[0] if last else None)


#: A step of a proof: the digests of a run, in hex, before and after the node.
PATH = "array<struct<before: string, after: string>>"


def _down(levels: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """(tree, at, digest, end, path, keep) of each node of level 0. above: (of_tree, end, path) of each tree's last node."""
    paths: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        nodes, more = levels[k], keep if k == 0 else []
        # a tree that ends here has its proof from above
        out = nodes.where("n = 1").join(above, F.col("tree") == F.col("of_tree")).select("tree", "at", "digest", "end", "path", *more)
        if paths is not None:
            first = _run() * FANOUT
            asked = nodes.where("n > 1").select("tree", "at", _run().alias("run"), F.explode(F.sequence(first, F.least(first + FANOUT, F.col("n")) - 1)).alias("asked"))
            table = nodes.select(F.col("tree").alias("of_tree"), F.col("at").alias("asked_at"), "digest", *more)
            found = asked.join(table, (F.col("tree") == F.col("of_tree")) & (F.col("asked") == F.col("asked_at")))
            itself = F.when(F.col("asked") == F.col("at"), F.struct("digest", *more))
            # by tree and run, so that the groups of a run's nodes, and what comes from above, meet without a further shuffle
            found = found.select("tree", "run", "at", F.when(F.col("asked") != F.col("at"), F.struct("asked", "digest")).alias("other"), itself.alias("itself")).repartition("tree", "run")
            runs = found.groupBy("tree", "run", "at").agg(F.array_sort(F.collect_list("other")).alias("others"), F.first("itself", ignorenulls=True).alias("itself"))
            joined = lambda keep: F.array_join(F.transform(F.filter("others", keep), lambda x: text_of(x["digest"])), "")
            step = F.struct(joined(lambda x: x["asked"] < F.col("at")).alias("before"), joined(lambda x: x["asked"] > F.col("at")).alias("after"))
            upper = paths.select(F.col("tree").alias("upper_tree"), F.col("at").alias("upper_at"), "end", F.col("path").alias("upper"))
            meet = runs.join(upper, (F.col("tree") == F.col("upper_tree")) & (F.col("run") == F.col("upper_at")))
            out = out.unionByName(meet.select("tree", "at", "itself.digest", "end", F.concat(F.array(step), "upper").alias("path"), *[F.col(f"itself.{c}").alias(c) for c in more]))
        paths = out if k == 0 else kept(out)
    return paths


def proofs(manifest: Manifest, keep: list[str] | None = None) -> DataFrame:
    """(leaf, subroot, root, path, keep) of every row: hex digests, and the proof from its level to the root's."""
    none = F.array().cast(PATH)
    ends = manifest.tops[-1].select(F.col("tree").alias("of_tree"), F.col("digest").alias("end"), none.alias("path"))
    tops = _down(manifest.tops, ends, [])
    above = tops.select(F.col("at").alias("of_tree"), F.col("digest").alias("end"), "path")
    rows = _down(manifest.levels, above, keep or [])
    return rows.select(text_of(F.col("digest")).alias("leaf"), text_of(F.col("end")).alias("subroot"), F.lit(manifest.root).cast("string").alias("root"), "path", *(keep or []))


def proof_digest(path: Column) -> Column:
    """The digest of a proof: all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings of a proof give."""
    return F.aggregate(path, leaf, lambda got, s: combined(s["before"], got, s["after"]))


def audit(docs: DataFrame, tampered: Column, *, fields: tuple[str, ...] = FIELDS, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Proves every row, and recomputes the root with ``tampered`` in the place of its text, by the original siblings.

    Returns (id_col, leaf, subroot, root, proof_sha256, folded_root, verified). Any field may be null; a null and an empty text have different
    leaves; repeated rows get a row and a place each; an empty table gives an empty one. Other columns of docs are not read, whatever their names.
    """
    own = leaf_digest(*[F.col(f"`{f}`") for f in fields])
    changed = leaf_digest(*[tampered if f == text else F.col(f"`{f}`") for f in fields])
    manifest = build(docs, own, source=source, order=id_col, keep={"own_id": F.col(id_col), "changed": changed})
    rows = proofs(manifest, ["own_id", "changed"])
    folded = fold(text_of(F.col("changed")), F.col("path"))
    out = rows.select(F.col("own_id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
