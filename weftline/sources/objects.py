"""Objects in a shared folder: results of map runs behind a manifest (S21), write-once evidence by content (S1, S22), graph namespaces in partitions.

Spark's file sources list, prune and read; which objects a run or a key should have is told by joins with what they name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.checkpoints import cut
from weftline.operators.publication import Refused

MANIFEST = "manifest.json"
_MANIFEST = "struct<ResultFiles: struct<SUCCEEDED: array<struct<Key: string, Size: bigint>>>>"


def run_objects(spark: SparkSession, folder: str, pattern: str = r"workflow-results/([^/]+)/B5/([^/]+)/([^/]+)$") -> DataFrame:
    """(command, run, name, size, content) of every object under the folder whose path fits the pattern; its groups are the first three."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.url_decode("_metadata.file_path")
    group = lambda i: F.regexp_extract(path, pattern, i)
    return read.select(group(1).alias("command"), group(2).alias("run"), group(3).alias("name"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content")).where("name <> ''")


def map_results(objects: DataFrame, child: str, *, max_shards: int = 100, max_bytes: int = 128 << 20, max_children: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Children (command, run, shard, nth, child) of the runs that succeeded as a whole, and of each run (command, run, code); code is null for those.

    objects: as ``run_objects`` has them. child: the type of a child result. A run is refused, by the first of these, for: no-manifest, failed-or-pending (children that failed or are
    open), unexpected-object, too-many-shards, object-too-large, invalid-manifest, missing-shard (the manifest names it, it is not there), extra-shard (the reverse), torn-shard
    (another size than the manifest says, or no JSON array), too-many-children.
    """
    by = ["command", "run"]
    success = F.col("name").rlike(r"^SUCCEEDED_[0-9]+\.json$")
    shards = objects.where(success)
    counted = objects.groupBy(*by).agg(
        F.max((F.col("name") == MANIFEST).cast("int")).alias("manifests"), F.max(F.col("name").rlike("^(FAILED|PENDING)_").cast("int")).alias("open"), F.max((~success & (F.col("name") != MANIFEST)).cast("int")).alias("odd"),
        F.sum(success.cast("int")).alias("shards"), F.max("size").alias("largest"),
    )
    # the manifest, one object of a run, names the shards
    manifest = objects.where(F.col("name") == MANIFEST).select(*by, F.from_json("content", _MANIFEST).alias("m"))
    named = manifest.select(*by, F.explode("m.ResultFiles.SUCCEEDED").alias("s")).select(*by, F.element_at(F.split("s.Key", "/"), -1).alias("name"), F.col("s.Size").alias("stated"), F.lit(True).alias("named"))
    kind = f"array<{child}>"
    # a shard that holds more, or less, than it should is not JSON: from_json then has a null
    parsed = F.when(F.col("content").rlike(r"^\s*\["), F.from_json("content", kind))
    held = cut(shards.select(*by, "name", "size", parsed.alias("children"), F.lit(True).alias("there")))
    both = held.select(*by, "name", "size", "there", F.size("children").alias("n"), F.col("children").isNull().alias("unread")).join(named, [*by, "name"], "full_outer")
    judged = both.groupBy(*by).agg(
        F.max(F.col("there").isNull().cast("int")).alias("missing"), F.max(F.col("named").isNull().cast("int")).alias("extra"), F.max((F.coalesce("unread", F.lit(False)) | (F.col("there") & (F.col("size") != F.col("stated")))).cast("int")).alias("torn"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n"),
    )
    readable = manifest.where(F.col("m.ResultFiles").isNotNull()).select(*by, F.lit(True).alias("readable")).distinct()
    all_ = counted.join(readable, by, "left").join(judged, by, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    rules = [(~is_("manifests"), "no-manifest"), (is_("open"), "failed-or-pending"), (is_("odd"), "unexpected-object"), (F.col("shards") > max_shards, "too-many-shards"), (F.col("largest") > max_bytes, "object-too-large")]
    rules += [(F.col("readable").isNull(), "invalid-manifest"), (is_("missing"), "missing-shard"), (is_("extra"), "extra-shard"), (is_("torn"), "torn-shard"), (F.coalesce("n", F.lit(0)) > max_children, "too-many-children")]
    runs = cut(all_.select(*by, reduce(lambda w, r: w.when(*r), rules[1:], F.when(*rules[0])).alias("code")))
    good = held.join(runs.where("code IS NULL").select(*by), by)
    return good.select(*by, F.col("name").alias("shard"), F.posexplode("children").alias("nth", "child")), runs


class Evidence:
    """Write-once objects under a folder, laid out by the SHA-256 of their content, and an index of (kind, key, checksum).

    An object is a text file in a folder of its own, so that other tools find it by its checksum. A million small ones are a million folders, which a store
    creates, renames and lists one by one: ``packed``, objects are rows (checksum, content) of Parquet files, a folder for each of the 256 prefixes.
    """

    def __init__(self, spark: SparkSession, folder: str, packed: bool = False) -> None:
        self.spark, self.folder, self.packed = spark, folder.rstrip("/"), packed

    def index(self) -> DataFrame:
        schema = "kind string, key string, checksum string"
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/index")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/index")

    @staticmethod
    def _place(checksum: Column) -> list[Column]:
        # a letter in front keeps Spark from reading digits as numbers
        return [F.concat(F.lit("h"), F.substring(checksum, 1, 2)).alias("prefix"), F.concat(F.lit("h"), checksum).alias("object")]

    def _write(self, objects: DataFrame, mode: str) -> None:
        """One file for each (checksum, content); packed, a row, and the files of a prefix are replaced (overwrite) or added to (append)."""
        placed = objects.select("content", *self._place(F.col("checksum"))).repartition("prefix")
        if self.packed:
            write = placed.sortWithinPartitions("prefix", "object").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("prefix")
            write.parquet(f"{self.folder}/objects")
        else:
            placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "object").text(f"{self.folder}/objects")

    def _rows(self) -> DataFrame:
        """Packed objects (content, prefix, object), be there none."""
        self.spark.createDataFrame([], "content string, prefix string, object string").write.mode("append").partitionBy("prefix").parquet(f"{self.folder}/objects")
        return self.spark.read.schema("content string, object string, prefix string").parquet(f"{self.folder}/objects")

    def _alter(self, objects: DataFrame) -> None:
        """Other contents for (checksum, content), where those objects lie: what a write-once store must tell."""
        if not self.packed:
            return self._write(objects, "overwrite")
        new = objects.select(F.col("content").alias("other"), *self._place(F.col("checksum")))
        # the prefixes that hold one are written anew, beside what is read, and then take its place
        held = self._rows().join(F.broadcast(new.select("prefix").distinct()), "prefix", "left_semi").join(new.drop("prefix"), "object", "left")
        self._write(held.select(F.coalesce("other", "content").alias("content"), F.substring("object", 2, 64).alias("checksum")), "overwrite")

    def put(self, rows: DataFrame) -> DataFrame:
        """Stores (kind, key, content) and returns (kind, key, checksum, code).

        code is null for what is stored now, or was before with the same content; OVERWRITE_ATTEMPT for a key whose content is another, in the index or in these rows: nothing of it is
        written. Equal content is one object. Objects are written before the index names them, so a run that is cut short and repeated ends the same.
        """
        own = rows.select("kind", "key", F.coalesce("content", F.lit("")).alias("content")).withColumn("checksum", F.sha2("content", 256))
        had = cut(self.index())
        claims = own.select("kind", "key", "checksum", F.lit(True).alias("new")).distinct().unionByName(had.withColumn("new", F.lit(False)))
        several = claims.groupBy("kind", "key").agg(F.min("checksum").alias("a"), F.max("checksum").alias("b"), F.max("new").alias("asked"), (~F.min("new")).alias("known")).where("asked")
        told = cut(own.select("kind", "key", "checksum").distinct().join(several, ["kind", "key"]).select("kind", "key", "checksum", F.when(F.col("a") != F.col("b"), "OVERWRITE_ATTEMPT").alias("code"), "known"))
        fresh = told.where("code IS NULL AND NOT known")
        # packed, files are added: what lies there counts, be it named or not, so that a repeated run adds no object twice
        stored = self._rows().select(F.substring("object", 2, 64).alias("checksum")) if self.packed else had.select("checksum").distinct()
        contents = own.join(fresh.select("checksum").distinct().join(stored, "checksum", "left_anti"), "checksum").groupBy("checksum").agg(F.first("content").alias("content"))
        self._write(contents, "append" if self.packed else "overwrite")
        fresh.select("kind", "key", "checksum").write.mode("append").parquet(f"{self.folder}/index")
        return told.select("kind", "key", "checksum", "code")

    def objects(self, checksums: list[str] | None = None) -> DataFrame:
        """(checksum, content, verified): the objects as they lie there, all or some; only the folders of those are read."""
        read = self._rows() if self.packed else self.spark.read.format("binaryFile").load(f"{self.folder}/objects")
        if checksums is not None:
            read = read.where(F.col("prefix").isin(*{f"h{c[:2]}" for c in checksums}) & F.col("object").isin(*[f"h{c}" for c in checksums]))
        body = F.col("content") if self.packed else F.expr("substring(content, 1, length(content) - 1)")  # the text source ends each row with a break
        checksum = F.substring("object", 2, 64)
        return read.select(checksum.alias("checksum"), body.cast("string").alias("content"), (F.sha2(body, 256) == checksum).alias("verified"))

    def get(self, kind: str | None = None) -> DataFrame:
        """(kind, key, checksum, content, code) of what the index names: CHECKSUM_MISMATCH and no content for an altered object, MISSING_OBJECT for a lost one."""
        index = self.index() if kind is None else self.index().where(F.col("kind") == kind)
        j = index.join(self.objects(), "checksum", "left")
        code = F.when(F.col("verified").isNull(), "MISSING_OBJECT").when(~F.col("verified"), "CHECKSUM_MISMATCH")
        return j.select("kind", "key", "checksum", F.when(F.col("verified"), F.col("content")).alias("content"), code.alias("code"))


class Namespaces:
    """Edges of graph versions in partitions by environment, version and batch. A batch is a hash part of the keys, replaced as a whole or not at all."""

    def __init__(self, spark: SparkSession, folder: str, batches: int = 16) -> None:
        self.spark, self.folder, self.batches = spark, folder.rstrip("/"), batches

    def batch(self) -> Column:
        return F.pmod(F.xxhash64("edge_key"), F.lit(self.batches)).cast("int")

    def read(self, env: str, version: int) -> DataFrame:
        """(edge_key, payload, batch) of one version: its partitions alone are read."""
        return self.spark.read.schema("edge_key string, payload string, env string, version int, batch int").parquet(self.folder).where((F.col("env") == env) & (F.col("version") == version)).select("edge_key", "payload", "batch")

    def _sums(self, rows: DataFrame) -> DataFrame:
        own = F.conv(F.substring(F.sha2(F.concat_ws("\0", "edge_key", "payload"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        return rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum(own).alias("total"))

    def write(self, env: str, version: int, edges: DataFrame) -> int:
        """Writes the edges (edge_key, payload) of a version that is being staged and returns how many batches that took.

        What is there already stays: a batch is written only if it differs in number or in the sum of its rows' digests, so a write that was cut short goes on where it
        ended, with no row twice. An edge that is there with another payload, or twice with two payloads among the new ones, is a conflict: nothing is written.
        """
        new = cut(edges.select("edge_key", "payload").distinct().withColumn("batch", self.batch()))
        self.spark.createDataFrame([], "edge_key string, payload string, env string, version int, batch int").write.mode("append").partitionBy("env", "version", "batch").parquet(self.folder)
        old = cut(self.read(env, version))
        conflict = new.unionByName(old).groupBy("edge_key").agg(F.min("payload").alias("a"), F.max("payload").alias("b")).where("a <> b").limit(1).collect()
        if conflict:
            raise Refused(f"NAMESPACE_CONFLICT: {conflict[0]['edge_key']}")
        want, has = self._sums(new), self._sums(old).select("batch", F.col("n").alias("has_n"), F.col("total").alias("has_total"))
        # as many rows as there are batches
        open_ = [r["batch"] for r in want.join(has, "batch", "left").where("NOT (n <=> has_n AND total <=> has_total)").select("batch").collect()]
        if open_:
            rows = new.where(F.col("batch").isin(*open_)).repartition("batch").select("edge_key", "payload", F.lit(env).alias("env"), F.lit(version).alias("version"), "batch")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env", "version", "batch").parquet(self.folder)
        return len(open_)

    def copy(self, env: str, version: int, to: int) -> int:
        """A version under a new number, resumed like any write; refused unless both are equal in the end."""
        wrote = self.write(env, to, self.read(env, version).drop("batch"))
        mark = lambda v, name: self._sums(self.read(env, v)).select("batch", F.col("n").alias(f"n_{name}"), F.col("total").alias(f"total_{name}"))
        both = mark(version, "old").join(mark(to, "new"), "batch", "full_outer").where("NOT (n_old <=> n_new AND total_old <=> total_new)")
        if not both.isEmpty():
            raise Refused(f"NAMESPACE_CONFLICT: version {to} holds more than version {version}")
        return wrote
