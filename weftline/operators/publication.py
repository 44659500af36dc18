"""Publishing graph namespaces behind a fenced pointer, and nightly reconciliation."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.queues import checksum


class Refused(RuntimeError):
    """A publication that may not take effect."""


class Store:
    """Namespaces ``env=/version=`` of edges under a folder, and a pointer for each environment.

    A namespace is written aside, verified by count and checksum, and only then named by the pointer. A pointer is a row of numbered files, of which
    the highest holds; a new one is written whole and takes the next number by a rename, which the file system grants to one writer only. So there always
    is a pointer, tokens only grow, and of two writers that read the same pointer one is refused.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def place(self, env: str, version: int) -> str:
        return f"{self.folder}/graph/env={env}/version={version}"

    def _numbers(self, env: str) -> list[int]:
        at = self._path(f"{self.folder}/pointer/{env}")
        if not self.fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def pointer(self, env: str) -> dict:
        numbers = self._numbers(env)
        if not numbers:
            return {"active": None, "prior": None, "token": 0, "number": 0}
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/pointer/{env}/{numbers[-1]:012d}.json").first()[0]
        return {**json.loads(text), "number": numbers[-1]}

    def _point(self, env: str, before: dict, value: dict) -> None:
        """Puts value after the pointer that was read before; refused if another came between."""
        folder = f"{self.folder}/pointer/{env}"
        new, to = self._path(f"{folder}/{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{before['number'] + 1:012d}.json")
        out = self.fs.create(new, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(new, to):
            self.fs.delete(new, False)
            raise Refused(f"another writer moved the pointer of {env}")

    def reserve(self, env: str) -> int:
        """A token above all before."""
        p = self.pointer(env)
        self._point(env, p, {"active": p["active"], "prior": p["prior"], "token": p["token"] + 1})
        return p["token"] + 1

    def digest(self, edges: DataFrame) -> tuple[str, int]:
        r = checksum(edges.select(F.lit(1).alias("g"), F.to_json(F.struct(*sorted(edges.columns))).alias("body")), "g", "body").first()
        return (r["checksum"], r["n"]) if r else ("", 0)

    def publish(self, env: str, version: int, edges: DataFrame, token: int) -> str:
        """Write, verify, activate; an existing equal namespace is taken as it is (a redrive)."""
        want = self.digest(edges)
        at = self._path(self.place(env, version))
        if not self.fs.exists(at):
            edges.write.mode("errorifexists").parquet(at.toString())
        if self.digest(self.read(env, version)) != want:
            raise Refused("the namespace differs from what was to be published")
        self._activate(env, version, token)
        return want[0]

    def _activate(self, env: str, version: int, token: int) -> None:
        p = self.pointer(env)
        if token != p["token"]:
            raise Refused("a later reservation holds the fence")
        if p["active"] != version:
            self._point(env, p, {"active": version, "prior": p["active"], "token": token})

    def rollback(self, env: str, version: int, token: int, expected: str) -> None:
        """U8: names an earlier namespace again, if its checksum still is the expected one."""
        if self.digest(self.read(env, version))[0] != expected:
            raise Refused("the namespace is not what it was")
        self._activate(env, version, token)

    def read(self, env: str, version: int | None = None) -> DataFrame:
        """The edges of a version, or of the active one: its folder is named in the plan, so only it is listed."""
        version = self.pointer(env)["active"] if version is None else version
        if version is None:
            raise Refused(f"nothing is published in {env}")
        return self.spark.read.parquet(self.place(env, version))


def copied(edges: DataFrame, version: int) -> DataFrame:
    """A namespace under a new version."""
    return edges.withColumn("version", F.lit(version))


def diff(base: DataFrame, new: DataFrame, key: str, band: str) -> DataFrame:
    """Each changed key as added, removed or bandChanged."""
    b, n = base.select(key, F.col(band).alias("before")), new.select(key, F.col(band).alias("after"))
    j = b.withColumn("old", F.lit(True)).join(n.withColumn("now", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "bandChanged")
    return j.select(key, "before", "after", kind.alias("kind")).where(F.col("kind").isNotNull())


def unsafe() -> Column:
    """Whether an edge was auto-published that lacked complete coverage, an exact static proof, or more than a model's word."""
    safe = (F.col("coverage") == "COMPLETE") & F.col("static_exact") & F.array_contains("mechanisms", "SCA")
    return (F.col("status") == "AUTO_PUBLISHED") & ~safe


def unsafe_auto_publish(edges: DataFrame) -> DataFrame:
    """The edges that are ``unsafe``."""
    return edges.where(unsafe())


def alerts(checks: DataFrame) -> DataFrame:
    """C12, A.7: a night's alerts in order, and whether proposals were raised."""
    rules = [
        ("ARCHIVE_RECONCILIATION_DRIFT", F.col("archive_drift") > 0), ("PUBLISHED_SAMPLE_DRIFT", F.col("sample_drift") > 0), ("PROJECTION_CHECKSUM_DRIFT", ~F.col("checksum_ok")),
        ("ENVIRONMENT_CHANGED", F.col("env_changed")), ("CACHE_DRAIN_INCOMPLETE", F.col("drain_truncated")), ("AUTOPUBLISH_AUDIT_DRIFT", F.col("unsafe") > 0),
    ]
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))
    return checks.select("night", F.array_join(found, ",").alias("alerts"), F.when(F.col("sample_drift") > 0, "PROPOSALS_RAISED").otherwise("RECONCILED").alias("terminal"))


def drained(entries: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first entries in order, and whether there were more (one more is asked for)."""
    some = entries.orderBy(*order).limit(most + 1)
    return entries.orderBy(*order).limit(most), some.count() > most


def cache_disposition(asked: DataFrame, cache: DataFrame, *others: str) -> DataFrame:
    """(key, others of asked, disposition): INVALIDATED, DUPLICATE (already), SUPERSEDED (a newer version is held) or MISSING."""
    j = asked.join(cache.select("key", F.col("version").alias("held"), "invalid"), "key", "left")
    return j.select("key", *others, F.when(F.col("held").isNull(), "MISSING").when(F.col("held") > F.col("version"), "SUPERSEDED").when(F.col("invalid"), "DUPLICATE").otherwise("INVALIDATED").alias("disposition"))
