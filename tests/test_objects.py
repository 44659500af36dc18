"""Runs with objects missing, torn or too many; evidence that is written twice, altered and lost; namespaces that are resumed."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from weftline.operators.publication import Refused
from weftline.sources import objects

OBJECTS = "command string, run string, name string, size bigint, content string"


def runs(spark, **kinds):
    rows = [("c", run, name, len(text), text) for run, files in kinds.items() for name, text in files.items()]
    return spark.createDataFrame(rows, OBJECTS)


def manifest(**sizes):
    return json.dumps({"ResultFiles": {"FAILED": [], "SUCCEEDED": [{"Key": f"x/y/{n}.json", "Size": s} for n, s in sizes.items()]}})


def test_map_results(spark):
    ok = {"SUCCEEDED_0.json": '[{"v": 1}, {"v": 2}]', "SUCCEEDED_1.json": "[]"}
    good = manifest(SUCCEEDED_0=20, SUCCEEDED_1=2)
    found = runs(
        spark,
        good=ok | {"manifest.json": good},
        bare=ok,
        failed=ok | {"manifest.json": good, "FAILED_0.json": "[]"},
        pending=ok | {"manifest.json": good, "PENDING_0.json": "[]"},
        odd=ok | {"manifest.json": good, "x.txt": ""},
        many={f"SUCCEEDED_{i}.json": "[]" for i in range(5)} | {"manifest.json": good},
        broken=ok | {"manifest.json": "{"},
        missing={"SUCCEEDED_0.json": ok["SUCCEEDED_0.json"], "manifest.json": good},
        extra=ok | {"SUCCEEDED_2.json": "[]", "manifest.json": good},
        torn=ok | {"SUCCEEDED_0.json": '[{"v": 1}, {"v":', "manifest.json": manifest(SUCCEEDED_0=16, SUCCEEDED_1=2)},
        short=ok | {"manifest.json": manifest(SUCCEEDED_0=21, SUCCEEDED_1=2)},
        scalar=ok | {"SUCCEEDED_1.json": "{}", "manifest.json": good},
        large={"SUCCEEDED_0.json": json.dumps([{"v": i} for i in range(400)]), "manifest.json": manifest(SUCCEEDED_0=9)},
        wide={"SUCCEEDED_0.json": "[" + ",".join(["{}"] * 60) + "]", "manifest.json": manifest(SUCCEEDED_0=181)},
    )
    children, codes = objects.map_results(found, "struct<v: int>", max_shards=4, max_bytes=1000, max_children=50)
    assert {r["run"]: r["code"] for r in codes.collect()} == {
        "good": None, "bare": "no-manifest", "failed": "failed-or-pending", "pending": "failed-or-pending", "odd": "unexpected-object", "many": "too-many-shards", "broken": "invalid-manifest", "missing": "missing-shard", "extra": "extra-shard",
        "torn": "torn-shard", "short": "torn-shard", "scalar": "torn-shard", "large": "object-too-large", "wide": "too-many-children",
    }
    assert sorted((r["run"], r["shard"], r["nth"], r["child"]["v"]) for r in children.collect()) == [("good", "SUCCEEDED_0.json", 0, 1), ("good", "SUCCEEDED_0.json", 1, 2)]


def test_run_objects_are_read_from_files(spark, tmp_path):
    for path, text in {"c 1/B5/r/manifest.json": "{}", "c 1/B5/r/SUCCEEDED_0.json": "[]\n\n[]", "c 1/B6/r/SUCCEEDED_0.json": "no"}.items():
        os.makedirs(tmp_path / "workflow-results" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "workflow-results" / path).write_text(text)
    assert sorted(tuple(r) for r in objects.run_objects(spark, f"file://{tmp_path}").collect()) == [("c 1", "r", "SUCCEEDED_0.json", 6, "[]\n\n[]"), ("c 1", "r", "manifest.json", 2, "{}")]


def test_evidence_is_written_once(spark, tmp_path):
    store = objects.Evidence(spark, f"file://{tmp_path}/e")
    rows = lambda *xs: spark.createDataFrame(list(xs), "kind string, key string, content string")
    codes = lambda df: {(r["kind"], r["key"]): r["code"] for r in df.collect()}
    assert codes(store.put(rows(("k", "a", "one\ntwo"), ("k", "b", "one\ntwo"), ("k", "c", None), ("k", "d", "x"), ("k", "d", "y")))) == {("k", "a"): None, ("k", "b"): None, ("k", "c"): None, ("k", "d"): "OVERWRITE_ATTEMPT"}
    assert codes(store.put(rows(("k", "a", "other"), ("k", "b", "one\ntwo"), ("l", "a", "new")))) == {("k", "a"): "OVERWRITE_ATTEMPT", ("k", "b"): None, ("l", "a"): None}
    assert {(r["kind"], r["key"]): (r["content"], r["code"]) for r in store.get().collect()} == {("k", "a"): ("one\ntwo", None), ("k", "b"): ("one\ntwo", None), ("k", "c"): ("", None), ("l", "a"): ("new", None)}
    assert store.objects().count() == 3 and store.index().count() == 4
    files = {r["checksum"]: r["key"] for r in store.get().collect()}
    some = next(c for c, key in files.items() if key == "a" or key == "b")
    (place,) = (tmp_path / "e/objects" / f"prefix=h{some[:2]}" / f"object=h{some}").glob("part-*")
    place.write_text("altered\n")
    (place.parent / f".{place.name}.crc").unlink()  # the local file system's own check, which other stores lack
    lost = next(c for c, key in files.items() if key == "c")
    shutil.rmtree(tmp_path / "e/objects" / f"prefix=h{lost[:2]}" / f"object=h{lost}")
    told = {(r["kind"], r["key"]): r["code"] for r in store.get("k").collect()}
    assert told["k", "c"] == "MISSING_OBJECT" and "CHECKSUM_MISMATCH" in told.values()
    plan = store.objects([some])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan or "PartitionFilters: [isnotnull(prefix" in plan or "prefix#" in plan.split("PartitionFilters")[1]


def test_namespaces_are_resumed(spark, tmp_path):
    store = objects.Namespaces(spark, f"file://{tmp_path}/n", batches=8)
    edges = lambda n, p="p": spark.range(n).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("edge_key"), F.concat(F.lit(p), F.col("id").cast("string")).alias("payload"))
    assert store.write("env", 1, edges(100)) == 8 and store.write("env", 1, edges(100)) == 0
    half = edges(100).withColumn("batch", store.batch()).where("batch < 3")
    assert store.write("env", 2, half) == 3 and store.write("env", 2, edges(100)) == 5
    # a batch of which a part is there is replaced
    assert store.write("other", 2, edges(40)) == 8 and store.write("other", 2, edges(41)) == 1
    for env, version, n in (("env", 1, 100), ("env", 2, 100), ("other", 2, 41), ("none", 1, 0)):
        got = store.read(env, version).collect()
        assert len(got) == n and len({r["edge_key"] for r in got}) == n
    with pytest.raises(Refused, match="NAMESPACE_CONFLICT: k"):
        store.write("env", 1, edges(3, "q"))
    with pytest.raises(Refused, match="NAMESPACE_CONFLICT"):
        store.write("new", 1, edges(3).unionByName(edges(3, "q")))
    assert store.read("new", 1).count() == 0
    plan = store.read("env", 2)
    assert len(plan.inputFiles()) >= 8 and "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    scanned = plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "env" in scanned and "version" in scanned


def test_packed_evidence_takes_a_file_for_each_prefix(spark, tmp_path):
    store = objects.Evidence(spark, f"file://{tmp_path}/e", packed=True)
    rows = lambda n, p="c": spark.range(n).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("key"), F.concat(F.lit(p), (F.col("id") % 2000).cast("string")).alias("content"))
    assert store.put(rows(2500)).where("code IS NULL").count() == 2500
    # a run that was cut short left objects that the index does not name yet
    store._write(spark.createDataFrame([("k", "x", "y")], "kind string, key string, content string").withColumn("checksum", F.sha2("content", 256)), "append")
    assert store.put(rows(2600).unionByName(spark.createDataFrame([("k", "x", "y")], "kind string, key string, content string"))).where("code IS NULL").count() == 2601
    assert store.objects().count() == 2001 and store.index().count() == 2601
    assert len(list((tmp_path / "e/objects").glob("prefix=*/part-*.parquet"))) <= 256 + 1
    assert {r["code"] for r in store.put(rows(3, "d")).collect()} == {"OVERWRITE_ATTEMPT"}
    some = store.get("k").where("key = '7'").first()["checksum"]
    assert [r["content"] for r in store.objects([some]).collect()] == ["c7"]
    store._alter(spark.createDataFrame([(some, "altered")], "checksum string, content string"))
    told = store.get("k").where("code IS NOT NULL").collect()
    assert {(r["key"], r["content"], r["code"]) for r in told} == {("7", None, "CHECKSUM_MISMATCH"), ("2007", None, "CHECKSUM_MISMATCH")} and store.get().count() == 2601 and store.objects().count() == 2001
    shutil.rmtree(tmp_path / "e/objects" / f"prefix=h{some[:2]}")
    assert {r["code"] for r in store.get("k").where("key = '7'").collect()} == {"MISSING_OBJECT"}
