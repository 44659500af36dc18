"""The night's steps on odd inputs, and how often they shuffle their rows."""

from weftline.operators import nightly
from weftline.plans.queries import QUERIES


def test_sides_of_one_table_as_three_tables(spark):
    rows = [(1, "a", 7), (1, "b", 5), (1, "b", 1), (1, "c", 2), (1, "d", 4), (1, "e", 6), (2, "a", 1), (2, None, 3), (None, "a", 3), (3, "z", 2), (3, "z", 2)]
    events = spark.createDataFrame(rows, "system int, event_id string, sides int")
    side = lambda bit: events.where(f"sides & {bit} != 0").select("system", "event_id")
    got = sorted(map(tuple, nightly.sides_reconciliation(events, ["system"], ["event_id"]).collect()), key=str)
    assert got == sorted(map(tuple, nightly.event_reconciliation(side(1), side(2), side(4), ["system"]).collect()), key=str)
    assert (1, 2, 3, 4, 1, 0, 2, 2, 1, "DRIFT") in got and (3, 0, 1, 0, 0, 0, 1, 0, 1, "DRIFT") in got


def test_sample_has_a_key_that_comes_again_once(spark):
    rows = spark.createDataFrame([(s, f"k{k}") for s in (1, 2) for k in range(9 * s) for _ in range(k % 3 + 1)], "system int, key string")
    got, once = (nightly.bottom_sample(df, "system", "key", 4).collect() for df in (rows, rows.distinct()))
    assert len(got) == 8 and sorted(map(tuple, got)) == sorted(map(tuple, once))


def test_drain_tells_of_all_that_is_asked_for(spark):
    entries = spark.createDataFrame([("none", "a", 1), ("none", "b", 1), ("some", "a", 1), ("some", "b", 1), ("some", "c", 1), ("all", "a", 1), ("all", "d", 2), ("stray", "a", 1)], "system string, key string, version int")
    cache = spark.createDataFrame([("a", 1, False), ("b", 1, True), ("c", 9, False), ("d", 3, False)], "key string, version int, invalid boolean")
    limits = spark.createDataFrame([("none", 0), ("some", 2), ("all", 2), ("empty", 5)], "system string, cache_limit int")
    got = {r["system"]: tuple(r)[1:] for r in nightly.cache_drain(entries, cache, limits).collect()}
    assert got == {"none": (2, 0, True), "some": (3, 2, True), "all": (2, 2, True), "empty": (0, 0, False)}


def test_night_shuffles_a_line_a_few_times(spark, small):
    context = spark.sparkContext
    jvm, store = context._jvm, context._jsc.sc().statusStore()
    stages = lambda: jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, context._gateway.new_array(jvm.double, 0), None))
    last = max((s.stageId() for s in stages()), default=-1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        QUERIES["c12_nightly_run"](spark, small).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    moved = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last)
    assert moved < 4 * lines, moved / lines
