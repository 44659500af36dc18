"""Urls with secrets, names that JSON escapes, and sums beyond 64 bits."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from weftline.functions import names, rules
from weftline.operators import queues


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in rows.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_credentials(spark):
    urls = {
        "postgres://user:p@ss@host/db": "postgres://host/db", "jdbc:postgresql://u:p/w@host/db": None, "jdbc:postgresql://u:p@Host:5432/db?user=x&password=y": "jdbc:postgresql://host:5432/db", "S3://bucket/key#x": "s3://bucket/key",
        "http://h:0080/": "http://h:80/", "http://h:99999/": None, "http://h:x/": None, "http://u:p@[::1]:80/a": "http://::1:80/a", "no url at all": "no url at all", "jdbc:oracle:thin:x": "jdbc:oracle:thin:x", "file:///a/b": "file:///a/b", "http://h:/p": "http://h/p", None: None, "": "",
    }
    assert dict(zip(urls, column(spark, list(urls), names.without_credentials), strict=True)) == urls


def test_service_urls(spark):
    urls = {"http://bob:pw@host/x": ("host", "/x"), "HTTP://Host/x": ("host", "/x"), "http://a@b@host:80?q": ("host", "/"), "https://h/a/b?c#d": ("h", "/a/b"), "nothing": ("", "/"), "http://u:p/w@host": ("", "/w@host")}
    got = column(spark, list(urls), names.service_url)
    assert {u: (r["host"], r["route"]) for u, r in zip(urls, got, strict=True)} == urls


def test_edge_keys_are_those_of_canonical_json(spark):
    rng = random.Random(6)
    texts = ['say "x"', "back\\slash", "é", "\x00\x1f\x7f\b\f\n\r\t", "😀 \U0001f1e9", "", "plain", "￿퟿"] + ["".join(rng.choices('ab"\\é中😀\n/\x01 ', k=rng.randint(1, 12))) for _ in range(100)]
    got = column(spark, texts, rules.json_text)
    assert got == [json.dumps(t)[1:-1] for t in texts]
    rows = spark.createDataFrame([(["b", 'a"é'], "t\\", "READS")], "s array<string>, t string, k string")
    body = json.dumps({"edgeType": "READS", "from": sorted(["b", 'a"é']), "to": "t\\"}, separators=(",", ":"))
    assert rows.select(rules.edge_key(F.col("s"), F.col("t"), F.col("k"))).first()[0] == "edge-" + hashlib.sha256(body.encode()).hexdigest()[:24]


def test_checksum_sums_are_decimal(spark):
    rows = spark.range(5).select(F.lit("n").alias("by"), F.col("id").cast("string").alias("body"))
    parts = [[int(hashlib.sha256(str(i).encode()).hexdigest()[k : k + 8], 16) for i in range(5)] for k in (0, 8, 16, 24)]
    want = hashlib.sha256("-".join(map(str, [5, *map(sum, parts)])).encode()).hexdigest()
    checked = queues.checksum(rows, "by", "body")
    assert checked.first()["checksum"] == want
    plan = checked._jdf.queryExecution().analyzed().toString()
    assert "decimal(38,0)" in plan and plan.count("Aggregate") == 2
