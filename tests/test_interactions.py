"""Routes against templates, tried one by one."""

import random

from weftline.operators import interactions


def best(path, templates):
    fits = [(tuple((s == "{}", s) for s in t), e) for t, e in templates if len(t) == len(path) and all(s in ("{}", p) for s, p in zip(t, path, strict=True))]
    return min(fits)[1] if fits else None


def test_routes_by_brute_force(spark):
    rng = random.Random(12)
    words = ["a", "b", "c", "{}"]
    templates = [([rng.choice(words) for _ in range(rng.randint(0, 4))], f"e{i}") for i in range(60)]
    paths = [[rng.choice("abcd") for _ in range(rng.randint(0, 5))] for _ in range(200)]
    endpoints = spark.createDataFrame([(e, "s", "GET", "/" + "/".join("{x}" if s == "{}" else s for s in t)) for t, e in templates] + [("other", "t", "GET", "/a")], "endpoint_id string, service string, method string, route string")
    calls = spark.createDataFrame([(i, "r", "get", "http://u:p@H/" + "/".join(p)) for i, p in enumerate(paths)] + [(1000, "r", "GET", "nothing"), (1001, "r", "POST", "http://h/a"), (1002, "r", "GET", None)], "call_id int, caller string, method string, url string")
    services = spark.createDataFrame([("h", "s")], "host string, service string")
    got = {r["call_id"]: (r["endpoint_id"], r["code"]) for r in interactions.linked(calls, endpoints, services).collect()}
    for i, p in enumerate(paths):
        e = best(p, templates)
        assert got[i] == (e, None if e else "unmatched-route")
    assert got[1000] == got[1002] == (None, "unknown-service") and got[1001] == (None, "unmatched-route")
