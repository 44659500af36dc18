"""Settings of nested files against a reader that keeps a stack."""

import random

from pyspark.sql import functions as F

from weftline.sources import extractors


def flat(text):
    out, stack = [], []
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.split("#", 1)[0].rstrip()
        bare = line.strip()
        if not bare or bare.startswith("-"):
            continue
        if "=" in bare:
            key, value = bare.split("=", 1)
            out.append((number, key.strip(), value.strip()))
        elif ":" in bare:
            key, value = (x.strip() for x in bare.split(":", 1))
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= indent:
                stack.pop()
            if value:
                out.append((number, ".".join([*(k for _, k in stack), key]), value.strip("'\"")))
            else:
                stack.append((indent, key))
    return out


def test_nested_settings(spark):
    rng = random.Random(14)
    pieces = ["a:", "b: 1", "c: 'x:y'", "d=2", "- e: 3", "# f", "g", "h: # i", "", 'j: "k"', "l.m: n", "o = p = q"]
    texts = ["\n".join(" " * rng.choice([0, 0, 2, 4, 6]) + rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(200)] + ["", "\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["f"]] for r in rows.select("i", extractors.flattened(F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(texts))] == [flat(t) for t in texts]
