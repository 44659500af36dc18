"""The decontamination search against a brute-force edit search, both ways, and its memory."""

import random
import tracemalloc

from pyspark.sql import functions as F

from weftline.llm import decontamination as d


def nearest(window, text):
    """Least edits between a window and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(window, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def holds(item, text):
    item, text = d.normalise(item), d.normalise(text)
    for length in {min(d.WINDOW, len(item))} | ({len(item)} if len(item) < 2 * d.WINDOW else set()):
        most = next(m for m in range(int(d.EDITS * length), -1, -1) if m == 0 or length + 1 - d.Q * (m + 1) >= 1)
        if any(nearest(item[a : a + length], text) <= most for a in range(len(item) - length + 1)):
            return True
    return False


def test_against_brute_force():
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    seen = set()
    for n in (45, 70, 90):
        item = prose(n)
        index = d.Index([(1, item)], d.Q, d.EDITS, d.WINDOW)
        for _ in range(14):
            a = rng.randint(0, max(0, len(item) - 62))
            part = list(item[a : a + rng.randint(50, n + 5)])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["x"], [part[at], "y"]])
            text = f"{prose(30)}{''.join(part)}{prose(30)}"
            want = holds(item, text)
            seen.add(want)
            assert bool(index.hits(d.normalise(text))) == want, (item, text)
    assert seen == {True, False}


def test_nothing_clean_is_taken(spark, small):
    """Documents that the search names hold their item by brute force; those of a sample that it leaves do not."""
    docs, benchmark = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    found = {r["doc_id"]: r["items"] for r in d.contamination(docs.where(F.length("text") < 1500), benchmark).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    named = [(i, k) for i, ks in sorted(found.items()) for k in ks]
    assert named
    rng = random.Random(1)
    for i, k in rng.sample(named, min(4, len(named))):
        assert holds(items[k], texts[i])
    clean = sorted(i for i, ks in found.items() if not ks and len(texts[i]) < 300)
    for i in rng.sample(clean, 4):
        assert not holds(items[rng.choice(sorted(items))], texts[i])


def test_repetitive_texts_need_little_memory():
    items = [(i, f"{'la ' * 60}{i}") for i in range(200)]
    index = d.Index(items, d.Q, d.EDITS, d.WINDOW)
    tracemalloc.start()
    assert index.hits(d.normalise("la " * 6700)) == set(range(200))
    assert index.hits(d.normalise("la lo " * 3000)) == set()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20


def test_items_of_one_text_are_all_named():
    index = d.Index([(7, "A quiet river runs past the old mill and under the bridge."), (9, "a quiet river runs past the old mill, and under the bridge")], d.Q, d.EDITS, d.WINDOW)
    assert index.hits(d.normalise("Here: a quiet river runs past the old mill and under the bridge!")) == {7, 9}


def test_parts_and_clashing_names(spark, small, monkeypatch):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = benchmark.select(F.col("item_id").alias("doc_id"), "text", F.lit(-7).alias("items"), F.lit("s").alias("searched"), F.lit(1.5).alias("row"))
    whole = sorted(map(str, d.contamination(rows, benchmark).collect()))
    monkeypatch.setattr(d, "INDEX_CHARS", 600)
    monkeypatch.setattr(d, "PARTS", 3)
    assert sorted(map(str, d.contamination(rows, benchmark).collect())) == whole
    kept = d.contaminated_rows(rows, benchmark).collect()
    assert {(r["row"]["items"], r["row"]["searched"], r["row"]["row"]) for r in kept} == {(-7, "s", 1.5)} and all(r["row"]["doc_id"] in r["items"] for r in kept)
