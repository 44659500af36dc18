"""The links of the Jaccard join, counted."""

import random

import duckdb

from weftline.llm import parity_join, queries


def test_links_of_each_document(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a c")]
    for size, copies in ((6, 12), (60, 25), (200, 25)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, size // 40))):
                own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(parity_join, "GROUP", 4)
    found = parity_join.link_components(documents, count_links=True)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = c.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.OP9_LINKS_SQL})").fetchall()
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(want)
    assert max(r[3] for r in got) > 1 and got[2][3] == got[3][3] == 1
    assert parity_join.link_components(documents.where("false"), count_links=True).count() == 0
