"""The pipeline's stages, each and together, against brute force and on odd rows."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from weftline.llm import decontamination, mixing
from tests.llm.test_llm import brute_components

CLASH = ("score", "lang_pred", "items", "searched", "whole", "row", "own", "alone", "mix_pass", "mix_block", "n_shingles", "component_id")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 6000)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Nulls in every column, blanks, repeats, ids that two texts share, foreign letters, a very long text, and columns of any names."""
    text = docs.where("lang = 'en'").orderBy(F.desc("n_chars")).first()["text"]
    other = docs.where("lang = 'fr'").orderBy(F.desc("n_chars")).first()["text"]
    rows = [
        (None, text, "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n", "en", "b"), (4, text, "en", "b"), (4, text, "en", "b"), (5, text + " more", None, None), (6, other, None, "b"),
        (6, text, "en", "a"), (7, "Это предложение написано по-русски и ни на что не похоже здесь", "en", "a"), (8, "12345 !!", "de", "a"), (9, (other + " ") * 60, "fr", "b"), (10, "Да", "en", "a"),
    ]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    whole = docs.select("doc_id", "text", "lang", "source", "n_chars").where("lang <> 'xx'").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(made)
    for c in CLASH:
        whole = whole.withColumn(c, F.lit(f"own {c}"))
    return whole


def untouched(df):
    return all({r[c] for r in df.select(c).distinct().collect()} <= {f"own {c}"} for c in CLASH)


def test_language_stage(spark, odd, docs, small):
    out = p.identify_language(spark, odd, small)
    assert out.columns == odd.columns and untouched(out)
    left = collections.Counter((r["doc_id"], r["lang"]) for r in out.collect())
    assert not {1, 2, 3, 7, 8} & {i for i, _ in left} and left[4, "en"] == 2 and left[5, "en"] == 1 and left[6, "fr"] == 1 and left[None, "en"] == 1 and (None, None) not in left
    # no document of the table itself is lost
    assert {i - 1000 for i, _ in left if i and i > 999} == {r["doc_id"] for r in docs.collect()}
    assert p.identify_language(spark, odd.where("false"), small).count() == 0


def test_copies_stage(spark, odd, small):
    some = odd.where("doc_id < 1000 OR doc_id IS NULL")
    out = p.drop_near_copies(spark, some, small)
    assert out.columns == some.columns and untouched(out)
    got = collections.Counter((r["doc_id"], (r["text"] or "")[:12]) for r in out.collect())
    text = some.where("doc_id = 4").first()["text"][:12]
    # of the copies of one text, id 4 stays, once; the other text of id 6 is a document of its own
    assert got[4, text] == 1 and (6, text) not in got and (5, text) not in got and (None, text) not in got
    # id 9 says id 6's text again and again: nearly the same shingles
    assert {i for i, _ in got} == {None, 1, 2, 3, 4, 6, 7, 8, 10} and sum(got.values()) == 9
    assert p.drop_near_copies(spark, some.where("false"), small).count() == 0


def test_copies_stage_by_brute_force(spark, docs, small):
    want = {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if i == c}
    assert {r["doc_id"] for r in p.drop_near_copies(spark, docs, small).collect()} == want


def test_decontamination_stage(spark, odd, small):
    out = p.decontaminate(spark, odd, small)
    assert out.columns == odd.columns and untouched(out)
    items = [decontamination.normalise(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontamination.Index(list(enumerate(items)), decontamination.Q, decontamination.EDITS, decontamination.WINDOW)
    want = collections.Counter(r["doc_id"] for r in odd.collect() if not index.hits(decontamination.normalise(r["text"])))
    assert collections.Counter(r["doc_id"] for r in out.collect()) == want and want[4] in (0, 2)
    assert p.decontaminate(spark, odd.where("false"), small).count() == 0


def test_mixing_stage(spark, odd, small):
    out = p.mix_sources(spark, odd, small)
    assert out.columns == odd.columns and untouched(out)
    before, after = (collections.Counter((r["doc_id"], r["text"]) for r in df.collect()) for df in (odd, out))
    assert set(after) == set(before) and all(after[k] % n == 0 for k, n in before.items())
    assert p.mix_sources(spark, odd.where("false"), small).count() == 0


def test_sharding_stage(spark, odd, small):
    out = p.shard(spark, odd, small).collect()
    assert len(out) == odd.count()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert p.shard(spark, odd.where("false"), small).count() == 0


def test_run(spark, small):
    """The whole run over the whole table against its stages by brute force: who is left, and how often."""
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    last = p.run(spark, small)
    out = collections.Counter(r["doc_id"] for r in last.collect())
    single = {i for i, (_, c) in brute_components([(i, r["text"]) for i, r in docs.items()]).items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontamination.Index(items, decontamination.Q, decontamination.EDITS, decontamination.WINDOW)
    clean = {i for i in single if not index.hits(decontamination.normalise(docs[i]["text"]))}
    assert set(out) == clean
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(p.MODEL))
    tokens = collections.Counter()
    for i in clean:
        tokens[docs[i]["source"]] += len(model.encode(docs[i]["text"]))
    names = sorted(tokens)
    ws = mixing.weights([tokens[n] for n in names], mixing.exponent_for_entropy([tokens[n] for n in names], p.ENTROPY_SHARE * __import__("math").log(len(names))))
    budget = max(tokens[n] / w for n, w in zip(names, ws, strict=True))
    for n, w in zip(names, ws, strict=True):
        times = w * budget / tokens[n]
        assert all(int(times - 1e-6) <= out[i] <= int(times + 1e-6) + 1 for i in clean if docs[i]["source"] == n)
    assert {r["shard"] for r in last.collect()} == set(range(8))
    assert [n for n, _ in p.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "sharding"]


def test_layout_follows_blocks(spark, docs, small, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5000)
    random.seed(1)
    out = [r["doc_id"] for r in p.mix_sources(spark, docs, small).collect()]
    assert out != sorted(out) and set(out) == {r["doc_id"] for r in docs.collect()}
