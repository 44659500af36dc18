"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat_format, decontamination, fingerprints, language_id, minimax_shards, mixing, parity_join, queries, textblocks, token_counts, toxicity, url_cascade

ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "a b c d e f"), (6, "A B C D E F"), (None, "x y"), (7, "word " * 3000), (8, "ß" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and extra columns of clashing names."""
    rows = [(i, t, "label", 1.0, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string, score double, n bigint")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def shingles_of(text, k=5):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n\tC") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", None, "x" * 5000, " y " * 2000]
    whole = [w.tolist() for w in textblocks.word_hashes(pa.array(texts))]
    monkeypatch.setattr(textblocks, "BLOCK", 64)
    assert [w.tolist() for w in textblocks.word_hashes(pa.array(texts))] == whole
    assert [len(w) for w in whole] == [len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_fingerprints(spark, docs, odd, nothing):
    got = {r["doc_id"]: r for r in fingerprints.compare_with_edits(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    assert set(got) == {i for i, _ in rows}
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text)
        a, b = shingles_of(text), shingles_of(edited)
        errors.append(abs(got[i]["near_edited"] - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.06
    assert fingerprints.compare_with_edits(odd).count() == len(ODD)
    assert fingerprints.compare_with_edits(nothing).count() == 0
    same = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(odd).collect()}
    assert same[1] == same[2] == same[3] == "" and same[5] == same[6] != ""


def test_fingerprints_merge_and_contain():
    rng = np.random.default_rng(1)
    big = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    part = big[:1000]
    a, b = fingerprints.sketch(part), fingerprints.sketch(big)
    assert fingerprints.merge(a, fingerprints.sketch(big[500:])).tolist() == b.tolist()
    assert fingerprints.containment(a, b) == 1.0
    assert abs(fingerprints.containment(b, a) - 0.05) < 0.02
    assert fingerprints.read(fingerprints.write(b)).tolist() == b.tolist()


def test_mixing_weights():
    counts = [1000, 100, 10, 0]
    for share in (0.6, 0.8, 0.95):
        a = mixing.exponent_for_entropy(counts, share * np.log(3))
        assert abs(mixing.entropy(mixing.weights(counts, a)) - share * np.log(3)) < 1e-6
    a = mixing.exponent_for_repeats(counts, 1110, 4.0)
    assert max(w * 1110 / t for w, t in zip(mixing.weights(counts, a), counts) if t) == pytest.approx(4.0)


def test_mixing_realises_budgets(spark, docs, odd):
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 10 < 7, "big").when(F.col("doc_id") % 10 < 9, "mid").alias("source"), mixing.words(F.col("text")).alias("tokens"))
    mix = mixing.plan(rows, 100_000, max_repeats=2.0)
    given = [(r["row"], r["mix_pass"], r["mix_block"]) for r in mixing.realise(rows, mix).collect()]
    # by brute force: whole passes, and of the next one the rows by place while their running tokens are within what is left
    places = {(r["source"], r["doc_id"], k): r["p"] for k in range(4) for r in rows.select("*", mixing._place(F.lit(k), F.col("doc_id"), mix.seed).alias("p")).collect()}
    every, want = rows.collect(), collections.Counter()
    for s in mix.shares:
        own = [r for r in every if r["source"] == s.source]
        assert s.tokens == sum(r["tokens"] for r in own) and s.budget <= 2.0 * s.tokens + 1 and s.passes == s.budget // s.tokens
        for k in range(s.passes):
            want.update((r["doc_id"], k) for r in own)
        left = s.budget - s.passes * s.tokens
        for r in sorted(own, key=lambda r: places[s.source, r["doc_id"], s.passes]):
            left -= r["tokens"]
            if left < 0:
                break
            want[r["doc_id"], s.passes] += 1
    assert collections.Counter((r["doc_id"], k) for r, k, _ in given) == want
    # every block holds the sources about in their weights
    assert {b for *_, b in given} == set(range(mix.blocks))
    whole = mixing.plan(rows, whole=True, entropy_share=0.9)
    assert {r["row"]["doc_id"] for r in mixing.realise(rows, whole).collect()} == {r["doc_id"] for r in every}
    clash = odd.withColumn("source", F.lit(None).cast("string")).withColumn("mix_pass", F.lit(-7)).withColumn("row", F.lit("r"))
    few = mixing.plan(clash.withColumn("tokens", mixing.words(F.col("text"))), max_repeats=1.0)
    laid = mixing.laid_out(mixing.realise(clash, few))
    assert laid.columns == clash.columns and {(r["mix_pass"], r["row"]) for r in laid.collect()} == {(-7, "r")} and laid.count() <= len(ODD)
    empty = mixing.plan(clash.withColumn("tokens", F.lit(0)))
    assert mixing.realise(clash, empty).count() == len(ODD)
    assert mixing.plan(clash.where("false").withColumn("tokens", F.lit(1))).shares == []


def test_mixing_lays_blocks_out_in_order(spark, docs):
    rows = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("tokens"))
    mix = mixing.plan(rows, whole=True, entropy_share=0.95, block_tokens=20_000)
    mixed = mixing.realise(rows, mix)
    want = [(r["mix_block"], r["mix_place"], r["row"]["doc_id"]) for r in mixed.collect()]
    assert mix.blocks > 3 and [r["doc_id"] for r in mixing.laid_out(mixed, shuffle=True).collect()] == [i for *_, i in sorted(want)]
    place = collections.defaultdict(list)
    for b, p, i in sorted(want):
        place[i].append((b, p))
    for part in mixing.laid_out(mixed).rdd.map(lambda r: r["doc_id"]).glom().collect():  # each task's rows are in that order too
        own = [place[i].pop(0) for i in part]
        assert own == sorted(own)


def test_language_id(docs, odd, nothing):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    languages, bundles = language_id.train(docs.where(~held))
    found = language_id.identify(docs.where(held), languages, bundles).collect()
    truth = dict(docs.select("doc_id", "lang").collect())
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    got = language_id.identify(odd, languages, bundles).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.identify(nothing, languages, bundles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, [], np.zeros((0, language_id.DIMENSIONS))).collect()} == {"und"}


def test_language_vectors_are_bound_and_bundled():
    b = language_id.Bundler(256)
    v, letter = b.bundle(["abc ab", "", None, "字字"])
    counts = collections.Counter(("\0abc\0ab\0"[i : i + 3]) for i in range(6))
    want = sum(n * np.roll(sign(b, g[0]), 2) * np.roll(sign(b, g[1]), 1) * sign(b, g[2]) for g, n in counts.items())
    assert v[0].tolist() == want.tolist() and letter.tolist() == [True, False, False, True]


def sign(b, c):
    return b.vectors.table[b.vectors.row(ord(c)), 2].astype(int)


@pytest.mark.parametrize("text", ["The quick brown fox, jumped. " * 40, "abcdef", "a b", "... ab", "é!" * 30 + "字" * 7, "", "x"])
def test_language_blocks(monkeypatch, text):
    whole, _ = language_id.Bundler(256).bundle([text])
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language_id, "BLOCK", size)
        cut, _ = language_id.Bundler(256).bundle([text])
        assert cut[0].tolist() == whole[0].tolist()


def test_languages_by_brute_force():
    """Cosines of counted trigrams' vectors, added one by one, against those of the operator."""
    b = language_id.Bundler(512)

    def vector(text):
        letters = [c.lower() if c.isalpha() else "\0" for c in f"\0{text}\0"]
        letters = [c for i, c in enumerate(letters) if c != "\0" or i == 0 or letters[i - 1] != "\0"]
        return sum((np.roll(sign(b, letters[i]), 2) * np.roll(sign(b, letters[i + 1]), 1) * sign(b, letters[i + 2]) for i in range(len(letters) - 2)), np.zeros(512, int))

    learned = {"a": "the cat and the dog sat on the mat", "b": "el gato y el perro en la casa"}
    bundles = np.array([vector(t) for t in learned.values()], float)
    for text in ("the dog", "un perro y la gata!", "12 the 34", "zzz"):
        v = vector(text)
        cosine = bundles @ v / np.linalg.norm(bundles, axis=1) / np.linalg.norm(v)
        found, score = language_id._Labels(list(learned), bundles, 512, language_id.SEED).of(b, [text])
        assert found[0].as_py() == "ab"[int(cosine.argmax())] and score[0].as_py() == pytest.approx(max(0.0, cosine.max()), abs=1e-5)


def edits(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_banded_alignment():
    rng = random.Random(5)
    for _ in range(60):
        w = "".join(rng.choice("abcd") for _ in range(30))
        part = list(w)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["x"], [part[k], "y"]])
        text = "zzzzz" + "".join(part) + "zzzzz"
        want = edits(w, text)
        assert decontamination.distance(w, text, 8, 5) == want


def test_decontamination(spark, docs, small, odd, nothing):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r["item_id"]: decontamination.normalise(r["text"]) for r in benchmark.collect()}
    passage = items[3]
    noisy = passage[:30] + "q" + passage[31:60] + passage[61:]
    planted = [(1001, f"Some words before. {passage.upper()} and after"), (1002, f"Well well {noisy} so"), (1003, "nothing to see here " * 20), (1004, None), (1005, "")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id bigint, text string"))
    got = {r["doc_id"]: set(r["items"]) for r in decontamination.contamination(rows, benchmark).collect()}
    for i, text in rows.collect():
        held = {k for k, v in items.items() if v in decontamination.normalise(text)}
        assert held <= got[i]
    assert 3 in got[1001] and 3 in got[1002] and not got[1003] and not got[1004] and not got[1005]
    assert decontamination.contamination(odd, benchmark).count() == len(ODD)
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert {tuple(r["items"]) for r in decontamination.contamination(odd, benchmark.where("false")).collect()} == {()}


def test_toxicity(spark, small, docs, odd, nothing):
    plain = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(toxicity.labelled_sample(plain, labels.where(~held)))
    scored = {r["doc_id"]: r for r in toxicity.score(plain, model).collect()}
    truth = labels.where(held).collect()
    clean = [scored[r["doc_id"]]["predicted"] for r in truth if r["toxic"] == 0]
    toxic = [scored[r["doc_id"]]["score"] for r in truth if r["toxic"] == 1]
    assert np.mean(clean) < 0.02 and np.mean([x >= 0.5 for x in toxic]) >= 0.9
    assert np.mean([s > np.median([scored[r["doc_id"]]["score"] for r in truth if r["toxic"] == 0]) for s in toxic]) > 0.95
    # naming a group, and which one, moves a score next to nothing
    said = ["people", "women", "muslims", "gays", "immigrants"]
    got = toxicity.score(spark.createDataFrame([(i, f"We met some {w} today") for i, w in enumerate(said)], "doc_id bigint, text string"), model).collect()
    values = [r["score"] for r in got]
    assert max(values) - min(values) < 0.05 and max(values) < 0.5
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.score(nothing, model).count() == 0
    one = toxicity.train(toxicity.labelled_sample(plain, labels.where("toxic = 0")))
    assert {r["predicted"] for r in toxicity.score(odd, one).collect()} == {0}


def test_the_penalty_takes_a_group_out_of_the_score(spark):
    """A term that the labels hold against a text: with the penalty naming the group says little, without it says much."""
    rng = random.Random(9)
    plain = [f"we met {rng.choice(['some', 'many', 'few'])} friends by the {rng.choice(['lake', 'mill', 'road'])}" for _ in range(120)]
    rows = [(0, p) for p in plain[:60]] + [(1, f"{p}. those muslims are vile scum") for p in plain[60:]] + [(0, f"{p}. people are kind") for p in plain[:60]]
    sample = spark.createDataFrame(rows, "label int, text string")
    said = spark.createDataFrame([(0, "we met some people by the lake"), (1, "we met some muslims by the lake"), (2, "they are vile scum")], "doc_id bigint, text string")
    scores = lambda m: [r["score"] for r in sorted(toxicity.score(said, m).collect())]
    on, off = scores(toxicity.train(sample)), scores(toxicity.train(sample, swap_penalty=0.0))
    assert abs(on[1] - on[0]) < 0.1 < abs(off[1] - off[0]) and on[2] > 0.5
    few = toxicity._swaps(toxicity.train(sample), [("muslims", "those muslims are vile scum")], 300)
    assert few.n <= 300


def test_swaps_are_made_in_sentences():
    said = list(toxicity.mentions("Old Muslims sing. No one else; Women\nand men do!"))
    assert ("muslims", "old muslims sing") in said and ("old", "old muslims sing") in said and ("men", "and men do") in said and ("women", "no one else; women") in said
    assert toxicity.swapped("men and women, menfolk, men", "men", "people") == "people and women, menfolk, people"


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, at = 1, 0
        for s in sizes:
            if at + s > mid:
                n, at = n + 1, 0
            at += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_minimax_shards(spark, docs, odd, nothing):
    got = minimax_shards.shard(docs).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(got) == len(texts)
    place = collections.defaultdict(set)
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1
        place[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keyed = docs.select(F.shiftrightunsigned(F.xxhash64("text"), 4).alias("key"), (F.octet_length("text") + 1).alias("size")).groupBy("key").agg(F.sum("size").alias("size")).orderBy("key").collect()
    assert max(size.values()) <= least_capacity([r["size"] for r in keyed], 8)
    assert minimax_shards.shard(odd).count() == len(ODD)
    assert minimax_shards.shard(nothing).count() == 0


def test_minimax_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(minimax_shards, "FIRST", 3)
    monkeypatch.setattr(minimax_shards, "STEP", 2)
    rng = random.Random(2)
    rows = sorted((rng.randrange(1 << 60), rng.choice([1, 5, 40])) for _ in range(80))
    df = spark.createDataFrame(rows, "key bigint, size bigint")
    _, capacity = minimax_shards.minimax_cuts(df, 5)
    assert capacity == least_capacity([s for _, s in rows], 5)


def test_token_counts(spark, docs, odd, nothing):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.MODEL))
    counter = token_counts.WholeTokenCounter(public_tokenizers.path(queries.MODEL))
    assert counter.shortcut and len(counter.single) > 10_000
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abcé ß\n\t.,▁  'ñ12  字́👍<s></s>-_\x00") for _ in range(rng.randint(0, 40)))
        assert counter.count(text) == len(model.encode(text)), repr(text)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, queries.MODEL).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(model.encode(text)), len(text.encode()))
    assert token_counts.count_tokens(odd, queries.MODEL).count() == len(ODD)
    assert token_counts.count_tokens(nothing, queries.MODEL).count() == 0


def test_token_counts_with_a_full_memory(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "PIECE", 20)
    counter = token_counts.WholeTokenCounter(public_tokenizers.path(queries.MODEL))
    for text in ("thanonontioniner ofanndound thingstan onthreerin " * 5, "a.b,c " * 30):
        assert counter.count(text) == len(counter.model.encode(text))


def test_chat_format_round_trip(spark, small):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>x\n", "<<|", "", None, "plain\n<|", "é" * 2000, "<|im_end|>\n<|im_start|>assistant\nok"]
    roles = ["user", "assistant", None, "a\nb\\n", "<|im_end|>"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty), 1) for c in [*range(12), None] for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, piece bigint").repartition(5)
    for piece in (1, 40, 1 << 22):
        got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df, piece_bytes=piece)).collect()}
        for c in {r[0] for r in rows}:
            turns = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
            whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
            said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
            assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(said))
    laid = chat_format.format_chats(df, piece_bytes=40).repartition(7, F.rand(1))
    assert sorted(map(str, chat_format.read_back(laid).collect())) == sorted(map(str, chat_format.read_back(chat_format.format_chats(df), in_order=True).collect()))
    with pytest.raises(Exception, match="lacks a piece"):
        chat_format.read_back(laid.where("piece <> 0")).collect()
    text = chat_format.format_chats(df).select("formatted").collect()
    assert sum(r[0].count("<|im_start|>") for r in text) == len(rows)
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).count() == 0


def brute_components(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingles_of(t) for i, t in rows}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join(spark, docs, nothing, monkeypatch):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in docs.where(F.length("text") < 3000).collect()]
    base = 100_000
    for size, copies in ((6, 12), (14, 12), (60, 25), (200, 25)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randint(0, max(1, size // 40))):
                own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((base, " ".join(own)))
            base += 1
    rows += [(base, None), (base + 1, ""), (base + 2, "a b"), (base + 3, "A b"), (base + 4, "a c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_components(rows)
    monkeypatch.setattr(parity_join, "GROUP", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.link_components(df).collect()}
    assert got == want
    assert parity_join.link_components(nothing).count() == 0


def test_jaccard_join_odd_rows(odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.link_components(odd).collect()]
    assert len(got) == len(ODD)
    assert (6, 2, 5) in got and got.count((4, 1, 4)) == 2 and (1, 0, 1) in got


def test_sets_with_few_places_are_found(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words here and there again")], "doc_id bigint, text string")
    ids = {r["id"]: r["set_id"] for r in parity_join.sized(df).collect()}
    short = spark.createDataFrame([(ids[1],)], "set_id bigint")
    assert {(r["a"], r["b"]) for r in parity_join._short(df, short, "text").collect()} == {(ids[1], ids[2])}


def test_bound_on_differences():
    for a in range(1, 60):
        for b in range(a, 75):
            possible = [a + b - 2 * i for i in range(a + 1) if 100 * i >= 80 * (a + b - i)]
            assert int(parity_join.most_different(a, b)) == (max(possible) if possible else -1)


@pytest.mark.parametrize("limit", [url_cascade.MAX_FILTER_BYTES, 512])
def test_url_filter(spark, limit):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), *[(f"host{i}.org", f"/p{i % 5}", "block") for i in range(300)]]
    hosts = ["example.com", "www.Example.COM", "a.net", "net", "host7.org", "x.host8.org", "host9.org:80", "com", ""]
    urls = [None, "no scheme", "http://", *[f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/x?q#f", "/es/1", "/fr", "/p2/a", "?x", "#y")], *[f"https://host{i}.org/p{i % 7}/z" for i in range(400)]]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, None, "h")], "page_id bigint, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_cascade.judge_urls(pages, table, max_filter_bytes=limit).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = urls[r["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = __import__("re").match(r"[^/?#]*", rest)[0]
        path = __import__("re").match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2])
    assert url_cascade.judge_urls(pages.where("false"), table).count() == 0
    assert {r["verdict"] for r in url_cascade.judge_urls(pages, table.where("false")).collect()} == {"allow"}


