"""A corpus pipeline of five stages, each by one training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, language_id, minimax_shards, mixing, parity_join, token_counts
from weftline.llm.queries import MODEL
from weftline.llm.shared import kept, shared_folder

#: The least cosine with a language of a text of n letters is LEAST_COSINE * n / (n + HALF_AT): few trigrams may all be rare ones of their language. Cosines of
#: texts that share nothing with any prototype are noise of 1 / sqrt(2048) = 0.022 at any length, and the best of four languages is below 0.062 in 99 of 100.
LEAST_COSINE, HALF_AT = 0.12, 24
ENTROPY_SHARE, MAX_REPEATS = 0.95, 4.0
SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no learned language: null, without a letter, or like no prototype. A null lang becomes what was found.

    Prototypes are learned from the stage's own input; where no row has a text and a lang, none is, and nothing is rejected. A text whose lang column says otherwise is kept as
    it is. Repeated rows are judged alike; extra columns may have any names; an empty table gives an empty one.
    """
    languages, bundles = language_id.train(docs)
    if not languages:
        return docs
    found = language_id.labelled_rows(docs, languages, bundles)
    letters = F.regexp_count("row.text", F.lit(r"\p{L}"))
    like = (F.col("score") >= LEAST_COSINE) | (F.col("score") >= letters * LEAST_COSINE / (letters + HALF_AT))
    some = found.where((F.col("lang_pred") != language_id.UNKNOWN) & like)
    return some.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: that with the smallest id, of several texts with that id the one of the smallest hash.

    A row goes by its id and its text, so rows with one id and different texts are documents of their own, and a row that comes twice is
    kept once. Rows without an id come after all others. Texts without a word are copies of nothing: each is kept. Extra columns may have any names; an
    empty table gives an empty one.
    """
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("own"))
    found = parity_join.link_components(docs.select(own.alias("own"), "text"), id_col="own")
    first = found.where(F.col("own") == F.col("component_id")).select("own", "n_shingles").distinct()
    left = packed.join(first, "own")
    # a row that comes twice is one group; each blank row is a group of its own
    alone = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return left.withColumn("alone", alone).dropDuplicates(["own", "alone"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a part of a benchmark item.

    Null and empty texts hold none; repeated rows are judged alike; extra columns may have any names; an empty table, or an empty benchmark, leaves all.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contaminated_rows(docs, benchmark).where(F.size("items") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every source at least once as a whole, and rarer sources again, up to their weights by tokens and MAX_REPEATS times at most, in permuted blocks.

    The columns are those of docs; the permutation is the order of the rows: what is written holds block after block, each with the sources in their
    weights. A null source is a source of its own; null and empty texts have no tokens and go with their source; rows with one id go
    together; an empty table gives an empty one.
    """
    counted = token_counts.count_tokens(docs.select(F.struct("doc_id", "source").alias("row"), "text"), MODEL, id_col="row")
    rows = kept(counted.select("row.doc_id", "row.source", F.col("n_tokens").alias("tokens")))
    mix = mixing.plan(rows, whole=True, entropy_share=ENTROPY_SHARE, max_repeats=MAX_REPEATS)
    return mixing.laid_out(mixing.realise(docs, mix))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes, equal texts together; nulls, repeats and empty tables as the operator has them.

    A shard's slots are a random order, so any run of them holds the sources as the shard does, and the repeats of a document are apart.
    """
    return minimax_shards.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
