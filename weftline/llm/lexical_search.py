"""Ranked lexical search: an index of compressed postings by shard, and document-at-a-time merging of a query's posting lists.

A shard holds a bounded run of a task's documents, numbered by ascending id. For each of its terms it has one posting list: the documents' numbers as gaps and the term's
occurrences, both as bytes of seven bits, ascending. A search merges the lists of an item's terms by a heap, adds up one document at a time, and keeps the
best in a bounded heap keyed by score, then id; the shards' results are merged by rank.

Lists are searched in the order of the most that they can add: once a shard has as many results as asked for, a list that could not lift a
document over the worst of them, alone with those below it, no longer begins a document: it is only looked up for documents that others have. No result is lost by it.

All arithmetic of scores is on 64-bit integers, so every shard and every order of work gives the same.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.shared import hold_batches, shared_folder

TOP = 20
#: Characters of texts in a shard, unless one text is longer.
SHARD_CHARS = 16 << 20
#: Shards that a task searches, about.
SHARDS_PER_TASK = 4
#: Characters of queries that are searched in one pass: what a task holds of them is bounded.
PASS_CHARS = 1 << 20
#: Bytes of a text that are split at once.
BLOCK = 1 << 20

#: Bytes that end a term become blanks, A-Z become a-z; bytes from 0x80 on are parts of letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def _blocks(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data, at = (text or "").encode().translate(_FOLD), 0
    while at < len(data):
        stop = data.find(b" ", at + BLOCK)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, the lowest first, the high bit on all but the last; and how many bytes each takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begin = ends - size
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        more = (size[own] > k + 1).astype(np.uint8) << 7
        out[begin[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    begin = np.append(0, last[:-1] + 1) if len(last) else last
    k = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * k), begin) if len(raw) else np.empty(0, np.int64)


def _shard(ids: list, texts: list[str | None]) -> tuple[list, np.ndarray, list[bytes], np.ndarray, list[bytes]]:
    """Of documents in the order of their ids: ids and lengths of those with terms; and of each term the number of documents and the posting list."""
    names: dict[bytes, int] = {}
    number = names.setdefault
    own_ids, length, keys = [], [], []
    for i, text in zip(ids, texts, strict=True):
        n, each, count = 0, np.empty(0, np.int64), np.empty(0, np.int64)
        for found in _blocks(text):
            n += len(found)
            here, times = np.unique(np.fromiter([number(t, len(names)) for t in found], np.int64, len(found)), return_counts=True)
            if len(each):
                here, where = np.unique(np.append(each, here), return_inverse=True)
                times = np.bincount(where, np.append(count, times)).astype(np.int64)
            each, count = here, times
        if not n:
            continue
        keys.append((each, np.full(len(each), len(own_ids), np.int64), count))
        own_ids.append(i)
        length.append(n)
    if not keys:
        return [], np.empty(0, np.int64), [], np.empty(0, np.int64), []
    term, doc, count = (np.concatenate([k[i] for k in keys]) for i in range(3))
    order = np.argsort(term, kind="stable")  # documents stay in order
    term, doc, count = term[order], doc[order], count[order]
    df = np.bincount(term, minlength=len(names))
    first = np.cumsum(df) - df
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    pairs = np.empty(2 * len(gap), np.int64)
    pairs[::2], pairs[1::2] = gap, count
    data, size = pack_numbers(pairs)
    ends = np.cumsum(size)[1::2][first + df - 1]
    raw, begin = data.tobytes(), np.append(0, ends[:-1])
    return own_ids, np.array(length), list(names), df, [raw[a:b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A written index of all rows of docs: (shard, term, df, postings) for each term, and for each shard a row without a term that has its (ids, lengths).

    A shard is a run of one task's rows in the order of their ids, null last. Null and blank texts have no term and stay out; repeated rows are documents
    of their own; an empty table gives an empty index. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    hold_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard bigint, term binary, df bigint, postings binary, ids array<{kind}>, lengths array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        shard = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
            own, length, names, df, lists = _shard([ids[k] for k in order], [texts[k] for k in order])
            if not own:
                return
            nonlocal shard
            shard += 1
            kinds = (pa.list_(id_type), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(own)], pa.int64()), pa.nulls(1, pa.binary()), pa.array([own], kinds[0]), pa.array([length.tolist()], kinds[1])], names=columns)
            for a in range(0, len(names), 50_000):
                n = len(names[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(names[a : a + n], pa.binary()), pa.array(df[a : a + n]), pa.array(lists[a : a + n], pa.binary()), pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1])], names=columns)

        columns = ["shard", "term", "df", "postings", "ids", "lengths"]
        for batch in batches:
            id_type = batch.column(0).type
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = value.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= shard_chars:
                    yield from flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush()

    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    docs.select(id_col, text).mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(w: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the scores of documents."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def search_shard(lists: dict[int, tuple[int, list[int], list[int]]], wanted: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    """The best (score, document) of one shard for an item: best score first, then by ascending document.

    lists: of each term the most that it adds, its ascending documents, and what it adds to each. wanted: the item's terms and how often each comes.
    """
    own = sorted(((lists[term][0] * times, term, times) for term, times in wanted if term in lists), key=lambda x: x[:2])
    reach = list(accumulate(most for most, _, _ in own))  # the most that the first lists add together
    best: list[tuple[int, int]] = []  # a heap of (score, -document): the worst comes first
    looked = at = 0  # lists that begin no document any more; documents before this one are done
    while looked < len(own):
        streams = [(*lists[term][1:], times) for _, term, times in own[looked:]]
        others = [(most, *lists[term][1:], times) for most, term, times in reversed(own[:looked])]
        beyond = reach[looked - 1] if looked else 0
        heap = [(docs[i], k, i) for k, (docs, _, _) in enumerate(streams) if (i := bisect_left(docs, at)) < len(docs)]
        heapq.heapify(heap)
        worst = best[0][0] if len(best) == top else 0
        while heap:
            doc, score = heap[0][0], 0
            while heap and heap[0][0] == doc:
                _, k, i = heap[0]
                docs, adds, times = streams[k]
                score += adds[i] * times
                i += 1
                if i < len(docs):
                    heapq.heapreplace(heap, (docs[i], k, i))
                else:
                    heapq.heappop(heap)
            rest = beyond
            for most, docs, adds, times in others:
                if score + rest <= worst:
                    break
                rest -= most
                i = bisect_left(docs, doc)
                if i < len(docs) and docs[i] == doc:
                    score += adds[i] * times
            if score <= worst:  # of equal scores the document that came first stays: its id is smaller
                continue
            if len(best) < top:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == top:
                worst = best[0][0]
                if reach[looked] <= worst:
                    break
        if not heap and (len(best) < top or reach[looked] > worst):
            break
        at = doc + 1
        while looked < len(own) and reach[looked] <= worst:
            looked += 1
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def _passes(items: Iterable[Row], chars: int) -> Iterator[list[tuple]]:
    """Items (number, id, terms and times) in runs of so many characters."""
    out, size = [], 0
    for number, (item, text) in enumerate(items):
        if out and size + len(text or "") > chars:
            yield out
            out, size = [], 0
        out.append((number, item, Counter(terms(text))))
        size += len(text or "")
    if out:
        yield out


def search(index: DataFrame, items: DataFrame, *, top: int = TOP, item_col: str = "item_id", text: str = "text", id_col: str = "doc_id", pass_chars: int = PASS_CHARS, shards_per_task: int = SHARDS_PER_TASK) -> DataFrame:
    """The ``top`` documents of the index for each row of items: (item_col, rank, id_col, score).

    Items go through the driver, and to tasks, in passes of at most pass_chars characters, or one item. Of equal scores the smaller id ranks
    higher (null last). An item without a term that any document has, or with a null text, gives no row; repeated items are ranked each by itself; an empty index,
    or no items, gives no rows.
    """
    spark = index.sparkSession
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    whole = index.where(F.col("term").isNull()).agg(F.sum("df").alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("terms"), F.count("*").alias("shards")).first()
    n_docs, n_terms = whole["docs"] or 0, whole["terms"] or 0
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"item bigint, item_id {item_kind}, own_id {id_kind}, score bigint"
    found: list[DataFrame] = []
    for some in _passes(items.select(item_col, text).toLocalIterator(), pass_chars):
        numbers = {t: k for k, t in enumerate(sorted({t for *_, own in some for t in own}))}
        # one row for each term of a pass: at most half as many as it has characters
        wanted = F.broadcast(spark.createDataFrame([(k, t) for t, k in numbers.items()], "number bigint, wanted binary"))
        lists = index.where(F.col("term").isNotNull()).join(wanted, F.col("term") == F.col("wanted")).select("shard", "number", "df", "postings")
        df = {r["number"]: r["df"] for r in lists.groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator()}
        asked = [(number, item, [(numbers[t], times) for t, times in own.items() if numbers[t] in df]) for number, item, own in some]
        own = index.where(F.col("term").isNull()).select("shard", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("binary").alias("postings"), "ids", "lengths")
        parts = lists.select("shard", "number", "postings").unionByName(own, allowMissingColumns=True)
        # a shard's lists are few bytes and much work, so tasks are told by the number of shards
        parts = parts.repartition(max(1, -(-whole["shards"] // shards_per_task)), "shard")
        found.append(parts.groupBy("shard").applyInArrow(_searcher(asked, {k: weight(n_docs, n) for k, n in df.items()}, n_docs, n_terms, top, item_type), schema))
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {id_kind}, score bigint")
    # each task keeps the best of its shards before they are dealt by item
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("own_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("own_id").alias(id_col), "score")


def _searcher(asked: list[tuple], weights: dict[int, int], n_docs: int, n_terms: int, top: int, item_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Searches one shard for all items of a pass."""

    def run(shard: pa.Table) -> pa.Table:
        at = shard.column("number").to_pylist()
        row = at.index(None)
        lengths, ids = shard.column("lengths")[row].as_py(), shard.column("ids")[row].values
        m = np.array([100 - 25 + (25 * n * n_docs) // n_terms for n in lengths], np.int64)
        lists: dict[int, tuple[int, list[int], list[int]]] = {}
        for number, data in zip(at, shard.column("postings"), strict=True):
            if number is not None:
                pairs = unpack_numbers(data.as_py())
                docs = np.cumsum(pairs[::2])
                adds = contributions(weights[number], pairs[1::2], m[docs])
                lists[number] = (int(adds.max()), docs.tolist(), adds.tolist())
        out = [(number, item, doc, score) for number, item, own in asked for score, doc in search_shard(lists, own, top)]
        number, item, doc, score = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"item": pa.array(number, pa.int64()), "item_id": pa.array(item, item_type), "own_id": ids.take(pa.array(doc, pa.int64())), "score": pa.array(score, pa.int64())})

    return run
