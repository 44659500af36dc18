"""Mixture-controlled packing of documents into sequences of one length, by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In every round a source is given a quantum, its share of a window's tokens; it sends as
many whole grains as its credit holds, and what is left, less than a grain, is its deficit, carried to the next round. The rounds' tokens follow one
another and are cut into windows, so that each window holds the sources in their proportions, to within a grain or so of each, and none but the last is
short. After r rounds a source has sent floor((r * quantum + phase) / GRAIN) grains: its deficit needs no simulation, so the round of any token
follows from its place in its queue. Places are carried from task to task as sums: of each source's tokens in each written part.

Documents are tokenised once, into a table of ids; pieces travel once, to their round.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import hold_batches, kept, shared_folder
from weftline.operators.ordered import numbered

WINDOW = 4096
#: Tokens that a source sends at a time: the least length of a piece, but for the ends of documents and windows.
GRAIN = 64
#: Characters that are split at once, so that memory does not grow with a text.
BLOCK = 1 << 20
#: Rows, one for each part and source, that are broadcast; beyond it they are joined.
BROADCAST_ROWS = 200_000
#: Strings between blanks whose ids a worker remembers.
REMEMBERED = 600_000
#: Marks that end a word, none of which can be part of a special token or a contraction; the first character beyond Latin letters that are letters in every version of Unicode.
MARKS = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])[.,;:!?&%$#*)\]}\"]+(?=[ \n])")
LATIN_ENDS = "\u0250"
TYPECODES = {"<u2": "H", "<u4": "I"}


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0250, but for one whose lower case is two."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < LATIN_ENDS and "İ" not in text


class ChunkedTokens(dict[str, bytes]):
    """Token ids by the library, as bytes, remembered for each string between blanks.

    The library's own pre-tokeniser drops white space and lets no token reach over it, and its normaliser (NFC, lower case) joins nothing across a
    blank; so the ids of a text are those of its strings between blanks and line breaks, one after another. ``_splits`` proves that from the tokenizer's
    specification; where it fails each text goes to the library whole. By the same specification a word of letters below U+0250, which are letters in every version of Unicode, is one pre-token, as are marks between it and a blank: the library's
    merges alone give its ids. All other strings go through the whole library.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(file)
        self.splits = self._splits()
        self.merges = self.model.model
        self.kind = "<u2" if max(self.model.get_vocab().values()) < 1 << 16 else "<u4"
        self[""] = b""
        # the byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for what follows from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in printable)}

    def _splits(self) -> bool:
        spec = json.loads(self.model.to_str())
        normal, before = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        replace = [n for n in normal.get("normalizers", []) if n["type"] == "Replace"]
        first, *then = before.get("pretokenizers") or [{}]
        dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        plain = kinds == ["NFC", "Replace", "Lowercase"] and all(r["pattern"].get("Regex") == r"\s+" and r["content"] == " " for r in replace)
        alone = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        by_bytes = [(t["type"], t.get("add_prefix_space"), t.get("use_regex")) for t in then] == [("ByteLevel", False, False)]
        return bool(dropped and plain and alone and by_bytes and spec["post_processor"] is None and spec["truncation"] is None)

    def _packed(self, ids: list[int]) -> bytes:
        return array(TYPECODES[self.kind], ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self._packed(self.model.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """The ids of a word of letters."""
        low = word.lower()
        return self._packed([t.id for t in self.merges.tokenize(low if low.isascii() else "".join([self.letters[b] for b in low.encode()]))])

    def __missing__(self, chunk: str) -> bytes:
        """The ids of a string that is not remembered; it is from now on, while there is room."""
        ids = self._word(chunk) if chunk.isalpha() and (chunk.isascii() or max(chunk) < LATIN_ENDS) and chunk.lower().isalpha() else self._library(chunk)
        if len(self) < REMEMBERED:
            self[chunk] = ids
        return ids

    def _block(self, text: str) -> bytes:
        # of Latin letters alone, lower case is taken letter by letter and NFC changes nothing; a special token's capitals would make it none
        if _is_latin(text) and "<|" not in text:
            text = text.lower()
        # marks between a letter and a blank are a pre-token of their own
        return b"".join(map(self.__getitem__, MARKS.sub(r" \g<0>", text).replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, without added special tokens; null and the empty text have none."""
        if not text:
            return b""
        if not self.splits:
            return self._library(text)
        if len(text) <= BLOCK:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            stop = len(text) if at + BLOCK >= len(text) else text.rfind(" ", at, at + BLOCK)
            if stop < 0:
                stop = text.find(" ", at + BLOCK)
            stop = len(text) if stop < 0 else stop
            out.append(self._block(text[at:stop]))
            at = stop + 1
        return b"".join(out)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode(text), self.kind).tolist()


@lru_cache(maxsize=2)
def _tokens(model: str) -> ChunkedTokens:
    if not os.path.isabs(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return ChunkedTokens(model)


def tokenised(docs: DataFrame, model: str, end_id: int, *, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A written table (doc_id, source, part, before, n, ids): each row's ids with end_id after them, and the tokens of its source before it in its part."""
    spark = docs.sparkSession
    hold_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, sums = _tokens(model), TaskContext.get().partitionId(), {}
        end = tokens._packed([end_id])
        for batch in batches:
            before, n, ids = [], [], []
            for name, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = tokens.encode(value.as_py()) + end
                before.append(sums.get(name, 0))
                n.append(len(own) // len(end))
                ids.append(own)
                sums[name] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, part bigint, before bigint, n bigint, ids binary"
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _rounds(first: np.ndarray, n: np.ndarray, quantum: np.ndarray, phase: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with n tokens from place ``first`` of their queue on: a row for each of their rounds, with the document's row, the round, and the token that begins it."""
    low = first // grain
    count = (first + n - 1) // grain - low + 1
    row = np.repeat(np.arange(len(first)), count)
    begin = np.cumsum(count) - count
    grains = np.arange(len(row)) - begin[row] + low[row]
    rounds = np.maximum(1, np.ceil(((grains + 1) * float(grain) - phase[row]) / quantum[row])).astype(np.int64)
    new = np.append(True, (rounds[1:] != rounds[:-1]) | (row[1:] != row[:-1])) if len(row) else np.empty(0, bool)
    return row[new], rounds[new], np.maximum(0, grains[new] * grain - first[row[new]])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its rows begin and end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large binary column of bytes that are cut at the offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))])


def _pieces(queued: DataFrame, grain: int, ids: bool) -> DataFrame:
    """(round, length), with ids also (doc_id, source, place, start, doc_tokens, ids), for each run of a document's tokens that one round sends."""
    kind = queued.schema["doc_id"].dataType.simpleString()
    columns = ["round", "length", *(["doc_id", "source", "place", "start", "doc_tokens", "ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n, quantum, phase = (batch.column(c).to_numpy() for c in range(4))
            row, rounds, start = _rounds(first, n, quantum, phase, grain)
            end = np.append(start[1:], 0)
            last = np.append(np.flatnonzero(row[1:] != row[:-1]), len(row) - 1)
            end[last] = n
            arrays = [pa.array(rounds), pa.array(end - start)]
            if ids:
                data, at = _flat(batch.column(6))
                # a document's tokens follow one another, so do its pieces: the same bytes are cut in more places
                begin = at[row] + start * ((at[1:] - at[:-1]) // n)[row]
                index = pa.array(row)
                arrays += [batch.column(4).take(index), batch.column(5).take(index), pa.array(first[row] + start), pa.array(start), pa.array(n[row]), _binary(data, np.append(begin, at[-1])).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = "round bigint, length bigint" + (f", doc_id {kind}, source string, place bigint, start bigint, doc_tokens bigint, ids binary" if ids else "")
    return queued.select("first", "n", "quantum", "phase", *(["doc_id", "source", "ids"] if ids else [])).mapInArrow(run, schema)


def _bounds(total: int, window: int) -> tuple[int, list[int]]:
    """Where the full windows end, and where the sequences end that the rest fills: powers of two, which need no padding."""
    full, rest = total // window * window, total % window
    ends, at = [], full
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return full, ends


def pack(docs: DataFrame, model: str, *, end_id: int, targets: dict[str | None, float] | None = None, window: int = WINDOW, grain: int = GRAIN, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Packs all tokens of all documents into sequences of ``window`` tokens.

    targets: a weight for each source, by its tokens if it has none here; the default weighs all by their tokens, so that all queues end together. When one
    ends the others go on in their proportions. Returns a row for each piece: (id_col, source, start, length, ids, doc_tokens, sequence_id, offset);
    ids are four little-endian bytes each. Every id of every row is in exactly one piece. Sequences are full, but for the last few, whose lengths are powers of
    two that add up to what is left. A null or empty text is end_id alone; a null source is a source of its own; repeated rows, and rows
    without an id, are documents of their own; an empty table gives an empty one. Other columns of docs are not read, whatever their names.
    """
    stored = tokenised(docs, model, end_id, id_col=id_col, text=text, source=source)
    sums = kept(stored.groupBy("source", "part").agg(F.sum("n").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    weight = F.sum("n").cast("double")
    for name, value in (targets or {}).items():
        if value <= 0:
            raise ValueError(f"a target weight must be above 0: {name}")
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value)) * total).otherwise(weight)
    sources = kept(sums.groupBy("source").agg(weight.alias("weight")))
    weights = sources.agg(F.sum("weight")).first()[0] or 1.0
    # of one source as many rows as there are parts
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = sources.select(F.col("source").alias("turn_source"), (F.col("weight") * (window / weights)).alias("quantum"), F.pmod(F.xxhash64("source"), F.lit(grain)).cast("bigint").alias("phase"))
    queues = sums.select(F.col("source").alias("queue_source"), F.col("part").alias("queue_part"), offset.alias("offset"))
    queues = kept(queues.join(turns, F.col("queue_source").eqNullSafe(F.col("turn_source"))))
    queues = F.broadcast(queues) if queues.count() <= BROADCAST_ROWS else queues
    queued = stored.join(queues, F.col("source").eqNullSafe(F.col("queue_source")) & (F.col("part") == F.col("queue_part"))).withColumn("first", F.col("offset") + F.col("before"))
    ends = numbered(_pieces(queued, grain, ids=False).groupBy("round").agg(F.sum("length").alias("sent")), ["round"], value="sent", name="end")
    ends = ends.select(F.col("round").alias("of_round"), (F.col("end") - F.col("sent")).alias("base"))
    pieces = _pieces(queued, grain, ids=True).join(ends, F.col("round") == F.col("of_round"))
    inside = Window.partitionBy("round").orderBy("source", "place").rowsBetween(Window.unboundedPreceding, -1)  # a round is about one window of tokens
    placed = pieces.withColumn("at", F.col("base") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return _cut(placed, total, window, id_col)


def _cut(placed: DataFrame, total: int, window: int, id_col: str) -> DataFrame:
    """Cuts pieces where sequences end."""
    full, rest = _bounds(total, window)
    n_full = full // window
    kind = placed.schema["doc_id"].dataType.simpleString()

    def number(at: np.ndarray) -> np.ndarray:
        return np.where(at < full, at // window, n_full + np.searchsorted(np.array(rest, np.int64), at, "right"))

    def end(sequence: np.ndarray) -> np.ndarray:
        own = np.append(np.array(rest, np.int64), np.int64(1) << 62)
        return np.where(sequence < n_full, (sequence + 1) * window, own[np.clip(sequence - n_full, 0, len(rest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start, length, at = (batch.column(c).to_numpy() for c in ("start", "length", "at"))
            first = number(at)
            count = number(at + length - 1) - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(at[row], np.where(sequence > 0, end(sequence - 1), 0))
            size = np.minimum(at[row] + length[row], end(sequence)) - begin
            data, bounds = _flat(batch.column("ids"))
            width = (bounds[1:] - bounds[:-1]) // length
            parts = [data[a:b].view(f"<u{w}").astype("<u4") for w, a, b in _runs(width, bounds)]
            words = np.concatenate(parts).view(np.uint8)
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("source").take(index), pa.array(start[row] + begin - at[row]), pa.array(size), _binary(words, np.append(0, np.cumsum(size) * 4)).cast(pa.binary()), batch.column("doc_tokens").take(index), pa.array(sequence), pa.array(begin - np.where(sequence > 0, end(sequence - 1), 0))],
                names=[id_col, "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = f"`{id_col}` {kind}, source string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.select("doc_id", "source", "start", "length", "ids", "doc_tokens", "at").mapInArrow(run, schema)


def _runs(width: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(width, first byte, last byte) of neighbouring rows whose ids are as wide."""
    new = np.append(np.flatnonzero(np.append(True, width[1:] != width[:-1])), len(width))
    for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
        yield int(width[a]), int(bounds[a]), int(bounds[b])


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of the pieces of ``pack``: the ids of each sequence, four little-endian bytes each."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a window of tokens
    ids = F.aggregate(own, F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in the place of these."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

