"""Chat formatting by columnar byte assembly.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every
``<`` + k backslashes + ``|`` gets one backslash more, so no control string is left in
them, and taking one backslash away gives the original back. A line break in a role, which
would end the header, is written as a backslash and ``n``, a backslash in a role as two.

The output bytes are put together per batch of rows: segment lengths give offsets by a
cumulative sum, and headers, contents and trailers are scattered into one preallocated
buffer. That buffer is the data of the Arrow column: the rows of a batch are its turns in order, so every
piece of a conversation is a stretch of it, and only the column's offsets are made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textblocks import utf8
from weftline.llm.shared import hold_batches

START, END = b"<|im_start|>", b"<|im_end|>\n"
LEARNED = "assistant"
#: Bytes of input laid out at once.
BLOCK = 1 << 20
#: Longest piece of formatted text in one output row; a longer conversation has more pieces.
PIECE = 1 << 22
#: Bytes of roles and texts that are formatted at once: four times as many are a string column's end.
SLICE = 1 << 29

_OPEN = re.compile(rb"<(\\*)\|")
_ESCAPED = re.compile(rb"<\\(\\*)\|")
_NAME = re.compile(rb"\\(.)", re.S)


def escape(data: bytes) -> bytes:
    """One backslash more after each ``<`` that backslashes and ``|`` follow."""
    return _OPEN.sub(rb"<\\\1|", data) if b"<" in data else data


def unescape(data: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", data) if b"<" in data else data


def escape_role(data: bytes) -> bytes:
    """As escape, after line breaks and backslashes were written as two characters."""
    return escape(data.replace(b"\\", b"\\\\").replace(b"\n", b"\\n"))


def unescape_role(data: bytes) -> bytes:
    return _NAME.sub(lambda m: b"\n" if m[1] == b"n" else m[1], unescape(data))


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copies segment i, data[begin[i] : begin[i] + length[i]], to out[at[i]]."""
    total = int(length.sum())
    if total:
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + step] = data[np.repeat(begin, length) + step]


def _escaped(data: np.ndarray, off: np.ndarray, how=escape, marks: bytes = b"<") -> tuple[np.ndarray, np.ndarray]:
    """The segments with their control strings escaped; only those that hold one of the marks are looked at."""
    asked = np.zeros(256, bool)
    asked[list(marks)] = True
    at = np.flatnonzero(asked[data[off[0] : off[-1]]]) + off[0] if len(data) else np.empty(0, np.int64)
    if not len(at):
        return data, off
    own = np.unique(np.searchsorted(off, at, "right") - 1).tolist()
    lengths, pieces, last = np.diff(off), [], int(off[0])
    for i in own:
        new = how(data[off[i] : off[i + 1]].tobytes())
        pieces += [data[last : off[i]], np.frombuffer(new, np.uint8)]
        lengths[i], last = len(new), int(off[i + 1])
    return np.concatenate([*pieces, data[last : off[-1]]]), np.concatenate([[0], np.cumsum(lengths)])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of some turns, where each turn starts (one more: the end), and where
    its text starts and ends. A null role or text is empty."""
    role, role_off = _escaped(*utf8(roles), escape_role, b"<\\\n")
    text, text_off = _escaped(*utf8(texts))
    n_role, n_text = np.diff(role_off), np.diff(text_off)
    head, tail = np.frombuffer(START, np.uint8), np.frombuffer(END, np.uint8)
    turn = np.concatenate([[0], np.cumsum(len(head) + n_role + 1 + n_text + len(tail))])
    out = np.empty(int(turn[-1]), np.uint8)
    at, n = turn[:-1], len(n_role)
    out[at[:, None] + np.arange(len(head))] = head
    scatter(out, at + len(head), role, role_off[:-1], n_role)
    begin = at + len(head) + n_role + 1
    out[begin - 1] = 0x0A
    done = 0
    while done < n:  # the index arrays take 8 bytes a byte, so they are made block by block
        stop = max(done + 1, int(np.searchsorted(text_off, text_off[done] + BLOCK, "right")) - 1)
        if stop == done + 1:  # one text, perhaps a long one: a plain copy
            out[begin[done] : begin[done] + n_text[done]] = text[text_off[done] : text_off[stop]]
        else:
            scatter(out, begin[done:stop], text, text_off[done:stop], n_text[done:stop])
        done = stop
    out[(begin + n_text)[:, None] + np.arange(len(tail))] = tail
    return out, turn, begin, begin + n_text


def _columns(out: np.ndarray, turn_at: np.ndarray, begin: np.ndarray, end: np.ndarray, learn: np.ndarray, firsts: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The buffer as a string column of pieces, which begin at these turns, and the spans of each piece that are learned."""
    starts = turn_at[firsts]
    offsets = np.append(starts, turn_at[-1])
    formatted = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    turns = np.flatnonzero(learn)
    own = np.searchsorted(firsts, turns, "right") - 1
    lists = pa.array(np.searchsorted(own, np.arange(len(firsts) + 1)).astype(np.int32))
    return formatted, pa.ListArray.from_arrays(lists, pa.array(begin[turns] - starts[own])), pa.ListArray.from_arrays(lists, pa.array(end[turns] - starts[own]))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their roles and texts come to more than ``most`` bytes; a turn stays whole. Escaping doubles them at worst."""
    for batch in batches:
        size = sum(np.diff(utf8(batch.column(i))[1]) for i in (1, 2))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, "right")))
            yield batch.slice(at, n)
            at += n


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED, piece_bytes: int = PIECE, slice_bytes: int = SLICE) -> DataFrame:
    """Formats every conversation, its rows by turn (nulls first, ties by role, then text).

    Returns (conv_id, piece, formatted, loss_starts, loss_ends): pieces are numbered from 0 in
    each conversation, whole turns stay together, and a piece ends once it has piece_bytes, or where a batch of rows does, of which
    at most slice_bytes (or one turn) are formatted at once, so a conversation of any length is streamed. formatted is UTF-8 in a string column; the loss
    mask is given as byte spans of it, one for each text whose role is ``learned``. A null
    role or text is empty; null conv_ids are one conversation; repeated rows are turns of their
    own; an empty table gives an empty one. Other columns are not read, whatever their names.
    """
    hold_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, piece = None, -1  # the conversation at hand, and the last of its pieces
        for batch in _slices(batches, slice_bytes):
            ids, roles = batch.column(0).to_pylist(), batch.column(1)
            out, turn_at, begin, end = assemble(roles, batch.column(2))
            learn = np.fromiter((r == learned for r in roles.to_pylist()), bool, len(ids))
            keys, numbers, firsts = [], [], []
            a = 0
            while a < len(ids):
                b = a + 1
                while b < len(ids) and ids[b] == ids[a]:
                    b += 1
                if piece < 0 or ids[a] != key:
                    key, piece = ids[a], -1
                while a < b:  # a piece takes turns until it has piece_bytes
                    piece += 1
                    keys.append(key)
                    numbers.append(piece)
                    firsts.append(a)
                    a = min(b, max(a + 1, int(np.searchsorted(turn_at, turn_at[a] + piece_bytes, "left"))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int64()), *_columns(out, turn_at, begin, end, learn, np.array(firsts))], names=[conv_id, "piece", "formatted", "loss_starts", "loss_ends"])

    one = turns.select(conv_id, role, text, turn)
    kind = one.schema[0].dataType.simpleString()
    return one.repartition(F.col(conv_id)).sortWithinPartitions(conv_id, turn, role, text).select(conv_id, role, text).mapInArrow(run, f"`{conv_id}` {kind}, piece bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.S)


def read_back(formatted: DataFrame, *, conv_id: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Digests of each conversation, read from what format_chats returned, be it written and shuffled since.

    Returns (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    Pieces are streamed in order; the state of a conversation is two hash states. in_order: the rows still lie as
    format_chats gave them, so they need not be dealt and sorted again. A piece that is missing or comes twice is an error.
    """
    hold_batches(formatted.sparkSession)
    if not in_order:
        formatted = formatted.repartition(F.col(conv_id)).sortWithinPartitions(conv_id, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def out(rows: list[list]) -> pa.RecordBatch:
            cols = [[r[i] for r in rows] for i in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array([h.hexdigest() for h in cols[2]]), pa.array(cols[3], pa.int64()), pa.array([h.hexdigest() for h in cols[4]]), pa.array(cols[5], pa.int64())], names=[conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for key, data, starts, ends, piece in zip(*batch.columns, strict=True):
                key, data = key.as_py(), data.as_py().encode()
                if state is None or state[0] != key:
                    if state is not None:
                        done.append(state)
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if piece.as_py() != state[6]:
                    raise ValueError("a formatted conversation lacks a piece, or has one twice")
                state[6] += 1
                state[5] += len(data.decode())
                at = 0
                for m in _TURN.finditer(data):
                    if m.start() != at:
                        raise ValueError("a formatted conversation holds bytes outside its turns")
                    at = m.end()
                    state[1] += 1
                    state[2].update(unescape_role(m[1]) + b"\n" + unescape(m[2]) + b"\n")
                if at != len(data):
                    raise ValueError("a formatted conversation ends inside a turn")
                for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                    said = unescape(data[a:b])
                    state[3] += len(said.decode())
                    state[4].update(said)
            if done:
                yield out(done)
        if state is not None:
            yield out([state])

    kind_name = formatted.schema[conv_id].dataType.simpleString()
    return formatted.select(conv_id, "formatted", "loss_starts", "loss_ends", "piece").mapInArrow(run, f"`{conv_id}` {kind_name}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
