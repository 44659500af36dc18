"""Token counts with a whole-token shortcut.

The vocabulary is inspected once, offline. A letter run that follows the word mark is a
*word*; if no piece of the vocabulary joins a letter to a following non-letter, and none
has a word mark after another character, then merges never cross a word's ends, and the
tokens of a text are those of its words and of the strings between them, each on its own.
Words proven to be one token are counted by set membership; only the rest is merged.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.shared import hold_batches

MARK = "▁"
TOKEN_LIMIT = 4096
#: Code points given to the library at once, so that its memory does not grow with a text.
PIECE = 1 << 18
#: Words, and strings between them, whose counts a worker remembers.
REMEMBERED = 400_000


class WholeTokenCounter:
    """Counts the tokens that a sentencepiece BPE model gives a text, special tokens aside.

    Where the proof fails for a model (see ``shortcut``), each text goes to the library.
    """

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        letters = {c for p in pieces for c in p if c.isalpha()}
        # a letter that some piece joins to a non-letter on its right does not end a word
        loose = {p[0] for p in pairs if p[0] in letters and p[1] not in letters}
        self.letters = letters - loose
        joined = {p[0] for p in pairs if p[0] in self.letters and p[1] not in self.letters}
        while joined:
            self.letters -= joined
            joined = {p[0] for p in pairs if p[0] in self.letters and p[1] not in self.letters}
        mark_inside = any(p[1] == MARK and p[0] != MARK for p in pairs)
        break_alone = not any("\n" in p for p in pieces) and len(self._plain("\n")) == 2 and len(self._plain("a\n")) == 2
        self.shortcut = bool(self.letters) and not mark_inside and break_alone and self._identity(model_file)
        self.word = re.compile(f"{MARK}+[{''.join(map(re.escape, sorted(self.letters)))}]+") if self.shortcut else None
        # the proof for each string: the library gives it as one token when it stands alone
        self.single = frozenset(p for p in pieces if self.word and self.word.fullmatch(p) and len(self._plain(p[1:])) == 1)
        self.between: dict[str, int] = {"": 0}
        self.words: dict[str, int] = {}

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    @staticmethod
    def _identity(model_file: str) -> bool:
        """Whether the model's normaliser, by its own specification, changes nothing but spaces into word marks and puts one in front."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        n, suffix = spec.normalizer_spec, spec.trainer_spec.treat_whitespace_as_suffix
        return not n.precompiled_charsmap and not n.normalization_rule_tsv and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not suffix

    def _new(self, words: list[str]) -> int:
        """Tokens of words that are not remembered; those met while there is room then are."""
        n, at = 0, 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and size < PIECE:
                size += len(words[stop])
                stop += 1
            some, at = words[at:stop], stop
            if len(self.words) < REMEMBERED:
                counts = [len(x) for x in self.model.encode([w[1:] for w in some], num_threads=1)]
                self.words.update(x for x in zip(some, counts, strict=True) if len(x[0]) < 64)
                n += sum(counts)
            else:
                n += len(self._plain("".join(some)[1:]))
        return n

    def _chunk(self, text: str) -> int:
        """Tokens of a string between words; the break before it keeps the first mark away."""
        n = self.between.get(text)
        if n is None:
            n = len(self._plain("\n" + text)) - 2
            if len(self.between) < REMEMBERED and len(text) < 64:
                self.between[text] = n
        return n

    def count(self, text: str | None) -> int:
        """Tokens of one text; null and the empty text have none."""
        if not text:
            return 0
        if not self.shortcut:
            return len(self._plain(text))
        marked = MARK + text.replace(" ", MARK)
        n, single = 0, self.single
        words = self.word.findall(marked)
        rest = [w for w in words if w not in single]
        n = len(words) - len(rest)
        seen = self.words
        known = [seen.get(w) for w in rest]
        if None in known:
            n += sum(k for k in known if k)
            n += self._new([w for w, k in zip(rest, known, strict=True) if k is None])
        else:
            n += sum(known)
        between = self.word.sub("\n", marked).split("\n")
        # a break in the text is a token of its own; one put in a word's place is none
        n += len(between) - 1 - len(words)
        chunk, strings = self._chunk, self.between
        return n + sum([strings[c] if c in strings else chunk(c) for c in between if c])


@lru_cache(maxsize=4)
def _counter(model_file: str) -> WholeTokenCounter:
    return WholeTokenCounter(model_file)


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", id_col: str = "doc_id", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Token counts of every whole text.

    model: a path, or the name of a file that ``public_tokenizers.path`` finds on each executor.
    Returns (id_col, n_bytes, n_tokens, over_limit), one row for each row of docs. A null or
    empty text has 0 bytes and 0 tokens; repeated rows give repeated results; an empty table
    gives an empty one. Other columns of docs are not read, whatever their names.
    """
    hold_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model
        if not os.path.isabs(model):
            import public_tokenizers

            path = public_tokenizers.path(model)
        counter = _counter(path)
        for batch in batches:
            texts, n_bytes, n_tokens = batch.column(1), [], []
            for value in texts:
                t = value.as_py()
                n_bytes.append(len(t.encode()) if t else 0)
                n_tokens.append(counter.count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
