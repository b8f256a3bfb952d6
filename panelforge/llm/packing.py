"""Operator 4: sum-of-squares online packing of token documents into windows.

Each input split runs its own packer over its rows in order. Documents are
tokenised, whole windows are cut off those longer than a window, and the rest
goes to the fill level h (0 opens a window) that makes the sum of squares of
N(level), the number of open windows at each level, smallest. N is one small
array: a level is a thirty-second of the window wide, and a document may overshoot a window's end by
less than a level, or follow into one that lacks less than that; it is cut there and its rest placed
anew, so full windows have no padding. The rule keeps some windows a level
open, whatever the input. When a split ends, these (the only ones not closed by
placement: a handful) are laid end to end and cut at window ends, and the
last at powers of two, which need no padding.

Defined results: a null text counts as empty and gives the end id alone; a row
that stands twice is packed twice; null ids stay; extra columns are ignored;
an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, END_ID, LEVELS, MEMO_WORDS, STRETCH_BYTES = 2048, 1, 32, 400_000, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words of these characters are cut into the vocabulary's pieces here; all others go through the tokenizer whole.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017f]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+")


#: The rules of a vocabulary under which the ids of a text are those of its words in turn; others take texts whole.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Memo(dict):
    """Bytes of the ids of text parts, as ``make`` gives them; the latest ``MEMO_WORDS`` parts are known at least, twice as many at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, part):
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        known = self.old.get(part)
        out = self[part] = self.make(part) if known is None else known
        return out


class WordTokens:
    """Ids of a text from those of its white-space words in turn.

    The vocabulary lower-cases, drops white space and splits words into runs of
    letters, digits and other characters before it merges anything, so equal
    parts have equal ids wherever they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.by_words = {k: made[k] for k in RULES} == RULES and all(t["content"].startswith("<|") for t in made["added_tokens"])
        self.merge, self.as_bytes = self.tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts, self.words = Memo(self._part), Memo(self._word)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = self.as_bytes.pre_tokenize_str(part)[0][0]
        ids = [x.id for x in self.merge(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) and "<|" not in text:
            parts = _PIECES.findall(text.lower())
            return self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[x] for x in parts])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        for memo in (self.parts, self.words):
            memo.clear()
            memo.old = {}

    def of(self, text: bytes) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        out, a = [], 0
        while len(text) - a > STRETCH_BYTES:  # long texts by stretches of whole words
            b = text.find(b" ", a + STRETCH_BYTES)
            if b < 0:
                break
            out.append(b"".join(map(self.words.__getitem__, text[a:b].split())))
            a = b
        return b"".join([*out, *map(self.words.__getitem__, text[a:].split())])


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker: the vocabulary is read once."""
    return WordTokens(path)


class SumOfSquares:
    """Open windows by level: level h > 0 has those of more than (h - 1) grain tokens and of h grain at most.

    Pieces of a window: (doc_id, start, length, doc_tokens, ids or None).
    """

    def __init__(self, window: int, new_id, grain: int | None = None):
        self.window, self.new_id, self.grain = window, new_id, (grain := grain or max(1, window // LEVELS))
        levels = -(-window // grain) + 1
        self.count = np.zeros(levels, np.int64)
        #: tokens in the window of each level that is next to be filled; 0 stands for a new one, ``window`` for none
        self.fill = np.full(levels, window, np.int64)
        self.fill[0] = 0
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(levels)]

    def place(self, piece: tuple) -> Iterator[tuple]:
        """Put a piece shorter than the window; yields (window id, pieces) when one is full."""
        while piece[2]:
            size, full = piece[2], self.fill + piece[2]
            to = -(-full // self.grain)
            closes = full >= self.window
            to[closes] = 0
            # Moving a window from h to h' changes the sum of squares by 2 (N(h') - N(h)) + 2; a new one or a full one has one term only.
            gain = np.where(closes, 0, 2 * self.count[to] + 1) - np.where(np.arange(len(to)) > 0, 2 * self.count - 1, 0)
            gain[~closes & (to == np.arange(len(to)))] = 0
            # A full window cuts less than a grain off the piece; only one that lacks less than a grain takes the head of any.
            usable = (self.fill < self.window) & (full < self.window + self.grain)
            usable[-1] = self.count[-1] > 0
            level = len(gain) - 1 - int(np.where(usable, gain, np.iinfo(np.int64).max)[::-1].argmin())  # ties: the fuller window
            fill, pieces = self._take(level)
            head, piece = cut(piece, self.window - fill)
            pieces.append(head)
            if fill + head[2] == self.window:
                yield self.new_id(), pieces
            else:
                self._put(fill + head[2], pieces)

    def _take(self, level: int) -> tuple[int, list]:
        if not level:
            return 0, []
        out = self.open[level].pop()
        self.count[level] -= 1
        self.fill[level] = self.open[level][-1][0] if self.open[level] else self.window
        return out

    def _put(self, fill: int, pieces: list) -> None:
        level = -(-fill // self.grain)
        self.open[level].append((fill, pieces))
        self.count[level] += 1
        self.fill[level] = fill

    def close(self) -> Iterator[tuple]:
        """Merge what is open: lay all pieces end to end, cut at window ends; the rest at powers of two."""
        pieces = [p for level in reversed(self.open) for _, window in level for p in window]
        left, room, out = sum(p[2] for p in pieces), 0, []
        for p in pieces:
            while p[2]:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    left -= room
                    out = []
                head, p = cut(p, room)
                out.append(head)
                room -= head[2]
                if not room:
                    yield self.new_id(), out
        self.__init__(self.window, self.new_id, self.grain)


def cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, length, total, ids = piece
    at = min(at, length)
    return (doc, start, at, total, ids[: 4 * at]), (doc, start + at, length - at, total, ids[4 * at :])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows; sequence_id is unique over the splits (split number, then a counter)."""
    name = tokenizer_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, end = word_tokens(name), np.array([end_id], "<u4").tobytes()
        made, rows = TaskContext.get().partitionId() << 33, []

        def new_id() -> int:
            nonlocal made
            made += 1
            return made - 1

        def put(sequence: int, pieces: list) -> None:
            offset = 0
            for doc, start, length, total, ids in pieces:
                rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset))
                offset += length

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                rows.clear()

        packer = SumOfSquares(window, new_id)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = (tokens.of(text.as_buffer().to_pybytes()) if text.is_valid else b"") + end
                total = len(ids) // 4
                rest = (doc, 0, total, total, ids)
                while rest[2] >= window:
                    whole, rest = cut(rest, window)
                    put(new_id(), [whole])
                if rest[2]:
                    for full in packer.place(rest):
                        put(*full)
                if len(rows) >= 20_000:
                    yield from flush()
        for full in packer.close():
            put(*full)
        tokens.forget()  # the worker may go on to other work
        yield from flush()

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)
