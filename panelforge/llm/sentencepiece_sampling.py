"""Operator 1: SentencePiece encoding by sampling from the piece lattice, and decoding.

A text becomes one dummy space plus itself, spaces written as U+2581; words
are cut before each space and around each line feed, which no piece crosses.
Over each word's lattice of vocabulary pieces (weights fall with a piece's
merge rank) the forward pass sums all segmentations, and the backward pass
draws one piece after the other from the end. The uniform numbers are a hash
of (seed, row key, word number, step), so a row's segmentation is the same
whenever and wherever it runs. All words of a chunk go through numpy at once:
the forward pass over its distinct words, the backward pass over all.

Characters outside the vocabulary, and a literal U+2581, become byte pieces,
so decoding gives back exactly the text.

Defined results: a null text has null ids and decodes to null; an empty text
has no ids and decodes to "". A row that stands twice gets the same ids twice.
Null keys count as key 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.textnum import chunks, mix

SPACE = "▁"
LONGEST = 16
CHUNK_BYTES = 2 << 20
TABLE_FLOATS = 4 << 20
WORD = re.compile(r"\n| [^ \n]*|[^ \n]+")
_BASE = 0x9E3779B97F4A7C15
_SPREAD = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


class Lattice:
    """Vocabulary tables: hashes of pieces to ids and log weights."""

    def __init__(self, model_path: str, temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces, weights, ids, self.byte_ids = [], [], [], np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.bytes_of[i] = p.replace(SPACE, " ").encode()
                if SPACE not in p[1:]:
                    pieces.append(p)
                    ids.append(i)
                    weights.append(-np.log(100.0 - sp.get_score(i)) / temperature)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = hashes
        for k, h in enumerate(hashes.tolist()):
            s = (h * _SPREAD & _MASK) >> (64 - self.bits)
            while self.slots[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slots[s] = k
        self.probes = self._probes()
        self.ids, self.weights = np.array(ids, np.int32), np.array(weights, np.float32)
        self.other = float(self.weights.min()) - 10.0

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & _MASK
        return h

    def _probes(self) -> int:
        full, longest, run = np.append(self.slots >= 0, self.slots[:64] >= 0), 0, 0
        for x in full.tolist():
            run = run + 1 if x else 0
            longest = max(longest, run)
        return longest + 1

    def find(self, raw: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, or -1."""
        h = raw
        at = ((h * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        hit = self.keys[got] == h
        todo = np.flatnonzero((got >= 0) & ~hit)
        out = np.where(hit & (got >= 0), got, np.int32(-1))
        for step in range(1, self.probes):
            if not len(todo):
                break
            got = self.slots[(at[todo] + step) & ((1 << self.bits) - 1)]
            hit = (got >= 0) & (self.keys[got] == h[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
        return out

    def forward(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars: code points (words, places), 0 padded. Returns by end place, piece length and word the cumulative
        share in the probability of reaching that place, and the piece number (-1: byte pieces)."""
        n, size = chars.shape
        most = min(LONGEST, size)
        share = np.zeros((size, most, n), np.float32)
        piece = np.full((size, most, n), -2, np.int32)
        value = chars.T.astype(np.uint64) + np.uint64(1)
        alpha = np.zeros((size + 1, n), np.float32)
        running: list[np.ndarray] = []  # running[k]: hash of the k + 1 characters before the end place
        base = np.uint64(_BASE)
        weights, none = self.weights, np.float32(-np.inf)
        for end in range(size):
            running = [value[end], *(h * base + value[end] for h in running[: most - 1])]
            score = share[end]
            for k, h in enumerate(running):
                got = piece[end, k] = self.find(h)
                score[k] = np.where(got >= 0, weights[got], none if k else np.float32(self.other)) + alpha[end - k]
            score = score[: len(running)]
            top = score.max(axis=0)
            score -= top
            np.exp(score, out=score)
            for k in range(1, len(score)):
                score[k] += score[k - 1]
            total = score[-1].copy()
            score /= total
            alpha[end + 1] = top + np.log(total)
        return share, piece

    def sample_long(self, text: str, key: int, seed: int, limit: int) -> np.ndarray:
        """ids of one long text, a stretch of whole words at a time; the same as of the text at once."""
        out, number = [], 0
        for stretch in stretches(text, limit):
            out.append(self.sample([stretch], np.array([key]), seed, number, not out)[0])
            number += len(WORD.findall(stretch if number else " " + stretch))
        return np.concatenate(out)

    def sample(self, texts: list[str], keys: np.ndarray, seed: int, number: int = 0, start: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, number of ids of each row). Words count from ``number``; without ``start`` texts get no dummy space."""
        words, counts, first_word = [], [], number
        for t in texts:
            found = WORD.findall(" " + t if start else t) if t else []
            words += found
            counts.append(len(found))
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        counts = np.array(counts, np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        number = first_word + np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        noise = mix(mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.int64).view(np.uint64)))[row] + number.astype(np.uint64))
        sizes = np.array([len(w) for w in distinct], np.int64)
        take_word, take_step, take_id = [], [], []
        drawn = np.zeros(len(words), np.int64)
        # short words go by their length, longer ones by powers of two (padding does not change a prefix's sums)
        levels = np.where(sizes <= 24, sizes, 32 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).clip(0).astype(np.int64))
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(distinct) + 1))
        for level in np.unique(levels):
            kinds = np.flatnonzero(levels == level)
            width = int(sizes[kinds].max())
            step = max(1, TABLE_FLOATS // (width * min(LONGEST, width)))
            for a in range(0, len(kinds), step):
                these = kinds[a : a + step]
                # the first space of a word is written U+2581; a literal U+2581 must become bytes
                chars = np.array([distinct[i] for i in these], f"<U{width}").view(np.uint32).reshape(len(these), width).copy()
                chars[chars == 0x2581] = 0x110000
                chars[chars[:, 0] == 32, 0] = 0x2581
                share, piece = self.forward(chars)
                occurrences = np.concatenate([order[first[i] : first[i + 1]] for i in these])
                kind = np.repeat(np.arange(len(these)), first[these + 1] - first[these])
                end, salt, step_number = sizes[these][kind], np.uint64(0), 0
                most, n = share.shape[1:]
                while len(occurrences):
                    salt += np.uint64(0x9E3779B97F4A7C15 & 0xFFFFFFFF)
                    u = (mix(noise[occurrences] + salt) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
                    flat = (end - 1) * (most * n) + kind
                    k = np.zeros(len(u), np.int64)
                    todo = np.flatnonzero(share.take(flat) <= u)
                    length = 1
                    while len(todo) and length < most:
                        k[todo] = length
                        todo = todo[(length < end[todo]) & (share.take(flat[todo] + length * n) <= u[todo])]
                        length += 1
                    k = np.minimum(k, end - 1)
                    got = piece.take(flat + k * n)
                    begin = end - k - 1
                    take_word.append(occurrences)
                    take_step.append(np.full(len(u), step_number, np.int32))
                    take_id.append(np.where(got >= 0, self.ids[got], -chars[kind, begin].astype(np.int32) - 1))
                    drawn[occurrences] += 1
                    step_number += 1
                    more = np.flatnonzero(begin > 0)
                    occurrences, kind, end = occurrences[more], kind[more], begin[more]
        if not take_word:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        word, step, got = map(np.concatenate, (take_word, take_step, take_id))
        ids = np.empty_like(got)
        ids[np.cumsum(drawn)[word] - 1 - step] = got
        word = np.repeat(np.arange(len(words)), drawn)
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            encoded = [("▁" if c == 0x110000 else chr(c)).encode("utf-8", "surrogatepass") for c in (-ids[missing] - 1).tolist()]
            width = np.ones(len(ids), np.int64)
            width[missing] = [len(b) for b in encoded]
            where = (np.cumsum(width) - width)[missing]
            word, ids = np.repeat(word, width), np.repeat(ids, width)
            for start, b in zip(where.tolist(), encoded):
                ids[start : start + len(b)] = self.byte_ids[list(b)]
        return ids, np.bincount(row[word], minlength=len(texts))

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def stretches(text: str, limit: int) -> Iterator[str]:
    """The text in turn, cut before spaces or line feeds into some ``limit`` characters (more only without any)."""
    a = 0
    while len(text) - a > limit:
        b = max(text.rfind(" ", a + 1, a + limit), text.rfind("\n", a + 1, a + limit))
        if b < 0:
            b = min((x for x in (text.find(" ", a + limit), text.find("\n", a + limit)) if x >= 0), default=len(text))
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """doc_id, text, ids: a sampled segmentation of each row's whole text, reproducible from (seed, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, temperature)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                keys, col = part.column(0), part.column(1)
                texts, numbers = [t or "" for t in col.to_pylist()], keys.fill_null(0).to_numpy(zero_copy_only=False)
                if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
                    ids = lattice.sample_long(texts[0], numbers[0], seed, CHUNK_BYTES)
                    counts = np.array([len(ids)])
                else:
                    ids, counts = lattice.sample(texts, numbers, seed)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                valid = np.asarray(col.is_valid())
                lists = pa.ListArray.from_arrays(pa.array(offsets[:-1].tolist() + [int(offsets[-1])], pa.int32(), mask=np.append(~valid, False)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, col, lists], names=["doc_id", "text", "ids"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model_path: str, temperature: float = 1.0) -> DataFrame:
    """The rows of encode() with ``decoded``, the text that their ids spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_path, temperature)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("ids"))
            offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
            out = [lattice.decode(flat[a:b]).decode("utf-8", "surrogatepass") if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], np.asarray(col.is_valid()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, _with(encoded, "decoded string"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])
