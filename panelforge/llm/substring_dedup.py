"""Operator 6: removal of passages repeated from earlier documents, by fixed-block anchors.

A shared window of 50 words holds a whole block of 25 words that is aligned in
its own document. So the non-overlapping 25-word blocks of every document are
looked up among the rolling 25-word windows of every document: a block whose
hash also stands in another document anchors a repeat. Anchors are extended to
maximal exact repeats: the windows of 50 words around them get 96-bit keys, and
each document with a smaller one behind an equal key loses the words of that
window; runs of such windows are the maximal repeats.

Both meetings aggregate before they shuffle. Texts of some megabytes make a unit,
which answers what it can itself (a block that two of its documents hold is an
anchor) and sends on each hash of its windows once: with their places the blocks
of a single one of its documents, which ask, and bare all other hashes, sorted
and as steps of three or four bytes. They meet in hash buckets, whose number
follows the input; a block is an anchor where a second unit has its hash. The
windows near anchors meet likewise by their keys. So a passage of a third of all
rows sends an entry for each unit, and no pair of documents is ever listed. The
texts are shuffled once: both joins by document read the same exchange.

Defined results: null text has no words; a null doc_id is neither source nor
target and keeps its words; rows that repeat a doc_id count as one document
for order, each row is returned; very long texts are one row of a unit, like any
other; empty tables give no rows. Other columns go through in the struct
``rest`` on request. (Where a doc_id has several rows, they are told apart by a
64-bit hash of their text, the ``tag``; else the tag is 0.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blobs
from panelforge.llm.common import input_buckets, materialized, with_rest
from panelforge.llm.textnum import Words, chunks

WINDOW, CHUNK_BYTES, UNIT_BYTES = 50, 2 << 20, 8 << 20

#: What units send: entries with places, bare keys, or places that are answered already and go by their document's bucket.
PLACED, BARE, ANSWERED = 0, 1, 2
SHIPPED = "bucket int, kind int, pack binary"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First place of each run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _batch(*kinds: tuple[int, list[tuple[int, bytes]]]) -> pa.RecordBatch:
    rows = [(bucket, kind, pack) for kind, packs in kinds for bucket, pack in packs]
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "pack"])


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.loc[pdf["kind"] == ANSWERED, ["bucket", "pack"]]


def _hashed(part: pa.RecordBatch, block: int) -> tuple[np.ndarray, ...]:
    """Ids and tags of the rows; hash, row and place of each rolling window of ``block`` words."""
    ids, tags = part.column(0).to_numpy(), part.column(2).to_numpy()
    words = Words(part.column(1))
    at, h = words.rolling(block)
    row = np.repeat(np.arange(len(ids)), words.counts)[at]
    return ids, tags, h, row, at - words.rows[row]


def _unit(parts: list[tuple[np.ndarray, ...]], block: int, buckets: int) -> pa.RecordBatch:
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    row = np.concatenate([p[3] + b for p, b in zip(parts, base)])
    ids, tags, h, _, place = (np.concatenate(x) for x in zip(*parts))
    if not len(h):
        return _batch()
    order = np.argsort(h)
    h, doc = h[order], ids[row[order]]
    first = _starts(h)
    size = np.diff(np.append(first, len(h)))
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    aligned = place[order] % block == 0
    asks = aligned & ~np.repeat(several, size)
    bare = ~np.logical_or.reduceat(asks, first)
    hit = order[aligned & np.repeat(several, size)]
    found = blobs.deal_documents(ids[row[hit]], tags[row[hit]], place[hit], buckets)
    bucket, key = blobs.bucket_and_key(h, buckets)
    own = np.argsort(order[asks])  # in the order of rows and places again
    at, own_bucket, own_key = order[asks][own], bucket[asks][own], key[asks][own]
    placed = blobs.deal(own_bucket, ids, tags, row[at], place[at], [own_key])
    others = blobs.deal_sorted(bucket[first[bare]], key[first[bare]])
    return _batch((PLACED, list(placed)), (BARE, list(others)), (ANSWERED, list(zip(found["bucket"].tolist(), found["pack"]))))


def _probes(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                held.append(_hashed(part, block))
                size += part.column(1).nbytes
                if size >= UNIT_BYTES:
                    yield _unit(held, block, buckets)
                    held, size = [], 0
        if held:
            yield _unit(held, block, buckets)

    return docs.mapInArrow(run, SHIPPED)


def _anchors(shipped: DataFrame, block: int, buckets: int) -> DataFrame:
    """Aligned places whose block also stands in another document."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = [blobs.read(p, ("<u4",)) for p in pdf.loc[pdf["kind"] == PLACED, "pack"]]
        if not asks:
            return _answered(pdf)
        # a unit's hashes are asks or bare, so a hash that is there twice has two units
        seen = [*(np.unique(keys[0]) for *_, keys in asks), *(blobs.read_sorted(p) for p in pdf.loc[pdf["kind"] == BARE, "pack"])]
        value = np.sort(np.concatenate(seen))
        shared = np.unique(value[1:][value[1:] == value[:-1]])
        doc, tag = (np.concatenate([np.repeat(x[k], x[2]) for x in asks]) for k in (0, 1))
        hit = np.isin(np.concatenate([keys[0] for *_, keys in asks]), shared)
        place = np.concatenate([x[3] for x in asks])[hit]
        return pd.concat([_answered(pdf), blobs.deal_documents(doc[hit], tag[hit], place, buckets)])

    return blobs.by_document(shipped.groupBy("bucket").applyInPandas(meet, blobs.PACKED))


def _windows(joined: DataFrame, window: int, block: int, buckets: int) -> DataFrame:
    """The windows that hold an anchor, keyed by 96 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                ids, tags = part.column("doc_id").to_numpy(), part.column("tag").to_numpy()
                words = Words(part.column("text"), hashes=2)
                anchor = np.zeros(len(words.starts) + 1, np.int64)
                for row, places in enumerate(part.column("places").to_pylist()):
                    anchor[words.rows[row] + np.frombuffer(places, "<u4").astype(np.int64)] = 1
                before = np.concatenate([[0], np.cumsum(anchor)])
                at, h = words.rolling(window)
                _, h2 = words.rolling(window, 1)
                near = before[at + window - block + 1] > before[at]
                at, h, h2 = at[near], h[near], h2[near].astype("<u4")
                if not len(at):
                    continue
                row = np.repeat(np.arange(len(ids)), words.counts)[at]
                place = at - words.rows[row]
                order = np.lexsort((h2, h))
                doc = ids[row][order]
                first = _starts(h[order], h2[order])
                later = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
                hit, at = order[later], np.sort(order[~later])
                found = blobs.deal_documents(ids[row[hit]], tags[row[hit]], place[hit], buckets)
                packs = blobs.deal(blobs.bucket_of(h[at], buckets), ids, tags, row[at], place[at], [h[at].astype("<u8"), h2[at]])
                yield _batch((PLACED, list(packs)), (ANSWERED, list(zip(found["bucket"].tolist(), found["pack"]))))

    return joined.mapInArrow(run, SHIPPED)


def _repeated(shipped: DataFrame, buckets: int) -> DataFrame:
    """Window starts of each document whose words also start in a document with a smaller id."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        packs = pdf.loc[pdf["kind"] == PLACED, "pack"]
        if not len(packs):
            return _answered(pdf)
        doc, tag, place, (a, b) = blobs.entries(packs, ("<u8", "<u4"))
        order = np.lexsort((b, a))
        doc, tag, place, a, b = doc[order], tag[order], place[order], a[order], b[order]
        first = _starts(a, b)
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
        later = doc > least
        return pd.concat([_answered(pdf), blobs.deal_documents(doc[later], tag[later], place[later], buckets)])

    return blobs.by_document(shipped.groupBy("bucket").applyInPandas(meet, blobs.PACKED))


def _removed(joined: DataFrame, window: int, schema: str, more: tuple[str, ...]) -> DataFrame:
    """Kept words of each row; joined has doc_id, text, places (window starts or null), and the columns ``more`` to carry on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept_text, spans = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words, gone = text.as_buffer().to_pybytes().split() if text.is_valid else [], []
                if places.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.frombuffer(places.as_buffer(), "<u4").astype(np.int64)
                    edge[starts] += 1
                    np.subtract.at(edge, starts + window, 1)
                    edge = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
                    gone = np.stack([edge[::2], np.diff(edge)[::2]], axis=1).tolist()
                n_words.append(len(words))
                n_removed.append(sum(n for _, n in gone))
                spans.append([{"start": a, "length": n} for a, n in gone])
                for a, n in reversed(gone):
                    del words[a : a + n]
                kept_text.append(b" ".join(words))
            named = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string()),
                **{c: batch.column(c) for c in more},
            }
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return joined.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rest: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text (kept words, one space between) and, if asked, the text and the struct rest.

    spans: start and length, in words, of each maximal run of removed words.
    """
    block = window // 2
    buckets = input_buckets(docs)
    named, more_schema = with_rest(docs, id_col, text_col, rest)
    several = named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    known = named.where("doc_id is not null and text is not null").withColumn("tag", F.xxhash64("text") if several else F.lit(0).cast("long"))
    anchors = materialized(_anchors(_probes(known.select("doc_id", "text", "tag"), block, buckets), block, buckets))
    # both joins hash their small side and take the texts from one exchange, so they ask for the same columns of it
    near = known.join(anchors.hint("shuffle_hash"), ["doc_id", "tag"])
    places = _repeated(_windows(near, window, block, buckets), buckets)
    schema = f"doc_id long, n_words long, n_removed long, spans array<struct<start:long, length:long>>, kept_text string{more_schema}"
    joined = known.join(places.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    # rows without an id or a text have no places, whatever another row of their id has
    nameless = named.where("doc_id is null or text is null").withColumns({"tag": F.lit(0).cast("long"), "places": F.lit(None).cast("binary")})
    more = () if rest is None else ("text", "rest") if rest else ("text",)
    return _removed(joined, window, schema, more).union(_removed(nameless.select(joined.columns), window, schema, more))
