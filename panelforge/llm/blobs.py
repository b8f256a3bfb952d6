"""Packed exchange of word positions: many (document, word place, key) entries as a few binary rows per bucket.

A pack holds parallel arrays for entries of many documents, in the order of
their places in one chunk. Rows of Spark's shuffle then cost a few bytes an
entry instead of some thirty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.textnum import mix

PACKED = "bucket int, pack binary"


def _small(values: np.ndarray) -> tuple[int, bytes]:
    """Non-negative values in 1, 2, 4 or 8 bytes each, zeros in none."""
    most = int(values.max()) if len(values) else 0
    if not most:
        return 0, b""
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return size, values.astype(f"<u{size}").tobytes()


def write_sorted(keys: np.ndarray) -> bytes:
    """Ascending distinct 32-bit keys by their steps: 3 bytes each where all steps fit, else 4."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    if int(steps.max()) < 1 << 24:
        return b"".join([struct.pack("<IB", len(keys), 3), (steps & 0xFFFF).astype("<u2").tobytes(), (steps >> 16).astype("<u1").tobytes()])
    return struct.pack("<IB", len(keys), 4) + steps.astype("<u4").tobytes()


def read_sorted(pack: bytes) -> np.ndarray:
    n, size = struct.unpack_from("<IB", pack)
    if size == 3:
        steps = np.frombuffer(pack, "<u2", n, 5).astype(np.uint64) | np.frombuffer(pack, "<u1", n, 5 + 2 * n).astype(np.uint64) << np.uint64(16)
    else:
        steps = np.frombuffer(pack, "<u4", n, 5).astype(np.uint64)
    return np.cumsum(steps).astype("<u4")


def deal_sorted(bucket: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packs of 32-bit keys by bucket, each key once; entries come in the order of bucket and key."""
    if not len(keys):
        return
    new = _firsts(bucket, keys)
    bucket, keys = bucket[new], keys[new]
    first = np.flatnonzero(_firsts(bucket))
    for k, part in zip(bucket[first].tolist(), np.split(keys, first[1:])):
        yield k, write_sorted(part)


def write(docs: np.ndarray, tags: np.ndarray | None, counts: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> bytes:
    """docs: an id per document; tags: 64 bits that tell rows of one id apart; counts: entries; places: ascending within it; keys: arrays of an entry each."""
    steps = places.astype(np.int64).copy()
    first = np.cumsum(counts) - counts
    inner = np.ones(len(steps), bool)
    inner[first[counts > 0]] = False
    steps[1:][inner[1:]] = np.diff(places)[inner[1:]]
    gaps = np.diff(docs.astype(np.int64), prepend=np.int64(0))
    (g, w), (a, x), (b, y) = _small(((gaps << 1) ^ (gaps >> 63)).view(np.uint64)), _small(counts), _small(steps)
    t = tags.astype("<i8").tobytes() if tags is not None and tags.any() else b""
    return b"".join([struct.pack("<IIBBBB", len(docs), len(places), g, a, b, bool(t)), w, t, x, y, *(k.tobytes() for k in keys)])


def _values(size: int, n: int, pack: bytes, at: int) -> np.ndarray:
    return np.frombuffer(pack, f"<u{size}", n, at) if size else np.zeros(n, np.uint8)


def read(pack: bytes, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    n, m, g, a, b, tagged = struct.unpack_from("<IIBBBB", pack)
    at = 12
    gaps = _values(g, n, pack, at).astype(np.uint64)
    docs = np.cumsum((gaps >> np.uint64(1)).view(np.int64) ^ -(gaps & np.uint64(1)).view(np.int64))
    at += g * n
    tags = np.frombuffer(pack, "<i8", n, at) if tagged else np.zeros(n, "<i8")
    at += 8 * n * tagged
    counts = _values(a, n, pack, at).astype(np.int64)
    at += a * n
    steps = _values(b, m, pack, at).astype(np.int64)
    at += b * m
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    full = counts > 0
    base = np.zeros(n, np.int64)
    base[full] = total[first[full]] - steps[first[full]]
    places = total - np.repeat(base, counts)
    keys = []
    for kind in kinds:
        keys.append(np.frombuffer(pack, kind, m, at))
        at += keys[-1].nbytes
    return docs, tags, counts, places, keys


def entries(packs, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Document, tag, place and keys of every entry of tagged packs."""
    parts = [read(p, kinds) for p in packs]
    doc = np.concatenate([np.repeat(d, c) for d, _, c, _, _ in parts])
    tag = np.concatenate([np.repeat(t, c) for _, t, c, _, _ in parts])
    return doc, tag, np.concatenate([p for *_, p, _ in parts]), [np.concatenate([k[i] for *_, k in parts]) for i in range(len(kinds))]


def deal(bucket: np.ndarray, docs: np.ndarray, tags: np.ndarray | None, rows: np.ndarray, places: np.ndarray, keys: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Packs of entries (row of docs, place, keys...) by bucket; entries come in the order of row and place."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.size and bucket.max() < 1 << 16 else bucket, kind="stable")
    sizes = np.bincount(bucket) if len(bucket) else []
    stop = np.cumsum(sizes)
    for k in np.flatnonzero(sizes):
        at = order[stop[k] - sizes[k] : stop[k]]
        r = rows[at]
        own, counts = np.unique(r, return_counts=True)
        yield int(k), write(docs[own], None if tags is None else tags[own], counts, places[at], [x[at] for x in keys])


def batch_of(packs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in packs], pa.int32()), pa.array([b for _, b in packs], pa.binary())], names=["bucket", "pack"])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket from the high half of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_and_key(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash and 32 bits more of it; in the order of the hashes both ascend."""
    room = np.uint64(max(1, n.bit_length()))
    spread = (h >> room) * np.uint64(n)
    return (spread >> (np.uint64(64) - room)).astype(np.int64), (spread >> (np.uint64(32) - room)).astype("<u4")


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Marks of the rows that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def by_document(packed: DataFrame) -> DataFrame:
    """(doc_id, tag, places) of packs without keys that were dealt by document: places as sorted distinct u4 bytes."""

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, tag, place, _ = entries(pdf["pack"], ())
        order = np.lexsort((place, tag, doc))
        doc, tag, place = doc[order], tag[order], place[order]
        new = _firsts(doc, tag, place)
        doc, tag, place = doc[new], tag[new], place[new].astype("<u4")
        first = np.flatnonzero(_firsts(doc, tag))
        return pd.DataFrame({"doc_id": doc[first], "tag": tag[first].astype(np.int64), "places": [p.tobytes() for p in np.split(place, first[1:])]})

    return packed.groupBy("bucket").applyInPandas(gather, "doc_id long, tag long, places binary")


def deal_documents(docs: np.ndarray, tags: np.ndarray, places: np.ndarray, buckets: int) -> pd.DataFrame:
    """Entries (document, tag, place) as packs dealt by document."""
    order = np.lexsort((places, tags, docs))
    docs, tags, places = docs[order], tags[order], places[order]
    row = np.cumsum(_firsts(docs, tags)) - 1 if len(docs) else docs
    first = np.searchsorted(row, np.arange(row[-1] + 1)) if len(docs) else row
    own = docs[first]
    packs = list(deal(bucket_of(mix(docs.astype(np.int64).view(np.uint64)), buckets), own, tags[first], row, places, [])) if len(docs) else []
    return pd.DataFrame({"bucket": np.array([k for k, _ in packs], np.int32), "pack": [b for _, b in packs]})
