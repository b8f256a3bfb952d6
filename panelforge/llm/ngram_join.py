"""Operator 9: n-gram Jaccard join by grouped prefixes, down to components of linked documents.

1. Every document becomes its set of distinct 3-word shingles (64-bit hashes);
   equal sets collapse into one class.
2. For a size class the hash order of shingles is cut into K + m segments, and
   starting the order at each segment gives as many orders. A set's prefix in an
   order is its shingles of the first segment. Two sets whose similarity reaches
   the threshold differ in K - 1 shingles at most, so in m + 1 orders at least
   their prefixes are identical: sets with identical prefixes and size class form
   one group. An empty prefix says nothing and forms a group only for the rare
   sets with more than m of them, so that linked sets always meet. Below
   ``PERCENT`` segments are short, and one may hold nothing but a common line: there
   m is larger, a prefix of shingles that a bounded sample shows to be common
   says nothing either, and two segments of a block of some five make a prefix (more
   identical segments than blocks leave two in one block). A chunk of
   texts ties its members of a group to their least one and sends only that on;
   the least ones meet in hash buckets, whose number follows the input, as packs
   of a few bytes, and are tied to the least of all. So m members give m ties,
   not m squared, and a group of a third of all rows sends an entry for each
   chunk. (Prefixes of single rare shingles in one order tie documents that share
   no more than a passage; whole segments do not.)
3. Ties merge into families, which hold every linked pair. Families are expanded
   to their members and verified on whole sets. A family over ``BLOCK_MEMBERS``
   members or ``BLOCK_SHINGLES`` shingles is cut into blocks: first each block is
   verified together with the family's least set, its centre; members that no
   chain of links ties to the centre inside their block are then verified
   against the other blocks, two blocks a task, once for each two that a group with
   such a member spans. A task stays bounded, and a group of near copies of one
   text takes one comparison for each member. A task returns the links that it
   found merged into stars round the least document of each component.
4. Components of the links give the result.

Defined results: null or blank texts have an empty set and link with nothing;
with one or two words, the whole sequence is the one shingle; a null doc_id
links with nothing and has a null component; rows that repeat a doc_id are one
document for links of either text, each row is returned; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import blobs
from panelforge.llm.common import broadcast_if_small, input_buckets, materialized, smallest
from panelforge.llm.graph import connected_components
from panelforge.llm.textnum import Words, chunks, distinct, mix

SHINGLE, PERCENT = 3, 90
BLOCK_MEMBERS, BLOCK_SHINGLES = 1000, 1_000_000
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_SEEN = 2048, 8192, 3
#: From so many segments on a key is made of two of them.
PAIRS_FROM = 6


def shingle_sets(col: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all rows in turn, sorted within a row; number of each row)."""
    words = Words(col, lower=True)
    at, h = words.rolling(width)
    row = np.repeat(np.arange(len(words.counts)), words.counts)[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        base = [mix(np.bitwise_xor.reduce(mix(words.hashes[0][words.rows[r] : words.rows[r + 1]] + np.arange(1, words.counts[r] + 1, dtype=np.uint64)), keepdims=True))[0] for r in short]
        row, h = np.concatenate([row, short]), np.concatenate([h, np.array(base, np.uint64)])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return distinct(h, np.cumsum(np.bincount(row, minlength=len(words.counts))))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, two halves of the set's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, n = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in signatures(h, n))], names=["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def signatures(h: np.ndarray, n: np.ndarray, salts: tuple[int, ...] = (1, 2)) -> list[np.ndarray]:
    """Order-free 64-bit sums of each set, one for each salt; 0 for empty sets."""
    first, full, out = np.cumsum(n) - n, n > 0, []
    for salt in salts:
        half = np.zeros(len(n), np.uint64)
        if full.any():
            half[full] = np.add.reduceat(mix(h + np.uint64(salt << 40 | salt)), first[full])
        out.append(half)
    return out


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes within the threshold's ratio lie in one class or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)


def segments(k: np.ndarray, percent: int) -> np.ndarray:
    """K of a key class k, for sets of the classes k and k + 1: one more than they can differ in."""
    top = np.power(100 / percent, k + 1) + np.power(100 / percent, k + 2) + 2
    return np.floor(top * (100 - percent) / (100 + percent)).astype(np.int64) + 1


def spare(parts: np.ndarray, percent: int) -> np.ndarray:
    """m for K: segments that may say nothing; below PERCENT a segment holds some three shingles and is empty more often."""
    return 1 + parts // 64 if percent >= PERCENT else 3 + parts // 6


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that several texts of a bounded sample hold. They steer what is compared, never what links."""
    named = docs.where("text is not null").select(F.xxhash64("text").alias("key"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    texts = [r["text"] for r in smallest(named, "key", SAMPLE_TEXTS).select("text").collect()]
    values, seen = np.unique(shingle_sets(pa.array(texts, pa.large_string()), width)[0], return_counts=True)
    return values[seen >= SAMPLE_SEEN]


def pair_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments, silent ones allowed, blocks) of the keys made of two segments for K.

    K + m segments leave m + 1 identical ones; without the silent ones these are more than there are blocks, so that a block holds two."""
    few = 1 + (7 * parts) // 10
    silent = 1 + 19 * (parts + few) // 100
    return parts + few, silent, few - silent


def _totals(h: np.ndarray, row: np.ndarray, tokens: np.ndarray, rare: np.ndarray, k: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(salted sum of each segment of each set, whether it has a rare shingle, number of the segment in its set)."""
    base = np.cumsum(parts) - parts
    place = base[row] + ((h >> np.uint64(11)) % parts[row].astype(np.uint64)).astype(np.int64)
    total = np.zeros(int(parts.sum()), np.uint64)
    np.add.at(total, place, tokens)
    filled = np.bincount(place[rare], minlength=len(total)) > 0
    segment = np.arange(len(total)) - np.repeat(base, parts)
    return total ^ mix((np.repeat(k, parts) << 32 | segment).astype(np.uint64)), filled, segment


def prefix_keys(h: np.ndarray, n: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every grouped prefix. Sets so small that only equal ones can link have none.

    Linked sets have m + 1 identical segments at least. A set with m silent ones (empty, or all of ``common`` shingles)
    or fewer speaks by the others; one with more speaks by all, so that two such sets meet too.

    Below PERCENT, from ``PAIRS_FROM`` segments on, two speaking segments of a block make a key: texts that share no more
    than a few shingles would meet by one short segment, and their number grows as the square of the texts. Sets with more
    silent segments than ``pair_parts`` allows meet each other by single segments besides.
    """
    rows = np.flatnonzero(100 * n >= percent * (n + 1))
    own = np.repeat(np.isin(np.arange(len(n)), rows), n)
    h, size = h[own], n[rows]
    row, tokens = np.repeat(np.arange(len(rows)), size), mix(h)
    rare = np.ones(len(h), bool) if common is None or not len(common) else common[np.minimum(np.searchsorted(common, h), len(common) - 1)] != h
    out_rows, out_keys = [], []

    def some(chosen: np.ndarray) -> tuple:
        """What _totals takes first, of the chosen sets alone."""
        of = chosen[row]
        return h[of], (np.cumsum(chosen) - 1)[row[of]], tokens[of], rare[of]

    for step in (0, 1):
        k = size_class(size, percent) - step
        parts = segments(k, percent)
        paired = (parts >= PAIRS_FROM) & (percent < PERCENT)
        single = ~paired
        if paired.any():
            count, silent, blocks = pair_parts(parts[paired])
            total, filled, segment = _totals(*some(paired), k[paired], count)
            base = np.cumsum(count) - count
            single[paired] = count - np.add.reduceat(filled, base, dtype=np.int64) > silent
            total, apart, whole, named = mix(total), np.repeat(blocks, count), np.repeat(count, count), np.repeat(rows[paired], count)
            for d in range(1, int(-(-count // blocks).max())):
                one = np.flatnonzero(filled & (segment + d * apart < whole))
                two = one + d * apart[one]
                one, two = one[filled[two]], two[filled[two]]
                out_rows.append(named[one])
                out_keys.append(mix(total[one] + (total[two] << np.uint64(1))))
        if single.any():
            few = spare(parts[single], percent)
            count = parts[single] + few
            total, filled, _ = _totals(*some(single), k[single], count)
            use = filled | np.repeat(count - np.add.reduceat(filled, np.cumsum(count) - count, dtype=np.int64) > few, count)
            out_rows.append(np.repeat(rows[single], count)[use])
            out_keys.append(mix(total)[use])
    return np.concatenate([np.empty(0, np.int64), *out_rows]), np.concatenate([np.empty(0, np.uint64), *out_keys])


def _ties(docs: DataFrame, width: int, percent: int, buckets: int, common: np.ndarray | None) -> DataFrame:
    """(a, b): first signature halves of sets in one group, b the least of the group."""

    def tied(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, least of each, pairs of others with it)."""
        order = np.argsort(key)
        key, own = key[order], own[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        least = np.minimum.reduceat(own, first) if len(key) else own
        whole = np.repeat(least, np.diff(np.append(first, len(key))))
        other = own != whole
        return key[first], least, np.unique(np.stack([own[other], whole[other]], axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                h, n = shingle_sets(part.column(0), width)
                own = signatures(h, n, (1,))[0].view(np.int64)
                _, once = np.unique(own, return_index=True)  # equal sets of a chunk speak once
                use = np.isin(np.arange(len(n)), once)
                h, n, own = h[np.repeat(use, n)], n[use], own[use]
                row, key = prefix_keys(h, n, percent, common)
                key, least, pairs = tied(key, own[row])
                sets, row = np.unique(least, return_inverse=True)
                order = np.argsort(row, kind="stable")
                row, key = row[order], key[order]
                packs = list(blobs.deal(blobs.bucket_of(key, buckets), sets, None, row, np.zeros(len(row), np.int64), [key.astype("<u4"), (key >> np.uint64(32)).astype("<u1")]))
                if packs:
                    rows = [(k, p, None) for k, p in packs] + [(packs[int(key[0]) % len(packs)][0], None, pairs.tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "pack", "pairs"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [blobs.read(p, ("<u4", "<u1")) for p in pdf["pack"] if p is not None]
        own = np.concatenate([np.empty(0, np.int64), *(np.repeat(d, c) for d, _, c, _, _ in parts)])
        key = np.concatenate([np.empty(0, np.uint64), *(k[0].astype(np.uint64) << np.uint64(8) | k[1] for *_, k in parts)])
        near = [np.frombuffer(p, np.int64).reshape(-1, 2) for p in pdf["pairs"] if p is not None]
        pairs = np.concatenate([tied(key, own)[2], *near])
        return pd.DataFrame(dict(zip("ab", stars(pairs[:, 0], pairs[:, 1]))))

    return docs.select("text").mapInArrow(run, f"{blobs.PACKED}, pairs binary").groupBy("bucket").applyInPandas(meet, "a long, b long")


def _group_keys(members: DataFrame, width: int, percent: int, common: np.ndarray | None) -> DataFrame:
    """(rep, key): the groups that a member of a family is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                row, key = prefix_keys(*shingle_sets(part.column("text"), width), percent, common)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(row)), pa.array(key.view(np.int64))], names=["rep", "key"])

    return members.select("rep", "text").mapInArrow(run, "rep long, key long")


def linked(sets: list[np.ndarray], percent: int, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (by number) whose Jaccard similarity is percent or more.

    Trees grow from one set after another (the ``settled`` sets are one tree already): a set is compared with all sets
    that no tree holds yet and that share a shingle of its rare-first prefix, in array operations. A set that a tree
    holds is never compared from the other side again, so near copies of one text cost one comparison each.
    """
    if len(sets) < 2:
        return []
    n = np.array([len(s) for s in sets])
    stop = np.cumsum(n)
    first, of = stop - n, np.repeat(np.arange(len(n)), n)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    own = np.sort(of << 32 | rank[code]) & 0xFFFFFFFF
    once = np.sort(count) < 2
    use = (np.arange(len(own)) - first[of] < (n + 1 + (-percent * n) // 100)[of]) & ~once[own]
    head, whose = own[use], of[use]
    starts = np.searchsorted(whose, np.arange(len(n) + 1))
    all_heads, mark, free = head, np.zeros(len(count), bool), np.ones(len(n), bool)
    todo = np.flatnonzero(settled).tolist() if settled is not None else []
    free[todo] = False
    head, whose = head[free[whose]], whose[free[whose]]
    forest, fresh = [], 0
    while len(head):
        if todo:
            x = todo.pop()
        else:
            while not free[fresh]:
                fresh += 1
            x = fresh
            free[x] = False
        part = all_heads[starts[x] : starts[x + 1]]
        mark[part] = True
        near = np.unique(whose[mark[head]])
        mark[part] = False
        near = near[free[near]]
        near = near[percent * np.maximum(n[near], n[x]) <= 100 * np.minimum(n[near], n[x])]
        if len(near):
            mark[own[first[x] : stop[x]]] = True
            base = np.cumsum(n[near]) - n[near]
            both = np.add.reduceat(mark[own[np.repeat(first[near] - base, n[near]) + np.arange(n[near].sum())]], base, dtype=np.int64)
            mark[own[first[x] : stop[x]]] = False
            near = near[100 * both >= percent * (n[x] + n[near] - both)]
            free[near] = False
            forest += [(x, y) for y in near.tolist()]
            todo += near.tolist()
        if len(near) or not todo:
            kept = free[whose]
            head, whose = head[kept], whose[kept]
    return forest


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges a - b, for all nodes but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x) and (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, text. Returns (sets of all rows, classes of equal sets, links between class representatives)."""
    buckets = input_buckets(docs)
    common = common_shingles(docs, width) if percent < PERCENT else None
    sets = materialized(_sets(docs, width))
    classes = materialized(sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    family = connected_components(_ties(docs.where("doc_id is not null"), width, percent, buckets, common))
    named = classes.join(family, F.col("s1") == F.col("node"), "left").select("rep", "n", F.coalesce("label", "s1").alias("family"), (F.coalesce("label", "s1") == F.col("s1")).alias("centre"))
    blocks = lambda: F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")

    def counted(members: DataFrame, name: str) -> DataFrame:
        """Number of blocks of each family; written out, so that Spark can split a family of very many in the join with it."""
        sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
        return materialized(sizes.select("family", "members", blocks().alias(name)))

    sizes = counted(named, "blocks").where("members > 1").drop("members")
    placed = materialized(named.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    # texts of members alone, written once: whatever needs them later reads these and does not join all texts again
    texts = materialized(docs.join(broadcast_if_small(placed), F.col("doc_id") == F.col("rep")).select("rep", "text", "n", "family", "centre", "blocks", "block"))
    # the centre stands in every block of its family
    every = F.when(F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    tasks = texts.select("rep", "text", "family", "centre", "blocks", F.explode(every).alias("block"))

    def sets_of(pdf: pd.DataFrame) -> list[np.ndarray]:
        h, n = shingle_sets(pa.array(pdf["text"], pa.large_string()), width)
        return np.split(h, np.cumsum(n)[:-1])

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of a block; (rep, null) for members of a cut family that are not tied to its centre here."""
        pdf = pdf.sort_values("centre", ascending=False).drop_duplicates(["rep", "text"])
        ids, found = pdf["rep"].to_numpy(np.int64), np.array(linked(sets_of(pdf), percent), np.int64).reshape(-1, 2)
        a, b = stars(ids[found[:, 0]], ids[found[:, 1]])
        rows = list(zip(a.tolist(), b.tolist()))
        if pdf["blocks"].iloc[0] > 1:
            least, centre = dict(rows), pdf.loc[pdf["centre"], "rep"]
            near = {least.get(x, x) for x in centre.tolist()}
            rows += [(x, None) for x in set(ids.tolist()) if least.get(x, x) not in near]
        return pd.DataFrame(rows, columns=["a", "b"]).astype("Int64")

    def verify_open(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("open").drop_duplicates(["rep", "text"], keep="last")
        ids = pdf["rep"].to_numpy(np.int64)
        found = np.array(linked(sets_of(pdf), percent, ~pdf["open"].to_numpy(bool)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    # the cost of a block is its comparisons, not its bytes: a fixed number of partitions keeps Spark from merging them by bytes
    seen = materialized(tasks.repartition(2 * buckets, "family", "block").groupBy("family", "block").applyInPandas(verify, "a long, b long"))
    edges, left = seen.where("b IS NOT NULL"), seen.where("b IS NULL").select(F.col("a").alias("rep")).distinct()
    if left.limit(1).count():
        left = materialized(left)
        own = materialized(placed.join(broadcast_if_small(left.withColumnRenamed("rep", "_open")), F.col("rep") == F.col("_open"), "left").select("rep", "family", "block", F.col("_open").isNotNull().alias("open")))
        cut = own.where("open").select("family").distinct()
        members = texts.join(cut, "family", "left_semi")
        # Two blocks meet where a group has an open member in one of them and any member in the other, and of both only the
        # members of such groups; a block by itself has been verified. Groups without an open member, and groups of one,
        # ask nothing: they go before anything wider than a key moves.
        alone = materialized(_group_keys(members, width, percent, common))
        asked = alone.join(broadcast_if_small(left), "rep", "left_semi").select("key").distinct()
        near = alone.join(asked, "key", "left_semi")
        shared = near.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
        keys = materialized(near.join(shared, "key", "left_semi").join(broadcast_if_small(own), "rep").select("family", "key", "block", "rep", "open"))
        asks = keys.where("open").select("family", "key", F.col("block").alias("i")).distinct()
        meet = asks.join(keys.select("family", "key", F.col("block").alias("j")).distinct(), ["family", "key"]).where("i <> j")
        pairs = materialized(meet.select("family", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
        at = pairs.select("family", "key", "i", "j", F.explode(F.array("i", "j")).alias("block"))
        both = materialized(keys.join(at, ["family", "key", "block"]).select("family", "i", "j", "rep", "open").distinct())
        both = texts.select(F.col("rep").alias("_rep"), "text").join(broadcast_if_small(both), F.col("rep") == F.col("_rep"))
        both = both.select("family", "i", "j", "rep", "text", "open").repartition(2 * buckets, "family", "i", "j")
        edges = edges.unionByName(both.groupBy("family", "i", "j").applyInPandas(verify_open, "a long, b long"))
    return sets, classes, edges


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets, classes, edges = links(docs, width, percent)
    # rows that repeat a doc_id tie their classes to it
    own = sets.where("n > 0 and doc_id is not null").select("doc_id", "s1", "s2", "n").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"])
    twice = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    component = connected_components(edges.union(own.join(twice.select("doc_id", "a"), "doc_id").select("rep", "a")).union(twice.select("doc_id", "a")))
    out = sets.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left")
    out = out.join(component, F.col("rep") == F.col("node"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id")).alias("component_id")
    )
