"""N-gram join and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import blobs, ngram_join, substring_dedup
from panelforge.session import ship
from tests.llm.fixtures import frame, lower, split, texts, words


def shingles(text, width=3):
    w = split(lower(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, width=3, percent=90):
    """By exact sets: (doc_id, set size, least doc_id reachable); rows of one doc_id hang together."""
    sets = [shingles(t, width) for _, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    live = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for n, a in enumerate(live):
        for b in live[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return sorted(((i, len(s), None if i is None else i if not s else root(i)) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("blocks", [(1000, 1_000_000), (3, 400)])
def test_components_equal_brute_force(spark, monkeypatch, blocks):
    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks[1])
    rows = texts()
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_one_group_of_near_copies_and_one_long_chain(spark):
    """5000 copies of one text with a word changed are one component; a chain links from end to end though its ends share nothing."""
    ship(spark)
    rng = random.Random(8)
    base = words(rng, 200, 5000)
    rows = [(k, " ".join(base[:100] + [f"x{k}"] + base[101:])) for k in range(5000)]
    step = words(rng, 120, 5000)
    for k in range(3000):
        step[(7 * k) % 120] = f"step{k}"
        rows.append((10_000 + k, " ".join(step)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert len(got) == 8000 and all(c == (0 if i < 5000 else 10_000) for i, c in got.items())


@pytest.mark.parametrize("blocks", [(1000, 1_000_000), (3, 400), (7, 3000)])
def test_components_at_five_words_and_80_percent(spark, monkeypatch, blocks):
    """Also where passages tie texts of many clusters into families of many blocks."""
    ship(spark)
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks[1])
    rng, rows = random.Random(4), texts(4)
    shared = [words(rng, 90, 5000) for _ in range(3)]
    for cluster in range(25):
        own = words(rng, rng.randrange(20, 70), 5000)
        for copy in range(rng.randrange(1, 7)):
            text = [*own[:10], *shared[cluster % 3], *own[10:]]
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"c{cluster}k{copy}n{rng.randrange(99)}"
            rows.append((1000 + 10 * cluster + copy, " ".join(text)))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows), width=5, percent=80).collect()), key=str)
    assert got == brute_components(rows, 5, 80)


def test_near_copies_and_a_long_chain_at_five_words_and_80_percent(spark):
    ship(spark)
    rng = random.Random(8)
    base = words(rng, 200, 5000)
    rows = [(k, " ".join(base[:100] + [f"x{k}"] + base[101:])) for k in range(4000)]
    step = words(rng, 120, 5000)
    for k in range(3000):
        step[(7 * k) % 120] = f"step{k}"
        rows.append((10_000 + k, " ".join(step)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, rows), width=5, percent=80).collect()}
    assert len(got) == 7000 and all(c == (0 if i < 5000 else 10_000) for i, c in got.items())


def test_components_of_empty_table(spark):
    ship(spark)
    assert ngram_join.jaccard_components(frame(spark, texts()).where("false")).count() == 0


@pytest.mark.parametrize("n", [5, 8, 9, 10, 11, 13, 19, 20, 60, 400])
def test_linked_sets_share_a_prefix(n):
    """Every pair at the threshold or above has a grouped prefix in common."""
    rng = np.random.default_rng(n)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        changed = rng.integers(0, n // 10 + 2)
        b = np.unique(np.concatenate([a[: len(a) - changed], rng.integers(0, 1 << 63, rng.integers(0, n // 10 + 2), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        keys = [set(ngram_join.prefix_keys(x, np.array([len(x)]), 90)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("n", [4, 5, 8, 13, 20, 60, 400])
def test_linked_sets_share_a_prefix_at_80_percent(n):
    """Also where most shingles are common."""
    rng = np.random.default_rng(n)
    for k in range(300):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        changed = rng.integers(0, n // 5 + 2)
        b = np.unique(np.concatenate([a[: len(a) - changed], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 2), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        common = np.sort(rng.permutation(a)[: len(a) * (k % 5) // 4])
        keys = [set(ngram_join.prefix_keys(x, np.array([len(x)]), 80, common)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_a_common_line_ties_few_texts_at_80_percent():
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    sets = [np.unique(np.concatenate([line, rng.integers(0, 1 << 63, 300, dtype=np.uint64)])) for _ in range(300)]
    row, key = ngram_join.prefix_keys(np.concatenate(sets), np.array([len(x) for x in sets]), 80, np.sort(line))
    rows_of = defaultdict(set)
    for r, k in zip(row.tolist(), key.tolist()):
        rows_of[k].add(r)
    assert len(set().union(*[x for x in rows_of.values() if len(x) > 1])) < 10


def test_texts_with_a_few_shingles_in_common_do_not_meet():
    """Every two of 300 sets share eight of 2000 shingles, each by another choice: not one pair in a hundred may have a key in common."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) << np.uint64(1)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**64, 1820, dtype=np.uint64), rng.choice(pool, 180, replace=False)])) for _ in range(300)]
    row, key = ngram_join.prefix_keys(np.concatenate(sets), np.array([len(x) for x in sets]), 80)
    met = defaultdict(set)
    for r, k in zip(row.tolist(), key.tolist()):
        met[k].add(r)
    pairs = {(a, b) for x in met.values() if len(x) > 1 for a in x for b in x if a < b}
    assert len(pairs) < 300 * 299 / 2 / 100


@pytest.mark.parametrize("size", [12, 24, 36, 60, 150, 400, 1500])
def test_linked_sets_share_a_key(size):
    """Pairs at the threshold, of equal and of unequal sizes, some with many shingles that the sample knows."""
    rng = np.random.default_rng(size)
    common = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    for known in (0, size // 10, size // 2):
        for _ in range(60):
            both = np.concatenate([rng.integers(0, 2**64, size - known, dtype=np.uint64), rng.choice(common, min(known, 400), replace=False)])
            more = len(both) * 20 // 80
            left = int(rng.integers(0, more + 1))
            extra = rng.integers(0, 2**64, more, dtype=np.uint64)
            pair = [np.unique(np.concatenate([both, x])) for x in (extra[:left], extra[left:])]
            assert 100 * len(both) >= 80 * len(np.union1d(*pair))
            one, two = (set(ngram_join.prefix_keys(x, np.array([len(x)]), 80, common)[1].tolist()) for x in pair)
            assert one & two


def brute_dedup(rows, window=50):
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = split(t)
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first[k], i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone.update(range(p, p + window))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_equals_brute_force(spark):
    ship(spark)
    rows = texts()
    got = substring_dedup.substring_dedup(frame(spark, rows))
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(rows)
    assert any(r[2] for r in got)


def test_dedup_of_empty_table_and_rest(spark):
    ship(spark)
    docs = frame(spark, texts())
    assert substring_dedup.substring_dedup(docs.where("false")).count() == 0
    got = substring_dedup.substring_dedup(docs, rest=("n", "places", "rest"))
    assert got.select("rest.n").distinct().collect()[0][0] == "9" and got.count() == docs.count()


def test_repeated_id_with_a_null_and_a_text(spark):
    ship(spark)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage + " a"), (2, None), (2, "b " + passage), (3, "c d"), (4, None), (None, passage)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(rows)


def test_dedup_shuffles_texts_once(spark):
    """Both joins by document read one exchange of the texts."""
    ship(spark)
    got = substring_dedup.substring_dedup(frame(spark, texts()))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_spans_are_the_removed_runs(spark):
    ship(spark)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage), (2, f"a b {passage} c {passage}")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(2, 60), (63, 60)]}


@pytest.mark.parametrize("n", [1, 3, 1000, 300_000])
def test_sorted_keys_return(n):
    rng = np.random.default_rng(n)
    bucket, keys = blobs.bucket_and_key(np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)), 3)
    got = {k: blobs.read_sorted(p) for k, p in blobs.deal_sorted(bucket, keys)}
    assert got.keys() == set(bucket.tolist()) and all(np.array_equal(got[k], np.unique(keys[bucket == k])) for k in got)


@pytest.mark.parametrize("at", [0, 1, 24, 25, 26, 49, 50, 51])
def test_passage_at_any_offset(spark, at):
    ship(spark)
    passage = [f"p{k}" for k in range(50)]
    rows = [(1, " ".join([f"a{k}" for k in range(at)] + passage)), (2, " ".join(passage[1:] + ["x"] + passage + ["y"]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 50}


@pytest.mark.parametrize("chunk", [1, 400, 1 << 20])
def test_dedup_whatever_the_chunks(spark, monkeypatch, chunk):
    """Header at one offset in every text, copies, passages at many offsets, a text that repeats itself."""
    ship(spark)
    header, passage = " ".join(f"h{k}" for k in range(60)), " ".join(f"p{k}" for k in range(55))
    rows = [(k, f"lead{k} {header} own{k} " + f"pad{k} " * (k % 26) + passage) for k in range(30)] + [(k, f"same text {header} {passage}") for k in range(30, 36)]
    rows += [(40, "again and again " * 60), (41, "and again again " * 60)]
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", 2 * chunk)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_dedup(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_verification_ties_what_all_pairs_tie(percent):
    rng = np.random.default_rng(percent)

    def labels(n, edges):
        label = list(range(n))
        for _ in range(n):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        return label

    for trial in range(60):
        base = [rng.choice(400, rng.integers(1, 60), replace=False).tolist() for _ in range(3)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            own = set(base[rng.integers(3)])
            own ^= set(rng.choice(sorted(own), min(len(own) - 1, rng.integers(0, 5)), replace=False).tolist()) | set(rng.integers(400, 500, rng.integers(0, 4)).tolist())
            sets.append(np.array(sorted(own), np.uint64))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        settled = rng.random(len(sets)) < 0.3 if trial % 2 else None
        tied = [(int(np.flatnonzero(settled)[0]), int(x)) for x in np.flatnonzero(settled)] if settled is not None and settled.any() else []
        got = ngram_join.linked(sets, percent, settled)
        assert {(max(e), min(e)) for e in got} <= set(pairs)
        assert labels(len(sets), got + tied) == labels(len(sets), pairs + tied)
        if pairs:
            node, least = ngram_join.stars(*np.array(pairs).T)
            assert dict(zip(node.tolist(), least.tolist())) == {x: y for x, y in enumerate(labels(len(sets), pairs)) if x != y}
