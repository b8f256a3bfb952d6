"""Quality rules, license scan and packing against plain Python."""

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import license_scan, packing, quality_rules, queries
from panelforge.session import ship
from tests.llm.fixtures import frame, lower, split, texts

LICENSE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"


def scanned():
    extra = [
        (200, "Under the MIT License. under-the-mit-license; UNDER the\nmit license"), (201, "apache license, version 2"), (202, "cc by nc cc by nc"), (203, "under the mit licenses"),
        (204, "x " * 500 + LICENSE + " y" * 500), (205, LICENSE.replace("free of charge", "free of every charge")), (206, " ".join(LICENSE.split()[:8])), (207, "ünder the mit license under the mit\x7flicense"),
        (200, "Under the MIT License. under-the-mit-license; UNDER the\nmit license"),
    ]
    return texts() + extra


def test_license_base_columns_and_spans(spark):
    rows = scanned()
    got = sorted((tuple(r)[:6] for r in license_scan.license_scan(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        at = [(p, label) for phrase, label in license_scan.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        want.append((i, len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)
    more = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert more[204] == ("mit", 1.0) and more[205][0] == "mit" and 0.6 < more[205][1] < 1 and more[206] == ("", 0.0)
    assert all(0 <= s <= 1 for _, s in more.values())


def test_license_plan_is_native(spark):
    plan = license_scan.license_scan(frame(spark, scanned()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_quality_rules_equal_python(spark):
    rows = texts() + [(300, "the of and to # * $ word " * 20), (301, "ab ab ab ab " * 30)]
    got = sorted((tuple(r)[:6] + (r["base_failed"],) for r in quality_rules.quality_rules(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        windows = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        again = {q for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
        want.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert got == sorted(want, key=str)


def test_quality_rules_are_one_projection(spark):
    plan = quality_rules.quality_rules(frame(spark, texts()))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Aggregate \\[|Window", plan)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def word_tokens():
    return packing.WordTokens(queries.tokenizer_file("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x1c\x85 　́​<>|[]CLSé' aAzZ09.,")), max_size=60))
def test_word_tokens_equal_whole_text(tokenizer, word_tokens, text):
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert word_tokens.of(text.encode()) == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "STRETCH_BYTES", 7)
        assert word_tokens.of(text.encode()) == want


@pytest.mark.parametrize("partitions", [1, 4])
def test_packing_keeps_every_token_once(spark, tokenizer, partitions):
    ship(spark)
    rows = texts()
    docs = frame(spark, rows).repartition(partitions)
    got = packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json")).collect()
    ids = Counter()
    for i, t in rows:
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        ids[(i, len(x))] += 1
        mine = [r for r in got if r["doc_id"] == i and r["doc_tokens"] == len(x)]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in mine)
    for (i, n), times in ids.items():
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i and r["doc_tokens"] == n)
        cover = np.zeros(n, int)
        for a, size in mine:
            cover[a : a + size] += 1
        assert (cover == times).all()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_of_empty_table(spark):
    ship(spark)
    assert packing.pack(frame(spark, texts()).where("false"), queries.tokenizer_file("word_bpe_49k.json")).count() == 0


def test_sum_of_squares_choice_is_the_best():
    """Each placement makes the sum of squared level counts as small as any placement could."""
    rng = np.random.default_rng(4)
    packer = packing.SumOfSquares(20, iter(range(10**6)).__next__)
    for k in range(400):
        size = int(rng.integers(1, 20))
        before = packer.count[1:20].copy()
        options = []
        for level in range(0, 20):
            if level + size > 20 or (level and not before[level - 1]):
                continue
            c = before.copy()
            if level:
                c[level - 1] -= 1
            if level + size < 20:
                c[level + size - 1] += 1
            options.append(int((c**2).sum()))
        list(packer.place((k, 0, size, size, b"\0" * 4 * size)))
        assert int((packer.count[1:20] ** 2).sum()) == min(options)


def test_placement_closes_nearly_all_windows():
    """Full windows have no padding, few are left open whatever the input, and the least sum of squares is chosen among what a cut of less than a level allows."""
    rng = np.random.default_rng(6)
    packer, placed, at = packing.SumOfSquares(2048, iter(range(10**6)).__next__), 0, Counter()
    for k, size in enumerate(np.minimum(2047, rng.lognormal(5.5, 1.2, 5000).astype(int) + 1).tolist()):
        for _, pieces in packer.place((k, 0, size, size, b"\0" * 4 * size)):
            placed += 1
            assert sum(p[2] for p in pieces) == 2048
            at.update({(p[0], p[1]): p[2] for p in pieces})
    still = [p for level in packer.open for _, pieces in level for p in pieces]
    at.update({(p[0], p[1]): p[2] for p in still})
    ends = {}
    for (k, start), n in sorted(at.items()):
        assert ends.get(k, 0) == start
        ends[k] = start + n
    assert len(ends) == 5000 and packer.count.sum() <= 3 * packing.LEVELS
    closed = list(packer.close())
    assert placed >= 0.95 * (placed + len(closed)) and not packer.count.any()


def test_other_vocabularies_take_texts_whole(tokenizer, word_tokens, tmp_path):
    made = json.loads(tokenizer.to_str())
    made["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(made))
    other, text = packing.WordTokens(str(tmp_path / "other.json")), "Some Words, IN capitals"
    assert word_tokens.by_words and not other.by_words
    assert np.frombuffer(other.of(text.encode()), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


def test_tables_of_the_queries_match_sql(spark):
    from tests.oracle import DATA, run_sql, same_kind

    for name, sql in queries.ORACLE_SQL.items():
        same_kind(queries.QUERIES[name](spark, DATA), *run_sql(sql))


def test_words_hash_like_python():
    from panelforge.llm.textnum import Words

    col = pa.array(["a b  a", None, "", "\tb é", "x" * 5000])
    w = Words(col)
    assert w.counts.tolist() == [3, 0, 0, 2, 1]
    h = w.hashes[0]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
