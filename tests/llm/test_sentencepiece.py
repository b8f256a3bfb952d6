"""Sampled segmentations: lossless, reproducible, and distributed as the lattice says."""

import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import queries
from panelforge.llm import sentencepiece_sampling as sps
from panelforge.session import ship
from tests.llm.fixtures import frame, texts


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice(model):
    return sps.Lattice(model, 1.0)


def test_round_trip_and_seed(spark, model):
    ship(spark)
    docs = frame(spark, texts() + [(700, " ▁ ▁▁ a"), (701, "\n\n  \t x\r\n"), (702, "日本 \U0001f600\u0000")])
    once = sps.decode(sps.encode(docs, model), model).collect()
    assert len(once) == docs.count() and all(r["text"] == r["decoded"] for r in once)
    assert all((r["ids"] is None) == (r["text"] is None) for r in once)
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"]), str(r["ids"])) for r in rows)
    again = sps.encode(docs.repartition(2), model).collect()
    assert key(once) == key(again)
    other = sps.encode(docs, model, seed=1).collect()
    assert key(once) != key(other)
    assert sps.encode(docs.where("false"), model).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(lattice, text):
    ids, counts = lattice.sample([text], np.array([5]), 0)
    assert counts[0] == len(ids)
    assert lattice.decode(ids).decode("utf-8", "surrogatepass") == text


def test_sampling_follows_the_lattice(lattice, model):
    """Shares of whole segmentations over many keys equal products of piece weights, by listing them all."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    word, n = "there", 6000
    full = "▁" + word
    weight = {}
    for cuts in itertools.product([0, 1], repeat=len(full) - 1):
        parts, start = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(full[start:k])
                start = k
        ids = tuple(sp.piece_to_id(p) for p in parts)
        if all(sp.id_to_piece(i) == p for i, p in zip(ids, parts)):
            weight[ids] = float(np.exp(sum(-np.log(100.0 - sp.get_score(i)) for i in ids)))
    total = sum(weight.values())
    ids, counts = lattice.sample([word] * n, np.arange(n), 0)
    seen = Counter(tuple(x) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(weight)
    for got, w in weight.items():
        p = w / total
        assert abs(seen[got] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\u00e9\u2581", min_size=1, max_size=120), st.integers(1, 30))
def test_long_texts_in_stretches_give_the_same(lattice, text, limit):
    assert "".join(sps.stretches(text, limit)) == text
    assert lattice.sample_long(text, 3, 0, limit).tolist() == lattice.sample([text], np.array([3]), 0)[0].tolist()
