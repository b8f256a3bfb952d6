"""Each stage of the pipeline against brute force on the same input, and the entry file without the subpackage."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import queries
from tests.llm.fixtures import frame, split, texts
from tests.llm.test_pairs import brute_components

ROOT = Path(__file__).parents[2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of odd rows: nulls, empty texts, copies, repeated ids, extra columns."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = frame(spark, texts())
    docs.write.parquet(f"{d}/documents.parquet")
    docs.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 5 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(f"{d}/labels.parquet")
    return d


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_keep_columns_and_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "language_id", "ngram_jaccard_join", "substring_dedup", "packing"]

    kept = stages["ngram_jaccard_join"](spark, docs, sf)
    component = {i: c for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert kept.columns == columns
    assert rows(kept) == [x for x in rows(docs) if x[0] is None or component[x[0]] == x[0]]

    cut = stages["substring_dedup"](spark, docs, sf)
    assert cut.columns == columns and cut.count() == docs.count()
    first = {}
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in data:
        w = split(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t in data:
        w, gone = split(t), set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want.append((i, " ".join(x for q, x in enumerate(w) if q not in gone) if gone else t))
    assert rows(cut) == sorted(want, key=str)
    assert all(r["n_chars"] is None or r["n_chars"] == len(r["text"] or "") for r in cut.select("n_chars", "text").collect())

    for name in ("quality_classifier", "language_id"):
        part = stages[name](spark, docs, sf)
        assert part.columns == columns and set(rows(part)) <= set(rows(docs))
        assert stages[name](spark, docs.where("false"), sf).count() == 0


def test_near_copies_between_the_thresholds_go(spark, tmp_path):
    """80 % or more by five words goes, less stays."""
    own = [[f"d{d}w{k}" for k in range(200)] for d in range(6)]
    longer = [*own[0], *(f"more{k}" for k in range(40))]  # 196 of 236 shingles: 0.83
    changed = [f"new{k}" if k in (30, 90, 150, 180) else w for k, w in enumerate(own[1])]  # 176 of 216: 0.81; by three words 0.89
    cut = own[2][:165]  # 161 of 196: 0.82
    apart = own[3][:150]  # 146 of 196: 0.74
    docs = [(d, " ".join(w)) for d, w in enumerate(own)] + [(10 + d, " ".join(w)) for d, w in enumerate((longer, changed, cut, apart))]
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, frame(spark, docs), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(6), 13]


def test_run_ends_in_pieces_of_what_the_stages_kept(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    total = 0
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert any(x["doc_id"] == r["doc_id"] and x["doc_tokens"] == len(ids) and zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) == x["ids_crc32"] for x in got)
    assert sum(x["length"] for x in got) == total


def test_entry_without_the_subpackage(tmp_path):
    code = f"""
import sys
sys.path[:0] = ['{ROOT}']
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('panelforge.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(x.startswith('op') and x[2].isdigit() for x in e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
