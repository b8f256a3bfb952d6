"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as
Parquet into shared storage and reads it back as the next one's docs. All
stages but the last return the columns of documents. Other columns of the
input go through; their values never steer a stage. A document with a null id
stays in its place, except that a row counts as near copy of none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import language_id, ngram_join, packing, quality_classifier, queries, substring_dedup
from panelforge.llm.common import materialized, table
from panelforge.session import ship


NEAR_WORDS, NEAR_PERCENT = 5, 80


def _columns(got: DataFrame, docs: DataFrame, new: dict | None = None) -> DataFrame:
    """The columns of docs out of doc_id, text and the struct rest; ``new`` replaces some."""
    return got.select(*[(new or {}).get(c, F.col(c if c in ("doc_id", "text") else f"rest.`{c}`")).alias(c) for c in docs.columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1."""
    ship(spark)
    stats = materialized(quality_classifier.document_statistics(docs))
    model = quality_classifier.fit_documents(stats, table(spark, sf_dir, "labels"), queries.remainder(3) != 1)
    return _columns(quality_classifier.score_documents(docs, model, rest=_others(docs)).where("score >= 0.5"), docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: neither ``und`` nor a near tie between languages."""
    ship(spark)
    model = language_id.fit(docs.where(queries.remainder(5) != 0))
    return _columns(language_id.language_id(docs, model, rest=_others(docs)).where("lang_pred <> 'und' AND score >= 0.4"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five words and a similarity of 0.8 or more (operator 9 itself: three and 0.9)."""
    ship(spark)
    groups = ngram_join.jaccard_components(docs, width=NEAR_WORDS, percent=NEAR_PERCENT).where("component_id IS NULL OR component_id = doc_id")
    kept = groups.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document holds; untouched texts keep their white space."""
    ship(spark)
    got = substring_dedup.substring_dedup(docs, rest=_others(docs))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("rest.n_chars"))
    return _columns(got, docs, new)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    ship(spark)
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", passages),
    ("packing", pack),
]

#: Trained models and a tokenizer have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
