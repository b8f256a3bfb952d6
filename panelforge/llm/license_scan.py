"""Operator 5: license scan by diagonal voting, all native Spark.

Every rolling word k-gram of every text is joined by hash (and then by its
words) to the positions of the same k-gram in the license templates. Hits
vote for their offset diagonal (text position minus template position);
diagonals are counted, near ones merged, and the merged spans verified by the
share of template k-grams that they hold and by their length. The template
side of the join has a fixed size (``TEMPLATES``, some hundred k-grams), so it
is broadcast; the text side is never shuffled, only its hits are.

Defined results: a null text counts as empty; a text of fewer than k words has
no label; rows with the same doc_id but other texts are scanned apart; a row
that stands twice is returned twice; null ids are kept; extra columns ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Opening passages of public licenses, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of 0-9, a-z and characters from \\x80 on."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _grams(df: DataFrame, keys: list[str], place: str, gram: str) -> DataFrame:
    """One row for each k-gram of the column w: keys, place, hash and words."""
    n = F.size("w")
    zipped = F.arrays_zip(*[F.slice("w", F.lit(k + 1), n).alias(f"w{k}") for k in range(K)])
    out = df.where(n >= K).select(*keys, F.posexplode(F.slice(zipped, F.lit(1), n - (K - 1))).alias(place, gram))
    return out.select(*keys, place, *[F.col(f"{gram}.w{k}").alias(f"{gram}{k}") for k in range(K)]).withColumn(
        f"{gram}_hash", F.xxhash64(*[f"{gram}{k}" for k in range(K)])
    )


def templates(spark: SparkSession, phrases=PHRASES, texts=TEMPLATES) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("is_base"), F.lit(text).alias("t"))
        for i, (text, label) in enumerate([*phrases, *texts])
    ]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    one = one.select("tid", "label", "is_base", words(F.col("t")).alias("w"))
    return _grams(one.withColumn("t_grams", F.size("w") - (K - 1)), ["tid", "label", "is_base", "t_grams"], "t_at", "g")


def license_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, texts=TEMPLATES,
    least_cover: float = 0.6, drift: int = 4,
) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, is_base, start, stop (words), cover (0 to 1)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    grams = _grams(d, ["doc_id", "text_hash"], "at", "d")
    t = F.broadcast(templates(docs.sparkSession, phrases, texts))
    same = F.col("d_hash") == F.col("g_hash")
    for k in range(K):
        same = same & (F.col(f"d{k}") == F.col(f"g{k}"))
    hits = grams.join(t, same).select("doc_id", "text_hash", "tid", "label", "is_base", "t_grams", "t_at", (F.col("at") - F.col("t_at")).alias("diagonal"))
    key = ["doc_id", "text_hash", "tid", "label", "is_base", "t_grams"]
    votes = hits.groupBy(*key, "diagonal").agg(F.collect_set("t_at").alias("held"))  # a template's positions at most
    # a phrase must stand whole on one diagonal; runs of near diagonals are one span of a template
    votes = votes.where(F.when(F.col("is_base"), F.size("held") == F.col("t_grams")).otherwise(F.size("held") >= 2))
    by = Window.partitionBy("doc_id", "text_hash", "tid").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(by) > drift)).cast("int"))
    votes = votes.withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(by))
    spans = votes.groupBy(*key, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n"),
        F.min(F.col("diagonal") + F.array_min("held")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("held") + K).alias("stop"),
    )
    spans = spans.withColumn("cover", F.col("n") / F.col("t_grams"))
    whole = (F.col("cover") >= least_cover) & (F.col("stop") - F.col("start") <= 1.25 * (F.col("t_grams") + K - 1))
    return spans.where(F.col("is_base") | whole).select("doc_id", "text_hash", "label", "is_base", "start", "stop", "cover")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: word and phrase counts, first and last place, labels, score."""
    spans = license_spans(docs, id_col, text_col, **options)

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(which)), ",")

    base = F.col("is_base")
    found = spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("cover").alias("score"),
    )
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = d.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
