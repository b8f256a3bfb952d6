"""Small documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, places string, n string, `bucket` string"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return ["w%d" % rng.randrange(size) for _ in range(n)]


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    out: list[tuple[int | None, str | None]] = []
    passage, hot = words(rng, 80), words(rng, 60)
    for k in range(40):
        own = words(rng, rng.randrange(1, 300))
        if k % 4 == 0:
            own[len(own) // 2 : len(own) // 2] = passage[k % 7 : 70]
        if k % 5 == 0:
            own += hot
        out.append((k, " ".join(own)))
    for k in range(40, 60):  # copies and near copies
        own = out[k - 40][1].split(" ")
        if k % 2:
            own[len(own) // 3] = f"new{k}"
        out.append((k, " ".join(own)))
    base = words(rng, 120)
    for k in range(60, 90):  # a chain of near copies
        base = list(base)
        base[(k * 7) % 120] = f"step{k}"
        out.append((k, " ".join(base)))
    out += [(90, None), (91, ""), (92, " \t\n \x0b\f\r"), (93, "one"), (94, "one two"), (95, "one two"), (96, "a b c"), (97, "A B C"), (None, "null id text " * 30), (None, None)]
    out += [(98, "été\n à É  x y 日本語 \U0001f600 ## !!"), (98, "été\n à É  x y 日本語 \U0001f600 ## !!"), (99, out[0][1]), (99, out[1][1])]
    out.append((100, " ".join(words(rng, 30_000, 5000))))
    out.append((101, "same line\n" * 200))
    rng.shuffle(out)
    return out


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    data = [(i, t, "en" if i and i % 2 else "de", None, len(t) if t else None, "r", None, "9", "b") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def split(text: str | None) -> list[str]:
    """Words between space and the characters 9 to 13."""
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})
