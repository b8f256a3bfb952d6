"""Operator 8: quality rules as one native Spark projection.

``RULES`` is a table of (ratio, least, most); it compiles into one boolean
expression over built-in functions, so nothing leaves the JVM and nothing is
shuffled. Defined results: a null text counts as empty; an empty text has
zero counts and fails (too few words); null or repeated ``doc_id`` rows are
each judged on their own; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends a word.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for with was on are as be it this by from at or an a "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les un une que qui dans en du pour par sur est "
    "el los las del se con por para una no su al y"
).split()

#: (name, expression over the counts, least, most); None leaves a side open.
RULES = (
    ("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.1),
    ("shout_ratio", "n_shouts / n_words", None, 0.1),
    ("stop_word_count", "n_stop_words", 2, None),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    ("doubled_word_ratio", "n_doubled / n_words", None, 0.2),
)
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def verdict(rules=RULES) -> Column:
    """All rules as one boolean column over the count columns."""
    out = F.lit(True)
    for _, ratio, least, most in rules:
        if least is not None:
            out = out & (F.expr(ratio) >= F.lit(least))
        if most is not None:
            out = out & (F.expr(ratio) <= F.lit(most))
    return F.coalesce(out, F.lit(False))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Counts, ratios' verdict and base verdict of each row."""
    at = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    at = at.select("doc_id", "t", words(F.col("t")).alias("w"))
    n = F.size("w")
    lines = F.filter(F.split("t", "\n"), lambda line: _without(line, SPACE) != "")
    # (word, next, next but one, place) of each 3-word window, sorted: equal windows stand together
    windows = F.when(
        n >= 3,
        F.sort_array(
            F.slice(
                F.arrays_zip(
                    F.col("w").alias("a"),
                    F.slice("w", F.lit(2), n).alias("b"),
                    F.slice("w", F.lit(3), n).alias("c"),
                    F.sequence(F.lit(0), n - 1).alias("p"),
                ),
                F.lit(1),
                n - 2,
            )
        ),
    )
    at = at.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("t"), SPACE)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(_without(F.col("t"), "!"))).cast("long").alias("n_shouts"),
        lines.alias("lines"),
        F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda x, i: x == F.get(F.col("w"), i + 1))).cast("long").alias("n_doubled"),
        windows.alias("s"),
    )

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    again = F.filter(
        "s",
        lambda x, i: F.coalesce(same(x, F.get(F.col("s"), i + 1)), F.lit(False))
        | F.coalesce((i > 0) & same(x, F.get(F.col("s"), F.greatest(i - 1, F.lit(0)))), F.lit(False)),
    )
    at = at.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x["p"])).alias("places"),
    )
    covered = F.aggregate(
        F.transform(
            "places",
            lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(F.col("places"), F.greatest(i - 1, F.lit(0))))),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    at = at.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return at.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_shouts", "n_stop_words", "n_doubled",
        base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(verdict(rules)).alias("kept"),
    )
