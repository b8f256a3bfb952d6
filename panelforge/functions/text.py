"""Flags of the form name:argument, labels, numbers and hashes as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_name(flag: Column) -> Column:
    return F.split_part(flag, F.lit(":"), F.lit(1))


def flag_argument(flag: Column) -> Column:
    return F.nullif(F.split_part(flag, F.lit(":"), F.lit(2)), F.lit(""))


def flag_phrase(flag: Column, phrases: dict[str, str]) -> Column:
    """Phrase of a flag's name with the argument where it has {}; unknown flags are shown with spaces for underscores.

    Two flags have rules of their own: ``path_coverage`` shows its share as a percentage, ``rotates`` writes degrees by their sign.
    """
    name = flag_name(flag)
    argument = F.when(F.instr(flag, ":") > 0, F.regexp_replace(flag, "^[^:]*:", "")).otherwise(F.lit(""))
    shown = F.when(name == "rotates", F.replace(argument, F.lit("deg"), F.lit("°"))).otherwise(argument)
    out = F.replace(flag, F.lit("_"), F.lit(" "))
    for key, phrase in phrases.items():
        out = F.when(name == key, F.replace(F.lit(phrase), F.lit("{}"), shown)).otherwise(out)
    share = F.bround(100 * F.coalesce(argument.try_cast("double"), F.lit(0.0)), 0).cast("long")
    return F.when(name == "path_coverage", F.format_string("growth off the tube (%d%% on it)", share)).otherwise(out)


def safe_name(name: Column, fallback: str = "movie") -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one underscore, dots and underscores at the ends go."""
    out = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def number_text(value: Column) -> Column:
    """Three decimals below ten, one from there on, blank for null."""
    exact = value.cast("decimal(30,9)")
    shown = F.when(F.abs(value) < 10, F.bround(exact, 3).cast("decimal(25,3)").cast("string")).otherwise(F.bround(exact, 1).cast("decimal(25,1)").cast("string"))
    return F.coalesce(shown, F.lit(""))


def value_kind(text: Column) -> Column:
    """Which reading of a text works first: tuple (a comma, or a bracket in front), int, float, bool or text."""
    return (
        F.when(F.contains(text, F.lit(",")) | F.startswith(text, F.lit("(")), "tuple")
        .when(text.try_cast("bigint").isNotNull() & ~F.contains(text, F.lit(".")), "int")
        .when(text.try_cast("double").isNotNull(), "float")
        .when(F.lower(text).isin("true", "false"), "bool")
        .otherwise("text")
    )


def canonical_hash(*parts: Column) -> Column:
    """sha256 of the parts in a fixed order, tab between."""
    return F.sha2(F.concat_ws("\t", *[p.cast("string") for p in parts]), 256)
