"""Typed parameters: overrides given as texts ``name=value``, checked against defaults and read as columns."""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import text

#: Kinds of value that a parameter of a kind takes.
TAKES = {"int": ("int",), "float": ("int", "float"), "bool": ("bool",), "text": ("int", "float", "bool", "text"), "tuple": ("tuple", "int", "float")}
_KIND = {bool: "bool", int: "int", float: "float", str: "text", tuple: "tuple"}


def kinds(defaults: object) -> dict[str, str]:
    """Name and kind of each parameter of a dataclass, by its default value."""
    return {f.name: _KIND[type(getattr(defaults, f.name))] for f in fields(defaults) if type(getattr(defaults, f.name)) in _KIND}


def judged(overrides: DataFrame, column: str, defaults: object) -> DataFrame:
    """overrides with name, value, kind and problem (null: fine; ``no value``, ``unknown``, ``wrong kind``)."""
    known = kinds(defaults)
    at = F.instr(F.col(column), F.lit("="))
    name = F.when(at > 0, F.trim(F.substring(F.col(column), F.lit(1), at - 1))).otherwise(F.trim(F.col(column)))
    value = F.when(at > 0, F.trim(F.substring(F.col(column), at + 1, F.length(column))))
    rows = overrides.withColumn("name", name).withColumn("value", value).withColumn("kind", F.when(F.col("value").isNotNull(), text.value_kind(F.col("value"))))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    allowed = F.create_map(*[x for kind, takes in TAKES.items() for x in (F.lit(kind), F.array(*[F.lit(t) for t in takes]))])
    fits: Column = F.array_contains(F.try_element_at(allowed, F.try_element_at(table, F.col("name"))), F.col("kind"))
    problem = F.when(F.coalesce(F.col("value"), F.lit("")) == "", "no value").when(F.try_element_at(table, F.col("name")).isNull(), "unknown").when(~fits, "wrong kind")
    return rows.withColumn("problem", problem)


def applied(defaults: object, overrides: dict[str, str]) -> object:
    """defaults with overrides read by the kinds of their parameters; an unknown name or an unfit value is an error."""
    if not is_dataclass(defaults):
        raise TypeError("defaults are a dataclass")
    known, out = kinds(defaults), {}
    for name, raw in overrides.items():
        if name not in known:
            raise ValueError(f"unknown parameter {name!r}")
        if known[name] == "bool":
            if raw.lower() not in ("true", "false"):
                raise ValueError(f"{name} is true or false, not {raw!r}")
            out[name] = raw.lower() == "true"
        elif known[name] == "tuple":
            out[name] = tuple(float(x) for x in raw.strip("()").split(",") if x.strip())
        else:
            out[name] = {"int": int, "float": float, "text": str}[known[name]](raw)
    return replace(defaults, **out)
