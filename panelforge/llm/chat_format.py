"""Operator 12: chat formatting by a role machine and a declarative template, in built-in Spark functions alone.

A template says for each role what stands before and after a text and whether
the text carries loss; for the order of roles it gives the transitions of a
finite-state machine. Every mark of the template is a control string. In texts
(and in names of roles without a line of their own) the first character of a
control string becomes an entity, and ``&`` becomes ``&amp;``, so that a
formatted conversation holds control strings only where the template put them,
and ``read_back`` gives the very texts again.

Defined results: rows go by turn (nulls first), then role, then text; null
texts and roles are empty; repeated rows are repeated turns; rows with a null
conversation id form one conversation; a conversation whose order the machine
refuses is formatted too, with ``valid`` false and the place of the first turn
refused (the number of turns, if it only ends too soon); an empty table gives no
rows; texts of any length pass whole, a conversation being one value (that its
one group is a row of the result is the operator's sense); extra columns are
ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = {"<": "&lt;", "[": "&#91;"}


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks of any other role (its name goes before ``named``), and the machine over roles."""

    roles: dict[str, Turn] = field(
        default_factory=lambda: {"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", True)}
    )
    other: Turn = Turn("[TURN] ", " [/TURN]")
    named: str = " [TEXT] "
    start: str = "start"
    next: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked", ("start", "user"): "heard", ("asked", "user"): "heard",
            ("heard", "assistant"): "answered", ("answered", "user"): "heard",
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        for mark in self.controls():
            if mark[:1] not in ENTITIES or any(c in mark[1:] for c in (*ENTITIES, "&")):
                raise ValueError(f"a control string begins with < or [ and holds no other of < [ &: {mark!r}")

    def controls(self) -> list[str]:
        return [m.strip() for t in (*self.roles.values(), self.other) for m in (t.before, t.after)] + [self.named.strip()]


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return reduce(lambda at, mark: F.replace(at, F.lit(mark), F.lit(ENTITIES[mark[0]] + mark[1:])), template.controls(), text)


def unescape(text: Column) -> Column:
    for char, entity in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _refused(turns: Column, template: Template) -> Column:
    """Place of the first turn that the machine refuses, the number of turns if it ends in a state it does not accept, else null."""
    table = F.create_map(*[F.lit(x) for (state, role), then in template.next.items() for x in (f"{state}>{role}", then)])
    state = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("done"))

    def step(at: Column, turn: Column) -> Column:
        then = F.when(at["state"].isNotNull(), F.try_element_at(table, F.concat(at["state"], F.lit(">"), turn["role"])))
        return F.struct(then.alias("state"), (at["done"] + F.when(then.isNotNull(), 1).otherwise(0)).alias("done"))

    end = F.aggregate(turns, state, step)
    return F.when(F.coalesce(end["state"].isin(*template.accept), F.lit(False)), None).otherwise(end["done"])


def _segments(turn: Column, template: Template) -> Column:
    def row(before: Column, after: str, loss: bool) -> Column:
        parts = ((before, False), (turn["text"], loss), (F.lit(after), False))
        return F.array(*[F.struct(text.alias("text"), F.lit(flag).alias("loss")) for text, flag in parts])

    out = row(F.concat(F.lit(template.other.before), turn["shown"], F.lit(template.named)), template.other.after, template.other.loss)
    for role, t in template.roles.items():
        out = F.when(turn["role"] == role, row(F.lit(t.before), t.after, t.loss)).otherwise(out)
    return out


def chat_format(
    rows: DataFrame, template: Template = CHAT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, segments (text, loss), formatted (the segments' texts joined), valid, refused_at: one shuffle by conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    shown = F.when(~role.isin(*template.roles), escape(role, template))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), escape(text, template).alias("text"), shown.alias("shown"))
    at = rows.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = at.select("conv_id", F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"), _refused(F.col("turns"), template).alias("refused_at"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return at.select("conv_id", "segments", joined.alias("formatted"), F.col("refused_at").isNull().alias("valid"), "refused_at")


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Turns (role, text) of a formatted conversation."""
    lines = [*template.roles.values(), template.other]
    pattern = "(?s)" + "|".join(f"{_literal(t.before)}.*?{_literal(t.after)}" for t in lines)

    def turn(found: Column) -> Column:
        def inside(t: Turn) -> Column:
            return F.substring(found, F.lit(len(t.before) + 1), F.length(found) - len(t.before) - len(t.after))

        other, named = inside(template.other), F.lit(template.named)
        at = F.instr(other, named)
        out = F.struct(unescape(F.substring(other, F.lit(1), at - 1)).alias("role"), unescape(F.substring(other, at + len(template.named), F.length(other))).alias("text"))
        for role, t in template.roles.items():
            out = F.when(F.startswith(found, F.lit(t.before)), F.struct(F.lit(role).alias("role"), unescape(inside(t)).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def _literal(text: str) -> str:
    return re.sub(r"([\[\]()*+?.^$|\\{}])", r"\\\1", text)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as the conversation had it."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
