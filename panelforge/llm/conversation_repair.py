"""Operator 11: conversation repair by a forward Viterbi walk over four grammar states.

A repaired conversation's roles read ``(s?(ua)+)?``. Edits of a row are Keep
(0), Rerole to user or assistant (3) and Delete (4); empty-text turns may be
Inserted anywhere (3); a truncated row that stays adds 3; blank and duplicate
rows must go. A layer holds for each grammar state (nothing yet, after system,
after user, after assistant) the least (cost, audit); each row's layer is closed
by at most two inserts, for a third never pays. The cost of an audit follows
from its letters, so two audits of one layer with equal costs never are prefixes
of each other, and the ASCII-least stays least whatever follows both.

The walk needs no text: rows travel as (id, turn, role, md5 of the text, fault),
ranges of them are walked side by side, and a conversation that spans several
ranges is put together from their transfers (a range's least audit from each
state to each state). Texts are shuffled once, to be replayed with the audit:
one conversation streams through one task in turn, for SHA-256 has no other
way, but never lies in memory.

Defined results: nulls in role and text count as one space, so null texts are
blank; rows with null turns come first; rows of one turn stand by role, then by
the md5 of the text; a role without an initial cannot be kept; repeated rows are
duplicates; null ids form one conversation; ids without rows give zeros, an
empty audit and the hash of nothing; an empty table gives no rows; texts of any
length pass whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept row of an initial.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: State after an inserted or reroled turn.
FORCED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: WORTH[q][p]: what state q pays at most over state p for the best of any future (deleting a system turn 4, inserting 3 each).
WORTH = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
FINE, BLANK, CUT, DUPLICATE = range(4)
STRIP_EVERY = 256

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "truncated", "duplicate", "illegal", "turns")
_TRANSFER = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64())]
    + [(c, pa.int64()) for c in (*_COUNTS, "least_turn", "last_turn")]
    + [("first_initial", pa.string()), ("last_initial", pa.string()), ("transfer", _TRANSFER)]
)
_PIECE = (
    "conv_id long, piece long, blank long, truncated long, duplicate long, illegal long, turns long, least_turn long, last_turn long, "
    "first_initial string, last_initial string, transfer array<struct<`from`: long, `to`: long, cost: long, audit: string>>"
)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32(id:turn) % 20: 0 drops, 1 empties, 2 unpunctuates, 3 repeats, 4 makes a user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)]
    kind = F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return (
        rows.select(
            F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), kind.alias("kind"),
            F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        )
        .where("kind <> 0")
        .select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))).alias("copy"))
        .drop("copy")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("h", _digest(F.col("text")))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: conv_id, turn, role, h, copies, fault (of the first copy), in no order.

    Copies collapse in a partial aggregation; only (conversation, role, text) groups with more than one turn are joined back.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    # the text's last character other than white space
    one = rows.select("conv_id", "turn", "role", "h", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT).alias("own"))
    each = one.groupBy("conv_id", "turn", "role", "h", "own").agg(F.count(F.lit(1)).alias("copies"))
    again = (
        each.groupBy("conv_id", "role", "h")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("turn").isNull()).alias("open"), F.min("turn").alias("first"))
        .where("n > 1")
        .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "open", "first")
    )
    met = each.join(again, each.conv_id.eqNullSafe(F.col("c")) & (each.role == F.col("r")) & (each.h == F.col("g")), "left")
    later = F.col("turn").isNotNull() & F.coalesce(F.col("open") | (F.col("turn") > F.col("first")), F.lit(False))
    return met.select("conv_id", "turn", "role", "h", "copies", F.when(later & (F.col("own") != BLANK), DUPLICATE).otherwise(F.col("own")).alias("fault"))


class Walk:
    """Least (cost, audit) of each state over the rows so far; what all live audits share is set aside, what can never win goes."""

    def __init__(self, start: int | None = None):
        self.layer: list[tuple[int, str] | None] = [None] * 4
        self.layer[start or START] = (0, "")
        self.head: list[str] = []
        self.rows = 0
        if start is None:
            self.close()

    def close(self) -> None:
        layer = self.layer
        for p in range(4):  # in this order one sweep makes every chain of two inserts
            if layer[p]:
                new, q = (layer[p][0] + INSERT, layer[p][1] + "I"), FORCED[p]
                if layer[q] is None or new < layer[q]:
                    layer[q] = new

    def step(self, initial: str, fault: int) -> None:
        layer: list[tuple[int, str] | None] = [None] * 4
        extra = TRUNCATED if fault == CUT else 0

        def put(q: int, cost: int, audit: str) -> None:
            if layer[q] is None or (cost, audit) < layer[q]:
                layer[q] = (cost, audit)

        for p, held in enumerate(self.layer):
            if held is None:
                continue
            cost, audit = held
            put(p, cost + DELETE, audit + "D")
            if fault != BLANK and fault != DUPLICATE:
                if (p, initial) in AFTER:
                    put(AFTER[p, initial], cost + KEEP + extra, audit + "K")
                put(FORCED[p], cost + REROLE + extra, audit + "R")
        self.layer = layer
        self.close()
        layer = self.layer
        for p in range(4):
            if layer[p] and any(layer[q] and layer[q][0] + WORTH[q][p] < layer[p][0] for q in range(4)):
                layer[p] = None
        self.rows += 1
        if self.rows % STRIP_EVERY == 0:
            shared = os.path.commonprefix([x[1] for x in layer if x])
            self.head.append(shared)
            self.layer = [x and (x[0], x[1][len(shared) :]) for x in layer]

    def ends(self) -> list[tuple[int, int, str]]:
        head = "".join(self.head)
        return [(q, x[0], head + x[1]) for q, x in enumerate(self.layer) if x]


class _Piece:
    """What a range of rows knows of one conversation; ``sure`` if the conversation starts in it."""

    def __init__(self, conv: int | None, sure: bool):
        self.conv, self.sure = conv, sure
        self.walks = [Walk()] if sure else [Walk(p) for p in range(4)]
        self.n = dict.fromkeys(_COUNTS, 0)
        self.least = self.last = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, fault: int, copies: int) -> None:
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.n["turns"] += 1
            self.least, self.last = turn if self.least is None else self.least, turn
        for k in range(copies):
            now = DUPLICATE if k and fault != BLANK else fault
            if now != FINE:
                self.n[("", "blank", "truncated", "duplicate")[now]] += 1
            if self.last_initial is None:
                self.first_initial = initial
            else:
                self.n["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
            self.last_initial = initial
            for walk in self.walks:
                walk.step(initial, now)

    def row(self, piece: int) -> dict:
        starts = [-1] if self.sure else range(4)
        transfer = [{"from": p, "to": q, "cost": c, "audit": a} for p, w in zip(starts, self.walks) for q, c, a in w.ends()]
        return {"conv_id": self.conv, "piece": piece, **self.n, "least_turn": self.least, "last_turn": self.last, "first_initial": self.first_initial, "last_initial": self.last_initial, "transfer": transfer}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a range: its counts and its transfers. The first may go on from the range before."""
    from pyspark import TaskContext

    number, piece, out, held = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for conv, turn, role, copies, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "copies", "fault"))):
            if piece is None or conv != piece.conv:
                if piece:
                    out.append(piece.row(number))
                    held += len(out[-1]["transfer"]) * piece.walks[0].rows
                piece = _Piece(conv, piece is not None)
            if role is not None:
                piece.add(turn, role, fault, copies)
        if len(out) >= 2000 or held > 1 << 22:
            yield pa.RecordBatch.from_pylist(out, _PIECE_ARROW)
            out, held = [], 0
    if piece:
        out.append(piece.row(number))
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE_ARROW)


class _Whole:
    """Pieces of one conversation in turn."""

    def __init__(self, conv: int | None):
        self.conv, self.n, self.layer = conv, dict.fromkeys(_COUNTS, 0), {q: (c, a) for q, c, a in Walk().ends()}
        self.least = self.last = self.initial = None

    def add(self, r: dict) -> None:
        for c in _COUNTS:
            self.n[c] += r[c]
        if self.initial is not None and r["first_initial"] is not None:
            self.n["illegal"] += self.initial + r["first_initial"] not in ("su", "ua", "au")
        if r["last_turn"] is not None:
            self.n["turns"] -= r["least_turn"] == self.last
            self.least, self.last = r["least_turn"] if self.least is None else self.least, r["last_turn"]
        self.initial = self.initial if r["last_initial"] is None else r["last_initial"]
        new: dict[int, tuple[int, str]] = {}
        for t in r["transfer"]:
            cost, audit = (0, "") if t["from"] < 0 else self.layer.get(t["from"], (None, ""))
            if cost is not None:
                found = (cost + t["cost"], audit + t["audit"])
                new[t["to"]] = min(found, new.get(t["to"], found))
        self.layer = new

    def row(self) -> tuple:
        cost, audit = min(self.layer[q] for q in (START, ASSISTANT) if q in self.layer)
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.n["turns"]
        return self.conv, gaps, self.n["blank"], self.n["duplicate"], self.n["truncated"], self.n["illegal"], cost, audit


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, {"long": pa.int64(), "string": pa.string()}[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole, out = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if whole is None or r["conv_id"] != whole.conv:
                if whole:
                    out.append(whole.row())
                whole = _Whole(r["conv_id"])
            whole.add(r)
        if out:
            yield _arrow(out, RESULT)
            out = []
    if whole:
        yield _arrow([whole.row()], RESULT)


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text), and of ids: counts of faults, least cost and its audit."""
    at = faults(_named(rows))
    if ids is not None:
        at = at.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    ranges = at.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h")
    pieces = ranges.select("conv_id", "turn", "role", "copies", "fault").mapInArrow(_pieces, _PIECE)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_wholes, RESULT)


class Replay:
    """Repaired turns of one conversation: its audit, then its rows in turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, FORCED[self.state]
            yield ROLES[self.state], "", "I"

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = AFTER[self.state, role[:1]]
            yield role, text, edit
        elif edit == "R":
            self.state = FORCED[self.state]
            yield ROLES[self.state], text, edit


def _replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Audits and rows beside each other: a conversation's audit comes first, then its rows in turn."""
    told = found.select(F.col("conv_id"), F.lit(0).alias("part"), F.struct(*[c for c in found.columns if c != "conv_id"]).alias("found"))
    both = told.unionByName(_named(rows).withColumn("part", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "h").drop("turn", "h")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict | None, Iterator[tuple[str, str, str]]]]:
    """(conv_id, what was found when a conversation begins, turns to add) for each row in turn; a conversation's end comes with its last inserts."""
    replay = conv = None
    for batch in batches:
        for c, found, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "found", "role", "text"))):
            if found is not None:
                if replay:
                    yield conv, None, replay.inserts()
                conv, replay = c, Replay(found["audit"])
                yield conv, found, iter(())
            else:
                yield conv, None, replay.turns(role, text)
    if replay:
        yield conv, None, replay.inserts()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), role, text, edit; found is what ``audits`` gave for these rows."""
    schema = "conv_id long, place long, role string, text string, edit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, size = 0, [], 0
        for conv, new, turns in _stream(batches):
            place = 0 if new else place
            for role, text, edit in turns:
                out.append((conv, place, role, text, edit))
                place, size = place + 1, size + len(text)
            if len(out) >= 5000 or size > 1 << 22:
                yield _arrow(out, schema)
                out, size = [], 0
        if out:
            yield _arrow(out, schema)

    return _replayed(rows, found).mapInArrow(run, schema)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What ``audits`` found and repaired_sha256: the hash of the repaired ``role:text`` lines, joined by newlines."""
    schema = RESULT + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = told = None
        first, out = True, []
        for conv, new, turns in _stream(batches):
            if new:
                if at:
                    out.append((*told, at.hexdigest()))
                at, told, first = hashlib.sha256(), (conv, *new.values()), True
            for role, text, _ in turns:
                at.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if len(out) >= 2000:
                yield _arrow(out, schema)
                out = []
        if at:
            out.append((*told, at.hexdigest()))
        if out:
            yield _arrow(out, schema)

    return _replayed(rows, found).mapInArrow(run, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each conversation of rows and of ids: what was found and the hash of what it became."""
    return digests(rows, audits(rows, ids))
