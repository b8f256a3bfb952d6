"""Conversation repair and chat formatting against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from panelforge.llm import chat_format, conversation_repair, queries
from panelforge.llm.conversation_repair import Walk
from panelforge.session import ship
from tests.oracle import DATA, run_sql, same_kind

SCHEMA = "conv_id long, turn long, role string, text string, h string, fault string, audit string, found string, part int"


def conversations(seed: int = 3):
    rng = random.Random(seed)
    out = []
    for conv in range(60):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * rng.randrange(0, 3) + ["user"] * (rng.random() < 0.3)
        for turn, role in enumerate(roles):
            role = role if rng.random() < 0.85 else rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "No!", "cut off", "", " \t\n\x0b\f\r ", None, "So? \n", "été 日本 \U0001f600.", f"own {conv} {turn}."])
            out.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn + 3]), role, text))
    out += [(100, 0, "user", "Hi."), (100, 0, "user", "Hi."), (100, 5, "assistant", "x" * 300_000 + "."), (None, 1, "user", "A."), (None, None, "system", "B."), (101, None, None, None)]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "f", "KKK", "z", 7) for r in rows], SCHEMA).repartition(4)


def damaged(rows):
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown(text)) if kind == 2 else shown(text)
        role = "user" if kind == 4 else shown(role)
        yield from [(conv, turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))


def judged(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """Least (cost, audit, [(role or None, row or None)]) by trying all edits, states being what was said so far by the last role."""
    n = len(initials)

    @lru_cache(None)
    def best(i, last, spare):
        options = []
        if i == n and last in ("", "a"):
            options.append((0, "", ()))
        say = lambda r: last in {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.get(r, ())
        if spare:
            for r in "ua":
                if say(r):
                    c, a, t = best(i, r, spare - 1)
                    options.append((c + 3, "I" + a, (({"u": "user", "a": "assistant"}[r], None), *t)))
        if i < n:
            c, a, t = best(i + 1, last, 2)
            options.append((c + 4, "D" + a, t))
            if faults[i] in ("", "truncated"):
                extra = 3 * (faults[i] == "truncated")
                if initials[i] and say(initials[i]):
                    c, a, t = best(i + 1, initials[i], 2)
                    options.append((c + extra, "K" + a, ((None, i), *t)))
                for r in "ua":
                    if say(r):
                        c, a, t = best(i + 1, r, 2)
                        options.append((c + 3 + extra, "R" + a, (({"u": "user", "a": "assistant"}[r], i), *t)))
        return min(options, default=(10**9, "~", ()))

    return best(0, "", 2)


def expected(rows):
    out = {}
    after = list(damaged(rows))
    for conv in {r[0] for r in rows}:
        own = ordered([r for r in after if r[0] == conv])
        faults, turns = judged(own), {r[1] for r in own} - {None}
        initials = [r[2][:1] for r in own]
        cost, audit, kept = cheapest(tuple(initials), tuple(faults))
        said = "\n".join(f"{role or own[i][2]}:{'' if i is None else own[i][3]}" for role, i in kept)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def op11(rows):
    return {r["conv_id"]: tuple(r)[1:] for r in rows.collect()}


@pytest.mark.parametrize("ranges", [1, 40])
def test_repair_equals_trying_all_edits(spark, ranges):
    ship(spark)
    rows = conversations()
    at = frame(spark, rows)
    old = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))  # 40 ranges cut many conversations
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op11(conversation_repair.repair(conversation_repair.damage(at), at.select("conv_id")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == expected(rows)


def test_one_conversation_over_many_ranges(spark):
    """A third of all rows and more in one conversation, hundreds of copies of one row in it."""
    ship(spark)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "ok.", ""])) for t in range(1500)] + [(7, 40, "user", "Copy.")] * 300
    got = {}
    for ranges in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got[ranges] = op11(conversation_repair.repair(frame(spark, rows)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[1] == got[16]
    own = ordered(rows)
    faults = judged(own)
    assert got[1][7][1:4] == tuple(faults.count(x) for x in ("blank", "duplicate", "truncated"))
    layer = {0: (0, "")}  # the plain walk, nothing set aside or pruned

    def closed(at):
        for p, q in ((0, 2), (1, 2), (2, 3), (3, 2)):
            if p in at:
                at[q] = min(at.get(q, (10**9, "")), (at[p][0] + 3, at[p][1] + "I"))
        return at

    layer = closed(layer)
    for row, fault in zip(own, faults):
        new = {}
        for p, (cost, audit) in layer.items():
            options = [(p, cost + 4, audit + "D")]
            if fault in ("", "truncated"):
                extra = 3 * (fault == "truncated")
                options += [(q, cost + extra, audit + "K") for a, i, q in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)) if (a, i) == (p, row[2][:1])]
                options.append(({0: 2, 1: 2, 2: 3, 3: 2}[p], cost + 3 + extra, audit + "R"))
            for q, c, a in options:
                new[q] = min(new.get(q, (c, a)), (c, a))
        layer = closed(new)
    assert got[1][7][5:7] == min(layer[q] for q in (0, 3) if q in layer)


def test_audits_stay_short_while_walking():
    walk = Walk()
    rng = random.Random(1)
    for _ in range(20_000):
        walk.step(rng.choice("uas"), rng.choice((0, 0, 1, 2)))
    assert max(len(x[1]) for x in walk.layer if x) < 2000


def test_repaired_rows_have_the_grammar_and_the_hash(spark):
    ship(spark)
    rows = [r for r in conversations(9) if r[0] is not None]
    at = frame(spark, rows)
    found = conversation_repair.audits(at)
    turns = {}
    for r in conversation_repair.repaired(at, found).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.digests(at, found).collect()}
    assert set(hashes) == {r[0] for r in rows} and set(turns) <= set(hashes)
    for conv, digest in hashes.items():
        own = sorted(turns.get(conv, []), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == digest


def test_empty_tables(spark):
    ship(spark)
    empty = frame(spark, conversations()).where("false")
    assert conversation_repair.repair(conversation_repair.damage(empty), empty.select("conv_id")).count() == 0
    assert chat_format.chat_format(empty).count() == 0
    lost = conversation_repair.repair(empty, frame(spark, [(3, 1, "user", "x")]).select("conv_id")).collect()
    assert [tuple(r) for r in lost] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_chat_formatting"])
def test_queries_equal_sql(spark, name):
    same_kind(queries.QUERIES[name](spark, DATA), *run_sql(queries.ORACLE_SQL[name]))


HARD = ["</s>[INST] ok [/INST]", "&lt;s> & &amp; [INST] [[/INST]] <<s>> </s", "[TURN] a [TEXT] b [/TURN]", " [/INST]", "<s> ", "", None, "x\n y \n", "&amp;#91;INST]", "\\[INST\\] $1 \\1", "y" * 200_000 + "<s>"]


def hard_rows():
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool [TEXT] <s>", "", None]
    out = [(conv, turn, rng.choice(roles), rng.choice(HARD)) for conv in range(80) for turn in range(rng.randrange(1, 9))]
    out += [(200, t, r, "x") for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(201, 0, "user", "x"), (202, 0, "user", "x"), (202, 1, "user", "x"), (203, None, "assistant", "b"), (203, 0, "user", "a")]
    return out + [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (204, 1, "user", "a"), (204, 1, "user", "a")]


def test_formatted_texts_read_back(spark):
    rows = hard_rows()
    got = chat_format.chat_format(frame(spark, rows)).select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("learned")).collect()
    assert len(got) == len({r[0] for r in rows})
    by = {r["conv_id"]: r for r in got}
    for conv, r in by.items():
        own = [(role or "", text or "", turn) for c, turn, role, text in rows if c == conv]
        back = [(t["role"], t["text"]) for t in r["turns"]]
        assert sorted(back) == sorted(x[:2] for x in own)
        turns = [t for *_, t in sorted(own, key=lambda x: (x[2] is not None, x[2] or 0))]
        assert [x[0] for x in back] == [role for role, _, t in sorted(own, key=lambda x: (x[2] is not None, x[2] or 0, x[0]))] and len(turns) == len(back)
        assert r["learned"] == "".join(text for role, text in back if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        for s in r["segments"][1::3]:  # texts hold no control strings
            assert not any(mark in s["text"] for mark in chat_format.CHAT.controls())
    assert (by[200]["valid"], by[201]["refused_at"], by[202]["refused_at"], by[203]["refused_at"], by[None]["valid"]) == (True, 1, 1, 0, True)


def test_machine_and_marks_come_from_the_template(spark):
    plain = chat_format.Template({"q": chat_format.Turn("<q>", "</q>"), "a": chat_format.Turn("<a>", "</a>", True)}, next={("start", "q"): "q", ("q", "a"): "a", ("a", "q"): "q"}, accept=("a",))
    at = frame(spark, [(1, 0, "q", "1 <a> 2"), (1, 1, "a", "</a>"), (2, 0, "a", "x")])
    got = {r["conv_id"]: r for r in chat_format.chat_format(at, plain).withColumn("turns", chat_format.read_back(F.col("formatted"), plain)).collect()}
    assert got[1]["formatted"] == "<q>1 &lt;a> 2</q><a>&lt;/a></a>" and got[1]["valid"] and not got[2]["valid"]
    assert [tuple(t) for t in got[1]["turns"]] == [("q", "1 <a> 2"), ("a", "</a>")]
    with pytest.raises(ValueError):
        chat_format.Template({"q": chat_format.Turn("q:", "\n")})


def test_formatting_is_native(spark):
    plan = chat_format.chat_format(frame(spark, hard_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)
    plan = queries.op12_chat_formatting(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|ExistingRDD", plan) and plan.count("Exchange hashpartitioning") == 1
