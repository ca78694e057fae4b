"""Banded target alignment against a search over all edit sequences, and whole conversations by hand and by brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vitalgrid.llm.conversations import align, damage, repair, repair_damaged, repair_shape, repaired_turns
from vitalgrid.llm.queries import QUERIES

GRAMMAR = re.compile("(s?(ua)+)?")


def every_repair(shape):
    """Least (cost, audit) by uniform-cost search over what the grammar has written, whatever the length."""
    states = {"": (0, "")}

    def step(written):  # only what decides how the grammar goes on
        return written if len(written) < 2 else ("S" if written[0] == "s" else "") + written[-1]

    def allowed(written, letter):
        if letter == "s":
            return written == ""
        return (written[-1:] in ("", "s", "a", "S")) if letter == "u" else written[-1:] == "u"

    def better(into, key, way):
        if key not in into or way < into[key]:
            into[key] = way

    def with_inserts(states):
        out = dict(states)
        for _ in range(3):
            for w, (cost, audit) in list(out.items()):
                letter = "a" if w[-1:] == "u" else "u"
                better(out, step(w + letter), (cost + 2, audit + "I"))
        return out

    for c in shape:
        nxt = {}
        for w, (cost, audit) in with_inserts(states).items():
            better(nxt, w, (cost + 3, audit + "D"))
            if c == "-":
                continue
            cut = int(c.isupper())
            for letter in "sua":
                if allowed(w, letter):
                    if c.lower() == letter:
                        better(nxt, step(w + letter), (cost + cut, audit + "K"))
                    if letter != "s":
                        better(nxt, step(w + letter), (cost + cut + 2, audit + "R"))
        states = nxt
    return min(way for w, way in with_inserts(states).items() if w == "" or (w[-1] == "a"))


def target(shape, audit):
    """Role initials after the edits, or None if the audit does not fit the turns."""
    out, i, system = [], 0, 0
    for e in audit:
        want = "ua"[(len(out) - system) % 2]
        if e == "I":
            out.append(want)
            continue
        if e == "K":
            if shape[i] == "-":
                return None
            out.append(shape[i].lower())
            system |= len(out) == 1 and out[0] == "s"
        elif e == "R":
            out.append(want)
        i += 1
    return "".join(out) if i == len(shape) else None


@pytest.mark.parametrize("n", range(5))
def test_all_short_shapes(n):
    for shape in itertools.product("suaxSUA-", repeat=n):
        shape = "".join(shape)
        cost, audit = repair_shape(shape)
        assert (cost, audit) == every_repair(shape), shape
        assert GRAMMAR.fullmatch(target(shape, audit))


def test_by_hand():
    assert repair_shape("") == (0, "")
    assert repair_shape("uaua") == (0, "KKKK")
    assert repair_shape("sua") == (0, "KKK")
    assert repair_shape("s") == (3, "D")
    assert repair_shape("uu") == (2, "KR")
    assert repair_shape("u") == (2, "KI")
    assert repair_shape("-uA") == (4, "DKK")


def test_long_shapes_and_pieces():
    draw = random.Random(3)
    for n in (9, 40, 300, 1300):
        for noise in (0.02, 0.2, 1.0):
            shape = "".join(draw.choice("suaxSUA-") if draw.random() < noise else "ua"[i % 2] for i in range(n))
            want = every_repair(shape)
            assert repair_shape(shape) == want
            assert repair_shape(shape, piece=7) == want and repair_shape(shape, piece=1) == want
    align.cache_clear()


def plain(rows):
    """Report of one conversation's rows (turn, role, text), by loops."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, shape, count = set(), "", {"b": 0, "d": 0, "t": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        shape += "-" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = every_repair(shape)
    lines, i, system = [], 0, 0
    for e in audit:
        want = ("user", "assistant")[(len(lines) - system) % 2]
        if e == "I":
            lines.append(f"{want}:")
            continue
        if e == "K":
            system |= not lines and rows[i][1][:1] == "s"
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
        elif e == "R":
            lines.append(f"{want}:{rows[i][2]}")
        i += 1
    return (gaps, count["b"], count["d"], count["t"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    out = {}
    for c, turn, role, text in rows:
        here = out.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        here.extend([(turn, role, text)] * (0 if what == 0 else 2 if what == 3 else 1))
    return out


COLS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLS) for r in QUERIES["op11_conversation_repair"](spark, folder).collect()}
    assert got == {c: plain(x) for c, x in hurt(rows).items()}


def test_edges(spark):
    draw = random.Random(5)
    words = ["Yes.", "No!", "And then", " \t", "", "Why?  \n", "É.", "x" * 5000 + "."]
    rows = [(c, draw.choice([None, 0, 1, 2, 7, 7]), draw.choice(["user", "assistant", "system", None, "", "User", "tool"]),
             draw.choice([None, *words])) for c in range(40) for _ in range(draw.randrange(1, 12))]
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (77, 3, "user", "Hi."), (77, 3, "user", "Hi.")]
    rows += [(99, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant"), f"Line {i}.") for i in range(1500)]
    rows += [(c, t, "user", "All go.") for c, t in itertools.product(range(200, 900), range(1))
             if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("audit", "_c", "_role", "cost", "_copy", "_times", "_head")])
    got = {r["conv_id"]: tuple(r[c] for c in COLS) for r in repair_damaged(df).collect()}
    assert got == {c: plain(x) for c, x in hurt(rows).items()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [v for k, v in got.items() if k is not None and 200 <= k < 900] and all(
        v == (0, 0, 0, 0, 0, 0, "", empty) for k, v in got.items() if k is not None and 200 <= k < 900)
    assert repair_damaged(df.limit(0)).count() == 0
    assert damage(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi."), ("c", 2, "user", "There?"), ("c", 3, "tool", "42."),
            ("c", 4, "assistant", "Yes"), ("c", 5, "assistant", " "), ("d", None, "user", "Alone.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    found = repair(df)
    got = [tuple(r)[1:] for r in repaired_turns(df, found).filter("conv_id = 'c' and edit <> 'D'").orderBy("place").collect()]
    told = found.filter("conv_id = 'c'").first()
    roles = [r[2] for r in got]
    assert roles[0] == "system" and roles[1:] == ["user", "assistant"] * ((len(roles) - 1) // 2)
    assert told["audit"] == "".join(e for _, e, _, _ in [tuple(r)[1:] for r in repaired_turns(df, found).filter(
        "conv_id = 'c'").orderBy("place").collect()])
    alone = repaired_turns(df, found).filter("conv_id = 'd'").orderBy("place").collect()
    assert [tuple(r)[2:] for r in alone] == [("K", "user", "Alone."), ("I", "assistant", "")]
