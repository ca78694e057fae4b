"""Repair of conversations by alignment of their turns to an alternating grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.workers import small_batches, tidy
from vitalgrid.session import materialize

#: Turns that are aligned as one piece; longer conversations are joined piece by piece.
PIECE = 512
RELABEL, DROP, ADD, CUT = 2, 3, 2, 1
_FAR = 1 << 30
# What is written so far: nothing (START), s (SYSTEM), ..ua (CLOSED), ..u (OPEN).
START, SYSTEM, CLOSED, OPEN = range(4)


@lru_cache(maxsize=1 << 16)
def align(shape: str, enter: tuple[int, ...], leave: tuple[int, ...]) -> dict:
    """Cheapest edits of a piece of turns from each state in ``enter`` to each in ``leave``.

    ``shape`` has a character per turn: the role initial s, u, a or x (any
    other), in upper case where the text breaks off, or ``-`` for a turn that
    must go. Returns {(from, to): (cost, audit)} of what is possible, the audit
    being the ASCII-least among the cheapest.

    Wagner-Fischer: ``table[i, r]`` is the cost of turning the turns from i on
    into the last r letters of the target. Targets that end alike differ only in
    their length, so one table holds the alignments to all lengths; those of
    the right parity are compared. Only cells in Ukkonen's band are filled: an
    incumbent repair gives a cost, and r letters more or less than the turns
    left cannot cost more than that in additions or deletions."""
    n = len(shape)
    must = np.array([c == "-" for c in shape], bool)
    left = np.concatenate([np.cumsum(~must[::-1])[::-1], [0]])  # turns that may stay, from i on
    spare = max(_incumbent(shape, p) for p in (CLOSED, OPEN)) - DROP * int(must.sum())
    width = int(left[0]) + spare // ADD + 1
    found: dict = {}
    for q in leave:
        if q in (START, SYSTEM):
            for p in enter:
                if (got := _prefix(shape, p, q)) is not None:
                    found[p, q] = got
            continue
        table = np.full((n + 1, width), _FAR, np.int64)
        r = np.arange(width)
        letter = (r % 2 == 0) ^ (q == OPEN)  # is the letter with r letters left a u?
        table[n, :spare // ADD + 1] = ADD * r[:spare // ADD + 1]
        for i in range(n - 1, -1, -1):
            lo, hi = max(0, int(left[i]) - spare // DROP), int(left[i]) + spare // ADD + 1
            cost = table[i + 1, lo:hi] + DROP
            if not must[i]:
                turn = shape[i].lower()
                extra = CUT if shape[i].isupper() else 0
                fits = letter[lo:hi] if turn == "u" else ~letter[lo:hi] if turn == "a" else np.zeros(hi - lo, bool)
                stay = np.where(fits, 0, RELABEL) + extra
                at = max(lo, 1)
                cost[at - lo:] = np.minimum(cost[at - lo:], table[i + 1, at - 1:hi - 1] + stay[at - lo:])
            table[i, lo:hi] = np.minimum(np.minimum.accumulate(cost - ADD * r[lo:hi]) + ADD * r[lo:hi], _FAR)
        for p in enter:
            if (got := _shortest(shape, table, p, q)) is not None:
                found[p, q] = got
    return found


def _incumbent(shape: str, state: int) -> int:
    """Cost of a plain repair to either end: what must go goes, other roles are
    renamed, and a missing turn is put in before one that repeats its role; both ends are reached with one more."""
    cost = ADD
    for c in shape:
        if c == "-":
            cost += DROP
            continue
        turn, want = c.lower(), "a" if state == OPEN else "u"
        cost += CUT if c.isupper() else 0
        if turn not in "ua":
            cost += RELABEL
            state = CLOSED if state == OPEN else OPEN
        else:
            cost += 0 if turn == want else ADD
            state = OPEN if turn == "u" else CLOSED
    return cost


def _prefix(shape: str, p: int, q: int) -> tuple[int, str] | None:
    """All turns go, or all but a system turn that opens the conversation (the last of the cheapest)."""
    n = len(shape)
    if p == q:
        return DROP * n, "D" * n
    if (p, q) != (START, SYSTEM):
        return None
    at = max(shape.rfind("s"), -1)
    if at < 0:
        at = shape.rfind("S")
    if at < 0:
        return None
    return DROP * (n - 1) + (CUT if shape[at] == "S" else 0), "D" * at + "K" + "D" * (n - 1 - at)


def _shortest(shape: str, table: np.ndarray, p: int, q: int) -> tuple[int, str] | None:
    """The best of all target lengths from ``p``: costs compared first, then the audits traced back."""
    n, width = len(shape), table.shape[1]
    # an open start wants the letter a; lengths of the other parity would begin with the wrong letter
    first = 1 if (p == OPEN) != (q == OPEN) else 0
    if p in (START, SYSTEM) and first == 0:
        first = 2  # no letter at all would leave the state as it was
    lengths = np.arange(first, width, 2)
    costs = table[0, lengths]
    best = int(costs.min()) if len(costs) else _FAR
    audits = []
    system = None
    if p == START:
        system = np.full((n + 1, width), _FAR, np.int64)
        for i in range(n - 1, -1, -1):
            system[i] = np.minimum(system[i + 1] + DROP, _FAR)
            if shape[i] in "sS":
                system[i] = np.minimum(system[i], table[i + 1] + (CUT if shape[i] == "S" else 0))
        best = min(best, int(system[0, lengths].min()) if len(lengths) else _FAR)
        if best < _FAR:
            for r in lengths[system[0, lengths] == best].tolist():
                i = 0
                while system[i + 1, r] + DROP == system[i, r]:
                    i += 1
                audits.append("D" * i + "K" + _trace(shape, table, i + 1, r, q))
    if best >= _FAR:
        return None
    audits += [_trace(shape, table, 0, r, q) for r in lengths[costs == best].tolist()]
    return best, min(audits)


def _trace(shape: str, table: np.ndarray, i: int, r: int, q: int) -> str:
    """Backtrace from the front: of the cheapest edits the ASCII-least, D before I before K or R."""
    out, n = [], len(shape)
    while i < n or r:
        here = table[i, r]
        if i < n and table[i + 1, r] + DROP == here:
            out.append("D")
            i += 1
        elif r and table[i, r - 1] + ADD == here:
            out.append("I")
            r -= 1
        else:
            out.append("K" if shape[i].lower() == ("u" if (r % 2 == 0) ^ (q == OPEN) else "a") else "R")
            i, r = i + 1, r - 1
    return "".join(out)


def repair_shape(shape: str, piece: int = PIECE) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation.

    A conversation of more than ``piece`` turns is cut, every piece is aligned
    between all states, and pieces are joined by the cheapest way to each
    state. Two different audits of equal cost over the same turns between the
    same states never begin one another (the longer one would hold more
    additions), so the ASCII-least whole is put together of ASCII-least pieces."""
    every = (START, SYSTEM, CLOSED, OPEN)
    so_far = {START: (0, "")}
    for at in range(0, max(len(shape), 1), piece):
        last = at + piece >= len(shape)
        ways = align(shape[at:at + piece], tuple(so_far), (START, CLOSED) if last else every)
        after: dict = {}
        for (p, q), (cost, audit) in ways.items():
            way = (so_far[p][0] + cost, so_far[p][1], audit)
            if q not in after or way[0] < after[q][0] or (way[0] == after[q][0]
                                                          and way[1] + way[2] < after[q][1] + after[q][2]):
                after[q] = way
        so_far = {q: (cost, before + audit) for q, (cost, before, audit) in after.items()}
    return min(so_far.values())


_BLANK = "\\x20\\x09-\\x0D"


def _keyed(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns under names of their own, null role and text as one space, with the digest that orders and compares texts."""
    say = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_id).alias("_c"), F.col(turn).cast("long").alias("_turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"), say.alias("_text"),
                        F.unhex(F.sha2(say.cast("binary"), 256)).alias("_digest"))


def _order(*first: Column) -> list[Column]:
    return [F.col("_c").asc_nulls_first(), *first, F.col("_turn").asc_nulls_first(), F.col("_role").asc(),
            F.col("_digest").asc()]


def _judge(piece: int):
    """Conversations from turns that come sorted: one at a time, a character per turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        kinds = [pa.int64()] * 6 + [pa.string()]
        now, open_, shape, seen = None, False, [], {}
        done: list[tuple] = []

        def close() -> None:
            cost, audit = repair_shape("".join(shape), piece)
            gaps = seen["last"] - seen["first"] + 1 - seen["turns"] if seen["turns"] else 0
            done.append((now, gaps, seen["-b"], seen["-d"], seen["-t"], seen["illegal"], cost, audit))

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[]] * 8
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [kind, *kinds], strict=True)], names)

        kind = None
        for batch in batches:
            kind = batch.column("_c").type
            for c, turn, initial, fault in zip(*(batch.column(x).to_pylist() for x in ("_c", "_turn", "_initial", "_fault")),
                                               strict=True):
                if not open_ or c != now:
                    if open_:
                        close()
                        if len(done) >= 1000:
                            yield flush(kind)
                    now, open_, shape = c, True, []
                    seen = {"turns": 0, "first": None, "last": None, "-b": 0, "-d": 0, "-t": 0, "illegal": 0, "role": None}
                if turn is not None and turn != seen["last"]:
                    seen["first"] = turn if seen["first"] is None else seen["first"]
                    seen["last"], seen["turns"] = turn, seen["turns"] + 1
                if seen["role"] is not None and seen["role"] + initial not in ("su", "ua", "au"):
                    seen["illegal"] += 1
                seen["role"] = initial
                if fault != "":
                    seen[f"-{fault}"] += 1
                letter = initial if initial in ("s", "u", "a") else "x"
                shape.append("-" if fault in ("b", "d") else letter.upper() if fault == "t" else letter)
        if open_:
            close()
        if done:
            yield flush(kind)

    return run


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           piece: int = PIECE) -> DataFrame:
    """Faults of every conversation and its cheapest repair.

    Turns are taken by ``turn`` (null first; ties by role, then by the SHA-256
    of the text, so repeated rows lie side by side). A turn's first fault
    counts: ``blank`` (no character but ASCII blanks), ``duplicate`` (role and
    text seen earlier in the conversation, texts compared by SHA-256),
    ``truncated`` (does not end in . ! or ?). ``gaps`` are missing turn numbers,
    ``illegal`` neighbouring role initials other than su, ua, au. Edits: Keep 0,
    Rename the role to user or assistant 2, Delete 3 (blank and duplicate turns
    must go), Insert an empty user or assistant turn 2; every truncated turn
    that stays costs 1. ``audit`` are the edits' initials that lead to role
    initials ``(s?(ua)+)?`` at the least ``cost``, the ASCII-least of equal ones.

    One exchange of narrow rows by conversation (no texts) and two sorts; each
    task reads its turns as a sorted stream and holds one character per turn of
    one conversation, so a conversation of any length passes through.

    Returns one row per conversation: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit``. Null role and text are one space; a null
    identifier is a conversation of its own; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    rows = _keyed(turns, conv_id, turn, role, text)
    bare = F.regexp_replace("_text", f"[{_BLANK}]+\\z", "")
    # trailing blanks are cut off, so nothing is left of a blank text
    rows = rows.select("_c", "_turn", "_role", "_digest", F.substring("_role", 1, 1).alias("_initial"),
                       F.length(bare).alias("_len"), F.substring(bare, -1, 1).alias("_end"))
    again = F.row_number().over(Window.partitionBy("_c", "_role", "_digest").orderBy(F.col("_turn").asc_nulls_first())) > 1
    fault = (F.when(F.col("_len") == 0, "b").when(F.col("_again"), "d")
             .when(~F.col("_end").isin(".", "!", "?"), "t").otherwise(""))
    kind = rows.schema["_c"].dataType.simpleString()
    told = (rows.repartition("_c").withColumn("_again", again).sortWithinPartitions(*_order())
            .select("_c", "_turn", "_initial", fault.alias("_fault"))
            .mapInArrow(tidy(_judge(piece)), f"_c {kind}, gaps long, blank long, duplicate long, truncated long, "
                                             "illegal long, cost long, audit string"))
    return told.withColumnRenamed("_c", conv_id)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edit, role, text) of every edit, in order, from conversations that come sorted, the audit first."""
    audit, at, c, place, system = "", 0, None, 0, 0

    def target() -> str:
        return "user" if (place - system) % 2 == 0 else "assistant"

    def inserts() -> Iterator[tuple]:
        nonlocal at, place
        while audit[at:at + 1] == "I":
            yield c, "I", target(), ""
            at, place = at + 1, place + 1

    for batch in batches:
        for conv, head, role, text in zip(*(batch.column(x).to_pylist() for x in ("_c", "_head", "_role", "_text")),
                                          strict=True):
            if head:
                yield from inserts()
                c, audit, at, place, system = conv, text, 0, 0, 0
                yield c, "", "", ""  # a conversation begins
                continue
            yield from inserts()
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "K" and place == 0 and role[:1] == "s":
                    system = 1
                yield c, edit, role if edit == "K" else target(), text
                place += 1
            else:
                yield c, edit, role, text
    yield from inserts()


def _stream(turns: DataFrame, repairs: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in the order of ``repair``, every conversation headed by its audit: one exchange of the texts."""
    small_batches(turns.sparkSession)
    rows = _keyed(turns, conv_id, turn, role, text)
    none = F.lit(None)
    heads = repairs.select(F.col(conv_id).alias("_c"), F.lit(True).alias("_head"), none.cast("long").alias("_turn"),
                           F.lit("").alias("_role"), none.cast("binary").alias("_digest"), F.col("audit").alias("_text"))
    both = heads.unionByName(rows.withColumn("_head", F.lit(False)))
    return both.repartition("_c").sortWithinPartitions(*_order(F.col("_head").desc())).select(
        "_c", "_head", "_role", "_text")


def repaired_turns(turns: DataFrame, repairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """The edits of ``repair`` carried out: one row per edit.

    Returns ``conv_id, place`` (number of the edit, from 0), ``edit, role,
    text``: kept turns as they are, renamed ones with their new role, added
    ones with an empty text; deleted ones have edit D. ``repairs`` must hold one
    row for each conversation of ``turns``. Nulls, ties and empty tables as in
    ``repair``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        place = 0
        kind = pa.null()

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("_c").type
                yield batch

        def flush() -> pa.RecordBatch:
            cols = list(zip(*some, strict=True))
            some.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)],
                ["_c", "place", "edit", "role", "text"])

        for c, edit, who, say in _edited(watched()):
            if not edit:
                place = 0
                continue
            some.append((c, place, edit, who, say))
            place += 1
            if len(some) >= 1000:
                yield flush()
        if some:
            yield flush()

    rows = _stream(turns, repairs, conv_id, turn, role, text)
    kind = rows.schema["_c"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_c {kind}, place long, edit string, role string, text string").withColumnRenamed(
        "_c", conv_id)


def repaired_digests(turns: DataFrame, repairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired conversations: the SHA-256 of
    their ``role:text`` lines joined by line feeds, taken while the turns
    stream by, so that no conversation is ever put together in memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, digest, first = pa.null(), None, True
        done: list[tuple] = []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column("_c").type
                yield batch

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done])],
                                             ["_c", "repaired_sha256"])
            done.clear()
            return out

        now = None
        for c, edit, who, say in _edited(watched()):
            if not edit:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                    if len(done) >= 1000:
                        yield flush()
                now, digest, first = c, hashlib.sha256(), True
            elif edit != "D":
                digest.update(f"{'' if first else chr(10)}{who}:{say}".encode())
                first = False
        if digest is not None:
            done.append((now, digest.hexdigest()))
            yield flush()

    rows = _stream(turns, repairs, conv_id, turn, role, text)
    kind = rows.schema["_c"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"_c {kind}, repaired_sha256 string").withColumnRenamed("_c", conv_id)


def damage(turns: DataFrame) -> DataFrame:
    """Planted faults, by crc32 of "conv_id:turn" modulo 20 (null: one space):
    0 drops the turn, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes its role user."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    what = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    rows = turns.filter(what != 0).select("conv_id", "turn", F.when(what == 4, "user").otherwise(shown("role")).alias("role"),
                                          text.alias("text"), F.when(what == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Every conversation of ``turns`` with its faults after ``damage`` and the
    digest of its repair; one without turns left has zeros, an empty audit and
    the digest of an empty text."""
    hurt = damage(turns)
    repairs = materialize(repair(hurt), "repairs")
    digests = repaired_digests(hurt, repairs).withColumnRenamed("conv_id", "_d")
    every = turns.select(F.col("conv_id").alias("_e")).distinct()
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (every.join(repairs, F.col("_e").eqNullSafe(F.col("conv_id")), "left")
            .join(digests, F.col("_e").eqNullSafe(F.col("_d")), "left")
            .select(F.col("_e").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
                    F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
