"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.session import materialize

#: Hash slices per source and level when the sampling threshold is located.
SLICES = 1024


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters (ASCII blanks only); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Position of every source in code point order, null last, without a
    single-task window: range-partition, count per partition, add offsets
    (the offsets have one row per partition)."""
    order = [F.col("source").isNull(), F.col("source")]
    put = materialize(sizes.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_p"))
                      .sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), "mix-sources")
    counts = {r["_p"]: (r["n"], r["least"]) for r in
              put.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("least")).collect()}
    base, start = 0, []
    for p in sorted(counts):
        start.append((p, base - counts[p][1]))
        base += counts[p][0]
    offsets = sizes.sparkSession.createDataFrame(start, "_p int, _o long")
    return put.join(F.broadcast(offsets), "_p").withColumn("position", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Capped water-filling of the whole size over weighted sources.

    ``sources``: ``source, source_size, weight`` (integers). Adds ``target``:
    sources share the sum of all sizes by weight; one whose share exceeds
    ``max_epochs`` times its size is clamped there, and what is left is shared
    again by weight among the others until none exceeds its cap. Each round is
    one aggregate over the source table; a source of size 0 gets 0.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, weights, clamped = total, None, -1
    while True:
        # a source is clamped once its share at the present water level exceeds its cap
        full = F.lit(False) if weights is None else (F.col("weight") * F.lit(left).cast("decimal(38,0)")
                                                     >= cap * F.lit(weights).cast("decimal(38,0)"))
        row = sources.agg(F.count(F.when(full, 1)).alias("n"),
                          F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("caps"),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")).first()
        left, weights = total - row["caps"], row["w"]
        if row["n"] == clamped or not weights:
            break
        clamped = row["n"]
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", max_epochs: int = 3,
        period: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """How much of each document a mix to target weights takes.

    Sources are put in code point order (null last, a source of its own) and
    weigh 1, 2, ... ``period``, repeating; ``water_fill`` gives their targets.
    With r = target / size of the source, every document is taken floor(r)
    times whole, and for the fractional part documents are taken once more in
    the order of a seeded hash as long as they fit the target; what the first
    one that does not fit leaves open is filled with the longest documents that
    fit, and with one more if that brings the sum nearer. Hash slices (two levels of
    ``SLICES``) are summed per source before any rows are ordered, so a source
    that holds a third of all rows is never sorted in one task.

    Returns the ``keep`` columns (default: ``doc_id``) and ``_row, size,
    source_size, target, epochs, taken``; a result column whose name is among
    the kept ones is called by that name with ``mix_`` in front (as often as
    needed, see ``result_name``). Null or blank texts have size 0 and
    take no part in the fractional sample; documents with equal ``doc_id``
    share a hash and are ordered by row. An empty table gives an empty
    result. Columns of other names are ignored.
    """
    keep = [doc_id] if keep is None else keep
    carried = {c: f"_c{i}" for i, c in enumerate(keep)}
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.select(*[F.col(c).alias(n) for c, n in carried.items()], F.col(source).cast("string").alias("_source"),
                       word_count(F.col(text)).alias("_size"), h.alias("_h"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id())
                       .withColumn("_s1", F.shiftright("_h", 50).cast("int"))
                       .withColumn("_s2", F.shiftright("_h", 40).bitwiseAND(F.lit(SLICES - 1)).cast("int")),
                       "mix-rows")
    by = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").cast("long").alias("source_size"))
    ranked = ranked_sources(by).withColumn("weight", (F.pmod("position", F.lit(period)) + 1).cast("long"))
    goals = water_fill(ranked, max_epochs)
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    goals = materialize(goals.select("source", "source_size", "target", whole.alias("epochs"))
                        .withColumn("goal", F.col("target") - F.col("epochs") * size), "mix-goals")

    # level 1: the slice of each source in which its fractional goal is reached
    level1 = _crossing(rows.groupBy("_source", "_s1").agg(F.sum("_size").alias("_n")),
                       goals.select(F.col("source").alias("_source"), F.col("goal").alias("_goal")), ["_source"], "_s1")
    edge1 = level1.select("_source", F.col("_s1").alias("_e1"), F.col("_before").alias("_b1"))
    in1 = _same(rows, edge1, ["_source"], F.col("_s1") == F.col("_e1"))
    level2 = _crossing(in1.groupBy("_source", "_s2").agg(F.sum("_size").alias("_n")),
                       level1.select("_source", (F.col("_goal") - F.col("_before")).alias("_goal")), ["_source"], "_s2")
    edge2 = level2.select("_source", F.col("_s2").alias("_e2"), (F.col("_goal") - F.col("_before")).alias("_goal"))
    # level 2: only the rows of one slice of one slice are put in order
    last = _same(in1.select("_source", "_s2", "_h", "_row", "_size"), edge2, ["_source"], F.col("_s2") == F.col("_e2"))
    w = Window.partitionBy("_source").orderBy("_h", "_row")
    extra = materialize(last.withColumn("_b", F.sum("_size").over(w)).filter((F.col("_size") > 0) & (F.col("_b") <= F.col("_goal")))
                        .select("_row"), "mix-last")

    g = goals.select(F.col("source").alias("_source"), "source_size", "target", "epochs", "goal")
    edges = _same(g, edge1.select("_source", "_e1"), ["_source"], None, "left")
    edges = materialize(_same(edges, edge2.select("_source", "_e2"), ["_source"], None, "left"), "mix-edges")
    before = (F.col("_size") > 0) & (F.col("_e1").isNull() & (F.col("goal") > 0)
                                     | F.coalesce(F.col("_s1") < F.col("_e1"), F.lit(False))
                                     | F.coalesce((F.col("_s1") == F.col("_e1"))
                                                  & (F.col("_e2").isNull() | (F.col("_s2") < F.col("_e2"))), F.lit(False)))
    narrow = _same(rows.select("_source", "_s1", "_s2", "_size", "_h", "_row"), edges.select("_source", "goal", "_e1", "_e2"),
                   ["_source"], None).join(extra.withColumn("_in", F.lit(True)), "_row", "left")
    narrow = materialize(narrow.select("_source", "_s1", "_size", "_h", "_row", "goal",
                                       (before | F.coalesce("_in", F.lit(False))).alias("_first")), "mix-first")
    more = materialize(_fill_rest(narrow).unionByName(extra).withColumn("_more", F.lit(True)), "mix-more")
    out = _same(rows, edges, ["_source"], None).join(more, "_row", "left")
    sampled = before | F.coalesce("_more", F.lit(False))
    times = F.when(F.col("_size") > 0, F.col("epochs") + sampled.cast("long")).otherwise(0)
    found = {"_row": F.col("_row"), "size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"),
             "epochs": times, "taken": times * F.col("_size")}
    return out.select(*[F.col(n).alias(c) for c, n in carried.items()],
                      *[c.alias(result_name(name, keep)) for name, c in found.items()])


def result_name(name: str, kept: list[str]) -> str:
    """``name``, with ``mix_`` in front until it is none of the ``kept`` names."""
    while name in kept:
        name = f"mix_{name}"
    return name


def _fill_rest(narrow: DataFrame) -> DataFrame:
    """Documents (``_row``) that fill what the hash order left of each source's goal.

    Of the documents not taken yet, the longest that still fits is taken, again
    and again; at the end one document more if that brings the sum nearer. The
    choice is made on the number of documents of each size (one row per source
    and size, none longer than twice what is left); of equally long documents the
    first by hash are taken, put in order within one hash slice only."""
    size = F.col("_size")
    left = narrow.groupBy("_source").agg((F.max("goal") - F.coalesce(F.sum(F.when(F.col("_first"), size)), F.lit(0))).alias("_left"))
    rest = narrow.filter(~F.col("_first") & (size > 0)).drop("goal")
    sizes = _same(rest.groupBy("_source", "_size").agg(F.count("*").alias("_n")), left, ["_source"],
                  size < 2 * F.col("_left"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_size", ascending=False, ignore_index=True)
        goal, take = float(frame["_left"].iloc[0]), np.zeros(len(frame), np.int64)
        for i, (s, n) in enumerate(zip(frame["_size"].tolist(), frame["_n"].tolist(), strict=True)):
            take[i] = min(n, int(goal // s))
            goal -= int(take[i]) * s
        free = np.flatnonzero(take < frame["_n"].to_numpy())
        if len(free) and frame["_size"].iloc[free[-1]] - goal < goal:
            take[free[-1]] += 1
        return frame.assign(_goal=take)[["_source", "_size", "_n", "_goal"]][take > 0]

    wanted = materialize(sizes.groupBy("_source").applyInPandas(
        choose, "_source string, _size long, _n long, _goal long"), "mix-wanted")
    keys = ["_source", "_size"]
    some = _same(rest, wanted, keys, None)
    edge = _crossing(some.groupBy(*keys, "_s1").agg(F.count("*").alias("_n")), wanted.drop("_n"), keys, "_s1")
    some = _same(some, edge.select(*keys, F.col("_s1").alias("_e"), F.col("_before").alias("_b")), keys, None, "left")
    whole = some.filter(F.col("_e").isNull() | (F.col("_s1") < F.col("_e"))).select("_row")
    w = Window.partitionBy(*keys).orderBy("_h", "_row")
    part = some.filter(F.col("_s1") == F.col("_e")).withColumn("_k", F.row_number().over(w) + F.col("_b"))
    return whole.unionByName(part.filter(F.col("_k") <= F.col("_goal")).select("_row"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], more: Column | None, how: str = "inner") -> DataFrame:
    """Null-safe join on ``keys`` (a null source is a source)."""
    r = right.select(*[F.col(k).alias(f"_r{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return left.join(r, on if more is None else on & more, how).drop(*[f"_r{k}" for k in keys])


def _crossing(slices: DataFrame, goals: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """Per source, the first slice at whose end the running size exceeds the
    goal (at most ``SLICES`` rows per source), with the size before it."""
    w = Window.partitionBy(*keys).orderBy(slice_col)
    run = _same(slices, goals, keys, None).withColumn("_upto", F.sum("_n").over(w))
    run = run.withColumn("_before", F.col("_upto") - F.col("_n")).filter(F.col("_upto") > F.col("_goal"))
    least = run.groupBy(*keys).agg(F.min_by(F.struct(slice_col, "_before", "_goal"), slice_col).alias("_m"))
    return materialize(least.select(*keys, "_m.*"), "mix-slice")


def repeat(mixed: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``mix(..., keep=keep)``, one row per time a document is taken.

    Documents not taken go (size 0, or beyond the target), so do all rows of an
    empty table; nulls, ties and repeated rows are as in ``mix``. Kept columns
    may have any names."""
    times = F.col(result_name("epochs", keep)).cast("int")
    some = mixed.filter(times > 0)
    copies = F.explode(F.sequence(F.lit(1), times))
    return some.select(F.struct(*keep).alias("_kept"), copies).select("_kept.*")
