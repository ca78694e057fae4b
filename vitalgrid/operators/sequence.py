"""Ordered per-entity operators (row frames, look-ahead labels, run lengths).

Scale design. A plain ``Window.partitionBy(entity)`` puts a whole entity in one
task; one entity may hold a third of all rows. Every operator here therefore
works on *chunks*:

1. ``row_index`` numbers rows per entity in parallel: counts per
   (entity, time bucket) -> running offsets over that small table -> row_number
   inside each (entity, bucket) piece. No task ever holds a whole entity.
2. Row-frame windows of bounded reach (``rows`` back / ``horizon`` ahead) run
   over ``(entity, rn-chunk)`` partitions with the neighbouring rows copied in as
   *halo* rows (``with_halo``), then the halo copies are dropped.
3. Unbounded carries (last non-null value before a row) run inside the chunk
   and take the value from earlier chunks through a per-chunk summary table
   (``carry_last``).

The default chunk sizes keep chunks large enough to amortise the halo and small
enough that one chunk always fits in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 250_000
RN = "_rn"


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def row_index(df: DataFrame, entity: str, order: Sequence[str], bucket: str = "day",
              out: str = RN, max_piece_rows: int = 1_000_000) -> DataFrame:
    """Add ``out`` = 1-based row number per ``entity`` in ``order`` order.

    The first ``order`` column must be a timestamp; rows are cut into pieces
    (entity, ``bucket`` = ``date_trunc`` unit) that are numbered independently
    and shifted by the running row count of the earlier pieces of the entity.
    A piece with more than ``max_piece_rows`` rows (a hot entity-day) is cut
    into equal time slices of its own span, so no task numbers more than about
    that many rows; only the hot pieces are joined back to the rows (a table
    that is empty or tiny in the normal case). Rows sharing one timestamp stay
    in one slice.
    """
    order = _cols(order)
    ts = order[0]
    d = df.withColumn("_bk", F.date_trunc(bucket, F.col(ts)))
    pieces = d.groupBy(entity, "_bk").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_p0"),
                                          F.max(ts).alias("_p1"))
    hot = (pieces.filter(F.col("_n") > max_piece_rows)
           .select(F.col(entity).alias("_he"), F.col("_bk").alias("_hb"),
                   F.ceil(F.col("_n") / max_piece_rows).alias("_parts"), F.col("_p0"),
                   (F.unix_micros(F.col("_p1")) - F.unix_micros(F.col("_p0")) + 1).alias("_span")))
    d = d.join(hot, (d[entity] == hot["_he"]) & (d["_bk"] == hot["_hb"]), "left")
    frac = (F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_p0"))).cast("double") / F.col("_span").cast("double")
    d = d.withColumn("_sl", F.coalesce(F.floor(frac * F.col("_parts")), F.lit(0)).cast("long")).drop(
        "_he", "_hb", "_parts", "_p0", "_span")
    counts = d.groupBy(entity, "_bk", "_sl").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(entity).orderBy("_bk", "_sl").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(entity).alias("_oe"), F.col("_bk").alias("_ob"), F.col("_sl").alias("_os"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # null-safe join: a NULL timestamp forms its own (first) piece
    cond = (d[entity].eqNullSafe(offsets["_oe"]) & d["_bk"].eqNullSafe(offsets["_ob"])
            & d["_sl"].eqNullSafe(offsets["_os"]))
    d = d.join(offsets, cond, "inner").drop("_oe", "_ob", "_os")
    piece = Window.partitionBy(entity, "_bk", "_sl").orderBy(*order)
    return d.withColumn(out, (F.col("_off") + F.row_number().over(piece)).cast("long")).drop("_off", "_bk", "_sl")


def with_halo(df: DataFrame, rn: str, chunk_rows: int, before: int, after: int) -> DataFrame:
    """Assign each row to chunk ``(rn-1) div chunk_rows`` and copy the rows that
    a neighbouring chunk needs as context: the last ``before`` rows of a chunk go
    to the next chunk, the first ``after`` rows to the previous one.

    Adds ``_chunk`` (long) and ``_halo`` (bool: true for a copy).
    """
    if before > chunk_rows or after > chunk_rows:
        raise ValueError("chunk_rows must be at least the frame reach")
    r = F.col(rn) - 1
    chunk = F.floor(r / chunk_rows).cast("long")
    pos = r - chunk * chunk_rows
    targets = [F.struct(chunk.alias("c"), F.lit(False).alias("h"))]
    if before > 0:
        targets.append(F.when(pos >= chunk_rows - before,
                              F.struct((chunk + 1).alias("c"), F.lit(True).alias("h"))))
    if after > 0:
        targets.append(F.when((pos < after) & (chunk > 0),
                              F.struct((chunk - 1).alias("c"), F.lit(True).alias("h"))))
    arr = F.filter(F.array(*targets), lambda x: x.isNotNull()) if len(targets) > 1 else F.array(*targets)
    return (df.withColumn("_t", F.explode(arr))
              .withColumn("_chunk", F.col("_t.c")).withColumn("_halo", F.col("_t.h")).drop("_t"))


def carry_last(df: DataFrame, entity: str, chunk: str, order: Sequence[str], cols: Sequence[str],
               suffix: str = "_prev", reverse: bool = False, inclusive: bool = True) -> DataFrame:
    """For each row, the last non-null value of each column in ``cols`` at or
    before the row (``inclusive``) in ``order`` order within ``entity``
    (``reverse=True``: at or after). Works chunk by chunk and takes values from
    earlier chunks through a per-(entity, chunk) summary, so no task holds a
    whole entity. ``chunk`` must be monotone in ``order``.
    """
    order = _cols(order)
    cols = _cols(cols)
    okey = F.struct(*[F.col(o) for o in order])
    ord_exprs = [F.col(o).desc() for o in order] if reverse else [F.col(o).asc() for o in order]
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(entity, chunk).orderBy(*ord_exprs).rowsBetween(Window.unboundedPreceding, end)
    # one select: a single Window operator carries every column
    out = df.select("*", *[F.last(F.col(c), ignorenulls=True).over(w_in).alias(f"_loc_{c}") for c in cols])
    pick = F.min_by if reverse else F.max_by
    summ = df.groupBy(entity, chunk).agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_edge_{c}") for c in cols])
    c_ord = F.col(chunk).desc() if reverse else F.col(chunk).asc()
    w_ch = Window.partitionBy(entity).orderBy(c_ord).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(entity, chunk, *[F.last(F.col(f"_edge_{c}"), ignorenulls=True).over(w_ch)
                                         .alias(f"_car_{c}") for c in cols])
    out = out.join(carry, [entity, chunk], "left")
    out = out.select("*", *[F.coalesce(F.col(f"_loc_{c}"), F.col(f"_car_{c}")).alias(f"{c}{suffix}") for c in cols])
    return out.drop(*[f"_loc_{c}" for c in cols], *[f"_car_{c}" for c in cols])


def _trend_exprs(d: DataFrame, entity: str, rn: str, cols: Sequence[str], rows: int, suffix: str) -> DataFrame:
    """Mean of the last ``rows`` usable values in O(n), without subtracting
    sums: the row numbers are cut into blocks of ``rows``; the last ``rows``
    rows are the head of the current block and the tail of the one before, so
    a spike leaves no rounding error behind once it is out of the window.
    NULL, NaN and infinite values are skipped. All columns go through one
    ``select`` per frame, so Spark runs one Window operator per frame, all on
    the (entity, chunk) partitioning."""
    keys = [entity, "_chunk"]
    block = Window.partitionBy(*keys, "_blk")
    head = block.orderBy(F.col(rn).asc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = block.orderBy(F.col(rn).desc()).rowsBetween(Window.unboundedPreceding, 0)
    asc = Window.partitionBy(*keys).orderBy(rn)
    # one exchange by (entity, chunk) serves the block frames too
    d = d.repartition(*keys).withColumn("_blk", F.floor(F.col(rn) / rows))
    x = {c: F.col(c).cast("double") for c in cols}
    ok = {c: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for c, v in x.items()}
    d = d.select("*", *[e for c in cols for e in (F.sum(ok[c]).over(tail).alias(f"_ts_{c}"),
                                                  F.count(ok[c]).over(tail).alias(f"_tn_{c}"))])
    d = d.select("*", *[e for c in cols for e in (F.sum(ok[c]).over(head).alias(f"_hs_{c}"),
                                                  F.count(ok[c]).over(head).alias(f"_hn_{c}"))])
    # the tail that starts rows - 1 rows back counts unless the window is exactly the current block
    cut = (F.col(rn) % rows) != rows - 1
    trends = []
    for c in cols:
        parts = [F.coalesce(F.when(cut, F.lag(f"_t{k}_{c}", rows - 1).over(asc)) if rows > 1 else F.lit(None), F.lit(0))
                 for k in "sn"]
        total = F.coalesce(F.col(f"_hs_{c}"), F.lit(0.0)) + parts[0]
        trends.append((total / F.nullif(F.col(f"_hn_{c}") + parts[1], F.lit(0))).alias(f"{c}{suffix}"))
    return d.select("*", *trends).drop("_blk", *[f"_{k}_{c}" for c in cols for k in ("ts", "tn", "hs", "hn")])


def _lookahead_expr(d: DataFrame, part, rn: str, flag: str, horizon: int, out: str) -> DataFrame:
    """1 when ``flag`` holds in rows ``[rn, rn + horizon - 1]``, in O(n) on the
    ascending order: a running count of flagged rows, read ``horizon - 1``
    rows ahead (``lead``) minus its value one row back; past the end of the
    partition the count at its last row is used."""
    run = part.orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    asc = part.orderBy(rn)
    d = d.select("*", F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long")).over(run).alias("_fc"))
    d = d.select("*", F.lead("_fc", horizon - 1).over(asc).alias("_fa"), F.lag("_fc", 1).over(asc).alias("_fb"),
                 F.max("_fc").over(part).alias("_fe"))
    label = ((F.coalesce(F.col("_fa"), F.col("_fe")) - F.coalesce(F.col("_fb"), F.lit(0))) > 0).cast("int")
    return d.withColumn(out, label).drop("_fc", "_fa", "_fb", "_fe")


def _ordered(df: DataFrame, entity: str, order, rn: str | None, bucket: str) -> tuple[DataFrame, str]:
    if rn is not None and rn in df.columns:
        return df, rn
    return row_index(df, entity, order, bucket=bucket), RN


def rolling_mean(df: DataFrame, entity: str, order, cols: Sequence[str], rows: int = 60,
                 suffix: str = "_trend", chunk_rows: int = DEFAULT_CHUNK_ROWS, rn: str | None = None,
                 bucket: str = "day") -> DataFrame:
    """Mean of the last ``rows`` rows (current included) per entity; NULL, NaN
    and infinite values are skipped and one value is enough (pandas
    ``rolling(rows, min_periods=1).mean()``). Row counts, not time spans."""
    d, rcol = _ordered(df, entity, order, rn, bucket)
    d = with_halo(d, rcol, max(chunk_rows, rows), before=rows - 1, after=0)
    d = _trend_exprs(d, entity, rcol, _cols(cols), rows, suffix)
    d = d.filter(~F.col("_halo")).drop("_chunk", "_halo")
    return d if rcol == rn else d.drop(RN)


def future_event(df: DataFrame, entity: str, order, flag: str, horizon: int = 720,
                 out: str = "target_future_risk", chunk_rows: int = DEFAULT_CHUNK_ROWS,
                 rn: str | None = None, bucket: str = "day") -> DataFrame:
    """1 when ``flag`` is true in any of the rows ``[current, current + horizon - 1]``
    of the entity (fewer rows at the series end), else 0.

    O(n) form on the ascending order: a running count of flagged rows read
    ``horizon - 1`` rows ahead minus its value one row back (no forward frame,
    no second sort).
    """
    d, rcol = _ordered(df, entity, order, rn, bucket)
    d = with_halo(d, rcol, max(chunk_rows, horizon), before=0, after=horizon - 1)
    d = _lookahead_expr(d, Window.partitionBy(entity, "_chunk"), rcol, flag, horizon, out)
    d = d.filter(~F.col("_halo")).drop("_chunk", "_halo")
    return d if rcol == rn else d.drop(RN)


def sustained(df: DataFrame, entity: str, order, flag: str, rows: int = 15, out: str | None = None,
              chunk_rows: int = DEFAULT_CHUNK_ROWS, rn: str | None = None, bucket: str = "day") -> DataFrame:
    """True from the ``rows``-th consecutive flagged row on (the window of the last
    ``rows`` rows is all true); the first ``rows - 1`` rows of an entity are false."""
    out = out or flag
    d, rcol = _ordered(df, entity, order, rn, bucket)
    d = with_halo(d, rcol, max(chunk_rows, rows), before=rows - 1, after=0)
    w = Window.partitionBy(entity, "_chunk").orderBy(rcol).rowsBetween(Window.unboundedPreceding, 0)
    last_break = F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(rcol))).over(w)
    d = d.withColumn(out, (F.col(rcol) >= rows) & (F.coalesce(last_break, F.lit(0)) <= F.col(rcol) - rows))
    d = d.filter(~F.col("_halo")).drop("_chunk", "_halo")
    return d if rcol == rn else d.drop(RN)


def flag_episodes(df: DataFrame, entity: str, ts: str, flag: str, max_gap: str = "1 minute",
                  bucket: str = "day", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Intervals of flagged rows: a new episode starts when the time since the
    previous flagged row of the entity is more than ``max_gap``.

    Returns ``entity, episode_start, episode_end, n_rows``. The previous flagged
    time is a carry across chunks of ``chunk_rows`` numbered rows, so no task
    holds a whole entity, nor a whole hot day of one.
    """
    f = df.filter(F.coalesce(F.col(flag), F.lit(False))).select(entity, ts)
    f = row_index(f, entity, [ts], bucket=bucket).withColumn("_ck", F.floor((F.col(RN) - 1) / chunk_rows))
    f = carry_last(f.withColumn("_t", F.col(ts)), entity, "_ck", [RN], ["_t"], suffix="_before",
                   inclusive=False)
    gap = F.col(ts) > F.col("_t_before") + F.expr(f"INTERVAL {max_gap}")
    f = f.withColumn("_start", F.when(F.col("_t_before").isNull() | gap, F.col(ts)))
    f = carry_last(f, entity, "_ck", [RN], ["_start"], suffix="_ep")
    return (f.groupBy(entity, F.col("_start_ep").alias("episode_start"))
             .agg(F.max(ts).alias("episode_end"), F.count(F.lit(1)).alias("n_rows")))


def trend_and_label(df: DataFrame, entity: str, rn: str, trend_cols: Sequence[str], rows: int | None,
                    flag: str, horizon: int, label: str = "target_future_risk",
                    sustained_rows: int | None = None, sustained_out: str = "sustained_event",
                    chunk_rows: int = DEFAULT_CHUNK_ROWS, trend_suffix: str = "_trend") -> DataFrame:
    """``rolling_mean`` + optional ``sustained`` + ``future_event`` in ONE
    exchange and ONE sort: the chunks carry a halo of the preceding rows (for
    the trend and the run length) and of the following rows (for the label).
    Back-looking frames of core rows never reach the following halo, and the
    look-ahead of core rows never reaches the preceding one, so both can share
    the chunk; the sustained flag is also right on the following halo (its own
    history is in the chunk), which the label then reads. Every frame is O(n):
    running sums / counts / max plus ``lag`` / ``lead``. Needs the row index ``rn``."""
    before = max((rows or 1) - 1, (sustained_rows or 1) - 1)
    after = horizon - 1
    d = with_halo(df, rn, max(chunk_rows, before, after, 1), before=before, after=after)
    part = Window.partitionBy(entity, "_chunk")
    if rows:
        d = _trend_exprs(d, entity, rn, trend_cols, rows, trend_suffix)
    target = flag
    if sustained_rows:
        wa = part.orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
        last_break = F.max(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(rn))).over(wa)
        d = d.select("*", last_break.alias("_lb")).withColumn(
            sustained_out, (F.col(rn) >= sustained_rows) & (F.coalesce(F.col("_lb"), F.lit(0)) <= F.col(rn) - sustained_rows)
        ).drop("_lb")
        target = sustained_out
    d = _lookahead_expr(d, part, rn, target, horizon, label)
    return d.filter(~F.col("_halo")).drop("_chunk", "_halo")


def carry_both(df: DataFrame, entity: str, chunk: str, order: Sequence[str], cols: Sequence[str],
               before_suffix: str = "_bf", after_suffix: str = "_af", strictly_after: bool = False) -> DataFrame:
    """For each row and column: the last non-NULL value at or before the row
    (``<col><before_suffix>``) and the first at or after it
    (``<col><after_suffix>``; ``strictly_after``: after it), within ``entity`` in ``order`` order.

    The rows are partitioned once by (entity, chunk); the ascending and the
    descending window run on that partitioning (one sort each, no second
    exchange). The per-chunk edge summary is a local aggregate on rows
    partitioned the same way; it reads only the carried columns, so Spark
    plans it as its own (narrower) exchange of the same input. Values from
    earlier / later chunks come through the summary table (one row per chunk)."""
    order = _cols(order)
    cols = _cols(cols)
    okey = F.struct(*[F.col(o) for o in order])
    shuffled = df.repartition(entity, chunk)
    part = Window.partitionBy(entity, chunk)
    w_up = part.orderBy(*[F.col(o).asc() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    w_dn = part.orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding,
                                                                       -1 if strictly_after else 0)
    out = shuffled.select("*", *[F.last(F.col(c), ignorenulls=True).over(w_up).alias(f"_lb_{c}") for c in cols])
    out = out.select("*", *[F.last(F.col(c), ignorenulls=True).over(w_dn).alias(f"_la_{c}") for c in cols])
    summ = shuffled.groupBy(entity, chunk).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_el_{c}") for c in cols],
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_ef_{c}") for c in cols])
    earlier = Window.partitionBy(entity).orderBy(F.col(chunk).asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(entity).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(entity, chunk,
                        *[F.last(F.col(f"_el_{c}"), ignorenulls=True).over(earlier).alias(f"_cb_{c}") for c in cols],
                        *[F.last(F.col(f"_ef_{c}"), ignorenulls=True).over(later).alias(f"_ca_{c}") for c in cols])
    out = out.join(carry, [entity, chunk], "left")
    out = out.select("*", *[F.coalesce(F.col(f"_lb_{c}"), F.col(f"_cb_{c}")).alias(f"{c}{before_suffix}")
                            for c in cols],
                     *[F.coalesce(F.col(f"_la_{c}"), F.col(f"_ca_{c}")).alias(f"{c}{after_suffix}") for c in cols])
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("lb", "la", "cb", "ca")])
