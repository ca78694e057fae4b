"""Aggregations: profiles, null counts, rates, cards, bins, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by(df: DataFrame, by):
    by = [by] if isinstance(by, str) else list(by or [])
    return df.groupBy(*by) if by else df.groupBy()


def event_rate(df: DataFrame, flag: str, by=None, prefix: str = "") -> DataFrame:
    """Rows, flagged rows and flagged share (overall or per ``by`` group)."""
    f = F.coalesce(F.col(flag).cast("int"), F.lit(0))
    return _by(df, by).agg(F.count(F.lit(1)).alias(f"{prefix}n_rows"),
                           F.sum(f).cast("long").alias(f"{prefix}n_events"),
                           F.avg(f.cast("double")).alias(f"{prefix}event_share"))


def label_rate(df: DataFrame, label: str = "target_future_risk", by=None) -> DataFrame:
    """Rows, positives and positive share of an int label."""
    y = F.col(label).cast("long")
    return _by(df, by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(y).alias("n_positive"),
                           F.avg(y.cast("double")).alias("positive_share"))


def profile(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """One row: rows, distinct entities, first and last timestamp."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"),
                  F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def entity_ids(df: DataFrame, entity: str) -> DataFrame:
    """The sorted distinct entity ids, as a DataFrame (never a collected list)."""
    return df.select(entity).distinct().orderBy(entity)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL (and NaN) cells per column, long format ``column_name, n_null``:
    one aggregate pass, then an unpivot of the single result row."""
    columns = list(columns or df.columns)
    aggs = []
    for c in columns:
        miss = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        aggs.append(F.count_if(miss).alias(c))
    wide = df.agg(*aggs)
    return wide.unpivot([], columns, "column_name", "n_null")


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Rows per distinct value, most frequent first (partial counts map-side)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), col)


def exact_median(df: DataFrame, col: str):
    """Exact median (mean of the two middle values for an even count) as a
    scalar-subquery Column. Works on one row per distinct value with bucketed
    running counts, so no task ever buffers all values (Spark's exact
    ``percentile`` keeps every distinct value in one final buffer)."""
    from vitalgrid.operators.ranking import running_totals
    x = df.filter(F.col(col).isNotNull())
    counts = x.groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    rt = running_totals(counts, col, ["_c"])
    n = x.select(F.count(F.lit(1))).scalar()
    r1 = F.floor((n + 1) / 2)
    r2 = F.ceil((n + 1) / 2)

    def at(r):
        return F.max(F.when((F.col("cum__c") - F.col("_c") < r) & (r <= F.col("cum__c")), F.col(col)))
    return rt.select(((at(r1).cast("double") + at(r2).cast("double")) / 2).alias("median")).scalar()


def median_split(df: DataFrame, score: str, out: str = "target") -> DataFrame:
    """``out`` = 1 when ``score`` is above the exact median of ``score``, else 0."""
    return df.withColumn(out, (F.col(score) > exact_median(df, score)).cast("int"))
