"""Exact global order statistics without a single-partition sort.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
Here the ordered key space is cut into buckets, each bucket is ranked / summed
in its own task, and the bucket totals (one row per bucket, a table of proven
small size) give each bucket its offset:

* ``hash_bucket`` — for keys ordered by an md5 hash: the leading hex digits of
  the hash are uniform, so buckets are balanced without sampling.
* ``range_bucket`` — for any other key: Spark's own range partitioner deals the
  rows (it samples them when the query runs, so building the plan runs no job),
  and the partition is the bucket. Callers pass tables of *distinct* keys
  (pre-aggregated), so a hot key is one row and buckets stay balanced. Rows and
  bucket totals read the same exchange, so the input is read once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

B = "_bucket"


def default_buckets(df: DataFrame) -> int:
    """One bucket per shuffle partition of the session (cluster-sized)."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def hash_digits(df: DataFrame) -> int:
    """Hex digits that give 16 buckets or more for every shuffle partition, the
    setting that grows with the data (3 digits, 4096 buckets, at least)."""
    return max(3, math.ceil(math.log(16 * default_buckets(df), 16)))


def hash_bucket(md5_hex: Column, digits: int) -> Column:
    """Bucket from the leading hex digits of an md5 string (16**digits buckets)."""
    return F.conv(F.substring(md5_hex, 1, digits), 16, 10).cast("long")


def range_bucket(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Add ``_bucket`` (int, monotone in ``keys``) with about equal rows per bucket. The
    number of partitions is given, so adaptive execution never joins some of them."""
    return df.repartitionByRange(n or default_buckets(df), *keys).withColumn(B, F.spark_partition_id())


def _bucket_offsets(df: DataFrame, sums: dict[str, Column], descending: bool,
                    by: Sequence[str] = ()) -> DataFrame:
    """Per (group, bucket): the running totals of the buckets before it. The
    table has one row per group and bucket (bounded by the bucket count times
    the few groups a metric table has), so it is broadcast."""
    by = list(by)
    tot = df.groupBy(*by, B).agg(*[e.alias(f"_bt_{k}") for k, e in sums.items()])
    order = F.col(B).desc() if descending else F.col(B).asc()
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, B, *[F.coalesce(F.sum(f"_bt_{k}").over(w), F.lit(0)).alias(f"_off_{k}") for k in sums])
    # one row per bucket is a proven bound; with group keys the size grows with
    # the number of groups, so the join strategy is left to AQE
    return F.broadcast(offs) if not by else offs


def global_row_number(df: DataFrame, order: Sequence[Column], bucket: Column, out: str = "_rank",
                      by: Sequence[str] = ()) -> DataFrame:
    """1-based rank of each row in ``order`` over the whole table (within each
    ``by`` group). ``bucket`` must be monotone in ``order`` (rows of a lower
    bucket come first); no task ranks more than one (group, bucket)."""
    by = list(by)
    d = df.withColumn(B, bucket)
    offs = _bucket_offsets(d, {"n": F.count(F.lit(1))}, descending=False, by=by)
    w = Window.partitionBy(*by, B).orderBy(*order)
    return (d.join(offs, [*by, B], "inner")
             .withColumn(out, F.col("_off_n") + F.row_number().over(w))
             .drop(B, "_off_n"))


def running_totals(df: DataFrame, key: str, cols: Sequence[str], descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_", by: Sequence[str] = ()) -> DataFrame:
    """For a table with one row per distinct ``key`` (per ``by`` group):
    inclusive running sums of ``cols`` in ``key`` order (``descending`` for
    high-to-low) within each group, as ``<prefix><col>``."""
    by = list(by)
    d = range_bucket(df, [*by, key], n_buckets)
    # a total that looks at all value columns needs the same columns as the rows, so both read one exchange
    values = [c for c in df.columns if c not in (*by, key)]
    there = F.greatest(*values).isNotNull() if len(values) > 1 else F.lit(True)
    offs = _bucket_offsets(d, {c: F.sum(F.when(there, F.col(c))) for c in cols}, descending, by)
    order = F.col(key).desc() if descending else F.col(key).asc()
    w = Window.partitionBy(*by, B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(offs, [*by, B], "inner")
    for c in cols:
        d = d.withColumn(f"{prefix}{c}", F.col(f"_off_{c}") + F.sum(c).over(w))
    return d.drop(B, *[f"_off_{c}" for c in cols])
