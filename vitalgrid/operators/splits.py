"""Deterministic splits, samples and per-cell masks.

Randomness is an md5 of ``key:seed`` — the same text in Spark and in DuckDB,
stable under task retries and re-execution (``rand()`` is not). Ranks over
the whole table come from ``ranking.global_row_number`` (no single-task sort).
"""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions.scalar import stable_hash_key, stable_uniform
from vitalgrid.operators.ranking import global_row_number, hash_bucket, hash_digits


def entity_ranks(df: DataFrame, entity: str, seed: int, digits: int | None = None) -> DataFrame:
    """Distinct entities with ``_rank`` = position in the seeded shuffle and
    ``_n`` = number of entities (a scalar subquery)."""
    ids = df.select(entity).distinct().withColumn("_h", stable_hash_key(entity, seed))
    ranked = global_row_number(ids, [F.col("_h"), F.col(entity)], hash_bucket(F.col("_h"), digits or hash_digits(df)))
    n = df.select(F.count_distinct(entity)).scalar()
    return ranked.withColumn("_n", n).drop("_h")


def test_entities(df: DataFrame, entity: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """The ``ceil(test_size * n)`` entities that go to test."""
    r = entity_ranks(df, entity, seed)
    return r.filter(F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_size))).select(entity)


def split_by_entity(df: DataFrame, entity: str, test_size: float = 0.25, seed: int = 42
                    ) -> tuple[DataFrame, DataFrame]:
    """(train, test) with no entity on both sides; ``ceil(test_size * n)``
    entities go to test. The entity tables hold one row per entity; AQE
    broadcasts them while they are small."""
    test_ids = test_entities(df, entity, test_size, seed)
    return df.join(test_ids, entity, "left_anti"), df.join(test_ids, entity, "left_semi")


def split_stratified(df: DataFrame, label: str, key: str, test_size: float = 0.25, seed: int = 42
                     ) -> tuple[DataFrame, DataFrame]:
    """(train, test) with about ``round(test_size * n_y)`` test rows of every
    class ``y`` (NULL is a class), chosen by the seeded hash of ``key``."""
    h = stable_hash_key(key, seed)
    d = df.withColumn("_h", h)
    ranked = global_row_number(d, [F.col(label), F.col("_h"), F.col(key)],
                               F.struct(F.col(label), hash_bucket(F.col("_h"), hash_digits(d))).alias("_b"))
    # per-class rank = global rank minus the rows of lower classes
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_ny"))
    # one row per class: a window over the whole (tiny) class table is fine here
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(label).alias("_class"), "_ny", F.coalesce(F.sum("_ny").over(w), F.lit(0)).alias("_below"))
    # a NULL label is a class of its own, so no row is lost
    r = ranked.join(counts, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")
    is_test = (F.col("_rank") - F.col("_below")) <= F.round(F.col("_ny") * F.lit(test_size))
    r = r.withColumn("_test", is_test).drop("_rank", "_below", "_ny", "_h")
    return r.filter(~F.col("_test")).drop("_test"), r.filter(F.col("_test")).drop("_test")


def assign_clients(df: DataFrame, entity: str, k: int = 4, seed: int = 42, out: str = "client") -> DataFrame:
    """Entity -> group 0..k-1 from a seeded shuffle cut into ``k`` near-equal
    parts (the first ``n % k`` parts one larger). One row per entity."""
    r = entity_ranks(df, entity, seed)
    i = F.col("_rank") - 1
    q = F.floor(F.col("_n") / k)
    rem = F.col("_n") - q * k
    big = (q + 1) * rem
    grp = F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / F.greatest(q, F.lit(1))))
    return r.select(entity, grp.cast("int").alias(out))


#: Rows of a hash range in which the cut of a sample is looked for row by row, and hex digits of a range at a time.
CUT_ROWS = 100_000
CUT_DIGITS = 4


def _sample_table(d: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the lowest hash ``_h`` (md5 hex, ties by ``keys``).

    Rows per hash range (at most 16^4 counts, of the key columns alone) tell in
    which range the n-th row lies; a range of more than ``CUT_ROWS`` rows is cut
    again. The first rows of that range give the cut-off, so what is left is a
    filter: no exchange, no sort of rows."""
    if n <= 0:
        return d.limit(0)
    prefix, left, inside = "", n, d.select("_h", *keys)
    while True:
        counts = {r["_b"]: r["n"] for r in inside.groupBy(F.substring("_h", len(prefix) + 1, CUT_DIGITS).alias("_b")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        if left >= sum(counts.values()):
            return d if not prefix else d.filter(F.col("_h") <= prefix + "g")
        for digits in sorted(counts):
            if counts[digits] >= left:
                break
            left -= counts[digits]
        prefix, rows = prefix + digits, counts[digits]
        inside = d.select("_h", *keys).filter(F.startswith("_h", F.lit(prefix)))
        if rows <= CUT_ROWS or len(prefix) + CUT_DIGITS > 32:
            break
    first = inside.orderBy("_h", *keys).limit(left + 1).collect()
    last = first[left - 1]
    if len(first) > left and first[left] == last:
        # repeated rows at the cut: only some of them belong to the sample
        part = d.filter(F.startswith("_h", F.lit(prefix))).orderBy("_h", *keys).limit(left)
        return d.filter(F.col("_h") < prefix).unionByName(part)
    upto = F.col("_h") < last["_h"]
    same = F.col("_h") == last["_h"]
    for k in keys:
        value = F.lit(last[k]).cast(d.schema[k].dataType)
        smaller = (F.lit(False) if last[k] is None else F.col(k).isNull() | (F.col(k) < value))
        upto, same = upto | (same & smaller), same & F.col(k).eqNullSafe(value)
    return d.filter(upto | same)


def _below_cut(d: DataFrame, by: list[str], n: int) -> DataFrame:
    """The rows of ``d`` up to the hash range (the first ``CUT_DIGITS`` digits of ``_h``) that holds the ``n``-th row of
    their ``by`` group. Groups have at most 16^4 counts each; rows with a null group go."""
    counts = d.groupBy(*by, F.substring("_h", 1, CUT_DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut = (counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).filter(F.col("_before") < n)
                 .groupBy(*by).agg(F.max("_b").alias("_cut")))
    return d.join(cut, by, "inner").filter(F.substring("_h", 1, CUT_DIGITS) <= F.col("_cut")).drop("_cut")


def sample_n(df: DataFrame, key: str | Sequence[str], n: int, seed: int = 42,
             by: str | Sequence[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, chosen by the seeded
    hash of ``key`` (one column or several that are unique together; per
    ``by`` group when given).

    Whole table: counts per hash range and the first rows of one range give
    the cut-off hash (``_sample_table``), so the sample itself is a filter
    without an exchange. Per group: for ``n``
    up to Spark's ``windowGroupLimitThreshold`` a ``row_number() <= n`` filter,
    which Spark runs with a partial WindowGroupLimit before the shuffle (a hot
    group sends at most ``n`` rows per map task); for larger ``n`` counts per
    group and hash range drop the ranges after the ``n``-th row (``_below_cut``),
    and the rank inside each group comes from hash buckets
    (``ranking.global_row_number``), so rows exchanged do not grow with the table."""
    keys = [key] if isinstance(key, str) else list(key)
    h = stable_hash_key(*keys, seed)
    if by is None:
        return _sample_table(df.withColumn("_h", h), keys, n).drop("_h")
    by = [by] if isinstance(by, str) else list(by)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    d = df.withColumn("_h", h)
    if n <= limit:
        w = Window.partitionBy(*by).orderBy("_h", *keys)
        return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_h", "_r")
    d = _below_cut(d, by, n)
    ranked = global_row_number(d, [F.col("_h"), *[F.col(k) for k in keys]], hash_bucket(F.col("_h"), hash_digits(d)), out="_r",
                               by=by)
    return ranked.filter(F.col("_r") <= n).drop("_h", "_r")


def mask_cells(df: DataFrame, cols: Sequence[str], frac: float, seed: int, key: str,
               value: float = 0.0) -> DataFrame:
    """Set each cell of ``cols`` to ``value`` with probability ``frac``
    (missing-data stress test); the draw is the seeded hash of ``key:col``."""
    for c in cols:
        hit = stable_uniform(key, F.lit(c), seed) < F.lit(frac)
        df = df.withColumn(c, F.when(hit, F.lit(value)).otherwise(F.col(c)))
    return df


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced class weights ``n / (n_classes * n_y)`` as a row column."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_ny"))
    # rows and classes follow from the counts, in one scalar subquery
    both = counts.select(F.struct(F.sum("_ny").alias("n"), F.count(label).alias("k"))).scalar()
    w = counts.select(label, (both["n"] / (both["k"] * F.col("_ny"))).alias(out))
    return df.join(w, label, "left")


def standardise(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Centre and scale by the train mean and population std (a zero std
    scales by 1). The fit is one aggregate over ``train`` returning
    ``2 x len(cols)`` numbers."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}

    def apply(d: DataFrame) -> DataFrame:
        out = []
        for f in d.columns:
            if f in stats:
                m, s = stats[f]
                scale = s if s not in (None, 0.0) else 1.0
                out.append(((F.col(f) - F.lit(m)) / F.lit(scale)).alias(f))
            else:
                out.append(F.col(f))
        return d.select(*out)
    return apply(train), apply(test)
