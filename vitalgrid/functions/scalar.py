"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL. Spark orders NaN above every number (``NaN > 2`` is true),
    pandas treats it as missing; panels keep missing values as NULL."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


def safe_div(num, den) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (ANSI mode raises on /0)."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def any_exceeds_expr(cols: Iterable, threshold: float) -> Column:
    """True when any ``|c| > threshold``; NULL operands count as false."""
    parts = [F.coalesce(F.abs(col(c)) > F.lit(threshold), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, parts)


def risk_band_expr(score, medium: float = 0.4, high: float = 0.7) -> Column:
    """High when ``score >= high``, Medium when ``>= medium``, else Low (NULL stays NULL)."""
    s = col(score)
    return (F.when(s >= high, F.lit("High"))
            .when(s >= medium, F.lit("Medium"))
            .when(s.isNotNull(), F.lit("Low")))


def relabel_expr(c, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; unknown keys map to NULL."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), col(c)) if kv else F.lit(None).cast("string")


def coerce_numeric_expr(c) -> Column:
    """Text -> double; unparsable text and NaN -> NULL (pandas ``to_numeric(errors='coerce')``)."""
    return nan_to_null(col(c).cast("string").try_cast("double"))


def row_sum_expr(cols: Iterable) -> Column:
    """Row-wise sum that skips NULL cells (pandas ``sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def stable_hash_key(*parts) -> Column:
    """``md5(p1:p2:...)`` — the same text in Spark and in DuckDB, so splits and
    samples are reproducible across engines and across re-executions."""
    cols = [F.lit(p) if isinstance(p, (int, float)) else col(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def stable_uniform(*parts) -> Column:
    """Uniform [0,1) from the first 8 hex digits of the md5 key (deterministic)."""
    h = F.substring(stable_hash_key(*parts), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def minutes_between(start, end) -> Column:
    """``(end - start)`` in minutes as double."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))).cast("double") / F.lit(60_000_000.0)


def round_doubles(df, digits: int = 6):
    """Round every double/float column of ``df`` to ``digits`` places."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
