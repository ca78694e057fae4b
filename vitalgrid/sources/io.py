"""Typed reads, panel and report sinks, the alert log, input gates.

Reads always use an explicit schema (no inference pass over the data);
timestamps are parsed with an explicit pattern in the session zone (UTC).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.functions.scalar import nan_to_null
from vitalgrid.session import materialize

#: Bytes of a file that ``write_panel`` aims at, and rows up to which a table of keys is broadcast by a hint.
FILE_BYTES = 128 << 20
BROADCAST_ROWS = 10_000

# The two timestamp layouts of the reference inputs.
TS_DAY_FIRST = "dd/MM/yyyy HH:mm:ss"
TS_ISO = "yyyy-MM-dd HH:mm:ss"

# The wearable signals of the reference panel.
WEARABLE_SIGNALS = ["heart_rate", "heart_rate_variability", "spo2", "steps", "respirations_per_minute",
                    "distance", "body_battery"]


def panel_schema(entity: str = "user_id", ts: str = "received_date",
                 signals: Sequence[str] = WEARABLE_SIGNALS, extra: Sequence[T.StructField] = ()) -> T.StructType:
    return T.StructType([T.StructField(entity, T.LongType()), T.StructField(ts, T.TimestampType()),
                         *[T.StructField(s, T.DoubleType()) for s in signals], *extra])


def read_panel(spark: SparkSession, path: str, fmt: str = "csv", ts_format: str = TS_ISO,
               schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed panel scan. ``columns`` keeps only those columns (pruned at the
    scan for Parquet); NaN readings become NULL."""
    schema = schema or panel_schema()
    if fmt == "csv":
        # columns are bound by the header's names, in whatever order; others are left out
        header = spark.read.option("header", True).csv(path).columns
        missing = [f.name for f in schema.fields if f.name not in header]
        if missing:
            raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
        known = {f.name: f.dataType for f in schema.fields}
        in_file = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
        df = (spark.read.schema(in_file).option("header", True).option("timestampFormat", ts_format)
              .option("mode", "FAILFAST").csv(path)).select(*[f.name for f in schema.fields])
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    if columns:
        df = df.select(*columns)
    return df.select(*[nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f.name) for f in df.schema.fields])


SERVING_SCHEMA = panel_schema(extra=[T.StructField("risk_score", T.DoubleType()),
                                     T.StructField("uncertainty", T.DoubleType()),
                                     T.StructField("top_factor_1", T.StringType()),
                                     T.StructField("top_factor_2", T.StringType()),
                                     T.StructField("top_factor_3", T.StringType())])
ALERT_SCHEMA = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("alert_time", T.TimestampType()),
                             T.StructField("risk_score", T.DoubleType()), T.StructField("uncertainty", T.DoubleType())])


def read_serving(spark: SparkSession, path: str, schema: T.StructType = SERVING_SCHEMA, fmt: str = "parquet",
                 ts_format: str = TS_ISO) -> DataFrame:
    return read_panel(spark, path, fmt=fmt, ts_format=ts_format, schema=schema)


def read_alerts(spark: SparkSession, path: str, schema: T.StructType = ALERT_SCHEMA, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("timestampFormat", TS_ISO).csv(path)
    return spark.read.schema(schema).format(fmt).load(path)


def drop_leading_rows(df: DataFrame, order: str | Sequence[str], n: int) -> DataFrame:
    """Drop the first ``n`` rows by a unique ``order`` key (e.g. a second
    header row of a survey export). The ``n`` first keys come from a top-n
    (each task keeps its own n before the merge); an anti join removes them."""
    order = [order] if isinstance(order, str) else list(order)
    if n <= 0:
        return df
    first = df.select(*order).orderBy(*order).limit(n)
    return df.join(F.broadcast(first) if n <= BROADCAST_ROWS else first, order, "left_anti")


def write_panel(df: DataFrame, path: str, entity: str, ts: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), files: int | None = None, mode: str = "overwrite",
                file_bytes: int = FILE_BYTES) -> None:
    """Write a panel clustered by (entity, ts): range partitioning on both keys
    splits a hot entity over several files by time (a hash on the entity alone
    would put it in one file), and sorting inside each file keeps Parquet
    min/max statistics tight for entity and time filters.

    The rows are written once to the shared folder (so ``df`` runs once, not
    again for the range bounds), and their measured bytes give the number of
    files: about ``file_bytes`` each. Rows of one (entity, ts) cannot be cut by
    ranges, so a file also ends at the rows that ``file_bytes`` hold on average."""
    spark = df.sparkSession
    held = materialize(df, "panel")
    size, rows = bytes_of(spark, held.inputFiles()), held.count()
    n = files or max(1, -(-size // file_bytes))
    most = max(1, int(rows * file_bytes / size)) if size else 1
    out = held.repartitionByRange(n, entity, ts).sortWithinPartitions(entity, ts)
    w = out.write.mode(mode).option("maxRecordsPerFile", most)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampFormat", TS_ISO).csv(path)
    else:
        w.format(fmt).save(path)


def bytes_of(spark: SparkSession, files: Sequence[str]) -> int:
    """Bytes of files of any file system (one listing of their folders)."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in files}
    return sum(path(f).getFileSystem(conf).getContentSummary(path(f)).getLength() for f in folders)


def write_report(df: DataFrame, path: str, name: str, nested: dict[str, Sequence[str]] | None = None) -> None:
    """A result table twice: flat CSV with header, and JSON where ``nested``
    groups columns into structs (``{"random_forest": ["auroc", ...]}``). ``df`` runs once."""
    df = materialize(df, "report")
    df.write.mode("overwrite").option("header", True).csv(os.path.join(path, f"{name}_csv"))
    cols = []
    used = set()
    for key, members in (nested or {}).items():
        cols.append(F.struct(*[F.col(m) for m in members]).alias(key))
        used |= set(members)
    cols += [F.col(c) for c in df.columns if c not in used]
    df.select(*cols).write.mode("overwrite").json(os.path.join(path, f"{name}_json"))


def append_alerts(new: DataFrame, path: str, entity: str = "user_id", ts: str = "alert_time") -> int:
    """Append alerts not yet in the log at ``path`` (anti join on entity and
    time); returns the number appended. Plain Parquet appends are safe for ONE
    writer at a time; concurrent writers need a table format with commits."""
    spark = new.sparkSession
    log = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = new
    # the file system of the path is asked, and a log that cannot be read raises: nothing is appended then
    if log.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log):
        old = read_alerts(spark, path)
        fresh = new.join(old.select(entity, ts), [entity, ts], "left_anti")
    fresh = fresh.dropDuplicates([entity, ts])
    fresh = materialize(fresh, "alerts-batch")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def require_complete(df: DataFrame, columns: Sequence[str], entity: str, min_entities: int = 1,
                     min_rows: int = 1) -> DataFrame:
    """Gate: raise when a column is missing or the input looks truncated
    (fewer entities or rows than expected). Returns the one-row check table."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing expected columns: {', '.join(missing)}")
    chk = df.agg(F.count_distinct(entity).alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))
    row = chk.first()
    if row["n_entities"] < min_entities or row["n_rows"] < min_rows:
        raise ValueError(f"input looks incomplete: {row['n_entities']} entities and {row['n_rows']} rows, "
                         f"expected at least {min_entities} and {min_rows}")
    return chk.withColumn("complete", F.lit(True))
