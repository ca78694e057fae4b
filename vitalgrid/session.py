"""Session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "vitalgrid", extra: dict | None = None) -> SparkSession:
    """Local/test session with the engine defaults (UTC, AQE, ANSI, no UI)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("VITALGRID_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset.

    On a cluster the setting names a shared folder and is used as is. Only a
    ``local`` master without it gets a fresh folder under the system temp dir;
    any other master raises, because executors could not see such a folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="vitalgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def pin_utc(spark: SparkSession) -> None:
    """Panel timestamps are wall-clock UTC; pin the session zone so casts,
    day truncation and bins agree with the SQL oracle."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_WRITTEN: dict[str, list[str]] = {}


def materialize(df, name: str, partitions: int | None = None):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts the lineage (a lost executor re-reads files instead of
    replaying the plan) with one run of the plan, unlike
    ``DataFrame.checkpoint`` which runs it twice, and keeps column pruning for
    later readers. The scan splits the files by ``maxPartitionBytes``, so the
    read-back grows with the table. ``partitions`` spreads a small table that
    an iterative fit reads many times over that many files first."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete the table that ``materialize`` returned as ``df`` (frames read from it become unusable)."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
        paths[:] = [p for p in paths if p.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def release(spark: SparkSession) -> int:
    """Delete every table that ``materialize`` wrote in this application
    (frames read from them become unusable); returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return len(paths)
