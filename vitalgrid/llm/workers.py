"""Memory of Python workers, which live on between tasks together with what they hold."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that go to a worker at a time, where the session leaves Spark's default of 10,000.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts may be long: a session with Spark's default number of rows an
    Arrow batch gets a smaller one, any other setting stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for one task, after which the worker's free memory goes back to the system."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task
