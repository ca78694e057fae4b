"""Incremental alert logging as new serving rows arrive.

``readStream`` over the serving table's folder (explicit schema) ->
``foreachBatch``: the latest row of each entity in the batch, alerts with
``risk >= threshold``, appended to the log through the anti join of
``sources.io.append_alerts``. A batch replayed after a failure finds its
alerts already logged and appends nothing, so the log stays exactly-once for
a single writer. Progress is kept in a checkpoint under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitalgrid.operators.serving import RISK_HIGH, latest_row, new_alerts
from vitalgrid.session import checkpoint_dir
from vitalgrid.sources.io import append_alerts


def run_alert_stream(spark: SparkSession, source: str, log_path: str, schema: T.StructType,
                     entity: str = "user_id", ts: str = "received_date", threshold: float = RISK_HIGH,
                     checkpoint: str | None = None, tie: tuple[str, ...] = ()) -> int:
    """Process every serving file present now (``availableNow``) and stop;
    returns the number of alerts appended by this run."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "streams", "alerts")
    appended = [0]

    def on_batch(batch: DataFrame, epoch: int) -> None:
        latest = latest_row(batch, entity, ts, required=["risk_score", "uncertainty"], tie=tie)
        appended[0] += append_alerts(new_alerts(latest, entity, ts, threshold), log_path, entity)

    q = (spark.readStream.schema(schema).parquet(source)
         .writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return appended[0]
