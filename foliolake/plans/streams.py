"""Queries that run as streams over what is there and end; their results equal the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, table
from ..streaming.tasks import latest_status
from . import Query


def stream_task_state(spark: SparkSession, folder: str) -> DataFrame:
    """The running state of every task: a stateful aggregation of the event stream, written out by batch to the shared folder."""
    out = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    q = latest_status(stream, "user_id", "ts", "event_type").writeStream.outputMode("complete").foreachBatch(keep)
    q.option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/state")


QUERIES: dict[str, Query] = {"stream_task_state": stream_task_state}
SQL: dict[str, str] = {"stream_task_state": "SELECT user_id, max(ts) AS at, arg_max(event_type, (ts, event_type)) AS status, count(*) AS events FROM events GROUP BY user_id"}
