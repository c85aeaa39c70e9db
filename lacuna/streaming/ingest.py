"""Incremental collection as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lacuna.functions.text import truthy


def new_papers(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Papers of the JSON-lines files that arrive in a folder, each id once.

    The ids seen are the operator's state; a stream with event times can bound it
    with dropDuplicatesWithinWatermark instead.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return raw.where(truthy(F.col("paperId")).isNotNull()).dropDuplicates(["paperId"])


def append(stream: DataFrame, table: str, checkpoint: str, manifest: str | None = None) -> StreamingQuery:
    """Write a stream batch by batch; a batch that is run again after a failure replaces its own folder.

    manifest: a folder for one row (batch, rows) a batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if manifest:
            count = batch.sparkSession.read.parquet(f"{table}/batch={number}").agg(F.lit(number).alias("batch"), F.count("*").alias("rows"))
            count.write.mode("overwrite").parquet(f"{manifest}/batch_{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls back with (batch number, input rows) after every micro-batch."""

    def __init__(self, callback: Callable[[int, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
