"""Changes of stored tables as streams: of rows added to a table, and of everything the store does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldquery.sources.sinks import SCHEMAS


def changes(spark: SparkSession, path: str, schema: str, collection: str, files_a_batch: int = 100) -> DataFrame:
    """(op, _id, ref_id, collection) of every row added to a table from now on."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return rows.select(F.lit("insert").alias("op"), "_id", "ref_id", F.lit(collection).alias("collection"))


def all_changes(spark: SparkSession, root: str, files_a_batch: int = 100) -> DataFrame:
    """(op, _id, ref_id, collection) of every insert, update and delete of a store from now on."""
    rows = spark.readStream.schema(SCHEMAS["changes"]).option("maxFilesPerTrigger", files_a_batch).parquet(f"{root.rstrip('/')}/changes")
    return rows.select("op", F.col("row_id").alias("_id"), "ref_id", "collection")


def for_user(events: DataFrame, ref_id: int | None) -> DataFrame:
    """What one user sees; None sees all."""
    return events if ref_id is None else events.where(F.col("ref_id") == ref_id)


def deliver(events: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each batch to `to`; offsets are kept in checkpoint, a folder that the cluster shares."""
    writer = events.writeStream.foreachBatch(to).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counters(windows: DataFrame) -> DataFrame:
    """A stream of (job_id, ok) to the job counters so far; write it in update mode."""
    return windows.groupBy("job_id").agg(F.count(F.lit(1)).alias("num_windows"), F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("num_windows_success"), F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("num_windows_fail"))
