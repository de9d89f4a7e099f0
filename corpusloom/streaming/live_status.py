"""Live batch status: the latest status of each item of a stream, rolled up by batch.

The stream keeps the latest status by item (stateful, update mode); each stream batch writes the items it changed, and the
roll-up takes each item's latest row, so replayed batches change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import batch_status

CHANGES = "batch_id long, idx long, status string, seen timestamp_ntz, stream_batch long"


def latest(items: DataFrame) -> DataFrame:
    """items: batch_id, idx, status, seen (a stream or a table)."""
    return items.groupBy("batch_id", "idx").agg(F.max_by("status", "seen").alias("status"), F.max("seen").alias("seen"))


def run(spark: SparkSession, source: str, folder: str) -> DataFrame:
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")  # a pattern, so a table may be a file or a folder
    items = stream.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"), F.col("ts").alias("seen"))

    def keep(batch: DataFrame, stream_batch: int) -> None:
        batch.withColumn("stream_batch", F.lit(stream_batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/b{stream_batch}")

    query = latest(items).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(CHANGES).parquet(f"{folder}/changes/*")
    now = changes.groupBy("batch_id", "idx").agg(F.max_by("status", "stream_batch").alias("status"))
    return batch_status(now)
