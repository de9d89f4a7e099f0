"""Helpers that the training-data operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step handles at a time; bounds a Python worker's memory whatever the rows hold.
STEP_BYTES = 1 << 21
#: Rows of an Arrow batch (its bytes are bounded too, as texts may be long).
BATCH_ROWS = "2000"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_own_shared_dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark._own_shared_dir = found
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Documents can be long: keep Arrow batches to a few hundred rows."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker keeps from task to task, such as encoded words; workers outlive a stage.
KEPT: dict = {}


def text_steps(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts come to about step bytes (at least one row each)."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > step:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)
