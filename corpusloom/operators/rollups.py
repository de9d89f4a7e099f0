"""Status and result roll-ups: map-side combined aggregates over item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_of(failed: Column, total: Column) -> Column:
    return F.when(failed == total, "failed").when(failed > 0, "partial_failure").otherwise("complete")


def batch_status(items: DataFrame) -> DataFrame:
    """Counts and status of each batch of (batch_id, status) items."""
    out = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "complete").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("status", status_of(F.col("failed"), F.col("total")))


def ingest_rollup(results: DataFrame) -> DataFrame:
    """Documents, web pages, transcripts and chunks of each tenant from (tenant_id, source_type, n_chunks)."""
    kind = F.col("source_type")
    return results.groupBy("tenant_id").agg(
        F.count_if(~kind.isin("web", "vtt")).alias("documents"), F.count_if(kind == "web").alias("web_pages"),
        F.count_if(kind == "vtt").alias("transcripts"), F.sum("n_chunks").alias("chunks"),
    )


def run_rollup(runs: DataFrame) -> DataFrame:
    """Totals of runs of (run_id, error) by run, with their errors in order of item."""
    bad = F.col("error").isNotNull()
    return runs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("completed"), F.count_if(bad).alias("failed"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(bad, F.struct("item", "error")))), lambda x: x["error"]), "; ").alias("errors"),
    )


def source_stats(results: DataFrame) -> DataFrame:
    """Documents retrieved and context length for each query."""
    return results.groupBy("query_id").agg(F.countDistinct("document_id").alias("documents_retrieved"), F.sum(F.length("content")).alias("context_length"))
