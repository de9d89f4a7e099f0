"""Incremental ingest: a file stream of documents, normalised, chunked and upserted batch by batch.

Documents and chunks are tables of buckets. A stream batch adds a log of its own rows to each, numbered by the batch, so it
writes in proportion to what came in, a batch that is repeated after a failure changes nothing, and other writers may
upsert the same tables meanwhile. Logs are merged into base files of their buckets once there are several.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators.chunking import chunk_pages
from ..operators.upserts import CHUNKS, DOCUMENTS
from ..sources.tables import BucketTable

DOCUMENT_ROWS = "tenant_id string, client_id string, source_uri string, source_type string, title string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz"
CHUNK_ROWS = "tenant_id string, document_id long, chunk_index int, page_start int, page_end int, content string, content_tokens int, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz"


def tables(spark: SparkSession, folder: str, buckets: int = 64, keep_logs: int = 8) -> tuple[BucketTable, BucketTable]:
    """(documents, chunks) under a folder."""
    return BucketTable(spark, f"{folder}/documents", DOCUMENTS, DOCUMENT_ROWS, buckets, keep_logs), BucketTable(spark, f"{folder}/chunks", CHUNKS, CHUNK_ROWS, buckets, keep_logs)


def chunk_rows(pages: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """Rows of the chunk table from (tenant_id, document_id, page, text): texts normalised, then cut by tokens."""
    texts = pages.select("document_id", "page", normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    tenants = pages.groupBy("document_id").agg(F.min("tenant_id").alias("tenant_id"))
    chunks = chunk_pages(texts, max_tokens, overlap_tokens).join(tenants, "document_id")
    none = F.create_map().cast("map<string,string>")
    return chunks.select("tenant_id", "document_id", "chunk_index", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), F.col("text").alias("content"), F.col("token_count").alias("content_tokens"), none.alias("metadata"))


def run(
    spark: SparkSession, source: str, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame]], folder: str, as_of: str,
    max_tokens: int = 800, overlap_tokens: int = 120, buckets: int = 64, keep_logs: int = 8, files_per_batch: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Take in all files there are now; (documents, chunks) after it.

    prepare: from a batch of the source, (rows of the document table without times, pages of tenant_id, document_id, page and text).
    """
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{source}*")
    documents, chunks = tables(spark, folder, buckets, keep_logs)

    def take_in(batch: DataFrame, number: int) -> None:
        found, pages = prepare(batch)
        at = F.lit(number).alias("seq")
        documents.append(found.select("*", at), as_of, "ingest", number)
        chunks.append(chunk_rows(pages, max_tokens, overlap_tokens).select("*", at), as_of, "ingest", number)

    query = stream.writeStream.foreachBatch(take_in).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return documents.read(), chunks.read()
