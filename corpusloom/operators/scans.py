"""Scoped scans, paging, counts over documents and chunks, source validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may be ingested, by kind of source.
EXTENSIONS = {"document": ["pdf", "docx", "xlsx"], "transcript": ["vtt"]}


def scope(df: DataFrame, tenant_id=None, client_id=None, **equal) -> DataFrame:
    """Rows of a tenant, and of a client if given; optional equalities are left out when None."""
    tests = {"tenant_id": tenant_id, "client_id": client_id} | equal
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in tests.items() if v is not None], df)


def embedded_chunks(chunks: DataFrame, docs: DataFrame, tenant_id=None, client_id=None, document_id=None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Chunks with an embedding and their document's client, by (document_id, chunk_index)."""
    of = scope(docs, tenant_id, client_id).select(F.col("id").alias("document_id"), "client_id")
    rows = chunks.drop("client_id").where("embedding is not null").join(of, "document_id")
    rows = rows.where(F.col("document_id") == document_id) if document_id is not None else rows
    if limit is None and offset is None:
        return rows
    rows = rows.orderBy("document_id", "chunk_index")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows


def page_with_total(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the exact total. The total is one aggregated row, joined by broadcast."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def clients(docs: DataFrame) -> DataFrame:
    return docs.where("client_id is not null").select("tenant_id", "client_id").distinct()


def stats(docs: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exact counts for each tenant and client; inputs carry tenant_id and client_id."""
    key = ["tenant_id", "client_id"]
    parts = [
        docs.groupBy(*key).agg(F.count(F.lit(1)).alias("documents")),
        chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded_chunks")),
        nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes")),
        edges.groupBy(*key).agg(F.count(F.lit(1)).alias("edges")),
    ]
    return reduce(lambda a, b: a.join(b, key, "full"), parts).na.fill(0)


def route_sources(sources: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects with reject_reason) of (kind, path), against the table of existing paths."""
    allowed: Column = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.col("ext").isin(kv[1])), EXTENSIONS.items(), F.when(F.lit(False), F.lit(False)))
    rows = sources.join(existing.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    rows = rows.withColumn("reject_reason", F.when(F.col("_there").isNull(), "not found").when(~F.coalesce(allowed, F.lit(False)), "unsupported type")).drop("_there", "ext")
    return rows.where("reject_reason is null").drop("reject_reason"), rows.where("reject_reason is not null")


def valid_embeddings(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """df with is_valid: of the given length, all components finite. An embedding given as text "[0.1,...]" is decoded."""
    if dict(df.dtypes)[col] == "string":
        df = df.withColumn(col, F.from_json(col, "array<double>"))
    return df.withColumn("is_valid", F.coalesce((F.size(col) == dim) & ~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)))
