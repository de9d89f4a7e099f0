"""Readers and writers: scraped-site JSON, WebVTT files, outputs with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

SITE_SCHEMA = "source_url string, scraped_at string, total_pages int, pages array<struct<page:int,url:string,title:string,text:string>>"


def read_scraped_json(spark: SparkSession, path: str) -> DataFrame:
    """(source_url, ordinal, page, url, title, text) of pages with text; one JSON document a file."""
    sites = spark.read.schema(SITE_SCHEMA).json(path, multiLine=True)
    rows = sites.select("source_url", F.posexplode("pages").alias("ordinal", "p")).select("source_url", "ordinal", "p.*")
    return rows.where(strip(F.coalesce("text", F.lit(""))) != "")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, text) of WebVTT files; bytes that are no UTF-8 are replaced, empty files give no row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("transcript_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def with_expiry(df: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    at = F.lit(as_of).cast("timestamp_ntz")
    return df.withColumns({"created_at": at, "expires_at": at + F.expr(f"interval {int(days)} days")})


def append_outputs(df: DataFrame, path: str, as_of: str, days: int = 7) -> None:
    """Append outputs that expire ``days`` days after as_of."""
    with_expiry(df, as_of, days).write.mode("append").parquet(path)

