"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents.

Quality classifier, line dedup, MinHash near-dedup, benchmark decontamination and best-fit packing, in this order; each
works on what the one before it kept. A document whose lines all go stays, with an empty text.

Defined cases, alike in all stages: columns beyond those of documents stay as they are, whatever their names; an empty table
passes through and packs into nothing; texts of any length are read whole. A row with a null id is never a copy and never
dropped as one; it goes only if the classifier judges ids of its kind, and is packed. A null text is empty: judged by the
classifier, it holds no line, no shingle and no item, and packs into one token. Repeated rows fare alike. Ties go to the
smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    from corpusloom.llm.quality import accepted

    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in an earlier document go; n_chars follows the text."""
    from corpusloom.llm.line_dedup import line_dedup

    out = line_dedup(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    from corpusloom.llm.near_dedup import near_dedup

    return near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    from corpusloom.llm.decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the documents left, in sequences of at most 2048."""
    import public_tokenizers

    from corpusloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packing),
]
#: Trained models and packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
