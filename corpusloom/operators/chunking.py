"""Token-bounded, overlapping chunks of a document's pages.

Sentences are cut, counted and joined by Column expressions, one row for each document. What lies between, where chunks begin
and end, depends on token counts only: a pandas UDF over arrays of numbers finds each end with a binary search in
the running sums, so Python sees no text and takes a step for each chunk, not for each sentence.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, token_len

CUTS = "array<struct<sentence:int,first:int,past:int,start_page:int,end_page:int,tokens:int>>"


def cut_points(pages: np.ndarray, tokens: np.ndarray, words: list, last: int, most: int, overlap: int) -> list[tuple]:
    """Chunks in order: (sentence or None, first, past, start page, end page, tokens).

    Sentences of at most ``most`` tokens form a sequence of their own, and a chunk is a range [first, past) of it: as many as
    fit, but one more than the chunk before at least. The next chunk begins with the longest run of sentences at this one's end
    whose tokens come to ``overlap`` at most, or with its last sentence; its start page is that of its first new
    sentence, which is also the end page of the chunk that it did not fit into. A longer sentence is cut by words: a range
    of its words ends where their tokens reach ``most``.
    """
    short = np.flatnonzero(tokens <= most)
    sums, n, found = np.append(0, np.cumsum(tokens[short])), len(short), []
    first = past = 0
    start = int(pages[short[0]]) if n else None
    while past < n:
        past = max(past + 1, int(np.searchsorted(sums, sums[first] + most, "right")) - 1)
        at, end = (int(short[past]), int(pages[short[past]])) if past < n else (len(tokens), last)
        found.append((at, 0, None, first, past, start or end or 1, end or start or 1, int(sums[past] - sums[first])))
        first, start = (min(past - 1, max(first, int(np.searchsorted(sums, sums[past] - overlap)))) if overlap > 0 else past), end
    for s in np.flatnonzero(tokens > most).tolist():
        sums, a, k = np.append(0, np.cumsum(words[s])), 0, 0
        while a < len(sums) - 1:
            b = min(int(np.searchsorted(sums, sums[a] + most)), len(sums) - 1)
            found.append((s, k, s, a, b, int(pages[s]), int(pages[s]), int(sums[b] - sums[a])))
            a, k = b, k + 1
    return [f[2:] for f in sorted(found, key=lambda f: f[:2])]


def chunk_pages(pages: DataFrame, max_tokens: int = 800, overlap_tokens: int = 120, count: Callable[[Column], Column] = token_len) -> DataFrame:
    """(document_id, chunk_index, text, start_page, end_page, token_count) of (document_id, page, text).

    count: tokens of a text as a Column; the tokens of a sentence's words are taken to add up.
    """

    @F.pandas_udf(CUTS)
    def cuts(page: pd.Series, tokens: pd.Series, words: pd.Series, last: pd.Series) -> pd.Series:
        rows = zip(page, tokens, words, last, strict=True)
        names = ("sentence", "first", "past", "start_page", "end_page", "tokens")
        return pd.Series([[dict(zip(names, c, strict=True)) for c in cut_points(np.asarray(p, np.int64), np.asarray(t, np.int64), w, int(z), max_tokens, overlap_tokens)] for p, t, w, z in rows])

    cut = pages.select("document_id", "page", sentences(F.coalesce("text", F.lit(""))).alias("s"))
    docs = cut.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "s"))).alias("p"), F.max("page").alias("last"))
    docs = docs.select("document_id", "last", F.flatten(F.transform("p", lambda x: x["s"])).alias("s"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["page"], F.size(x["s"])))).alias("page"))
    docs = docs.where(F.size("s") > 0).withColumn("tokens", F.transform("s", count))
    by_word = lambda s: F.split(s, r"(?U)\s+")
    words = F.zip_with("s", "tokens", lambda s, t: F.when(t > max_tokens, F.transform(by_word(s), count)))
    fits = F.transform(F.filter(F.arrays_zip("s", "tokens"), lambda x: x["tokens"] <= max_tokens), lambda x: x["s"])
    docs = docs.select("document_id", "s", fits.alias("fits"), cuts("page", "tokens", words, "last").alias("cuts"))
    rows = docs.select("document_id", "s", "fits", F.posexplode("cuts").alias("chunk_index", "c"))
    parts = F.when(F.col("c.sentence").isNull(), F.col("fits")).otherwise(by_word(F.get("s", F.col("c.sentence"))))
    text = F.array_join(F.slice(parts, F.col("c.first") + 1, F.col("c.past") - F.col("c.first")), " ")
    return rows.select("document_id", "chunk_index", text.alias("text"), "c.start_page", "c.end_page", F.col("c.tokens").alias("token_count"))


def to_chunks(documents: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects) of documents of several source types; builders: source_type -> function from documents to pages.

    rejects: documents of a type that has no builder, with a reject_reason.
    """
    built = [build(documents.where(F.col("source_type") == kind)) for kind, build in builders.items()]
    known = F.coalesce(F.col("source_type").isin(*builders), F.lit(False))
    rejects = documents.where(~known).withColumn("reject_reason", F.concat(F.lit("unsupported type: "), F.coalesce("source_type", F.lit("none"))))
    return chunk_pages(reduce(DataFrame.unionByName, built), **options), rejects


def branches_in_order(documents: DataFrame, transcripts: DataFrame, links: DataFrame, order: str = "position") -> DataFrame:
    """Results of the three ingest branches one after the other: documents, transcripts, links, each by order; ordinal counts
    from 0 within a branch, so (branch, ordinal) sorts the whole without a task that sees all of it."""
    parts = [df.withColumns({"branch": F.lit(k), "ordinal": F.col(order)}) for k, df in enumerate((documents, transcripts, links))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def capped_items(items: DataFrame, most: int | None = 50) -> DataFrame:
    """The first items of each batch by idx: the web branch takes 50 a batch; None lifts the cap."""
    from pyspark.sql import Window

    if most is None:
        return items
    return items.withColumn("_k", F.row_number().over(Window.partitionBy("batch_id").orderBy("idx"))).where(F.col("_k") <= most).drop("_k")
