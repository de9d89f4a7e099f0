"""Transcripts: cues, time-window pages, per-client gathering, sentiment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import depth_tier, normalize_text, numbered_texts, strip, vtt_seconds

NO_TRANSCRIPTS, NO_SUMMARY = "(No video transcript data available yet. Ingest .vtt transcripts to unlock deeper analysis.)", "(No context summary generated yet.)"


def parse_vtt(files: DataFrame) -> DataFrame:
    """(transcript_id, idx, start_s, end_s, speaker, text) of (transcript_id, text); cues with no readable time are left out.

    What stands before the first line that begins with two digits, a colon and two digits is a header. A cue's text runs to
    the next blank line.
    """
    text = F.regexp_replace(strip(F.coalesce("text", F.lit(""))), r"\r\n?", "\n")
    body = F.regexp_extract(text, r"(?s)(?:^|\n)(\d{2}:\d{2}.*)$", 1)
    blocks = files.select("transcript_id", F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("ord", "block"))
    lines = F.transform(F.split("block", "\n"), strip)
    rows = blocks.select("transcript_id", "ord", lines.alias("lines")).withColumn("timing", F.get(F.filter("lines", lambda x: x.contains("-->")), F.lit(0))).where("timing is not null")
    at = F.array_position("lines", F.col("timing")).cast("int")
    raw = strip(F.array_join(F.slice(F.col("lines"), at + 1, F.size("lines")), " "))
    voice = r"(?s)^<v\s+([^>]+)>(.+)"
    speaker = F.when(raw.rlike(voice), strip(F.regexp_extract(raw, voice, 1)))
    said = F.when(raw.rlike(voice), strip(F.regexp_extract(raw, voice, 2))).otherwise(raw)
    rows = rows.select(
        "transcript_id", "ord", vtt_seconds(F.split_part("timing", F.lit("-->"), F.lit(1))).alias("start_s"),
        vtt_seconds(F.regexp_extract(F.split_part("timing", F.lit("-->"), F.lit(2)), r"^\s*(\S+)", 1)).alias("end_s"),
        speaker.alias("speaker"), strip(F.regexp_replace(said, "</?[^>]+>", "")).alias("text"),
    ).where("text <> '' and start_s is not null")
    idx = F.row_number().over(Window.partitionBy("transcript_id").orderBy("ord")) - 1
    return rows.select("transcript_id", idx.alias("idx"), "start_s", "end_s", "speaker", "text")


def window_numbers(cues: DataFrame, seconds: float = 120.0) -> DataFrame:
    """(transcript_id, idx, page): a page ends at the first cue that starts ``seconds`` or more after the page's first.

    Windows begin anew at that cue, so they are no fixed grid: cues stream in order, with two numbers of state.
    """
    rows = cues.select("transcript_id", "idx", "start_s").repartition("transcript_id").sortWithinPartitions("transcript_id", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, page, fresh = None, 0.0, 0, True
        for batch in batches:
            pages = []
            for t, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fresh or t != at:
                    at, begun, page, fresh = t, s, 1, False
                elif s - begun >= seconds:
                    begun, page = s, page + 1
                pages.append(page)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.int32())], names=["transcript_id", "idx", "page"])

    kinds = dict(cues.dtypes)
    return rows.mapInArrow(run, f"transcript_id {kinds['transcript_id']}, idx {kinds['idx']}, page int")


def cue_pages(cues: DataFrame, seconds: float = 120.0) -> DataFrame:
    """(transcript_id, page, text) with ``[speaker]: `` before each cue."""
    line = F.concat(F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("["), F.col("speaker"), F.lit("]: "))).otherwise(""), F.col("text"))
    rows = cues.select("transcript_id", "idx", line.alias("line")).join(window_numbers(cues, seconds), ["transcript_id", "idx"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("transcript_id", "page").agg(normalize_text(joined).alias("text"))


def transcript_counts(docs: DataFrame) -> DataFrame:
    out = docs.where("source_type = 'vtt'").groupBy("tenant_id", "client_id").agg(F.count(F.lit(1)).alias("transcripts"))
    return out.withColumn("tier", depth_tier(F.col("transcripts")))


def transcript_chunks(chunks: DataFrame, docs: DataFrame, limit: int | Column | None = None) -> DataFrame:
    """Chunks of each client's transcripts by chunk_index, then document_id; limit may be a column of docs' counts."""
    vtt = docs.where("source_type = 'vtt'").select(F.col("id").alias("document_id"))
    rows = chunks.join(vtt, "document_id", "left_semi")
    if limit is None:
        return rows
    if not isinstance(limit, int):
        rows = rows.join(transcript_counts(docs).drop("tier"), ["tenant_id", "client_id"])
    rn = F.row_number().over(Window.partitionBy("tenant_id", "client_id").orderBy("chunk_index", "document_id"))
    return rows.withColumn("rank", rn).where(F.col("rank") <= limit)


def shared_context(docs: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row for each client: transcripts, tier, numbered excerpts, summary with topics, and stand-ins where there is none."""
    rows = transcript_chunks(chunks, docs, 15 + 5 * F.col("transcripts"))
    texts = rows.groupBy("tenant_id", "client_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("texts"))
    key = ["tenant_id", "client_id"]
    out = docs.where("client_id is not null").select(*key).distinct().join(transcript_counts(docs), key, "left").join(texts, key, "left").join(summaries.select(*key, "summary", "topics"), key, "left")
    brief = F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit("N/A")), F.lit("\nTopics: "), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", "))
    return out.select(
        *key, F.coalesce("transcripts", F.lit(0)).alias("transcripts"), F.coalesce("tier", F.lit("foundational")).alias("tier"),
        F.coalesce(numbered_texts(F.col("texts"), "Transcript Excerpt", glue=" "), F.lit(NO_TRANSCRIPTS)).alias("transcript_context"),
        F.when(F.col("summary").isNotNull(), brief).otherwise(NO_SUMMARY).alias("context_summary"),
        F.coalesce(F.size("texts"), F.lit(0)).alias("chunks_retrieved"), F.col("summary").isNotNull().alias("has_summary"),
    )


def document_text(chunks: DataFrame) -> DataFrame:
    """Each document's chunks joined by a blank, in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), " ")
    return chunks.groupBy("document_id").agg(joined.alias("text"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[ \n]"), "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets


def fit_scorer(texts: DataFrame, labels: DataFrame, buckets: int = 16384, sure: float = 3.0):
    """A native scorer fitted on texts (document_id, text) and their labels (document_id, label: positive, negative or neutral).

    Each hashed word weighs its log odds in a label's texts against all labelled texts, in thousandths, with one added to each
    count, and nothing if these are less than ``sure`` standard deviations from even; a window's shares are the softmax of its
    words' sums and the labels' own odds. Words are counted in Spark, map-side first: 3 * buckets counts reach the driver and
    as many weights each task, however many texts there are. Other labels and null texts are left out; a text with several
    labels counts for each; without labels all shares are a third.
    """
    classes = ("positive", "negative", "neutral")
    known = labels.where(F.col("label").isin(*classes)).select("document_id", "label")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = texts.select("document_id", "text").join(known, "document_id").select("label", F.explode(_words(F.col("text"))).alias("w"))
    counts = {c: [0] * buckets for c in classes}
    for r in words.groupBy("label", _bucket(F.col("w"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["label"]][r["b"]] = r["n"]
    every = [sum(x) for x in zip(*counts.values(), strict=True)]
    total = sum(every) + buckets

    def weight(n: int, a: int, size: int) -> int:
        odds = math.log((n + 1) * total / ((a + 1) * size))
        return 0 if abs(odds) < sure * math.sqrt(1 / (n + 1) + 1 / (a + 1)) else math.floor(1000 * odds)

    def weights(c: str) -> Column:
        size = sum(counts[c]) + buckets
        return F.split(F.lit(",".join(str(weight(n, a, size)) for n, a in zip(counts[c], every, strict=True))), ",").cast("array<bigint>")  # folded into one literal

    held = {c: weights(c) for c in classes}
    prior = {c: math.floor(1000 * math.log((sizes.get(c, 0) + 1) / (sum(sizes.values()) + 3))) for c in classes}

    def score(words: Column) -> Column:
        places = F.transform(words, lambda w: _bucket(w, buckets).cast("int"))
        start = F.struct(*[F.lit(prior[c]).cast("long").alias(c) for c in classes])

        def shares(z: Column) -> Column:
            top = F.greatest(*[z[c] for c in classes])
            e = {c: F.exp((z[c] - top) / 1000) for c in classes}
            whole = e["positive"] + e["negative"] + e["neutral"]
            return F.struct(*[(e[c] / whole).alias(c) for c in ("positive", "negative")])

        return F.aggregate(places, start, lambda a, b: F.struct(*[(a[c] + F.get(held[c], b)).alias(c) for c in classes]), shares)

    return score


def sentiment(texts: DataFrame, scorer, window: int = 510) -> DataFrame:
    """(document_id, positive, negative, neutral): mean over windows of ``window`` words, rounded to 2; null if empty."""
    words = _words(F.col("text"))
    cut = texts.select("document_id", words.alias("w")).select("document_id", F.explode_outer(F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / window).cast("int")), lambda i: F.slice("w", i * window + 1, window)))).alias("words"))
    scored = cut.withColumn("s", F.when(F.col("words").isNotNull(), scorer(F.col("words"))))
    mean = scored.groupBy("document_id").agg(F.avg("s.positive").alias("p"), F.avg("s.negative").alias("n"))
    return mean.select("document_id", F.round("p", 2).alias("positive"), F.round("n", 2).alias("negative"), F.round(1 - F.col("p") - F.col("n") + 1e-9, 2).alias("neutral"))


def sentiment_rollup(scores: DataFrame, *keys: str) -> DataFrame:
    """Means of rounded document scores, rounded to 2."""
    return scores.groupBy(*keys).agg(F.count("positive").alias("documents"), *[F.round(F.avg(c), 2).alias(c) for c in ("positive", "negative", "neutral")])


def fan_out(contexts: DataFrame, focus: DataFrame, max_queries: int | None = 10) -> DataFrame:
    """Each client's context with each focus query of its tenant, the first max_queries by position.

    A tenant-wide focus query (client_id null) goes to every client: an equi-join on tenant, no cross join of tenants.
    """
    rn = F.row_number().over(Window.partitionBy("tenant_id", "client_id").orderBy("position"))
    kept = focus.withColumn("rank", rn)
    kept = kept.where(F.col("rank") <= max_queries) if max_queries else kept
    f = kept.select("tenant_id", F.col("client_id").alias("f_client"), "position", "focus")
    return contexts.join(f, (contexts["tenant_id"] == f["tenant_id"]) & (f["f_client"].isNull() | (f["f_client"] == contexts["client_id"]))).drop(f["tenant_id"]).drop("f_client")
