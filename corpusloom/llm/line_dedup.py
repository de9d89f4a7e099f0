"""Line dedup: drop every repeat of a line across documents, keeping the smallest document's copy.

Native: DataFrame functions only. Line keys are hashed to 128 bits, range-partitioned by hash and sorted by
document and position inside each partition; a running first value streams the first occurrences. Keys so
frequent that one partition would fill up are found with a frequent-items sketch (bounded in size); their first
document comes from a map-side combined minimum and is broadcast, so no task ever holds all their rows. The result
is one run-length-coded keep bitmap for each document, never text.

Defined cases: a null text is one empty line; lines whose key is shorter than ``min_chars`` always stay; a row
with a null ``doc_id`` is kept whole and holds no line against others; repeated rows of a document get the same
bitmap each; two texts under one ``doc_id`` are told apart by a hash of the text; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACES = " \t\n\x0b\x0c\r"
#: Items the frequency sketch tracks, and the share of all lines from which a key is dealt with apart.
SKETCH_ITEMS, HOT_KEYS, HOT_SHARE = 4096, 1000, 0.0005


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("doc_id", "th", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), "doc_id", "th", "pos")


def _hot_keys(lines: DataFrame) -> DataFrame:
    """Keys with over HOT_SHARE of all lines and their first document: HOT_KEYS rows at most."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {SKETCH_ITEMS})").alias("t"), F.count(F.lit(1)).alias("n"))
    hot = top.select("n", F.inline("t").alias("h1", "c")).where(F.col("c") >= F.greatest(F.col("n") * HOT_SHARE, F.lit(64))).select("h1")
    return lines.join(F.broadcast(hot), "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, starts, ends, keep_rle) of documents that lose lines.

    starts and ends are the first and last positions of the runs to drop; keep_rle is the compressed bitmap: lengths
    of alternating runs kept, dropped, kept, dropped, ... (what follows the last dropped run is kept).
    """
    lines = written(_keyed_lines(docs, min_chars), "line-keys")  # 40 bytes a line: the texts are split and hashed once
    hot = F.broadcast(written(_hot_keys(lines), "hot-lines"))  # HOT_KEYS rows at most
    cold = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drops = cold.withColumn("first_doc", F.first("doc_id").over(order)).unionByName(lines.join(hot, ["h1", "h2"]))
    drops = drops.where(F.col("doc_id") > F.col("first_doc"))
    d = F.col("d")
    runs = drops.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("d")).select(
        "doc_id", "th",
        F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1)).alias("starts"),
        F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1)).alias("ends"),
    )
    s, e = F.col("starts"), F.col("ends")
    rle = F.flatten(F.transform(s, lambda x, i: F.array(x - F.coalesce(F.get(e, i - 1) + 1, F.lit(0)), F.get(e, i) - x + 1)))
    return runs.withColumn("keep_rle", rle)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text replaced by its kept lines, n_lines (before) and n_dropped."""
    marked = docs.withColumn("_th", F.xxhash64("text")).alias("a").join(bitmaps.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a._th") == F.col("b.th")), "left")
    lines, e = split_lines(F.col("a.text")), F.col("b.ends")
    cuts = F.concat(F.coalesce(F.col("b.starts"), F.array().cast("array<int>")), F.array(F.size(lines)))
    spans = F.transform(cuts, lambda x, i: F.struct(F.coalesce(F.get(e, i - 1) + 1, F.lit(0)).alias("a"), x.alias("z")))
    kept = F.flatten(F.transform(spans, lambda p: F.slice(lines, p["a"] + 1, p["z"] - p["a"])))
    dropped = F.coalesce(F.aggregate(F.zip_with("b.starts", "b.ends", lambda x, y: y - x + 1), F.lit(0), lambda acc, x: acc + x), F.lit(0))
    text = F.when(F.col("b.doc_id").isNull(), F.col("a.text")).otherwise(F.array_join(kept, "\n"))
    return marked.select(*[F.col(f"a.{c}") if c != "text" else text.alias("text") for c in docs.columns], F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with repeated lines dropped, plus n_lines and n_dropped; see the module's text for the defined cases."""
    docs = docs.drop("n_lines", "n_dropped")
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
