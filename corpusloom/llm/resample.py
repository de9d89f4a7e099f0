"""Target-distribution importance resampling over hashed word runs.

A text is scanned once: lower-cased (A-Z only), its words joined by single spaces, and the running CRC-32 kept at each
word's end. The CRC of any run of words then follows from two of these prefixes, crc(run) = crc(prefix to its end) xor
shift(crc(prefix to its start), bytes of the run): the shift, a multiplication by a power of x over GF(2), cancels what
stands before the run, so runs of every width cost one xor and a few table look-ups, and no run is hashed from its bytes.

Every text becomes counts of buckets, written once. Bucket counts of all texts, a gain for each bucket, every text's weight
and a seeded Gumbel draw follow from that; the highest scores are ranked over ranges of (score, doc_id), each range
numbered from the rows before it, so no task holds more than a range.

Defined cases: a null, empty or wordless text has no features, weight 0 and a score, but is never drawn where ``least``
is over 0; a text of any length is one scan; a null ``doc_id`` is drawn as the empty id and comes after all ids in ties;
repeated rows get equal weights and scores and take a rank each; ties of score go to the smaller id, then to fewer
features and the lower weight; other columns are ignored; an empty table gives no rows, an empty target counts as zeros.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_steps, written
from .vectext import lower_ascii, text_bytes


def _after_byte(register: np.ndarray) -> np.ndarray:
    """A zero byte's effect on the CRC register: eight steps of division by the polynomial (reflected)."""
    for _ in range(8):
        register = register >> np.uint32(1) ^ np.where(register & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return register


#: What one byte leaves in an empty register.
_STEP = _after_byte(np.arange(256, dtype=np.uint32))


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given for each of the four bytes."""
    return tables[0][x & 255] ^ tables[1][x >> np.uint32(8) & 255] ^ tables[2][x >> np.uint32(16) & 255] ^ tables[3][x >> np.uint32(24)]


def _doublings(n: int) -> list[np.ndarray]:
    """Maps that shift a CRC by 1, 2, 4, ... 2**(n - 1) bytes."""
    places = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    maps = [_after_byte(places)]
    while len(maps) < n:
        maps.append(_apply(maps[-1], maps[-1]))
    return maps


_SHIFTS = _doublings(40)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC moved over so many bytes: multiplied by x**(8 * length)."""
    out, k = crc.astype(np.uint32), 0
    left = length.astype(np.int64)
    while left.any():
        on = np.flatnonzero(left & 1)
        out[on] = _apply(_SHIFTS[k], out[on])
        left, k = left >> 1, k + 1
    return out


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, a space before each; each word's end there; each text's first word."""
    data = lower_ascii(data)
    word = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    sizes = ends - starts
    stops = np.cumsum(sizes + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    places = np.ones(len(out), bool)
    places[stops - sizes - 1] = False
    out[places] = data[word]
    return out, stops, np.searchsorted(starts, offsets)


def running_crcs(norm: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC of everything before each word, its space included, and of everything to the word's end."""
    view, crc, at, kept, step = memoryview(norm), 0, 0, [], zlib.crc32
    for stop in stops.tolist():
        crc = step(view[at:stop], crc)
        kept.append(crc)
        at = stop
    end = np.array(kept, np.uint32)
    start = np.zeros(len(end), np.uint32)
    start[1:] = end[:-1]
    register = ~start
    return ~(_STEP[(register ^ np.uint32(32)) & 255] ^ register >> np.uint32(8)), end


def run_crcs(column: pa.Array, widths: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: the text of every run of so many words, and the run's CRC; and words of each text."""
    data, offsets = text_bytes(column)
    norm, stops, first = normalised(data, offsets)
    start, end = running_crcs(norm, stops)
    begins = np.concatenate([[0], stops[:-1]]) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    for width in widths:
        n = max(0, len(end) - width + 1)
        inside = np.flatnonzero(text[:n] == text[width - 1 :])
        last = inside + width - 1
        yield text[inside], end[last] ^ shifted(start[inside], stops[last] - begins[inside]), np.diff(first)


def _counted(widths: range, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_steps(batch, "text"):
                part = batch.slice(a, z - a)
                keys, words = [np.empty(0, np.int64)], np.zeros(len(part), np.int64)
                for text, crc, words in run_crcs(part.column("text"), widths):
                    keys.append(text * buckets + (crc % np.uint32(buckets)).astype(np.int64))
                keys, times = np.unique(np.concatenate(keys), return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * buckets).astype(np.int32))
                total = np.bincount(keys // buckets, weights=times, minlength=len(part)).astype(np.int64)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((keys % buckets).astype(np.int32), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(total), *lists], names=["doc_id", "n_words", "n_features", "buckets", "times"])

    return run


def features(docs: DataFrame, widths: range, buckets: int) -> DataFrame:
    """doc_id, words, features, and the text's distinct buckets with their counts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counted(widths, buckets), "doc_id long, n_words long, n_features long, buckets array<int>, times array<long>")


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(held, batch.column("buckets").flatten().to_numpy(), batch.column("times").flatten().to_numpy())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=["bucket", "n"])

    return run


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """Features in each bucket: each task sums its own rows first."""
    return found.select("buckets", "times").mapInArrow(_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's log ratio of target to corpus, with one more count in every bucket, in thousandths."""
    spark = corpus.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    s, t = (F.col(c).cast("double") + 1 for c in ("s", "t"))
    ratio = t * F.lit(float(totals.all_s + buckets)) / (s * F.lit(float(totals.all_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("buckets")).to_numpy(zero_copy_only=False).astype(np.int64)
            worth = np.concatenate([[0], np.cumsum(gains[batch.column("buckets").flatten().to_numpy()] * batch.column("times").flatten().to_numpy())])
            stops = np.cumsum(sizes)
            n = batch.column("n_features").to_numpy()
            weight = (worth[stops] - worth[stops - sizes]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in a total order, from 1: ranges of the order, each numbered after the rows before it.

    rows have to be written already, as ranges are drawn from them first."""
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return placed.join(before, "part").withColumn(name, (F.col("before") + F.col("place")).cast("long")).drop("part", "place", "before")


def importance_resample(docs: DataFrame, target: DataFrame, words: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank; the best percent of the texts of least words or more have a rank.

    Features are runs of 1 to ``words`` words. The gains of all ``buckets`` come to the driver and go to every task: eight
    bytes a bucket, whatever the corpus.
    """
    widths = range(1, words + 1)
    found = written(features(docs, widths, buckets), "features")
    aimed = features(target.select(F.lit(None).alias("doc_id"), "text"), widths, buckets)
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(bucket_counts(found, buckets), bucket_counts(aimed, buckets), buckets).collect():
        gains[row.bucket] = row.gain
    weighed = found.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + luck), "scores")
    fit = scored.where(F.col("n_words") >= least)
    keep = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranked = numbered(fit, order, "rank").withColumn("rank", F.when(F.col("rank") <= keep, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
