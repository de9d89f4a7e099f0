"""Benchmark decontamination: documents that hold a benchmark item, give or take a few edits.

Texts and items are compared lower-cased (A-Z) with white space runs as one space. CGK random walks map strings at a
small edit distance to strings at a small Hamming distance: a walk reads a symbol, notes it, and stays or moves on by a
random bit of (step, symbol). Samples of the noted symbols are the keys of an LSH join. A walk that has lost step with
its twin seldom finds it again, so a window of an item's whole size agrees too rarely; the walk starts anew all along
it instead: an item has a walk from every byte, a document one from every ``stride`` bytes, and an item-sized window is
a candidate if enough of its walks' samples agree with those of the item at about one offset. ``SHAPES`` gives walks that
fit the items' sizes; only shapes that some item has are run. Exact edit distance against the region around a
candidate decides: a pair within ``RATE`` of the item's length counts.

Items shorter than 10 bytes may have no edit at all, so the bytes themselves are the key. Keys of items pass through a
filter of bounded size to the documents' tasks, and what passes is joined, so the documents are read once for
candidates and once for their regions, however many items there are.

Defined cases: a null or empty text holds no item; an item empty once normalised matches nothing; a null ``doc_id`` or
``item_id`` takes no part; repeated rows count once; two texts under one id are told apart by a hash of the text, and a
pair has its least distance; of equal distances the first end counts; very long texts are read in full, several at a
time or one at a time; other columns are ignored; with either table empty no pair results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_steps, written
from .vectext import INVERSE, lower_ascii, mix64, powers, prefix_hash, text_bytes

RATE = 0.1


class Shape(NamedTuple):
    """Walks for items of at least so many bytes: steps of a walk, symbols in a sample, bytes from one walk to the next."""

    least: int
    steps: int
    picked: int
    stride: int


SHAPES = [Shape(10, 14, 6, 1), Shape(20, 28, 8, 2), Shape(40, 46, 10, 4), Shape(80, 60, 12, 10)]
#: Sizes that leave no edit.
EXACT = SHAPES[0].least
WALKS, SAMPLES = 4, 3
#: One more walk must agree for so many bytes of an item, up to so many: a fifth or less of those that do at 10 % edits.
WALK_BYTES, MOST_WALKS = 120, 8
#: Zero bytes after each text, so that no walk reaches the next one.
GAP = 64
#: 64-bit words of the filter: two for each key, up to 32 MB. Rows that are broadcast; more are joined by a shuffle.
MOST_WORDS, BROADCAST_ROWS = 1 << 22, 2_000_000
_RNG = np.random.default_rng(11)
#: For each walk and symbol a random word: its bits are the moves, one for each step, and the word stands for the symbol.
MOVES = _RNG.integers(-(1 << 63), 1 << 63, (WALKS, 256), dtype=np.int64)
PICKS = {s: [[np.sort(_RNG.choice(s.steps, s.picked, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)] for s in SHAPES}
_MIX = np.int64(-7046029254386353131)


def shape_of(size: int) -> Shape:
    return [s for s in SHAPES if s.least <= size][-1]


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of texts lower-cased, each white space run as one space, none at an end, ``GAP`` zeros after each."""
    data = lower_ascii(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[offsets[(offsets >= 0) & (offsets < len(data))]] = True
    keep = ~(space & before)
    kept, cut = np.where(space, np.uint8(32), data)[keep], np.append(0, np.cumsum(keep))[offsets]
    sizes = np.diff(cut)
    shift = np.arange(len(sizes)) * GAP
    out = np.zeros(len(kept) + GAP * len(sizes), np.uint8)
    out[np.arange(len(kept)) + np.repeat(shift, sizes)] = kept
    starts, ends = cut[:-1] + shift, cut[1:] + shift
    return out, starts, ends - ((ends > starts) & (out[np.maximum(ends - 1, 0)] == 32))


def walk_starts(starts: np.ndarray, ends: np.ndarray, stride: int) -> np.ndarray:
    n = -(-(ends - starts) // stride)
    return np.repeat(starts - stride * (np.cumsum(n) - n), n) + stride * np.arange(n.sum())


def walk_keys(data: np.ndarray, starts: np.ndarray, shape: Shape, block: int = 1 << 14) -> Iterator[np.ndarray]:
    """For each sample the keys of all starts; the walks of a block of starts step together."""
    for w in range(WALKS):
        words = MOVES[w][data]
        picks = [set(p.tolist()) for p in PICKS[shape][w]]
        out = np.empty((SAMPLES, len(starts)), np.int64)
        for a in range(0, len(starts), block):
            at = starts[a : a + block].astype(np.int64)
            word, bit = np.empty_like(at), np.empty_like(at)
            keys = out[:, a : a + block]
            keys[:] = (np.arange(SAMPLES) + SAMPLES * w + 1 + 1000 * shape.least)[:, None]
            for j in range(shape.steps):
                words.take(at, out=word, mode="clip")
                for s in range(SAMPLES):
                    if j in picks[s]:
                        keys[s] *= _MIX
                        keys[s] += word
                np.right_shift(word, j, out=bit)
                np.bitwise_and(bit, 1, out=bit)
                at += bit
        yield from (mix64(keys.view(np.uint64)).view(np.int64) for keys in out)


def byte_keys(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Keys of the size bytes from each of at."""
    c = prefix_hash(data)
    return mix64((c[at + size] - c[at]) * powers(INVERSE, len(data) + 1)[at] + np.uint64(size)).view(np.int64)


def all_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int], stride: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, keys) for the shapes, and short sizes, that items of these sizes have; stride: as in documents, else every byte."""
    for shape in sorted({shape_of(n) for n in sizes if n >= EXACT}):
        # A walk moves on half a byte a step: one that begins too near a text's end would see little else than the gap.
        at = walk_starts(starts, np.maximum(ends - shape.steps // 3, starts), shape.stride if stride else 1)
        for keys in walk_keys(data, at, shape):
            yield at, keys
    for n in sorted({n for n in sizes if n < EXACT}):
        at = walk_starts(starts, np.maximum(ends - n + 1, starts), 1)
        yield at, byte_keys(data, at, n)


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "item_id", "ih", "size", "off"]
    for batch in batches:
        for x, z in text_steps(batch, "text", 1 << 18):
            part = batch.slice(x, z - x)
            data, starts, ends = normalised(*text_bytes(part.column("text")))
            ids, ih = (part.column(c).to_numpy() for c in ("item_id", "ih"))
            sizes = ends - starts
            kind = np.array([shape_of(n).least if n >= EXACT else n for n in sizes.tolist()])
            for n in np.unique(kind[kind > 0]).tolist():
                mine = np.flatnonzero(kind == n)
                for at, keys in all_keys(data, starts[mine], ends[mine], [n], False):
                    row = mine[np.searchsorted(starts[mine], at, "right") - 1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[row]), pa.array(ih[row]), pa.array(sizes[row]), pa.array(at - starts[row])], names=names)


def _filter_words(keys: DataFrame, words: int) -> np.ndarray:
    """Blocked Bloom filter of the keys: two bits in one word of each key; at most MOST_WORDS words reach the driver."""
    one, key = F.lit(1).cast("long"), F.col("key")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftrightunsigned(key, k).bitwiseAND(63).cast("int"))
    found = keys.select(F.shiftrightunsigned(key, 12).bitwiseAND(words - 1).alias("word"), bit(0).bitwiseOR(bit(6)).alias("m")).groupBy("word").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(words, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).view(np.uint64)
    return out


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys.view(np.uint64)
    word = words[(k >> np.uint64(12)) & np.uint64(len(words) - 1)]
    return np.flatnonzero((word >> (k & np.uint64(63))) & (word >> ((k >> np.uint64(6)) & np.uint64(63))) & np.uint64(1))


def _hits(held, sizes: list[int]):
    """(doc_id, th, key, pos) of documents' keys that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, z in text_steps(batch, "text"):
                part = batch.slice(x, z - x)
                data, starts, ends = normalised(*text_bytes(part.column("text")))
                ids, th = (part.column(c).to_numpy() for c in ("doc_id", "th"))
                for at, keys in all_keys(data, starts, ends, sizes, True):
                    hit = _may_hold(held.value, keys)
                    if len(hit):
                        doc = np.searchsorted(starts, at[hit], "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(th[doc]), pa.array(keys[hit]), pa.array(at[hit] - starts[doc])], names=["doc_id", "th", "key", "pos"])

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their candidates: the part of the normalised text that a candidate's window may lie in."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("ih", pa.int64()), ("start", pa.int64()), ("region", pa.binary())])
    for batch in batches:
        for x, z in text_steps(batch, "text"):
            part = batch.slice(x, z - x)
            data, starts, ends = normalised(*text_bytes(part.column("text")))
            for doc_id, s, e, found in zip(part.column("doc_id").to_pylist(), starts.tolist(), ends.tolist(), part.column("found"), strict=True):
                rows = []
                for f in found.as_py():
                    reach = int(RATE * f["size"]) + 2
                    a, b = max(s, s + f["lo"] - reach), min(e, s + f["hi"] + f["size"] + reach)
                    rows.append({"doc_id": doc_id, "item_id": f["item_id"], "ih": f["ih"], "start": a - s, "region": data[a:b].tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def edit_distance_within(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of pattern to any part of text, where that part ends), by bit-parallel columns."""
    m = len(pattern)
    ones, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    pv, mv, score, best, end = ones, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        score += (1 if ph & high else 0) - (1 if mh & high else 0)
        if score < best:
            best, end = score, j + 1
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
    return best, end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        data, starts, ends = normalised(*text_bytes(batch.column("text")))
        for doc_id, item_id, start, region, a, z in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "start", "region")), starts.tolist(), ends.tolist(), strict=True):
            item = data[a:z].tobytes()
            exact = region.find(item)
            distance, end = (0, exact + len(item)) if exact >= 0 else edit_distance_within(item, region)
            if distance <= RATE * len(item):
                rows.append((doc_id, item_id, distance, start + end))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["doc_id", "item_id", "distance", "ends_at"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _by_size(pick) -> Column:
    """pick(shape) as a Column over the size of an item."""
    out = F.lit(1)
    for s in SHAPES:
        out = F.when(F.col("size") >= s.least, F.lit(pick(s))).otherwise(out)
    return out


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(doc_id, th, item_id, ih, size, lo, hi): windows of doc_id's normalised text, by their first and last start, that share keys
    with an item. docs: doc_id, th, text; items: item_id, ih, text. None without items."""
    spark = docs.sparkSession
    keys = written(items.mapInArrow(_item_keys, "key long, item_id long, ih long, size long, off long"), "item-keys")
    # One row for each shape, or size under EXACT.
    seen = keys.groupBy(F.when(F.col("size") < EXACT, F.col("size")).otherwise(_by_size(lambda s: s.least)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        return None
    n_keys = sum(r["n"] for r in seen)
    held = spark.sparkContext.broadcast(_filter_words(keys, min(MOST_WORDS, 1 << max(10, (2 * n_keys).bit_length()))))
    hits = docs.mapInArrow(_hits(held, [int(r["size"]) for r in seen]), "doc_id long, th long, key long, pos long")
    pairs = hits.join(_small(keys, n_keys), "key").withColumn("start", F.col("pos") - F.col("off"))
    # Starts of one window differ by the edits allowed at most; two sets of bands, so that no window is parted in both.
    width = 4 * F.floor(RATE * F.col("size")) + 16
    walk = F.pmod(F.floor(F.col("pos") / _by_size(lambda s: s.stride)), F.lit(64)).cast("int")
    banded = pairs.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), walk)).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    banded = banded.withColumn("band", F.floor((F.col("start") + F.col("half") * width / 2) / width))
    found = banded.groupBy("doc_id", "th", "item_id", "ih", "size", "half", "band").agg(F.bit_or("bit").alias("walks"), F.min("start").alias("lo"), F.max("start").alias("hi"))
    enough = F.bit_count("walks") >= F.least(F.lit(MOST_WALKS), 1 + F.floor(F.col("size") / WALK_BYTES))
    return found.where(enough).select("doc_id", "th", "item_id", "ih", "size", "lo", "hi").distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, ends_at): least edit distance of the item to any part of the document, in bytes of
    normalised text, and where that part ends there."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("ih"), "text").dropDuplicates(["item_id", "ih"])
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = candidates(docs, items)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, distance long, ends_at long")
    found = written(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_id", "ih", "size", "lo", "hi")).alias("found")), "candidates")
    regions = docs.join(_small(found, found.count()), ["doc_id", "th"]).mapInArrow(_regions, "doc_id long, item_id long, ih long, start long, region binary")
    pairs = regions.repartition(F.xxhash64("doc_id", "item_id", "start")).join(_small(items, items.count()), ["item_id", "ih"])
    judged = pairs.select("doc_id", "item_id", "start", "region", "text").mapInArrow(_verify, "doc_id long, item_id long, distance long, ends_at long")
    best = judged.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "ends_at")).alias("x"))
    return best.select("doc_id", "item_id", "x.distance", "x.ends_at")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item."""
    hit = written(leaks(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
