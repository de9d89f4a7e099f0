"""Substring dedup on words: every word covered by a ``width``-word window that also starts in a document of a smaller id.

Anchors are runs of ``ANCHOR`` words that start at places of a difference cover modulo ``PERIOD``: whatever the places of
two equal windows, some step under PERIOD puts both on cover places, and an anchor from there still lies inside the
window. So equal windows share an aligned anchor, though only 3 of 7 places are hashed and sent. An anchor that another
document holds is then extended to the windows around it, which are compared by 96 bits in order of documents.

Both rounds combine before they shuffle: of an anchor or window that several documents of one step (a few megabytes of
text) share, only the smallest document's row is open, the others are settled on the spot. So a passage in a third of all
documents brings one open row a step to its key, not one a document; settled rows go anywhere, their key mixed with a
hash of the document. Exact copies of whole texts take no part: they lose all their words to the copy of the smallest id.

Defined cases: a null, empty or wordless text has no words; texts under ``width`` words lose nothing; rows with a null
``doc_id`` are kept whole and count for nothing; repeated rows of an id get equal results and do not count against each
other, nor do two texts under one id, told apart by a hash of the text; a text of any length is one list of words, held by
one task; there are no other ties; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_steps, written
from .vectext import mix64, text_bytes, word_hashes, word_spans

#: Every difference modulo 7 is one of two of these places.
PERIOD, COVER = 7, (1, 2, 4)
#: Bytes of text whose anchors or windows are combined before they are sent.
STEP = 4 << 20
#: Ids of documents that are broadcast, to leave texts out of a shuffle; more ids are joined by it.
BROADCAST_ROWS = 500_000
_KEYS = np.random.default_rng(1313).integers(0, 1 << 64, (2, 512), dtype=np.uint64) | np.uint64(1)


def _rolled(h: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hash of each run of width words."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += h[k : n + k] * _KEYS[which, k]
    return mix64(out)


def _spread(doc: np.ndarray) -> np.ndarray:
    """Hash of ids; xor with it makes a settled row's key, and gives back the key it had."""
    return mix64(doc.view(np.uint64) + np.uint64(PERIOD)).view(np.int64)


def _listed(lists: pa.ListArray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Where each document's keys begin, all keys as they were before settled ones were mixed, and the rows they are from."""
    cuts, rows = lists.offsets.to_numpy(), lists.flatten()
    cuts = cuts - cuts[0]
    key, settled = rows.field("key").to_numpy(), rows.field("settled").to_numpy(zero_copy_only=False).astype(bool)
    return cuts, np.where(settled, key ^ _spread(np.repeat(doc, np.diff(cuts))), key), rows


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, each text's first word, all bytes, starts, ends)"""
    data, offsets = text_bytes(part.column("text"))
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first, data, starts, ends


def _named(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window."""
    return _rolled(h, width, 0).view(np.int64), (_rolled(h, width, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _inside(first: np.ndarray, run: int, n: int) -> np.ndarray:
    """Whether the run that starts at each place ends in the same text."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left[:n] >= run


def _pairs(a: np.ndarray, b: np.ndarray, keys: np.ndarray, mores: np.ndarray) -> np.ndarray:
    """Whether each (a, b) is one of (keys, mores)."""
    pair = np.dtype([("a", np.int64), ("b", np.int32)])
    own, listed = np.empty(len(a), pair), np.empty(len(keys), pair)
    own["a"], own["b"], listed["a"], listed["b"] = a, b, keys, mores
    return np.isin(own, listed)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts
    stops = np.cumsum(sizes + 1)
    out = np.full(int(stops[-1]), 32, np.uint8)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    out[at] = data[np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)]
    return out[:-1].tobytes()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, z in text_steps(batch, "text"):
            part = batch.slice(a, z - a)
            data, offsets = text_bytes(part.column("text"))
            starts, ends, first = word_spans(data, offsets)
            sums = [hashlib.sha256(_joined(data, starts[x:y], ends[x:y])).hexdigest() for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(np.diff(first).astype(np.int64)), pa.array(sums)], names=["doc_id", "th", "n_words", "sha"])


def _anchors(width: int):
    """(key, doc_id, many, settled): of an anchor that many documents of a step hold, only the first row is open."""
    anchor, names = width - PERIOD + 1, ["key", "doc_id", "many", "settled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_steps(batch, "text", STEP):
                part = batch.slice(a, z - a)
                h, first, *_ = _words(part)
                r = _rolled(h, anchor, 0)
                place = np.arange(len(r)) - np.repeat(first[:-1], np.diff(first))[: len(r)]
                at = np.flatnonzero(np.isin(place % PERIOD, COVER) & _inside(first, anchor, len(r)))
                doc = part.column("doc_id").to_numpy()[np.searchsorted(first, at, "right") - 1]
                key = r[at].view(np.int64)
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
                new = new_key | np.append(True, doc[1:] != doc[:-1])[: len(key)]
                key, doc, new_key = key[new], doc[new], new_key[new]
                many = new_key & np.append(~new_key[1:], False)[: len(key)]
                key = np.where(new_key, key, key ^ _spread(doc))
                for x in range(0, len(key), 200_000):
                    cut = slice(x, x + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(doc[cut]), pa.array(many[cut]), pa.array(~new_key[cut])], names=names)

    return run


def _windows(width: int):
    """Windows around shared anchors: (key, more, doc_id, settled); of those that documents of a step share, the smallest's is open."""
    anchor, names = width - PERIOD + 1, ["key", "more", "doc_id", "settled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_steps(batch, "text", STEP):
                part = batch.slice(a, z - a)
                h, first, *_ = _words(part)
                n = max(0, len(h) - width + 1)
                r = _rolled(h, anchor, 0)
                row = np.repeat(np.arange(len(part)), np.diff(first))
                place = np.arange(len(h)) - first[:-1][row]
                hit = np.zeros(len(r) + 1, np.int64)
                cuts, flat, _ = _listed(part.column("shared"), part.column("doc_id").to_numpy())
                flat = flat.view(np.uint64)
                for k, (x, y) in enumerate(zip(first[:-1], first[1:] - anchor + 1, strict=True)):
                    if y > x:
                        hit[x + 1 : y + 1] = np.isin(r[x:y], flat[cuts[k] : cuts[k + 1]]) & np.isin(place[x:y] % PERIOD, COVER)
                hit = np.cumsum(hit)
                at = np.flatnonzero(_inside(first, width, n) & (hit[PERIOD : n + PERIOD] > hit[:n])) if n else np.empty(0, np.int64)
                key, more = _named(h, width)
                key, more, ids = key[at], more[at], part.column("doc_id").to_numpy()[row[at]]
                order = np.lexsort((ids, more, key))
                key, more, ids = (x[order] for x in (key, more, ids))
                differ = [np.append(True, x[1:] != x[:-1])[: len(x)] for x in (key, more, ids)]
                new = differ[0] | differ[1]
                least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ids) else ids
                once = new | differ[2]
                key, more, ids, settled = (x[once] for x in (key, more, ids, ids > least))
                cols = [np.where(settled, key ^ _spread(ids), key), more, ids, settled]
                for x in range(0, len(key), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[x : x + 200_000]) for c in cols], names=names)

    return run


def _removed(width: int):
    """Texts with windows to remove: spans of words that go, and the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_steps(batch, "text"):
                part = batch.slice(a, z - a)
                h, first, data, starts, ends = _words(part)
                out = []
                cuts, keys, lists = _listed(part.column("names"), part.column("doc_id").to_numpy())
                mores = lists.field("more").to_numpy()
                key, more = _named(h, width)
                for k, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    listed = slice(cuts[k], cuts[k + 1])
                    own = slice(x, max(x, y - width + 1))
                    gone = _pairs(key[own], more[own], keys[listed], mores[listed])
                    edge = np.zeros(y - x + 1, np.int64)
                    edge[: len(gone)] += gone
                    edge[width : width + len(gone)] -= gone
                    covered = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    kept = _joined(data, starts[x:y][~covered], ends[x:y][~covered])
                    out.append((int(covered.sum()), [{"start": int(s), "stop": int(e)} for s, e in turns.reshape(-1, 2)], hashlib.sha256(kept).hexdigest()))
                spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), spans, pa.string()), strict=True))], names=["doc_id", "th", "n_removed", "spans", "sha"])

    return run


def _shared_anchors(texts: DataFrame, width: int) -> DataFrame:
    """doc_id and the anchors that it shares with another document."""
    sent = texts.mapInArrow(_anchors(width), "key long, doc_id long, many boolean, settled boolean")
    meet, open_id = Window.partitionBy("key"), F.when(~F.col("settled"), F.col("doc_id"))
    rows = sent.withColumns({"low": F.min(open_id).over(meet), "high": F.max(open_id).over(meet), "more": F.max("many").over(meet)})
    return rows.where("settled or more or low < high").select("doc_id", "key", "settled")


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows of the ids: others stay out of later shuffles, if the ids are few enough to broadcast; else the join to come leaves them out."""
    return rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_ROWS else rows


def shared_windows(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the spans of words removed (from 0, end excluded)."""
    if not PERIOD < width <= _KEYS.shape[1]:
        raise ValueError(f"width has to be over {PERIOD} and at most {_KEYS.shape[1]}")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    known = written(texts.mapInArrow(_described, "doc_id long, th long, n_words long, sha string"), "known")
    firsts = known.where(f"n_words >= {width}").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    firsts = written(firsts, "firsts")  # a join of two plain tables can be split where one sha has very many rows
    judged = written(known.join(firsts, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("first_id"), "judged")
    copies = judged.where("copy").select("doc_id", "th").distinct()
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    own = texts.where("doc_id is not null").join(copies, ["doc_id", "th"], "left_anti")
    shared = written(_shared_anchors(own, width).groupBy("doc_id").agg(F.collect_list(F.struct("key", "settled")).alias("shared")), "shared")
    sent = _of(own, shared.select("doc_id")).join(shared, "doc_id").select("doc_id", "text", "shared").mapInArrow(_windows(width), "key long, more int, doc_id long, settled boolean")
    least = F.min(F.when(~F.col("settled"), F.col("doc_id"))).over(Window.partitionBy("key", "more"))
    gone = written(sent.withColumn("least", least).where("settled or doc_id > least").groupBy("doc_id").agg(F.collect_list(F.struct("key", "more", "settled")).alias("names")), "gone")
    changed = _of(own, gone.select("doc_id")).join(gone, "doc_id").select("doc_id", "th", "text", "names")
    cut = changed.mapInArrow(_removed(width), "doc_id long, th long, n_removed long, spans array<struct<start:long,stop:long>>, sha string").dropDuplicates(["doc_id", "th"]).withColumnRenamed("sha", "cut_sha")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return judged.join(cut, ["doc_id", "th"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.slice(whole, 1, 0))).alias("spans"),
    )
