"""Exact repeats: every byte covered by a ``length``-byte string that also starts earlier in the corpus.

Windows are the strings of ``length`` bytes inside one document. The least 24-byte gram of a window, by a hash order, is
its anchor, so equal windows have equal anchors at equal places and meet wherever anchors meet. Documents first send
only (anchor hash, run of windows it anchors): a sorted stream keeps the runs whose anchor occurs elsewhere. Those runs
then send their bytes, and a second sorted stream, in corpus order, tells windows seen before from new ones. Exact
copies of whole documents take no part: all of their windows start earlier, in the copy with the smallest id.

The induced suffix sorting first meant for this job is not used: see the README for why and for figures.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows with a null ``doc_id`` are kept
whole and count for nothing; repeated rows of an id get equal results (a text counts once for its id); two texts under
one id are told apart by a hash of the text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_steps
from .vectext import INVERSE, mix64, powers, prefix_hash, text_bytes

GRAM = 24
#: Low bits of a sort key that hold a place; longer texts are taken in overlapping parts.
PLACE_BITS = 24
PART = 1 << 22


def _hashes(data: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of data[i : i + width] for each i (or each of at)."""
    c, n = prefix_hash(data), len(data) - width + 1
    if at is None:
        return mix64((c[width:] - c[:n]) * powers(INVERSE, n)) if n > 0 else np.empty(0, np.uint64)
    return mix64((c[at + width] - c[at]) * powers(INVERSE, len(data) + 1)[at])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run of windows with one anchor; no window crosses texts."""
    n, grams = len(data) - length + 1, length - GRAM + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    g = _hashes(data, GRAM)
    key = g >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < grams:
        key = np.minimum(key[: len(key) - (grams - span)], key[grams - span :])
    place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)[:n]
    inside = np.zeros(n + 1, np.int32)
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        if z - a >= length:
            inside[a] += 1
            inside[z - length + 1] -= 1
    inside = np.cumsum(inside[:n]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.append(~inside[1:] | new[1:], True)) + 1
    return first, ends - first, g[place[first]]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "th", "doc_id", "a", "n"]
        for batch in batches:
            for x, z in text_steps(batch, "text"):
                part = batch.slice(x, z - x)
                data, offsets = text_bytes(part.column("text"))
                ids, th = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
                for base in range(0, max(1, len(data)), PART):
                    stop = min(len(data), base + PART + length - 1)
                    cut = np.clip(offsets, base, stop) - base
                    first, n, h = window_runs(data[base:stop], cut, length)
                    doc = np.searchsorted(offsets, first + base, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(th[doc]), pa.array(ids[doc]), pa.array(first + base - offsets[doc]), pa.array(n.astype(np.int32))], names=names)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, th, a, doc_id): the first of each (h, th, a), if its h has another."""
    names = ["h", "th", "doc_id", "a", "n"]
    held: list[np.ndarray] | None = None  # the last first-of-class row, not sent yet, and whether its h came before
    paired = False
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        h, th, _, a, _ = cols
        if not len(h):
            continue
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (th[1:] != th[:-1]) | (a[1:] != a[:-1])
        cols = [c[first] for c in cols]
        same = cols[0][1:] == cols[0][:-1]
        keep = np.zeros(len(cols[0]), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= paired
        paired = bool(keep[-1])
        held = [c[-1:] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in cols], names=names)
    if held is not None and paired:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def _snippets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, th, text, runs in zip(*(batch.column(c) for c in ("doc_id", "th", "text", "runs")), strict=True):
                data = (text.as_py() or "").encode()
                rows += [(r["h"], doc_id.as_py(), th.as_py(), r["a"], r["n"], data[r["a"] : r["a"] + r["n"] + length - 1]) for r in runs.as_py()]
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types, strict=True)], names=["h", "doc_id", "th", "a", "n", "bytes"])

    return run


def holds(runs: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Which keys one of the sorted runs holds."""
    found = np.zeros(len(keys), bool)
    for run in runs:
        found |= run[np.minimum(np.searchsorted(run, keys), len(run) - 1)] == keys
    return found


def put(runs: list[np.ndarray], new: np.ndarray) -> None:
    """Add a sorted run. Each run is at least twice as long as the next, so there are few and each key is moved few times."""
    while runs and len(runs[-1]) < 2 * len(new):
        new = np.sort(np.concatenate([runs.pop(), new]), kind="stable")
    if len(new):
        runs.append(new)


def _seen(length: int):
    """Rows sorted by (h, doc_id, a): spans [s, e) of windows equal to an earlier one with the same anchor.

    Eight bytes are held for each different window of the current anchor, in sorted runs, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, before = None, [], None
        for batch in batches:
            # A row given twice in the input comes twice here, too: the second says nothing new.
            cols = [batch.column(c).to_numpy() for c in ("h", "doc_id", "th", "a")]
            again = np.ones(len(batch), bool)
            for c, x in zip(cols, before or [None] * 4, strict=True):
                again[1:] &= c[1:] == c[:-1]
                again[:1] &= x is not None and c[:1] == x
            before = [c[-1] for c in cols] if len(batch) else before
            batch = batch.filter(pa.array(~again))
            if not len(batch):
                continue
            h, doc, th, a, n = (batch.column(c).to_numpy() for c in ("h", "doc_id", "th", "a", "n"))
            data, offsets = text_bytes(batch.column("bytes").cast(pa.large_binary()))
            row = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keys = _hashes(data, length, offsets[row] + inside)
            keys = mix64(keys + h.view(np.uint64)[row])
            _, at = np.unique(keys, return_index=True)
            old = np.ones(len(keys), bool)
            old[at] = False
            if last is not None and h[0] == last:
                with_last = h[row] == last
                old[with_last] |= holds(seen, keys[with_last])
            if h[-1] != last:
                last, seen = h[-1], []
            put(seen, np.unique(keys[(h[row] == last) & ~old]))
            start = old.copy()
            start[1:] &= ~old[:-1] | (row[1:] != row[:-1])
            end = old.copy()
            end[:-1] &= ~old[1:] | (row[1:] != row[:-1])
            s, e = np.flatnonzero(start), np.flatnonzero(end)
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[s]]), pa.array(th[row[s]]), pa.array(a[row[s]] + inside[s]), pa.array(a[row[e]] + inside[e] + length)], names=["doc_id", "th", "s", "e"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def hashed(docs: DataFrame) -> DataFrame:
    """The rows that take part. Both joins that need texts start from this very plan, so Spark shuffles texts once for both."""
    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")


def repeat_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, th, spans): spans array<struct<s,e>> of bytes to remove, not yet merged, of documents that have some."""
    small_batches(docs.sparkSession)
    docs = hashed(docs)
    size = F.octet_length("text").cast("long")
    first = docs.groupBy("th", size.alias("size")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where((F.col("lo") < F.col("hi")) & (F.col("size") >= length))
    copies = docs.select("doc_id", "th", size.alias("size")).join(first, ["th", "size"]).where("doc_id > lo").select("doc_id", "th", F.lit(0).cast("long").alias("s"), F.col("size").alias("e"))
    anchors = docs.mapInArrow(_anchors(length), "h long, th long, doc_id long, a long, n int")
    repeated = anchors.repartition("h").sortWithinPartitions("h", "th", "a", "doc_id").mapInArrow(_repeated, "h long, th long, doc_id long, a long, n int")
    runs = repeated.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "a", "n")).alias("runs"))
    snippets = docs.join(runs, ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(_snippets(length), "h long, doc_id long, th long, a long, n int, bytes binary")
    spans = snippets.repartition("h").sortWithinPartitions("h", "doc_id", "a").mapInArrow(_seen(length), "doc_id long, th long, s long, e long")
    return spans.unionByName(copies).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
            data = (text.as_py() or "").encode()
            gone = merged([(x["s"], x["e"]) for x in spans.as_py() or ()])
            kept = b"".join(data[a:z] for a, z in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)]))
            rows.append((doc_id.as_py(), len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs; kept is what is left, as bytes."""
    spans = repeat_spans(docs, length)
    rows = hashed(docs).join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    whole = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return rows.unionByName(whole).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
