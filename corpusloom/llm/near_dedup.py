"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

Each shingle set gets ``SLOTS`` min-hashes. The first ``CHUNKS * WIDTH`` of them, 16 bits each, are the index: split
into ``CHUNKS`` chunks, every chunk gives one key for each slot left out, so two sets share a key if some chunk differs
in at most one slot. By pigeonhole that finds all pairs whose indexed signatures differ in fewer than 2 * CHUNKS slots,
and misses a pair of similarity 0.75 with probability 6e-6. The 8-bit signature of all slots screens pairs before
full sets are fetched (a pair of 0.75 fails the screen with probability 5e-6).

Equal sets are one node from the start. Links matter only for what they connect, so the join works in two passes: each
node is first confirmed against the one centre (a bucket's node of the smallest document) with which it shares most keys; after joining up
what that links, only rows outside the component of a bucket's centre are compared with the rest of the bucket and with
each other, in blocks of ``BLOCK`` rows that spread over tasks. A pair is taken up in the first key that it shares only, and not at all if its
known distances to one centre differ by more than the threshold allows (Jaccard distance is a metric). No pair is
capped, and groups of copies never expand into all pairs.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with nothing; fewer
than five words make one shingle; a null ``doc_id`` is linked with nothing and kept, its component null; repeated rows
of an id get equal results; two texts under one id are one document: what either links to is in its component; ties go
to the smaller id; a text of any length is one set; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, small_batches, text_steps, written
from .components import components
from .vectext import mix64, shingle_sets

SLOTS, CHUNKS, WIDTH = 512, 9, 4
INDEXED = CHUNKS * WIDTH
#: Equal 8-bit slots a pair must have: 4.4 deviations under the mean at a similarity of 0.75, as safe as the index.
SCREEN = int(SLOTS * 0.75 - 4.4 * (SLOTS * 0.75 * 0.25) ** 0.5)
BLOCK, MEMBERS = 512, 512
#: Rows of counted tables (large buckets, centres of many members) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 64, SLOTS, dtype=np.uint64) | np.uint64(1)


def min_hashes(u: np.ndarray) -> np.ndarray:
    best = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(u), 2048):
        np.minimum(best, (u[a : a + 2048, None] * _MULTIPLIERS).min(axis=0), out=best)
    return mix64(best)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.clear()
        for batch in batches:
            for a, z in text_steps(batch, "text"):
                part = batch.slice(a, z - a)
                sets = shingle_sets(part.column("text"), width)
                sums = np.array([(mix64(u + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(u ^ np.uint64(0xA5A5A5A5))) if len(u) else np.uint64(0)) for u in sets], np.uint64).reshape(-1, 2).view(np.int64)
                hashes = [min_hashes(u) if len(u) else None for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("th"), pa.array([len(u) for u in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                        pa.array([None if h is None else (h & np.uint64(0xFF)).astype(np.uint8).tobytes() for h in hashes], pa.binary()),
                        pa.array([None if h is None else (h[:INDEXED] >> np.uint64(8) & np.uint64(0xFFFF)).astype("<u2").tobytes() for h in hashes], pa.binary()),
                    ],
                    names=["doc_id", "th", "n", "s1", "s2", "sig", "idx"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each slot left out of it: which, then the other slots' 16 bits."""
    for batch in batches:
        if not len(batch):
            continue
        idx = np.frombuffer(b"".join(batch.column("idx").to_pylist()), "<u2").reshape(len(batch), CHUNKS, WIDTH).astype(np.int64)
        keys = np.empty((len(batch), CHUNKS, WIDTH), np.int64)
        for out in range(WIDTH):
            key = np.arange(CHUNKS, dtype=np.int64) * WIDTH + out
            key = np.broadcast_to(key, (len(batch), CHUNKS))
            for k in range(WIDTH):
                if k != out:
                    key = key << 16 | idx[:, :, k]
            keys[:, :, out] = key
        each = CHUNKS * WIDTH
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(), each)) for c in ("rep", "n", "doc_id"))], names=["key", "rep", "n", "doc_id"])


def _confirm(width: int, percent: int):
    """Rows sorted by (centre, salt, side): the centre's text, then its members' texts; links that hold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = None, None
        for batch in batches:
            out: list[tuple[int, int, bool, float]] = []
            for a, z in text_steps(batch, "text"):
                part = batch.slice(a, z - a)
                rows = zip(*(part.column(c).to_pylist() for c in ("c", "salt", "side", "v")), shingle_sets(part.column("text"), width), strict=True)
                for c, salt, side, v, u in rows:
                    if side == 0:
                        head, at = u, (c, salt)
                    elif at == (c, salt) and len(u):
                        both = np.intersect1d(head, u, assume_unique=True).size
                        either = len(head) + len(u) - both
                        out.append((c, v, 100 * both >= percent * either, both / either))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, types, strict=True)], names=["a", "b", "linked", "j"])

    return run


def _compare(best_only: bool, percent: int):
    """Groups of bucket rows sorted by (key, bi, bj): pairs of different components that pass the screen.

    best_only: for each pair of components just the pair most alike; else all pairs.
    """

    def pairs(rows: list[tuple], key: int, bi: int, bj: int) -> Iterator[tuple[int, int]]:
        cols = list(zip(*rows, strict=True))
        block, rep, comp, n, pivot, near = (np.array(x) for x in cols[:6])
        sig = np.frombuffer(b"".join(cols[6]), np.uint8).reshape(len(rows), SLOTS)
        idx = np.frombuffer(b"".join(cols[7]), "<u2").reshape(len(rows), CHUNKS, WIDTH)
        chunk, out = divmod(key >> 48, WIDTH)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in range(len(rows)):
            if bi != bj and block[i] != bi:
                continue
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (block == bj)
            ok &= (pivot != pivot[i]) | (np.abs(near - near[i]) <= 1 - percent / 100 + 1e-9)
            ok[: i + 1] &= bi != bj
            where = np.flatnonzero(ok)
            if not len(where):
                continue
            same = (sig[where] == sig[i]).sum(axis=1)
            where, same = where[same >= SCREEN], same[same >= SCREEN]
            # Only in the first key that the two share: the first chunk with at most one difference, the slot that differs left out.
            equal = idx[where] == idx[i]
            first = (equal.sum(axis=2) >= WIDTH - 1).argmax(axis=1)
            left_out = np.where(equal[np.arange(len(where)), first].all(axis=1), 0, equal[np.arange(len(where)), first].argmin(axis=1))
            mine = (first == chunk) & (left_out == out)
            for j, m in zip(where[mine], same[mine], strict=True):
                pair = (min(rep[i], rep[j]), max(rep[i], rep[j]))
                if not best_only:
                    yield pair
                else:
                    of = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                    best[of] = max(best.get(of, (0, 0, 0)), (int(m), -pair[0], -pair[1]))
        for _, a, b in best.values():
            yield -a, -b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: set) -> pa.RecordBatch:
            x = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in x], pa.int64()), pa.array([int(p[1]) for p in x], pa.int64())], names=["c", "v"])

        at, rows, found = None, [], set()
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "bi", "bj", "block", "rep", "comp", "n", "pivot", "near", "sig", "idx")), strict=True):
                if r[:3] != at:
                    found.update(pairs(rows, *at) if rows else ())
                    at, rows = r[:3], []
                rows.append(r[3:])
            if len(found) > 50_000:
                yield out(found)
                found = set()
        found.update(pairs(rows, *at) if rows else ())
        yield out(found)

    return run


def _small(df: DataFrame, name: str) -> DataFrame:
    """df, written and counted: for a broadcast if it has few rows."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked, j): similarity of the full sets of pairs (c, v). Members meet their centre's text MEMBERS at a time."""
    many = _small(pairs.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MEMBERS).select("c", F.ceil(F.col("m") / MEMBERS).alias("salts")), "many-members")
    members = pairs.join(many, "c", "left").select("c", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("side"), "v")
    heads = members.select("c", "salt").distinct().select("c", "salt", F.lit(0).alias("side"), F.col("c").alias("v"))
    rows = members.unionByName(heads).join(texts.withColumnRenamed("rep", "v"), "v")
    rows = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "side")
    return written(rows.select("c", "salt", "side", "v", "text").mapInArrow(_confirm(width, percent), "a long, b long, linked boolean, j double"), "links")


def _across(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components, once for each pair of blocks (bi, bj) they take part in.

    A bucket's main component is that of its centre. Blocks of rows outside it are numbered from 0, those of the
    main component below 0; every block outside meets all the others, blocks of the main component don't meet each other.
    """
    comp = F.coalesce("component", "rep")
    marked = shared.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "size", "c", comp.alias("comp"))
    mixed = marked.groupBy("key").agg(F.max(F.when(F.col("rep") == F.col("c"), F.col("comp"))).alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "main")
    rows = marked.join(mixed, "key")
    others = rows.where("comp <> main").groupBy("key").agg(F.count(F.lit(1)).alias("others"))
    rows = rows.join(others, "key").withColumns({"outer": F.ceil(F.col("others") / BLOCK).cast("int"), "inner": F.ceil((F.col("size") - F.col("others")) / BLOCK).cast("int")})
    is_main = F.col("comp") == F.col("main")
    block = F.pmod(F.xxhash64(F.lit(3), "rep"), F.when(is_main, F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("block", F.when(is_main, -1 - block).otherwise(block))
    outside = F.sequence(F.lit(0), F.col("outer") - 1)
    rows = rows.withColumn("with", F.explode(F.when(is_main, outside).otherwise(F.concat(F.sequence(-F.col("inner"), F.lit(-1)), outside))))
    return rows.withColumns({"bi": F.least("block", "with"), "bj": F.greatest("block", "with")})


def near_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signed = written(docs.mapInArrow(_signatures(width), "doc_id long, th long, n long, s1 long, s2 long, sig binary, idx binary"), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    # A node for each different set, numbered as written; its least document gives the text.
    sets = full.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.min_by(F.struct("sig", "idx"), "doc_id").alias("x"))
    reps = written(sets.select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "n", "of.doc_id", "of.th", "x.sig", "x.idx"), "sets")
    members = written(signed.select("doc_id", "n", "s1", "s2").join(reps.select("rep", "s1", "s2", "n"), ["s1", "s2", "n"], "left").select("doc_id", "n", "rep"), "members")
    same = members.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    under_one_id = members.join(_small(same, "ids-with-several-texts"), "doc_id").where("rep is not null and rep <> a").select("a", F.col("rep").alias("b"), F.lit(True).alias("linked"), F.lit(0.0).alias("j"))
    buckets = written(reps.select("rep", "n", "doc_id", "idx").mapInArrow(_keys, "key long, rep long, n long, doc_id long"), "buckets")
    centres = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "rep", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "size", F.col("c.rep").alias("c"), F.col("c.n").alias("c_n"))
    shared = written(buckets.drop("doc_id").join(centres, "key"), "shared-buckets")

    star = shared.where("rep <> c").where(100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n")).groupBy("c", "rep").agg(F.count(F.lit(1)).alias("k"))
    first = written(star.groupBy(F.col("rep").alias("v")).agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("c")).select("c", "v"), "first-pairs")
    needed = reps.join(shared.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "th")
    texts = written(docs.join(needed, ["doc_id", "th"]).dropDuplicates(["rep"]).select("rep", "text"), "texts")
    judged = _links(first, texts, width, percent)
    links = judged.where("linked").unionByName(under_one_id)
    pivots = judged.select(F.col("b").alias("rep"), F.col("a").alias("pivot"), F.col("j").alias("near"))

    for best_only in (True, False):
        comps = written(components(links), "components")
        rows = _across(shared, comps).join(reps.select("rep", "sig", "idx"), "rep").join(pivots, "rep", "left")
        rows = rows.withColumns({"pivot": F.coalesce("pivot", "rep"), "near": F.coalesce("near", F.lit(1.0))})
        rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        found = rows.select("key", "bi", "bj", "block", "rep", "comp", "n", "pivot", "near", "sig", "idx").mapInArrow(_compare(best_only, percent), "c long, v long").distinct()
        found = written(found.join(first, ["c", "v"], "left_anti"), "pairs")
        first = first.unionByName(found)
        links = links.unionByName(_links(found, texts, width, percent).where("linked"))

    comps = written(components(links).withColumnRenamed("node", "rep"), "components")
    least = reps.join(comps, "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = reps.join(comps.join(least, "component"), "rep", "left").select("rep", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = members.join(classes, "rep", "left")
    comp = F.when(F.col("doc_id").isNull() | (F.col("n") == 0) & F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """docs without the near copies: of each component the document with the smallest id stays."""
    gone = near_components(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
