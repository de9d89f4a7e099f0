"""Hard-negative mining: for anchors and their nearest rows of one label, the best rows of other labels within a score window.

Candidates lie in blocks of at most ``ROWS`` rows of one label, in order of a Hilbert curve over the dimensions of the
largest spread, each with the least and greatest value of every dimension (its zone). Interval arithmetic over a zone
bounds the inner product of an anchor with all rows of the block, and only blocks whose bounds meet one of an anchor's
windows are read for it. Windows start as narrow as known rows make them: an anchor's own block gives a least score for
its positives, and one block, the zone whose middle lies nearest to the top of the anchor's windows, gives least scores
for its negatives; what can't beat them isn't read. Bounds leave room for rounding and scores are exact integers, so the
result is that of comparing every anchor with every row.

Anchors go in groups of at most ``HELD``; a task holds one group and streams zones or blocks by, in ``SALTS`` parts a group,
each with its own best rows, which a window then merges. So each block is sent at most once to each group that needs it.
Where zones don't prune (many dimensions, no clusters) that is every block: ``rows * anchors / HELD`` rows are sent.

Defined cases: rows with a null label, a null vector, a null or non-finite component or a null id take no part; a shorter
vector counts as padded by zeros, an empty one as all zeros; components are whole numbers (the fraction is cut down), and
scores beyond 64 bits are an error; every row is a row of its own, so a repeated row can be an anchor's positive, and
repeated anchors give repeated results; ties of score go to the smaller id; other columns are ignored; without anchors,
positives or negatives there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

ROWS, HELD, SALTS, PACK = 256, 8192, 8, 256
#: The curve runs over at most so many dimensions, with so many bits each.
CURVE, BITS = 16, 3
LEAST, MOST = -(1 << 62), 1 << 62
BLOCK = "block long, label string, n int, ids binary, anchors binary, kind string, rows binary, low binary, high binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (whole numbers under 2**bits), by undoing the curve's turns from the top bit down."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, padded by zeros."""
    sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(vectors.flatten().to_numpy(zero_copy_only=False))
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each dimension over a task's rows."""
    count, total, square, rows = np.zeros(0), np.zeros(0), np.zeros(0), 0
    for batch in batches:
        if len(batch):
            wide = max(len(total), int(pa.compute.max(pa.compute.list_value_length(batch.column("v"))).as_py() or 0))
            m = _matrix(batch.column("v"), wide)
            total, square = (np.pad(x, (0, wide - len(x))) + y for x, y in ((total, m.sum(axis=0)), (square, (m * m).sum(axis=0))))
            rows += len(batch)
    count = np.full(len(total), float(rows))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(count), pa.array(total), pa.array(square)], names=["d", "n", "s1", "s2"])


def _keyed(width: int, dims: list[int], mean: np.ndarray, deviation: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), width)[:, dims]
            cells = np.clip(np.floor((m - mean) / deviation * (1 << BITS) / 4) + (1 << BITS - 1), 0, (1 << BITS) - 1)
            key = hilbert_keys(cells, BITS) if dims else np.zeros(len(batch), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    return run


def _kept(m: np.ndarray) -> np.ndarray:
    """The narrowest type that holds whole numbers exactly."""
    most = np.abs(m).max(initial=0)
    return m.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def _blocks(width: int):
    """Rows in order become blocks of one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, None

        def block(label: str, m: np.ndarray, ids: np.ndarray, anchors: np.ndarray) -> dict:
            nonlocal made
            made += 1
            rows = _kept(m)
            return {"block": base + made, "label": label, "n": len(ids), "ids": ids.tobytes(), "anchors": anchors.tobytes(), "kind": rows.dtype.str, "rows": rows.tobytes(), "low": m.min(axis=0).tobytes(), "high": m.max(axis=0).tobytes()}

        names = ["block", "label", "n", "ids", "anchors", "kind", "rows", "low", "high"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.string(), *[pa.binary()] * 3]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            m, ids = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy()
            marks = batch.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
            labels = np.array(batch.column("label").to_pylist(), object)
            if held is not None:
                labels, m, ids, marks = (np.concatenate([a, b]) for a, b in zip(held, (labels, m, ids, marks), strict=True))
            cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1), len(labels)]
            out, held = [], None
            for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for x in range(a, z, ROWS):
                    y = min(x + ROWS, z)
                    if y == len(labels) and y - x < ROWS:
                        held = (labels[x:y], m[x:y], ids[x:y], marks[x:y])
                    else:
                        out.append(block(labels[x], m[x:y], ids[x:y], marks[x:y]))
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([block(held[0][0], *held[1:])])

    return run


def _values(kind: str, rows: bytes, n: int) -> np.ndarray:
    return np.frombuffer(rows, kind).reshape(n, -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if most >= 1 << 62:
        raise OverflowError("scores do not fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def _own_anchors(positives: int):
    """A block's anchors, each with the least score that its positives need: the last of those found in its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "vec_id", "label", "v", "tops", "lows", "block"]
        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
                if not len(at):
                    continue
                m = _values(r["kind"], r["rows"], r["n"])
                lows = np.full(len(at), LEAST, np.int64)
                if r["n"] > positives:
                    s = products(m[at], m)
                    s[np.arange(len(at)), at] = LEAST
                    lows = np.partition(s, -positives, axis=1)[:, -positives]
                ids = np.frombuffer(r["ids"], np.int64)[at]
                one = np.arange(len(at) + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["block"] * ROWS + at), pa.array(ids), pa.array([r["label"]] * len(at), pa.string()), pa.array([x.tobytes() for x in m[at]], pa.binary()),
                        pa.ListArray.from_arrays(one, pa.array(np.full(len(at), MOST, np.int64))), pa.ListArray.from_arrays(one, pa.array(lows)), pa.array(np.full(len(at), r["block"], np.int64)),
                    ],
                    names=names,
                )

    return run


def _grouped(windows: int):
    """Anchors in order become groups of at most HELD, a row each, with up to so many windows an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def group(rows: list[dict]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            tops, lows = np.full((len(rows), windows), LEAST, np.int64), np.full((len(rows), windows), MOST, np.int64)
            for k, r in enumerate(rows):
                tops[k, : len(r["tops"])], lows[k, : len(r["lows"])] = r["tops"], r["lows"]
            cols = [base + made, [r["label"] for r in rows], np.array([r["uid"] for r in rows], np.int64).tobytes(), b"".join(r["v"] for r in rows), tops.tobytes(), lows.tobytes()]
            types = [pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=["g", "labels", "uids", "vs", "tops", "lows"])

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= HELD:
                yield group(held[:HELD])
                held = held[HELD:]
        if held:
            yield group(held)

    return run


class _Group:
    """A group of anchors as a task holds it."""

    def __init__(self, r: dict) -> None:
        self.uids = np.frombuffer(r["uids"], np.int64)
        self.v = np.frombuffer(r["vs"], np.float64).reshape(len(self.uids), -1)
        self.labels = np.array(r["labels"], object)
        self.tops, self.lows = (np.frombuffer(r[c], np.int64).reshape(len(self.uids), -1).copy() for c in ("tops", "lows"))
        self.above, self.under = np.maximum(self.v, 0), np.minimum(self.v, 0)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with rows of each zone, with room for rounding."""
        room = 1 + 1e-9 * (np.abs(self.v) @ np.maximum(np.abs(low), np.abs(high)).T)
        return self.above @ low.T + self.under @ high.T - room, self.above @ high.T + self.under @ low.T + room


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zones of up to PACK blocks in a row."""
    names = ["blocks", "zone_labels", "low", "high"]
    for batch in batches:
        for x in range(0, len(batch), PACK):
            part = batch.slice(x, PACK)
            cols = [part.column("block").to_pylist(), part.column("label").to_pylist(), *(b"".join(part.column(c).to_pylist()) for c in ("low", "high"))]
            types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=names)


def _met(batches: Iterator[pa.RecordBatch], begin, step, end) -> Iterator[pa.RecordBatch]:
    """Rows in order of (g, salt, side): a group, then what it meets."""
    at = None
    for batch in batches:
        for k in range(len(batch)):
            r = batch.slice(k, 1).to_pylist()[0]
            if at != (r["g"], r["salt"]):
                if at is not None:
                    yield from end()
                at = (r["g"], r["salt"])
                begin(r)
            if r["side"]:
                yield from step(r)
    if at is not None:
        yield from end()


def _chosen(same: bool, nearest: bool):
    """Pairs (g, block) to read: those whose bounds meet a window, or each anchor's zone nearest to the top of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Group | None = None
        best: tuple[np.ndarray, np.ndarray] | None = None
        at = 0

        def out(blocks: np.ndarray, uids: np.ndarray, away: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), at, np.int64)), pa.array(blocks), pa.array(uids), pa.array(away)], names=["g", "block", "uid", "away"])

        def begin(r: dict) -> None:
            nonlocal held, best, at
            held, at = _Group(r), r["g"]
            best = np.full(len(held.uids), np.inf), np.zeros(len(held.uids), np.int64)

        def step(r: dict) -> Iterator[pa.RecordBatch]:
            blocks, labels = np.array(r["blocks"], np.int64), np.array(r["zone_labels"], object)
            low, high = (np.frombuffer(r[c], np.float64).reshape(len(blocks), -1) for c in ("low", "high"))
            for a in range(0, len(held.uids), 2048):
                cut = slice(a, a + 2048)
                part = object.__new__(_Group)
                part.v, part.above, part.under = held.v[cut], held.above[cut], held.under[cut]
                least, most = part.bounds(low, high)
                fits = (held.labels[cut, None] == labels[None, :]) == same
                if nearest:
                    away = np.where(fits, np.abs((least + most) / 2 - held.tops[cut].max(axis=1)[:, None]), np.inf)
                    k = away.argmin(axis=1)
                    away = away[np.arange(len(k)), k]
                    closer = away < best[0][cut]
                    best[0][cut][closer], best[1][cut][closer] = away[closer], blocks[k[closer]]
                    continue
                needed = np.zeros(len(blocks), bool)
                for j in range(held.tops.shape[1]):
                    needed |= (fits & (most >= held.lows[cut, j, None]) & (least <= held.tops[cut, j, None])).any(axis=0)
                found = blocks[needed]
                if len(found):
                    yield out(found, np.zeros(len(found), np.int64), np.zeros(len(found)))

        def end() -> Iterator[pa.RecordBatch]:
            if nearest:
                has = np.isfinite(best[0])
                yield out(best[1][has], held.uids[has], best[0][has])

        yield from _met(batches, begin, step, end)

    return run


def _read(same: bool, best: int):
    """The best rows of each window among the blocks of a (group, salt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Group | None = None
        found: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def begin(r: dict) -> None:
            nonlocal held, found, waiting
            held, found, waiting = _Group(r), [], 0

        def settle() -> None:
            """Keep the best of each window, and raise its least score once it is full."""
            nonlocal found, waiting
            slot, score, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((ids, -score, slot))
            slot, score, ids = slot[order], score[order], ids[order]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
            place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
            last = place == best - 1
            held.lows.reshape(-1)[slot[last]] = score[last]
            keep = place < best
            found, waiting = [(slot[keep], score[keep], ids[keep])], 0

        def step(r: dict) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            rows, ids = _values(r["kind"], r["rows"], r["n"]), np.frombuffer(r["ids"], np.int64)
            windows = held.tops.shape[1]
            own = np.flatnonzero((held.labels == r["label"]) == same)
            for a in range(0, len(own), 2048):
                at = own[a : a + 2048]
                s = products(held.v[at], rows)
                if same:  # a row is no partner of its own
                    mine = held.uids[at] - r["block"] * ROWS
                    inside = np.flatnonzero((mine >= 0) & (mine < r["n"]))
                    s[inside, mine[inside]] = LEAST - 1
                for j in range(windows):
                    i, k = np.nonzero((s >= held.lows[at, j, None]) & (s <= held.tops[at, j, None]))
                    if len(i):
                        found.append((at[i] * windows + j, s[i, k], ids[k]))
                        waiting += len(i)
                if waiting > 500_000:
                    settle()
            yield from ()

        def end() -> Iterator[pa.RecordBatch]:
            if not found:
                return
            settle()
            slot, score, ids = found[0]
            windows = held.tops.shape[1]
            for x in range(0, len(slot), 100_000):
                cut = slice(x, x + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(held.uids[slot[cut] // windows]), pa.array((slot[cut] % windows).astype(np.int32)), pa.array(score[cut]), pa.array(ids[cut])], names=["uid", "j", "score", "vec_id"])

        yield from _met(batches, begin, step, end)

    return run


def _side_by_side(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Groups, one copy for each salt, and items (with g and salt), dealt and sorted so that a group comes before its items."""
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("side", F.lit(0))
    both = copies.unionByName(items.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition("g", "salt").sortWithinPartitions("g", "salt", "side")


def _search(anchors: DataFrame, blocks: DataFrame, zones: DataFrame, same: bool, best: int, windows: int, nearest: bool = False) -> DataFrame:
    """The best rows (uid, j, score, vec_id, place) in each window of each anchor; with nearest, of one block for each anchor only."""
    ranges = max(1, -(-anchors.count() // HELD))
    groups = written(anchors.repartitionByRange(ranges, "uid").sortWithinPartitions("uid").mapInArrow(_grouped(windows), "g long, labels array<string>, uids binary, vs binary, tops binary, lows binary"), "groups")
    numbers = groups.select("g")
    salt = F.pmod(F.xxhash64(F.col("blocks")[0]), F.lit(SALTS)).cast("int")
    every = zones.join(numbers, F.lit(True)).withColumn("salt", salt)
    pairs = _side_by_side(groups, every).mapInArrow(_chosen(same, nearest), "g long, block long, uid long, away double")
    if nearest:
        pairs = pairs.groupBy("uid").agg(F.min_by(F.struct("g", "block"), F.struct("away", "block")).alias("p")).select("p.g", "p.block")
    read = blocks.select("block", "label", "n", "ids", "kind", "rows").join(pairs.select("g", "block").distinct(), "block")
    items = read.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    hits = _side_by_side(groups, items).mapInArrow(_read(same, best), "uid long, j int, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("uid", "j").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("place", place).where(F.col("place") <= best)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    vectors: vec_id, label, v (whole numbers). Negatives of a positive score p lie between low and high hundredths of p.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    unsound = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("v").cast("array<double>"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = written(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~unsound), "vectors")
    sums = rows.select("v").mapInArrow(_spread, "d int, n double, s1 double, s2 double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    spread = {r.d: (r.s1, r.s2) for r in sums.collect()}  # a row for each dimension
    width, total = max(1, len(spread)), max(1, rows.count())
    mean = {d: s1 / total for d, (s1, _) in spread.items()}
    deviation = {d: max(0.0, s2 / total - mean[d] ** 2) ** 0.5 for d, (_, s2) in spread.items()}
    dims = sorted(sorted(deviation, key=lambda d: (-deviation[d], d))[:CURVE])
    key = _keyed(width, dims, np.array([mean[d] for d in dims]), np.array([deviation[d] or 1.0 for d in dims]))
    keyed = written(rows.mapInArrow(key, "vec_id long, label string, v array<double>, anchor boolean, key long"), "curve")
    order = ["label", "key", "vec_id"]
    blocks = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(width), BLOCK), "blocks")
    zones = written(blocks.select("block", "label", "low", "high").mapInArrow(_zones, "blocks array<long>, zone_labels array<string>, low binary, high binary"), "zones")
    anchors = written(blocks.mapInArrow(_own_anchors(positives), "uid long, vec_id long, label string, v binary, tops array<long>, lows array<long>, block long"), "anchors")
    near = written(_search(anchors.drop("vec_id", "block"), blocks, zones, True, positives, 1), "positives").select("uid", F.col("vec_id").alias("positive_id"), F.col("score").alias("p"), (F.col("place") - 1).alias("j"))
    # the window of whole scores: 100 * score between low * p and high * p
    window = near.select("uid", "j", F.expr(f"cast(-floor(-cast({low} * p as decimal(38)) / 100) as long)").alias("least"), F.expr(f"cast(floor(cast({high} * p as decimal(38)) / 100) as long)").alias("most"))
    windows = window.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("j", "least", "most"))).alias("w"))
    asked = written(anchors.select("uid", "label", "v").join(windows, "uid").select("uid", "label", "v", F.col("w.most").alias("tops"), F.col("w.least").alias("lows")), "windows")
    first = _search(asked, blocks, zones, False, negatives, positives, nearest=True).where(F.col("place") == negatives).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("found"))
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("found", i), x)))
    asked = written(asked.join(first, "uid", "left").withColumn("lows", raised).drop("found"), "raised")
    far = _search(asked, blocks, zones, False, negatives, positives).select("uid", "j", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
    return far.join(near, ["uid", "j"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")
