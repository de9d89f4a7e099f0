"""Graph building: chunk nodes and cosine-similarity edges.

Vectors are compared in numpy, screened as float32 and worked out as float64 products. Sources are dealt into bands of about ``HELD`` rows, where there are many
by a tree of pivots, and each band is held in memory while candidates stream by. A candidate is sent only to bands it can
reach the threshold in (angles obey the triangle inequality: none is lost), and not at all twice to a band; a band is
split over tasks by dealing its candidates out, each part keeps the best ``k`` of each source, and the parts' bests are
merged. So n rows are moved n / HELD times at most, fewer where the threshold prunes.

The tree has two levels: about n / HELD pivots, in cells around the square root of as many. A row is measured against the
cells' centres, then against the pivots of cells it can reach. 1e8 sources of 64 dimensions have 3050 pivots (1.6 MB) in
56 cells; a step measures blocks of rows that come to ANGLE_BYTES of angles at most, and sends at most SENT rows in an
Arrow batch, whatever n is.

Vectors that hold a null, a value that is not a number or an infinite one, and those of another length than most, take no
part; ``rejected_vectors`` lists them with the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview

#: Sources that a task holds, candidates that it compares at least before work is dealt to another one, the most
#: bytes of pivots, of angles in one step, and rows in a batch that is sent on.
HELD, PART, PIVOT_BYTES, ANGLE_BYTES, SENT = 32_768, 4096, 64 << 20, 32 << 20, 16_384
#: Sources and candidates that are multiplied at once, bytes of vectors whose cosines are worked out at once, and pairs
#: that are found before they are sent on or the best are picked.
STEP, PAIR_BYTES, FOUND = 1024, 8 << 20, 65_536
#: Kinds of nodes.
NODE_TYPES = ["WebPage", "PDF", "Image", "PowerPoint", "Docx", "VideoTranscript", "ChatTranscript", "ChatSnapshot", "Chunk"]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))


def theta_pairs(vectors: DataFrame, threshold: float, prefix: int = 8) -> DataFrame:
    """(src_id, dst_id, weight), both ways: all pairs of rows (id, embedding) whose cosine is at or over the threshold.

    The blocked form of the join (see above): every pair is multiplied, in memory bounded by HELD sources and a step of
    candidates, and dealt over tasks. Rejected vectors and rows without an id take no part. ``prefix`` is kept for
    callers of the form in expressions, which compared so many components first; it has no bearing on the result.
    """
    rows = vectors.where("id is not null").select("id", "embedding")
    return best_pairs(rows, rows, None, threshold, True, None)


def validate_node_type(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("type").isin(NODE_TYPES), F.lit(False))
    return df.where(ok), df.where(~ok)


def chunk_nodes(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One active node for each chunk, with its embedding if chunks have one; its client is its document's."""
    of = docs.select(F.col("id").alias("document_id"), F.col("client_id"))
    rows = chunks.drop("client_id").join(of, "document_id", "left")
    props = F.create_map(*[x for c in ("id", "document_id", "chunk_index") for x in (F.lit("chunk_id" if c == "id" else c), F.col(c).cast("string"))])
    return rows.select(
        "tenant_id", "client_id", F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("node_key"), F.lit("Chunk").alias("type"),
        F.concat(F.lit("Chunk "), F.col("chunk_index").cast("string")).alias("name"), preview(F.col("content")).alias("description"), props.alias("properties"), F.lit("active").alias("status"),
        *(["embedding"] if "embedding" in chunks.columns else []),
    )


def vector_size(vectors: DataFrame) -> int | None:
    """The most frequent length of vectors, the smaller one of two; None if there are none."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return sizes[0]["n"] if sizes and sizes[0]["n"] else None


def _unsound(col: str = "embedding") -> Column:
    return F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def rejected_vectors(vectors: DataFrame, key: str = "id") -> DataFrame:
    """(id, reject_reason) of rows that take no part in comparisons."""
    size = vector_size(vectors)
    why = F.when(F.col("embedding").isNull(), "no vector").when(_unsound(), "null or non-finite component")
    why = why.when(F.size("embedding") != size, "another length") if size else why
    return vectors.select(F.col(key).alias("id"), why.alias("reject_reason")).where("reject_reason is not null")


def _sound(vectors: DataFrame, group: str | None, key: str = "id") -> DataFrame:
    """(grp, id, e): vectors as doubles; rejected ones are left out, but for those of another length."""
    grp = F.col(group).cast("string") if group else F.lit("")
    return vectors.where("embedding is not null").where(~_unsound()).select(F.coalesce(grp, F.lit("")).alias("grp"), F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))


def _unit(rows: DataFrame) -> DataFrame:
    """(grp, id, x): vectors of unit length as float64 bytes. rows: grp, id, e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            flat, n = e.flatten().to_numpy(zero_copy_only=False), e.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore", under="ignore"):
                norm = np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(n)))
            if not np.isfinite(norm).all() or (norm < 1e-150).any():  # squares left the range of doubles: by the largest component first
                most = np.zeros(len(n))
                np.maximum.at(most, row, np.abs(flat))
                odd = (~np.isfinite(norm) | (norm < 1e-150)) & (most > 0)
                flat = flat / np.where(odd, most, 1.0)[row]
                norm = np.where(odd, np.sqrt(np.bincount(row, weights=np.where(odd[row], flat * flat, 0.0), minlength=len(n))), norm)
            unit = flat / np.where(norm == 0, 1.0, norm)[row]
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("id"), pa.array([unit[z - k : z].tobytes() for z, k in zip(ends, n, strict=True)], pa.binary())], names=["grp", "id", "x"])

    return rows.mapInArrow(run, "grp string, id long, x binary")


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


class Tree:
    """Pivots in cells: each is in the cell of its nearest centre; cells' pivots lie together."""

    def __init__(self, pivots: np.ndarray):
        cells = max(1, round(len(pivots) ** 0.5))
        self.centres = pivots[:: max(1, len(pivots) // cells)]
        cell = _angles(pivots, self.centres).argmin(axis=1)
        order = np.argsort(cell, kind="stable")
        self.pivots, self.cell = pivots[order], cell[order]
        self.first = np.searchsorted(self.cell, np.arange(len(self.centres) + 1))

    def blocks(self, n: int) -> Iterator[slice]:
        step = max(1, ANGLE_BYTES // (8 * max(len(self.centres), int(np.diff(self.first).max()))))
        for a in range(0, n, step):
            yield slice(a, min(n, a + step))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pivot that each row belongs to, the nearest in the nearest cell that has any; its angle, and that to the cell's centre."""
        home, angle, wide = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
        empty = self.first[1:] == self.first[:-1]
        for block in self.blocks(len(x)):
            a = _angles(x[block], self.centres)
            a[:, empty] = np.inf
            near = a.argmin(axis=1)
            wide[block] = a[np.arange(len(near)), near]
            for c in np.unique(near):
                rows = np.flatnonzero(near == c) + block.start
                b = _angles(x[rows], self.pivots[self.first[c] : self.first[c + 1]])
                k = b.argmin(axis=1)
                home[rows], angle[rows] = self.first[c] + k, b[np.arange(len(k)), k]
        return home, angle, wide

    def reached(self, x: np.ndarray, reach: np.ndarray, wide: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, pivot) where the pivot's sources, which lie within its reach, may be at an angle of at most ``most``."""
        cells = np.full(len(self.centres), -10.0)
        np.maximum.at(cells, self.cell, wide)
        for block in self.blocks(len(x)):
            near = _angles(x[block], self.centres) - cells <= most
            for c in np.flatnonzero(near.any(axis=0)):
                own = slice(self.first[c], self.first[c + 1])
                rows = np.flatnonzero(near[:, c]) + block.start
                i, j = np.nonzero(_angles(x[rows], self.pivots[own]) - reach[own] <= most)
                yield rows[i], j + own.start


class Bands:
    """How a group's rows are dealt: its tree (None: by id), each pivot's reach (from itself, from its cell's centre), its sub-bands, and parts of candidates."""

    def __init__(self, tree: Tree | None, reach: np.ndarray, wide: np.ndarray, subs: np.ndarray, parts: int):
        self.tree, self.reach, self.wide, self.subs, self.parts = tree, reach, wide, subs, parts


def _nearest(held, size: int):
    """(grp, home, angle, wide) of each source of a group with pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, rows, x in _by_group(batch, size):
                if grp in held.value:
                    home, angle, wide = held.value[grp].homes(x)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(rows)), pa.array(home.astype(np.int32)), pa.array(angle), pa.array(wide)], names=["grp", "home", "angle", "wide"])

    return run


def _by_group(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(group, its rows, their vectors) of a batch; vectors of another size are left out."""
    grp, x = np.array(batch.column("grp").to_pylist(), object), batch.column("x")
    fits = pa.compute.binary_length(x).to_numpy() == 8 * size
    for g in sorted(set(grp[fits])):
        rows = np.flatnonzero(fits & (grp == g))
        yield g, rows, np.frombuffer(b"".join(x.take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), size)


def _dealt(held, size: int, sources: bool, threshold: float):
    """Rows with the (band, part) that they go to: a source to all parts of its band, a candidate to one part of each band in
    reach. Parts are numbered on over a group's bands."""
    alone = Bands(None, np.array([np.pi]), np.array([np.pi]), np.array([1]), 1)
    most = np.arccos(max(-1.0, threshold)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for grp, rows, x in _by_group(batch, size):
                b = held.value.get(grp, alone)
                mixed = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                first = np.append(0, np.cumsum(b.subs))  # a pivot's first band
                if sources:
                    home = np.zeros(len(rows), np.int64) if b.tree is None else b.tree.homes(x)[0]
                    band = first[home] + (mixed % b.subs[home].astype(np.uint64)).astype(np.int64)
                    met = [(np.repeat(np.arange(len(rows)), b.parts), np.repeat(band, b.parts), np.tile(np.arange(b.parts), len(rows)))]
                else:
                    everywhere = [(np.repeat(np.arange(len(rows)), len(b.subs)), np.tile(np.arange(len(b.subs)), len(rows)))]
                    met = []
                    for at, pivot in everywhere if b.tree is None or threshold <= -1 else b.tree.reached(x, b.reach, b.wide, most):
                        n = b.subs[pivot]
                        at, band = np.repeat(at, n), np.repeat(first[pivot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        met.append((at, band, (mixed[at] % np.uint64(b.parts)).astype(np.int64)))
                for at, band, part in met:
                    for k in range(0, len(at), SENT):
                        cut = slice(k, k + SENT)
                        take, slot = pa.array(rows[at[cut]]), band[cut] * b.parts + part[cut]
                        side = pa.array(np.full(len(take), 0 if sources else 1, np.int32))
                        yield pa.RecordBatch.from_arrays([batch.column("grp").take(take), pa.array(band[cut].astype(np.int32)), pa.array(slot.astype(np.int32)), side, batch.column("id").take(take), batch.column("x").take(take)], names=["grp", "band", "part", "side", "id", "x"])

    return run


class _Best:
    """A band's sources and, as candidates come, each source's best k at or over the threshold; all of them where k is None.

    A block of sources meets a step of candidates in single precision first. What lies under a source's bound by more than
    single precision can err is left; only the other pairs' cosines are worked out in double, component by component in the
    same order for every pair, so that equal vectors tie wherever they stand. The bound is the threshold or, once k
    candidates have been met, what the k-th best of these reaches, so few pairs are kept however many are compared.
    """

    def __init__(self, k: int | None, threshold: float, same: bool, size: int):
        self.k, self.threshold, self.same, self.size = k, threshold, same, size
        self.err = (size + 16) * 2.0**-23  # twice what rounding to float32 and summing in it can come to
        self.ids, self.rows, self.x = [], [], None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def hold(self, ids: list[int], rows: list[bytes]) -> None:
        self.ids += ids
        self.rows += rows

    def meet(self, ids: list[int], rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        if self.x is None:
            self.x, self.ids, self.rows = np.frombuffer(b"".join(self.rows), np.float64).reshape(-1, self.size), np.array(self.ids, np.int64), []
            self.single, self.bound = self.x.astype(np.float32), np.full(len(self.x), self.threshold)
            self.last = np.full(len(self.x), np.inf), np.zeros(len(self.x), np.int64)  # weight and id of the k-th best
        b, y = np.array(ids, np.int64), np.frombuffer(b"".join(rows), np.float64).reshape(-1, self.size)
        for a in range(0, len(b), STEP):
            z = min(len(b), a + STEP)
            step = y[a:z].astype(np.float32).T
            for s in range(0, len(self.x), STEP):
                self.pairs(s, self.single[s : s + STEP] @ step, b[a:z], y[a:z])
                if self.count > (FOUND if self.k is None else max(FOUND, 2 * self.k * len(self.x))):
                    if self.k is None:
                        yield self.out()
                    else:
                        self.cut()

    def pairs(self, s: int, w: np.ndarray, b: np.ndarray, y: np.ndarray) -> None:
        """Adds the pairs of a block, sources from s on, that may stand; w: their cosines in single precision."""
        own = slice(s, s + len(w))
        reached = lambda: np.flatnonzero(w >= (self.bound[own] - self.err).astype(np.float32)[:, None])
        at = reached()
        if self.k is not None and len(at) > 4 * self.k * len(w) and len(b) > self.k:
            if self.same:
                w[self.ids[own][:, None] == b] = -np.inf
            self.bound[own] = np.maximum(self.bound[own], np.partition(w, -self.k, axis=1)[:, -self.k].astype(np.float64) - self.err)
            at = reached()
        piece = max(1, PAIR_BYTES // (8 * self.size))
        for k in range(0, len(at), piece):
            i, j = np.divmod(at[k : k + piece], len(b))
            i += s
            exact, id_ = np.einsum("ij,ij->i", self.x[i], y[j]), b[j]
            keep = exact >= np.maximum(self.bound[i], self.threshold)
            keep &= (exact != self.last[0][i]) | (id_ < self.last[1][i])
            if self.same:
                keep &= self.ids[i] != id_
            self.found.append((i[keep], id_[keep], exact[keep]))
            self.count += len(self.found[-1][0])

    def cut(self) -> None:
        i, j, w = (np.concatenate(p) for p in zip(*self.found, strict=True))
        order = np.lexsort((j, -w, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.k
        i, j, w = i[keep], j[order[keep]], w[order[keep]]
        self.found, self.count = [(i, j, w)], 0
        full = place[keep] == self.k - 1
        self.bound[i[full]] = np.maximum(self.bound[i[full]], w[full])
        self.last[0][i[full]], self.last[1][i[full]] = w[full], j[full]

    def out(self) -> pa.RecordBatch:
        if not self.found:
            self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        elif self.k is not None:
            self.cut()
        i, j, w = (np.concatenate(p) for p in zip(*self.found, strict=True))
        self.found, self.count = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(self.ids, np.int64)[i]), pa.array(j), pa.array(w)], names=["src_id", "dst_id", "weight"])


def _matched(k: int | None, threshold: float, same: bool, size: int):
    """Rows sorted by (grp, band, part, side): sources first, then candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "band", "part", "side")]
            keys, ids, rows = list(zip(*cols, strict=True)), batch.column("id").to_pylist(), batch.column("x").to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if keys[a][:3] != at:
                    if best is not None:
                        yield best.out()
                    at, best = keys[a][:3], _Best(k, threshold, same, size)
                if keys[a][3] == 0:
                    best.hold(ids[a:z], rows[a:z])
                else:
                    yield from best.meet(ids[a:z], rows[a:z])
        if best is not None:
            yield best.out()

    return run


def _bands(rows_a: DataFrame, rows_b: DataFrame, size: int, threshold: float) -> dict[str, Bands]:
    """Bands of the groups that have more than a task's work: a row for each PART candidates or sources reaches the driver at
    most. rows_a, rows_b: sources and candidates as _sound has them; they are counted without Python."""
    spark, sources = rows_a.sparkSession, _unit(rows_a)
    count = lambda df: {r["grp"]: r["n"] for r in df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART).collect()}
    n_a = count(rows_a)
    n_b = n_a if rows_b is rows_a else count(rows_b)
    wide = {g: n for g, n in n_a.items() if n > HELD and threshold > -1}
    pivots: dict[str, Tree] = {}
    if wide:
        share = min(1 / HELD, PIVOT_BYTES / (8 * size) / sum(wide.values()))
        draw = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) / float(1 << 30)
        rows = sources.where(F.col("grp").isin(*wide) & (draw < share) & (F.length("x") == 8 * size)).select("grp", "x").collect()
        for g in wide:
            mine = [r["x"] for r in rows if r["grp"] == g]
            if mine:
                pivots[g] = Tree(np.frombuffer(b"".join(mine), np.float64).reshape(-1, size))
    homes: dict[str, list] = {}
    if pivots:
        held = spark.sparkContext.broadcast(pivots)
        near = sources.mapInArrow(_nearest(held, size), "grp string, home int, angle double, wide double")
        for r in near.groupBy("grp", "home").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach"), F.max("wide").alias("wide")).collect():
            homes.setdefault(r["grp"], []).append(r)
    out = {}
    for g in n_a.keys() | n_b.keys():
        n, m = n_a.get(g, PART), n_b.get(g, PART)
        reach, far, subs = np.array([np.pi]), np.array([np.pi]), np.array([-(-n // HELD)])
        if g in homes:
            reach, far, subs = np.full(len(pivots[g].pivots), -10.0), np.full(len(pivots[g].pivots), -10.0), np.ones(len(pivots[g].pivots), np.int64)
            for r in homes[g]:
                reach[r["home"]], far[r["home"]], subs[r["home"]] = r["reach"], r["wide"], -(-r["n"] // HELD)
        # Parts: as many copies of sources as of candidates at most, but enough to spread a group over a few tasks.
        out[g] = Bands(pivots.get(g) if g in homes else None, reach, far, subs, int(max(1, min(-(-m // PART), max(8, int(subs.sum()))))))
    return out


def best_pairs(sources: DataFrame, candidates: DataFrame, k: int | None, threshold: float, same: bool, group: str | None) -> DataFrame:
    """(src_id, dst_id, weight): pairs of a group at or over the threshold; of each source its best k (ties to the smaller id), or
    all where k is None. Vectors that ``rejected_vectors`` lists are left out."""
    spark = sources.sparkSession
    size = vector_size(sources)
    if size is None:
        return spark.createDataFrame([], "src_id long, dst_id long, weight double")
    rows_a = _sound(sources, group)
    rows_b = rows_a if candidates is sources else _sound(candidates, group)
    bands = _bands(rows_a, rows_b, size, threshold)
    held, a = spark.sparkContext.broadcast(bands), _unit(rows_a)
    b = a if rows_b is rows_a else _unit(rows_b)
    schema = "grp string, band int, part int, side int, id long, x binary"
    rows = a.mapInArrow(_dealt(held, size, True, threshold), schema).unionByName(b.mapInArrow(_dealt(held, size, False, threshold), schema))
    # A group's parts go to one partition after the other, so that no task gets two while another has none.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(int(x.subs.sum()) * x.parts for x in bands.values()))
    rows = rows.repartitionById(tasks, (F.pmod(F.xxhash64("grp"), F.lit(tasks)) + F.col("part")).cast("int")).sortWithinPartitions("grp", "band", "part", "side")
    found = rows.mapInArrow(_matched(k, threshold, same, size), "src_id long, dst_id long, weight double")
    if k is None:
        return found
    w = Window.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id")
    return found.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def similarity_edges(nodes: DataFrame, threshold: float = 0.82, max_edges: int | None = 10, group: str | None = "tenant_id") -> DataFrame:
    """Directed edges (src_id, dst_id, weight): cosine at or over the threshold, each source's best max_edges, ties to the smaller id.

    group: nodes are compared within a tenant, or within "client_id" (or None: all with all).
    """
    rows = nodes.select("id", "embedding", *([group] if group else []))
    return best_pairs(rows, rows, max_edges, threshold, True, group)


def extend_edges(nodes: DataFrame, edges: DataFrame, added: DataFrame, threshold: float = 0.82, max_edges: int = 10, group: str | None = "tenant_id") -> DataFrame:
    """Edges of nodes and added together, from those of nodes: equal to similarity_edges of all, with only new pairs compared.

    Added nodes meet all nodes; nodes meet the added ones only, which may displace the last of their stored edges. Ids of
    added are new; edges are those of nodes with the same threshold, max_edges and group.
    """
    columns = ["id", "embedding", *([group] if group else [])]
    old, new = nodes.select(columns), added.select(columns)
    found = best_pairs(new, old.unionByName(new), max_edges, threshold, True, group).unionByName(best_pairs(old, new, max_edges, threshold, False, group))
    w = Window.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id")
    every = edges.select("src_id", "dst_id", "weight").unionByName(found)
    return every.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_edges).drop("k")


def merge_graph(nodes: DataFrame, edges: DataFrame, stored_nodes: DataFrame, stored_edges: DataFrame, as_of: str, rel_type: str = "related_to") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) tables after a build's rows are upserted (U1, U2). nodes: as of build_graph, whose edges join chunk ids;
    an edge takes its source's tenant and client."""
    from . import upserts as U

    of = nodes.select("tenant_id", "client_id", F.col("properties")["chunk_id"].cast("long").alias("src_id"))
    batch = edges.join(of, "src_id").select("tenant_id", "client_id", "src_id", "dst_id", F.lit(rel_type).alias("rel_type"), "weight", F.create_map(F.lit("method"), F.lit('"chunk_embedding_cosine"')).alias("properties"), F.lit(1).alias("seq"))
    return U.upsert(stored_nodes, nodes.withColumn("seq", F.lit(1)), U.NODES, as_of), U.upsert(stored_edges, batch, U.EDGES, as_of)


def build_graph(chunks: DataFrame, docs: DataFrame, dim: int, threshold: float = 0.82, max_edges: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one-row summary) from embedded chunks with ids; valid chunks and edges are written once and read again."""
    from ..session import work_folder
    from .scans import valid_embeddings

    def written(df: DataFrame, name: str) -> DataFrame:
        path = work_folder(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    checked = valid_embeddings(chunks, dim)
    valid = written(checked.where("is_valid").drop("is_valid"), "valid")
    nodes = chunk_nodes(valid, docs)
    edges = written(similarity_edges(valid, threshold, max_edges), "edges")
    summary = checked.agg(F.count(F.lit(1)).alias("fetched"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("skipped"))
    summary = summary.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).withColumn("nodes", F.col("valid"))
    return nodes, edges, summary
