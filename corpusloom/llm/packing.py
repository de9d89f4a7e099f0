"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Documents are tokenised where they are read; only their pieces (id, length, checksum) travel. Planning needs just the
number of pieces of each length, at most ``size`` numbers whatever the corpus, so it runs on the driver: the reduction
permanently fixes bins of one to three pieces that provably dominate every other bin holding their largest piece, then
best-fit decreasing packs what is left. The plan is a list of patterns (lengths in a bin, number of such bins). Pieces
find their place by their rank among those of equal length: a length is split into blocks of about ``BLOCK_ROWS`` pieces,
each ranked by itself after the counts of the blocks before it, so a length that most documents share spreads over
many tasks.

Tokens are those of the tokenizer file, its added tokens included. The tokenizer splits a text before it merges, and
merges within a split only, so each distinct split is encoded once and kept in a worker (``KEPT_WORDS`` at most). Many
texts are split at once in numpy, and splits of up to ``SHORT`` bytes are looked up by their bytes in a hash table; texts
with letters beyond Latin ones, or with an added token, go to the tokenizer whole.

Defined cases: a null or empty text is one piece holding only the end token; a document longer than ``size`` is cut
into full pieces after a first piece that takes the remainder, however long it is; pieces of equal length are placed by
doc_id, piece and checksum, and those that tie in all three may change places; repeated rows and null ids are packed
like any others; other columns are ignored; an empty table packs into no sequence.
"""

from __future__ import annotations

import bisect
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import KEPT, small_batches, text_steps, written
from .vectext import mix64, text_bytes

#: Pieces of one length that a task ranks, about; blocks of lengths that are broadcast, beyond which they are joined by a shuffle.
BLOCK_ROWS, BROADCAST_ROWS = 200_000, 1_000_000
#: Encoded splits a worker keeps, and the code points whose classes splitting knows.
KEPT_WORDS, KNOWN = 400_000, 0x250
#: Bytes of splits that the hash table holds, its slots (a power of two), how many of them a split may lie in, and splits looked up at once.
SHORT, SLOTS, PROBES, STEP_WORDS = 15, 1 << 20, 4, 1 << 17
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
LETTER, DIGIT, SPACE, SIGN = range(4)
#: The letters that byte-level vocabularies write bytes as: visible ones as they are, others from U+0100 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in VISIBLE], range(256, 512)))
#: The low 0 to 8 bytes of a number.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _classes() -> np.ndarray:
    found = np.array([{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], SIGN) for c in range(KNOWN)], np.uint8)
    found[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    return found


CLASSES = _classes()
BYTE_CLASSES = np.append(CLASSES[:128], np.full(128, SIGN, np.uint8))


def split_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the byte-level tokenizer's splits of texts of known code points start: contractions, letters, digits, signs, white space.

    A split is a run of one class. The last white space before others stands alone, or, if it is a blank, goes with them;
    an apostrophe that starts a split makes one of its own with s, t, m, d, ll, ve or re."""
    n = len(data)
    kind = BYTE_CLASSES[data]
    lead = np.flatnonzero(data >= 0xC2)
    kind[lead] = kind[lead + 1] = CLASSES[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    first = np.zeros(n + 3, bool)  # of a text; what follows the last one counts as another
    first[offsets] = first[n:] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    after = after[~first[after]]
    start[after - np.where(data[after - 1] < 128, 1, 2)] = True
    start[after[data[after - 1] == 32]] = False
    mark = np.flatnonzero(data == 39)
    mark = mark[start[mark] & ~first[mark + 1]]
    one = data[mark + 1]
    two = np.where(first[mark + 2], 0, data[np.minimum(mark + 2, n - 1)])
    size = np.where(np.isin(one, list(b"stmd")), 2, np.where((one == two) & (one == 108) | np.isin(one, list(b"vr")) & (two == 101), 3, 0))
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    start[mark + size] = True
    return np.flatnonzero(start[:n])


def padded(data: np.ndarray) -> np.ndarray:
    """With zeros behind, so that eight bytes can be read from each place and eight on."""
    return np.append(data, np.zeros(16, np.uint8))


class Encoder:
    """Token ids of texts by a tokenizer file, the ids of a split kept for the next time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        way, self.merge = self.tokenizer.pre_tokenizer, self.tokenizer.model.tokenize
        #: Whether splits are those of split_starts; else every text goes to the tokenizer whole.
        self.known = self.tokenizer.normalizer is None and type(way).__name__ == "ByteLevel" and way.use_regex and not way.add_prefix_space
        #: Splits kept, and the numbers of those that are not in the table.
        self.count, self.number = 0, {}
        self.all_ids, self.first = np.empty(0, "<u4"), np.zeros(1, np.int64)  # ids of split k: all_ids[first[k] : first[k + 1]]
        self.slots = np.zeros((2, SLOTS), np.uint64), np.full(SLOTS, -1, np.int32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def forget(self, kept: int) -> None:
        """Forget all splits but the first ones."""
        self.count, self.number = kept, {w: k for w, k in self.number.items() if k < kept}
        self.all_ids, self.first = self.all_ids[: self.first[kept]].copy(), self.first[: kept + 1].copy()
        self.slots[1][self.slots[1] >= kept] = -1

    def add(self, words: list[bytes], ids: list[list[int]]) -> None:
        """Splits that the table has no place for go to a dictionary."""
        if not words:
            return
        base, self.count = self.count, self.count + len(words)
        self.all_ids = np.append(self.all_ids, np.fromiter(chain.from_iterable(ids), "<u4"))
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(x) for x in ids]))
        sizes = np.array([len(w) for w in words])
        keys = self.keys(padded(np.frombuffer(b"".join(words), np.uint8)), np.cumsum(sizes) - sizes, sizes)
        slot, left = self.slot(keys), np.flatnonzero(sizes <= SHORT)
        for k in range(PROBES):
            at, some = np.unique((slot[left] + k) % SLOTS, return_index=True)
            free = self.slots[1][at] < 0
            at, some = at[free], some[free]
            self.slots[0][:, at], self.slots[1][at] = keys[:, left[some]], base + left[some]
            left = np.delete(left, some)
        self.number.update((words[k], base + k) for k in [*left.tolist(), *np.flatnonzero(sizes > SHORT).tolist()])

    @staticmethod
    def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Two numbers that hold the bytes and the size of each split of up to SHORT bytes; data is padded."""
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        low = eight[starts] & LOW[np.minimum(sizes, 8)]
        high = eight[starts + 8 * (sizes > 8)] & LOW[np.clip(sizes - 8, 0, 7)]
        return np.stack([low, high | np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)])

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys[0] ^ keys[1] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each split; new ones are encoded."""
        keys = self.keys(data, starts, sizes)
        found, left, slot = np.full(len(starts), -1, np.int64), np.flatnonzero(sizes <= SHORT), self.slot(keys)
        for k in range(PROBES):
            at = (slot[left] + k) % SLOTS
            hit = (self.slots[1][at] >= 0) & (self.slots[0][0][at] == keys[0][left]) & (self.slots[0][1][at] == keys[1][left])
            found[left[hit]] = self.slots[1][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        rest = np.flatnonzero(found < 0)
        if len(rest):
            body = memoryview(data)
            words = [bytes(body[a : a + n]) for a, n in zip(starts[rest].tolist(), sizes[rest].tolist(), strict=True)]
            new = list(dict.fromkeys(w for w in words if w not in self.number))
            fresh = dict(zip(new, range(self.count, self.count + len(new))))
            self.add(new, [[t.id for t in self.merge(w.decode("latin-1").translate(BYTE_LETTERS))] for w in new])
            found[rest] = [fresh[w] if w in fresh else self.number[w] for w in words]
        return found

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold a code point that splitting does not know, or perhaps an added token."""
        if not self.known:
            return np.ones(len(offsets) - 1, bool)
        odd = [np.flatnonzero(data >= 0xC9)]
        odd[0] = odd[0][(data[odd[0]] > 0xC9) | (data[np.minimum(odd[0] + 1, len(data) - 1)] >= 0x90)]
        body = data.tobytes()
        for token in self.added:
            at = body.find(token)
            while at >= 0:
                odd.append(np.array([at]))
                at = body.find(token, at + 1)
        found = np.zeros(len(offsets) - 1, bool)
        found[np.searchsorted(offsets, np.concatenate(odd), "right") - 1] = True
        return found

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, null being empty, as little-endian unsigned 32-bit numbers."""
        data, offsets = text_bytes(texts)
        whole = self.whole(data, offsets)
        if whole.any():
            data, offsets = text_bytes(texts.filter(pa.array(~whole)))
        if self.count > KEPT_WORDS:
            # What came first is what comes often: that half stays.
            self.forget(KEPT_WORDS // 2)
        starts = split_starts(data, offsets)
        sizes, data = np.diff(starts, append=len(data)), padded(data)
        found, counts = [np.empty(0, "<u4")], [np.zeros(1, np.int64)]
        for a in range(0, len(starts), STEP_WORDS):
            k = self.numbers(data, starts[a : a + STEP_WORDS], sizes[a : a + STEP_WORDS])
            counts.append(n := self.first[k + 1] - self.first[k])
            found.append(self.all_ids[np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        found = np.concatenate(found)
        cuts = np.cumsum(np.concatenate(counts))[np.searchsorted(starts, offsets)].tolist()
        rows = zip(cuts, cuts[1:])
        for i, own in enumerate(whole.tolist()):
            if own:
                yield self.plain(texts[i].as_py() or "").tobytes()
            else:
                a, z = next(rows)
                yield found[a:z].tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a worker, so that what it keeps serves all of the worker's tasks; others release it."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        encode, end = encoder(path).ids, struct.pack("<I", end_id)
        for batch in batches:
            for x, z in text_steps(batch, "text"):
                part = batch.slice(x, z - x)
                rows: list[tuple] = []
                for doc_id, found in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    ids = found + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    rows += [(doc_id, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema, strict=True)], schema=schema)

    return run


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that dominance fixes, as (lengths, number of bins), and the counts left.

    Every length is tried as the largest piece of a bin, from the longest on; one without a dominating bin is left and
    the next is tried, over and over until nothing more can be fixed. What a bin dominates only grows less as
    pieces go, so equal bins are fixed together while their pieces last.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    lengths, fixed, changed = sorted(left), [], True
    while changed:
        changed = False
        for j in lengths[::-1]:
            while left.get(j) and (take := dominating(lengths, left, j, size - j)):
                times = min(left[w] // n for w, n in Counter(take).items())
                fixed.append((take, times))
                for w in take:
                    left[w] -= times
                for w in {w for w in take if not left[w]}:
                    del left[w]
                    lengths.pop(bisect.bisect_left(lengths, w))
                changed = True
    return fixed, left


def dominating(lengths: list[int], left: dict[int, int], j: int, room: int) -> tuple[int, ...] | None:
    """A bin of j and up to two more that dominates all bins holding j; None if there is none of this kind.

    A bin dominates another if the other's pieces can be dealt into groups, each no longer than a piece of its own. With b
    the longest piece that fits beside j: {j} does if there is no b; {j, b} if b fills the bin, or no two others fit, or
    (no three fitting) no two come to more than b; {j, b, a}, a the longest that fits beside both, if no three others fit
    and any two, both longer than a, come to no more than b.
    """

    def longest(most: int, besides: tuple[int, ...]) -> int | None:
        i = bisect.bisect_right(lengths, most)
        while i and left[lengths[i - 1]] <= besides.count(lengths[i - 1]):
            i -= 1
        return lengths[i - 1] if i else None

    low: list[int] = []
    for w in lengths:
        low += [w] * min(3 - len(low), left[w] - (w == j))
        if len(low) == 3:
            break
    if not low or low[0] > room:
        return (j,)
    b = longest(room, (j,))
    if b == room or len(low) < 2 or sum(low[:2]) > room:
        return (j, b)
    if len(low) == 3 and sum(low) <= room:
        return None
    if _best_pair(lengths, left, j, room) <= b:
        return (j, b)
    a = longest(room - b, (j, b))
    return (j, b, a) if a and _best_pair(lengths[bisect.bisect_right(lengths, a) :], left, j, room) <= b else None


def _best_pair(lengths: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum up to room of two pieces besides a j."""
    free = [w for w in lengths if left[w] - (w == j) > 0]
    a, z, best = 0, len(free) - 1, 0
    while a <= z:
        total = free[a] + free[z]
        if total > room:
            z -= 1
        else:
            if a < z or left[free[a]] - (free[a] == j) > 1:
                best = max(best, total)
            a += 1
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: bins with the same lengths are kept as one group."""
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> lengths -> bins
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not groups[room]:
            bisect.insort(rooms, room)
        groups[room][lengths] = groups[room].get(lengths, 0) + n

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect.bisect_left(rooms, w)
            if i == len(rooms):
                each = size // w
                full, rest = divmod(n, each)
                if full:
                    put(size - each * w, (w,) * each, full)
                if rest:
                    put(size - rest * w, (w,) * rest, 1)
                break
            room = rooms[i]
            lengths, bins = groups[room].popitem()
            each = min(room // w, n)
            take = min(bins, n // each)
            if bins > take:
                groups[room][lengths] = bins - take
            if not groups[room]:
                rooms.pop(i)
            put(room - each * w, lengths + (w,) * each, take)
            n -= take * each
    return [(lengths, n) for g in groups.values() for lengths, n in g.items()]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_instance(counts, size)
    return fixed + best_fit(rest, size)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length: (first rank, first sequence, offset) of runs of ranks that lie in consecutive sequences."""
    slots, used, base = defaultdict(list), Counter(), 0
    for lengths, bins in patterns:
        at = 0
        for w in lengths:
            slots[w].append((used[w], base, at))
            used[w] += bins
            at += w
        base += bins
    return slots


def _place(slots: dict[int, list[tuple[int, int, int]]]):
    tables = {w: np.array(x, dtype=np.int64).T for w, x in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for w in np.unique(length):
                here, (first, base, at) = length == w, tables[int(w)]
                k = np.searchsorted(first, rank[here], "right") - 1
                seq[here], off[here] = base[k] + rank[here] - first[k], at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, size, end_id), PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, size, end_id), "pieces")
    # size rows at most, however many documents there are.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(counts, size)))
    blocks = spark.createDataFrame([(w, -(-n // BLOCK_ROWS)) for w, n in counts.items()], "length long, blocks long")
    pieces = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "blocks")).drop("blocks")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = F.broadcast(first) if sum(counts.values()) // BLOCK_ROWS < BROADCAST_ROWS - size else first
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("k", F.row_number().over(inside)).join(first, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k") - 1).alias("rank"))

    def place(batches):
        yield from _place(slots.value)(batches)

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
