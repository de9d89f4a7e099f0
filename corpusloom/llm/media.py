"""Media columns: payloads kept as deduplicated, content-defined chunks, and read back verified.

A payload becomes a small media file (8-bit mono PCM, RIFF layout). A rolling gear hash over the file cuts it where the
content says so; chunks are named by SHA-256, so payloads that share long passages share chunks. Digests meet in a
map-side combined count; chunks that occur once stay inside their payload's list, the others are stored once and
joined by digest, so only bytes that repeat are ever shuffled. Reading joins ordered chunk lists with the store,
concatenates, and holds the result against the digest in the list.

Defined cases: a null payload is empty; equal payloads are stored and read back once and give equal values; rows with
a null ``doc_id`` and repeated rows each get a result row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Chunk sizes in bytes: least, most, and the bits of the gear hash that must be zero at a cut (4 KB on average).
CHUNK_LEAST, CHUNK_MOST, CUT_BITS = 1 << 11, 1 << 15, 12
#: Words of 64 bits in the map of digests that occur more than once (4 MB, fixed).
MAP_WORDS = 1 << 19
#: The gear hash sees 32 bytes: its 32-bit sum shifts older ones out.
GEAR = np.random.default_rng(20240101).integers(0, 1 << 32, 256, dtype=np.uint32)
SAMPLE_RATE, UNIT = 8000, 64


def to_media(payload: bytes) -> bytes:
    """8-bit mono PCM in RIFF layout."""
    fmt = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def from_media(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a stored payload")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, by doubling the span summed."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)  # numpy makes the right side first
    return h


def chunk_cuts(media: bytes) -> list[int]:
    """Ends of chunks: the first hash hit after the least size, or the most size."""
    n, cuts, start = len(media), [], 0
    if n > CHUNK_LEAST:
        hits = np.flatnonzero(gear_hashes(np.frombuffer(media, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
        while n - start > CHUNK_LEAST:
            k = np.searchsorted(hits, start + CHUNK_LEAST)
            end = min(int(hits[k]) if k < len(hits) else n, start + CHUNK_MOST, n)
            cuts.append(end)
            start = end
    return cuts if cuts and cuts[-1] == n else [*cuts, n]


def _medium(text: str | None) -> tuple[bytes, list[bytes]]:
    media = to_media(padded((text or "").encode()))
    cuts = chunk_cuts(media)
    return media, [media[a:z] for a, z in zip([0, *cuts], cuts)]


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _bit(digest: bytes) -> tuple[int, int]:
    """The digest's word and bit in the map of shared digests."""
    x = int.from_bytes(digest[:4], "little")
    return x % MAP_WORDS, x // MAP_WORDS % 64


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk's digest; repeats within a batch count once for each time."""
    for batch in batches:
        found = [chunk_digest(c) for text in batch.column(0) for c in _medium(text.as_py())[1]]
        bits = [_bit(d) for d in found]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([w for w, _ in bits], pa.int64()), pa.array([b for _, b in bits], pa.int32())], names=["digest", "word", "bit"])


def _stored(words: np.ndarray, shared: bool):
    """shared: the packed chunks whose digests the map has; else each payload's list, with its other chunks packed inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        on_map = lambda d: bool(int(words[_bit(d)[0]]) >> _bit(d)[1] & 1)
        list_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.binary()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("packed", pa.binary())]))), ("n_shared", pa.int32())])
        for batch in batches:
            rows, done = [], set()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                media, chunks = _medium(text)
                named = [(chunk_digest(c), c) for c in chunks]
                if shared:
                    rows += [{"digest": d, "packed": packer.compress(c)} for d, c in named if on_map(d) and not (d in done or done.add(d))]
                else:
                    refs = [{"digest": d, "packed": None if on_map(d) else packer.compress(c)} for d, c in named]
                    rows.append({"doc_id": doc_id, "n_bytes": len((text or "").encode()), "media_sha256": hashlib.sha256(media).digest(), "chunks": refs, "n_shared": sum(x["packed"] is None for x in refs)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("digest", pa.binary()), ("packed", pa.binary())]) if shared else list_schema)

    return run


LIST_SCHEMA = "doc_id long, n_bytes long, media_sha256 binary, chunks array<struct<digest:binary,packed:binary>>, n_shared int"


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, store), both written. lists: one row for each row of docs, its ordered chunks, those that no other chunk
    equals packed inside; store: digest, packed, one row for each chunk that occurs more than once."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    digests = docs.select("text").mapInArrow(_digests, "digest binary, word long, bit int")
    repeated = digests.groupBy("digest", "word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # MAP_WORDS words at most, whatever the corpus; a full map only sends more chunks through the join.
    found = repeated.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits")).toPandas()
    words = np.zeros(MAP_WORDS, np.uint64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    held = spark.sparkContext.broadcast(words)

    def shared(batches):
        yield from _stored(held.value, True)(batches)

    def lists(batches):
        yield from _stored(held.value, False)(batches)

    store = written(docs.mapInArrow(shared, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed")), "media-store")
    return written(docs.mapInArrow(lists, LIST_SCHEMA), "media-lists"), store


def features(payload: bytes) -> str:
    """Mean, deviation, zero-crossing share and entropy of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    crossings = np.count_nonzero(np.diff((x >= 128).astype(np.int8))) / len(x)
    return f"mean={x.mean():.4f};std={x.std():.4f};zcr={crossings:.5f};entropy={-(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0:.4f};peak={int(x.max())}"


READ_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in READ_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            media = b"".join(unpacker.decompress(p) for p in r["parts"])
            if hashlib.sha256(media).digest() != r["media_sha256"]:
                raise ValueError("a payload read back differs from the one stored")
            payload = from_media(media)
            rows.append((r["doc_id"], r["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names=names)


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Payloads read back, verified, with their digests and features. Only lists that name shared chunks are joined."""
    alone = lists.where("n_shared = 0").select("doc_id", "n_bytes", "media_sha256", F.col("chunks.packed").alias("parts"))
    mixed = lists.where("n_shared > 0")
    refs = mixed.select("doc_id", "media_sha256", F.posexplode("chunks").alias("pos", "c")).where("c.packed is null").select("doc_id", "media_sha256", "pos", F.col("c.digest").alias("digest")).distinct()
    fetched = refs.join(store, "digest").groupBy(F.col("doc_id").alias("f_id"), F.col("media_sha256").alias("f_sha")).agg(F.sort_array(F.collect_list(F.struct("pos", "packed"))).alias("got"))
    got = F.map_from_arrays("got.pos", "got.packed")
    joined = mixed.join(fetched, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("media_sha256") == F.col("f_sha")))
    joined = joined.select("doc_id", "n_bytes", "media_sha256", F.transform("chunks", lambda c, i: F.coalesce(c["packed"], got[i])).alias("parts"))
    return alone.unionByName(joined).mapInArrow(_read, READ_SCHEMA)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back."""
    return read_media(*store_media(docs))
