"""WARC bundles: records in independent Zstandard frames, a footer seek table, and a record index of frame offsets.

A bundle is one binary value of a Spark table (so any store Spark can write will do): frames of up to
``FRAME_BYTES`` of records each, then a skippable frame holding the seek table in the layout of the public Zstandard
seekable format. The index has, for each record, the bundle, its frame and the offset inside that frame, so one
record is read by decompressing one frame. Payloads that repeat are written as ``revisit`` records referring to the
smallest page that has them: digests meet in a map-side combined minimum, so groups of copies of any size never
gather anywhere. Records are WARC/1.1: a response holds an HTTP message, a revisit the head of that message, whose
Content-Length tells the payload's bytes.

Defined cases: a null html is an empty payload; a null url is written as the record's own URN and read back as null;
payloads of fewer than ``min_payload`` bytes are never revisits; a null page_id gets a record that nothing refers to;
repeated rows of a page get a record with an id each, and the later ones of equal payload revisit the first; two payloads
under one page_id are judged each by itself; of equal payloads the smallest page_id is the response; a payload of any length is one record, in a frame of its own if it is longer than a frame; other columns
are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small_batches, written

#: Uncompressed bytes of records in a frame, and compressed bytes of a bundle, from which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 21
#: Fixed values of the Zstandard seekable format: skippable-frame magic, seekable magic.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
BUNDLE_SCHEMA = "bundle_id string, bundle binary, n_records long, index array<struct<record_id:string,page_id:long,frame:int,frame_offset:long,offset:int,length:int>>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record_id: str, kind: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", record_id if url is None else url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = http + (payload if kind == "response" else b"")
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def page_of(urn: str) -> int:
    """The page that a URN names."""
    return int(urn.split(":")[2])


def page_urn(page_id: int | None, repeat: int | None = None) -> str:
    """The URN of a page's record; repeat tells further rows of the page apart."""
    return f"urn:page:{'none' if page_id is None else page_id}{'' if repeat is None else f':{repeat}'}"


class BundleWriter:
    """Frames of records and the seek table that ends them."""

    def __init__(self, level: int = 3):
        self.packer, self.frames, self.sizes, self.index = zstandard.ZstdCompressor(level=level), [], [], []
        self.open, self.open_size, self.written = [], 0, 0

    def add(self, record_id: str, page_id: int | None, record: bytes) -> None:
        self.index.append((record_id, page_id, len(self.frames), self.written, self.open_size, len(record)))
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.written += len(frame)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, offset: int, packed: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[offset : offset + packed])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _bundles(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema([("bundle_id", pa.string()), ("bundle", pa.binary()), ("n_records", pa.int64()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])))])
    part, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()

    def out() -> pa.RecordBatch:
        nonlocal count, writer
        body, index = writer.finish(), [dict(zip(("record_id", "page_id", "frame", "frame_offset", "offset", "length"), x, strict=True)) for x in writer.index]
        row = pa.RecordBatch.from_pylist([{"bundle_id": f"{part:06d}-{count:06d}", "bundle": body, "n_records": len(index), "index": index}], schema=schema)
        count, writer = count + 1, BundleWriter()
        return row

    for batch in batches:
        for r in batch.to_pylist():
            payload = (r["html"] or "").encode()
            kind = "response" if r["first"] is None else "revisit"
            urn = page_urn(r["page_id"], r["repeat"])
            first = None if r["first"] is None else page_urn(r["first"]["page_id"], r["first"]["repeat"])
            writer.add(urn, r["page_id"], warc_record(urn, kind, r["url"], payload, sha1_base32(payload), first, date))
            if writer.written >= BUNDLE_BYTES:
                yield out()
    if writer.index:
        yield out()


def write_warc(pages: DataFrame, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write every page's record; the written table of bundles with their record index. date: when pages were fetched."""
    small_batches(pages.sparkSession)
    pages, html = pages.select("page_id", "url", "html"), F.coalesce("html", F.lit(""))
    named = pages.where("page_id is not null")
    # Pages given more than once, no row as a rule: their first row keeps the plain URN, the others are numbered.
    repeated = written(named.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id"), "repeated-pages")
    rows = pages.withColumn("repeat", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()))
    if not repeated.isEmpty():
        number = F.row_number().over(Window.partitionBy("page_id").orderBy("url", F.sha1(html)))
        numbered = named.join(repeated, "page_id", "left_semi").withColumn("repeat", F.when(number > 1, number.cast("long")))
        rows = rows.join(repeated, "page_id", "left_anti").unionByName(numbered)
    # The first record of each payload that several records hold; a page's plain record has no number and comes first.
    at = F.struct("page_id", "repeat")
    long = rows.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= min_payload)).select(F.sha1(html).alias("digest"), at.alias("at"))
    first = long.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = long.join(first, "digest").where(~F.col("at").eqNullSafe(F.col("first"))).select(F.col("at.page_id").alias("r_page"), F.col("at.repeat").alias("r_repeat"), "first")
    records = rows.join(revisits, (F.col("page_id") == F.col("r_page")) & F.col("repeat").eqNullSafe(F.col("r_repeat")), "left").drop("r_page", "r_repeat")

    def run(batches):
        yield from _bundles(batches, date)

    return written(records.sortWithinPartitions("page_id").mapInArrow(run, BUNDLE_SCHEMA), "warc")


RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for bundle, index in zip(batch.column("bundle"), batch.column("index"), strict=True):
            bundle = memoryview(bundle.as_buffer())
            frames = seek_table(bundle)
            held, plain, rows = -1, b"", []
            for x in index.as_py():
                if x["frame"] != held:
                    at, packed, _ = frames[x["frame"]]
                    if at != x["frame_offset"]:
                        raise ValueError("the index and the seek table differ")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    held, plain, rows = x["frame"], read_frame(bundle, at, packed), []
                fields, block = parse_record(plain[x["offset"] : x["offset"] + x["length"]])
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(dict(h.split(b": ", 1) for h in head.split(b"\r\n")[1:])[b"Content-Length"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = fields.get("WARC-Refers-To", "").strip("<>")
                if not refers and (len(payload) != size or sha1_base32(payload) != digest):
                    raise ValueError(f"payload of {x['record_id']} is damaged")
                rows.append({"page_id": x["page_id"], "url": None if fields["WARC-Target-URI"] == x["record_id"] else fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": page_of(refers) if refers else None, "payload_bytes": size, "payload_digest": digest, "payload": payload})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_warc(bundles: DataFrame) -> DataFrame:
    """One row for each record, read frame by frame; a revisit's payload is empty (see refers_to)."""
    return bundles.select("bundle", "index").mapInArrow(_read, RECORD_SCHEMA)


def read_record(bundles: DataFrame, record_id: str) -> DataFrame:
    """A single record: only the bundle that holds it, and only its frame, is decompressed."""
    hit = bundles.select("bundle", F.filter("index", lambda x: x["record_id"] == record_id).alias("index")).where(F.size("index") > 0)
    return hit.mapInArrow(_read, RECORD_SCHEMA)
