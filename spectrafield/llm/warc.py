"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends
with a seek table of its frames, in the published seekable format (a skippable
frame that other decoders pass over). The index that comes back maps every
record to its bundle, frame and place inside the frame, so that one record costs
one seek and one frame. Bundles are written by tasks straight into the shared
folder, each under a name of its own: what a lost task has left there is in no
index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_hot, load, shared_dir
from .kernels import tidy

#: Bytes of records in a frame, and of frames in a bundle, from which the next begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 28
LEVEL = 3
# Fixed values of the seekable format: the skippable frame's magic number, the footer's, and the flag of checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
# Fixed value: the profile of a revisit to an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAME = "urn:page:"

INDEX = "id string, row long, record_type string, refers_to string, bundle string, frame int, frame_offset long, frame_bytes long, start long, length long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(id: str | None, row: int) -> str:
    """A record's identifier: the page's id, and the row's number, which no other record has."""
    return f"<{SAME}{'' if id is None else 'n' + quote(id, safe='')}:{row}>"


def id_of(name: str) -> tuple[str | None, int]:
    id, _, row = name[1 + len(SAME) : -1].rpartition(":")
    return (unquote(id[1:]) if id else None), int(row)


def record(id: str | None, row: int, url: str | None, payload: bytes, first: tuple[str | None, int] | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of the record ``first`` without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {name_of(id, row)}", f"WARC-Date: {date}"]
    if url is not None:  # a line end would end the field
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}")
    if first:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(*first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """A file of frames, written front to back, its seek table last."""

    def __init__(self, root: str):
        self.uri = f"{root}/{uuid.uuid4().hex}.warc.zst"
        system, path = file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size, self.frames = system.open_output_stream(path, compression=None), 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """(number, offset, bytes) of the frame that ``raw`` becomes."""
        if len(raw) >= 1 << 32:
            raise ValueError("a frame holds less than 4 GB")
        packed, at = self.packer.compress(raw), self.size
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(packed)
        return len(self.frames) - 1, at, len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int, int]]:
    """(offset, bytes, bytes unpacked, checksum) of every frame, read from the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    step = 12 if flags & CHECKSUMS else 8
    file.seek(size - 9 - step * count)
    raw, at, found = file.read(step * count), 0, []
    for k in range(count):
        entry = struct.unpack_from("<III" if step == 12 else "<II", raw, k * step)
        found.append((at, entry[0], entry[1], entry[2] if step == 12 else -1))
        at += entry[0]
    return found


def unpacked(file, offset: int, size: int, checksum: int = -1) -> bytes:
    """One frame of an open bundle."""
    file.seek(offset)
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(size))
    if checksum >= 0 and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
        raise ValueError("a frame's checksum differs")
    return raw


def parsed(raw: bytes, at: int = 0):
    """(start, length, fields, block) of the records that lie in a frame from ``at`` on."""
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if not lines[0].startswith("WARC/") or raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("not a record")
        yield at, stop + 4 - at, fields, raw[end + 4 : stop]
        at = stop + 4


def with_first(pages: DataFrame, staging: Staging, least: int) -> DataFrame:
    """``pages`` (id, row, url, payload, order) with the response that each row revisits, if one: (first_id, first_row)."""
    digest = F.sha2(F.col("payload"), 256)
    keys = staging.table(pages.where(F.octet_length("payload") >= least).select(digest.alias("digest"), "order", "id", "row"))
    rank = F.struct("order", F.struct((-F.col("row")).alias("row"), "id"))
    groups = staging.table(keys.groupBy("digest").agg(F.count("*").alias("n"), F.max(rank).alias("x")).where("n > 1").select("digest", "n", F.col("x.col2.id").alias("first_id"), (-F.col("x.col2.row")).alias("first_row")))
    return join_hot(pages.withColumn("digest", F.when(F.octet_length("payload") >= least, digest)), groups, ["digest"], "n", keys.count())


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str | None = None) -> DataFrame:
    """Write a record per row into bundles below ``folder``; the index, one row a record: (id, row, record_type, refers_to, bundle, frame, frame_offset, frame_bytes, start, length).

    Of rows with equal payloads of at least ``least`` bytes, the one with the
    largest id is the response and the others revisit it; of repeated rows with
    that id one is the response. Null ids come before all others, a null
    payload is empty, a null address is left out. start and length are the
    record's place in its unpacked frame, frame_offset and frame_bytes the
    frame's in its bundle. Other columns are ignored; an empty table writes
    nothing and gives an empty index. A record is never split.
    """
    spark = pages.sparkSession
    staging = Staging(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("order"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = staging.table(rows.withColumn("row", F.monotonically_increasing_id()))
    known = with_first(rows, staging, least).select("id", "row", "url", "payload", "first_id", "first_row")
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches):
        bundle, held, waiting, size = None, [], [], 0

        def flush():
            frame, at, packed = bundle.add(b"".join(held))
            columns = list(zip(*[(*w[:4], bundle.uri, frame, at, packed, *w[4:]) for w in waiting], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(c) for c in range(batch.num_columns)]
            for i in range(batch.num_rows):
                id, row, url_, payload, first_id, first_row = (c[i].as_py() for c in columns)
                first = None if first_row is None or first_row == row else (first_id, first_row)
                raw = record(id, row, url_, payload, first, date)
                if bundle is None:
                    bundle = Bundle(folder)
                waiting.append((id, row, "revisit" if first else "response", first[0] if first else None, size, len(raw)))
                held.append(raw)
                size += len(raw)
                if size >= FRAME_BYTES:
                    yield flush()
                    held, waiting, size = [], [], 0
                    if bundle.size >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
        if held:
            yield flush()
        if bundle is not None:
            bundle.close()

    s, n = pa.string(), pa.int64()
    types = [s, n, s, s, s, pa.int32(), n, n, n, n]
    out = staging.table(known.mapInArrow(tidy(run), INDEX))
    staging.drop(rows)
    return out


def read_archives(index: DataFrame) -> DataFrame:
    """(id, row, record_type, refers_to, payload_bytes, payload_digest, payload) of all records of the index's bundles, from the seek tables.

    A bundle is a task's work, read frame by frame; payload is null for
    revisits, whose payload is the other record's. Digests of responses are
    computed from what was read and have to equal the record's own.
    """
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = file_system(uri)
                with system.open_input_file(path) as file:
                    for offset, size, _, checksum in seek_table(file):
                        yield of_frame(parsed(unpacked(file, offset, size, checksum)))

    return index.select("bundle").distinct().mapInArrow(tidy(run), READ)


def read_records(index: DataFrame) -> DataFrame:
    """``read_archives`` for the rows of the index alone: a seek and one frame for each frame that holds any of them."""
    def run(batches):
        for batch in batches:
            for uri, offset, size, starts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                system, path = file_system(uri)
                with system.open_input_file(path) as file:
                    raw = unpacked(file, offset, size)
                yield of_frame(next(parsed(raw, s)) for s in sorted(starts))

    # a frame's records are bounded by its bytes
    wanted = index.groupBy("bundle", "frame_offset", "frame_bytes").agg(F.collect_set("start").alias("starts"))
    return wanted.mapInArrow(tidy(run), READ)


READ = "id string, row long, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def of_frame(records) -> pa.RecordBatch:
    found = []
    for _, _, fields, block in records:
        id, row = id_of(fields["WARC-Record-ID"])
        first = fields.get("WARC-Refers-To")
        http, _, body = block.partition(b"\r\n\r\n")
        length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if first is None and (len(body) != length or base32_sha1(body) != digest):
            raise ValueError("a payload differs from its digest")
        found.append((id, row, fields["WARC-Type"], id_of(first)[0] if first else None, length, digest, None if first else body))
    columns = list(zip(*found, strict=True)) or [()] * 7
    s, n = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [s, n, s, s, n, s, pa.binary()], strict=True)], [c.split()[0] for c in READ.split(", ")])


def op11_warc(spark, sf_dir):
    """All pages written into archives, and what the archives hold, read back."""
    staging = Staging(spark, "op11")
    index = write_archives(load(spark, sf_dir, "pages"), f"{staging.root}/archives")
    return read_archives(index).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
