"""Operator 5: WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; a bundle is a
file of such frames with the seek table of the public seekable format as its last, skippable frame. The
index maps each record to its bundle, its frame and its offset within the frame, so that one record
costs one range read and one frame to decompress.

A task writes its bundle under a name of its own and returns the index rows; only bundles that the index
names are read, so files of tasks that were lost or ran twice are never seen. Bundles go to any
store that pyarrow's file systems open, by default the folder that the cluster shares.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import cut, partitions, shared_dir, table

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Fixed values of the seekable format: skippable frame magic, footer magic; and the base-32 alphabet.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "record string, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


def open_store(uri: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def record(page: str, url: str, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit keeps the HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (b"" if refers is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{page}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record; checks that its length is the one it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = body.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields


class BundleWriter:
    """Appends frames to one bundle file and closes it with its seek table."""

    def __init__(self, folder: str, level: int = 3):
        import zstandard

        self.fs, path = open_store(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.at, self.table, self.held, self.rows, self.index = 0, [], bytearray(), [], []

    def add(self, key: str, data: bytes) -> None:
        self.rows.append((key, len(self.held), len(data)))
        self.held += data
        if len(self.held) >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            frame = self.pack(bytes(self.held))
            self.file.write(frame)
            self.index += [(key, self.name, len(self.table), self.at, len(frame), at, n) for key, at, n in self.rows]
            self.table.append((len(frame), len(self.held)))
            self.at += len(frame)
            self.held, self.rows = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.file.close()
        return self.index


def seek_table(fs, path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, bytes) of each frame, read from the end of the file alone."""
    end = fs.get_file_info(path).size
    with fs.open_input_file(path) as f:
        n, _, magic = struct.unpack("<IBI", f.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        raw, at, out = f.read_at(8 * n, end - 9 - 8 * n), 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", raw, 8 * k)
        out.append((at, packed, plain))
        at += packed
    return out


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) to bundles in ``folder``; returns their index.

    Of rows with equal payloads, those with the smallest page_id are responses, the others revisits that
    refer to it. Null html is an empty payload; a null url is an empty one; rows with null page_id are
    responses unless a row with an id has the same payload. Rows that repeat give a record each. The index
    is in the shared folder when this returns.
    """
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    slim = slim.withColumn("sha", F.unhex(F.sha1("payload")))
    first = cut(slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = slim.join(first, "sha", "left").select(
        F.col("page_id").cast("string").alias("page"), F.coalesce("url", F.lit("")).alias("url"), "payload", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers")
    )

    def bundles(batches):
        out = None
        names = [x.split()[0] for x in INDEX.split(", ")]

        def rows(found):
            return pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in found], pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]]) for n, x in zip(names, INDEX.split(", "))]))

        for batch in batches:
            for page, url, payload, sha, refers in zip(*(c for c in batch.columns)):
                out = out or BundleWriter(folder)
                page = page.as_py() or ""
                out.add(page, record(page, url.as_py(), payload.as_buffer().to_pybytes(), base64.b32encode(sha.as_py()).decode(), refers.as_py(), date))
                if out.at >= BUNDLE_BYTES:
                    yield rows(out.close())
                    out = None
        if out:
            yield rows(out.close())

    return table(marked.mapInArrow(bundles, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names, read back frame by frame: their headers, digest checked against the payload."""
    frames = index.groupBy("bundle", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("record", "at", "bytes")).alias("records"))  # a frame's records: bounded by its bytes
    schema = "record string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers string"

    def unpack(batches):
        import zstandard

        fs, path = open_store(folder)
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['bundle']}") as f:
                    data = plain(f.read_at(row["frame_bytes"], row["frame_at"]))
                got = []
                for r in row["records"]:
                    x = parse(data[r["at"] : r["at"] + r["bytes"]])
                    digest, kind = x["WARC-Payload-Digest"].removeprefix("sha1:"), x["WARC-Type"]
                    if x["WARC-Record-ID"] != f"<urn:x-page:{r['record']}>" or kind == "response" and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest:
                        raise ValueError(f"record {r['record']} doesn't match the index")
                    refers = x["WARC-Refers-To"][len("<urn:x-page:") : -1] if kind == "revisit" else None
                    got.append((r["record"], kind, x["WARC-Target-URI"], x["payload"] if kind == "response" else None, x["payload_bytes"], digest, refers))
                names = [c.split()[0] for c in schema.split(", ")]
                kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names)

    dealt = frames.repartition(partitions(index.sparkSession), "bundle", "frame_at")  # few rows, but each is a frame to unpack
    return dealt.mapInArrow(unpack, schema)


def digest_rows(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the written archives have them."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    back = read(write(pages, folder), folder)
    kind = dict(pages.dtypes)["page_id"]
    return back.select(F.when(F.col("record") != "", F.col("record")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', 1 + (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def query(spark, sf_dir: str) -> DataFrame:
    return digest_rows(spark.read.parquet(f"{sf_dir}/pages.parquet"))
