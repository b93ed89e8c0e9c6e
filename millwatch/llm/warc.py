"""Web archives with a two-level capture index.

``write`` stores one gzipped WARC record per page, each its own gzip member, and returns the captures
(where every record lies). Records with equal payloads of at least ``REVISIT_BYTES`` bytes are stored
once: the smallest page_id is the response, the others are revisits that refer to it.
``build_index`` sorts the captures by reversed-host URL key over ranges of keys. Each range becomes an index
file of compressed blocks of lines with a sparse directory (first key and place of every block). ``lookup``
finds keys by binary search over the index files, then the directory, then the lines of the one block it
reads, and ``fetch`` reads exactly the bytes of the records.

Files are written by the tasks through Arrow's file systems into a folder all executors share. A repeated or lost
task writes new files under new names; only files named in the stored captures count, so leftovers of
failed attempts are never read.

NULL payloads are empty and NULL URLs have the empty key. A page without id is always a response, and other pages never
refer to it. Pages that repeat the smallest id of their group are all responses. Without pages
there are no files, and look-ups find nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, stored, table, texts

REVISIT_BYTES = 100
BLOCK_LINES = 3000
#: Captures of one index file, and index files at most: their first and last keys are all that every task holds.
INDEX_LINES, INDEX_FILES = 1_000_000, 1 << 16
FILE_BYTES = 1 << 30
READ_BYTES = 4 << 20
#: Packed bytes that one task reads back.
TASK_BYTES = 4 << 20
CAPTURE = "page_id long, url_key string, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """``http://a.example.com:80/x?y#z`` -> ``com,example,a)/x?y``; blanks and controls become ``_``."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path), r"[\x00-\x20]", "_")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _record(row: dict, payload: bytes, date: str) -> bytes:
    identity = "" if row["page_id"] is None else row["page_id"]
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{identity}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """One unpacked record; raises ValueError if a response does not match its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = lambda x: int(x[12:-1]) if x is not None and len(x) > 13 else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest, "refers_to": page(fields.get("WARC-Refers-To")),
            "payload": None if revisit else payload}


def write(pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z", html: str = "html") -> DataFrame:
    """Write the archive below ``root``; returns the stored captures, one row per page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).alias("html"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    first = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where((F.col("n") > 1) & F.col("first").isNotNull()).select("payload_digest", "first")
    # Payloads that may not match have keys of their own: neither empty ones nor copies of a short one meet in one task.
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.xxhash64("url").cast("string"))
    rows = rows.withColumn("match", F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("payload_digest")).otherwise(alone))
    typed = rows.join(first.withColumnRenamed("payload_digest", "match"), "match", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    typed = typed.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "payload_bytes", "payload_digest", "refers_to",
                         F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"))

    def archive(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches, "html"):
                rows_ = batch.drop_columns(["html"]).to_pylist()
                places = []
                for row, payload_ in zip(rows_, texts(batch, "html"), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    packed = _gzip(_record(row, payload_ or b"", date))
                    out.write(packed)
                    places.append((name, at, len(packed)))
                    at += len(packed)
                files, offsets, lengths = zip(*places, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url_key"), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["page_id", "url_key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stored(typed.mapInArrow(archive, CAPTURE), "captures")


@dataclass(frozen=True)
class Index:
    """``tops``: (first key, last key, index file) in key order, ``INDEX_FILES`` at most."""
    root: str
    tops: tuple[tuple[bytes, bytes, str], ...]


def build_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort the captures into index files. File: blocks, directory (JSON, gzip), length of the directory."""
    by = ("url_key", "page_id", "file", "offset")

    def lay_out(batches):
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        name, out, at, lines, directory, last = f"index-{uuid.uuid4().hex}.cdx", None, 0, [], [], b""

        def flush():
            nonlocal at
            packed = _gzip(b"".join(lines))
            out.write(packed)
            directory.append((lines[0].split(b" ", 1)[0].decode(), at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                last = row["url_key"].encode()
                lines.append(last + b" " + json.dumps([row["page_id"], row["file"], row["offset"], row["length"]]).encode() + b"\n")
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = _gzip(json.dumps(directory).encode())
            out.write(packed + struct.pack("<q", len(packed)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "last": last.decode(), "file": name}])

    wanted = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // INDEX_LINES))
    parts = min(INDEX_FILES, wanted)
    ordered = captures.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    tops = stored(ordered.mapInArrow(lay_out, "first string, last string, file string"), "index")
    rows = [(r["first"].encode(), r["last"].encode(), r["file"]) for r in tops.collect()]
    return Index(root, tuple(sorted(rows)))


class Reader:
    """Binary search over index files, directories and lines; keeps the last directory and block."""

    def __init__(self, index: Index) -> None:
        self.index, (self.store, self.folder) = index, fs.FileSystem.from_uri(index.root)
        self.lasts = [t[1] for t in index.tops]
        self.file, self.keys, self.places, self.open = None, [], [], None
        self.at, self.lines, self.line_keys = None, [], []

    def _directory(self, name: str) -> None:
        if self.file != name:
            self.file, self.at = name, None
            self.open = self.store.open_input_file(f"{self.folder}/{name}")
            size = self.open.size()
            length, = struct.unpack("<q", self.open.read_at(8, size - 8))
            entries = json.loads(_gunzip(self.open.read_at(length, size - 8 - length)))
            self.keys, self.places = [k.encode() for k, _, _ in entries], [(a, n) for _, a, n in entries]

    def find(self, key: bytes):
        """(page_id, file, offset, length) of every capture of the key."""
        for k in range(bisect.bisect_left(self.lasts, key), len(self.index.tops)):
            first, _, name = self.index.tops[k]
            if first > key:
                return
            self._directory(name)
            for b in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
                if self.keys[b] > key:
                    break
                if self.at != b:
                    place, length = self.places[b]
                    self.at, self.lines = b, _gunzip(self.open.read_at(length, place)).splitlines()
                    self.line_keys = [x.split(b" ", 1)[0] for x in self.lines]
                for i in range(bisect.bisect_left(self.line_keys, key), bisect.bisect_right(self.line_keys, key)):
                    yield json.loads(self.lines[i].split(b" ", 1)[1])


def lookup(index: Index, urls: DataFrame, url: str = "url") -> DataFrame:
    """Captures of the distinct keys of ``urls``."""
    keys = urls.select(url_key(F.col(url)).alias("url_key")).distinct()
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def search(batches):
        reader = Reader(index)
        for batch in batches:
            for key in batch.column("url_key").to_pylist():
                found = ((p, key, f, a, n) for p, f, a, n in reader.find(key.encode()))
                while some := list(islice(found, 10_000)):  # a key may have captures without end
                    cols = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
                                                      pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                                                     names=["page_id", "url_key", "file", "offset", "length"])

    return keys.repartitionByRange(parts, "url_key").sortWithinPartitions("url_key").mapInArrow(search, CAPTURE)


def fetch(captures: DataFrame, root: str) -> DataFrame:
    """The records at the given places; neighbours in a file are read together, up to ``READ_BYTES``."""
    def read(batches):
        store, folder = fs.FileSystem.from_uri(root)
        name, source = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(places):
                file, start, length = places[i]
                j, stop = i + 1, start + length
                while j < len(places) and places[j][0] == file and stop <= places[j][1] < start + READ_BYTES:
                    stop, j = places[j][1] + places[j][2], j + 1
                if name != file:
                    name, source = file, store.open_input_file(f"{folder}/{file}")
                data = source.read_at(stop - start, start)
                rows = [parse(_gunzip(data[a - start:a - start + n])) for _, a, n in places[i:j]]
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                i = j

    # Tasks by the bytes they read, which their own rows do not show.
    places = stored(captures.select("file", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    near = places.repartitionByRange(max(1, -(-total // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    root = scratch(spark, "warc")
    index = build_index(write(pages, root), root)
    return fetch(lookup(index, pages), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
QUERIES = {"op1_warc_index": op1_warc_index}
ORACLES = {"op1_warc_index": ORACLE}
