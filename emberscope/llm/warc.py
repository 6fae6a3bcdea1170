"""WARC archives with a two-level capture index.

Writing: every page is one gzip member of a WARC file; of pages with equal payloads the one with the smallest id is the
response, the others revisit it.  Files are written by the tasks into a shared folder under names no other attempt
uses; only files named in the returned rows count, so a lost or repeated task leaves no wrong record.

Index: keys (reversed host, then path) are range-partitioned and sorted; each partition becomes a part file of compressed
blocks of ``BLOCK_LINES`` captures, followed by its sparse directory of the first key of each block.  The list of parts
has one row per partition.  A lookup searches that list for the parts of a key, deals the keys to their parts, and
there searches the directory by bisection before it reads the ranges of the blocks it needs.

Reading: captures are dealt to their files and read in merged ranges of bounded size.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import saved, text_slices
from emberscope.runtime import shared_folder

BLOCK_LINES = 1000
FILE_BYTES = 256 << 20
RANGE_BYTES, RANGE_GAP = 8 << 20, 1 << 16
CAPTURE = "key string, page_id long, file string, offset long, length long"
PART = "file string, first_key binary, last_key binary, directory_offset long, directory_length long"


def opened(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder or file: local, HDFS, S3 or GCS, as Arrow knows them."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return arrow_fs.FileSystem.from_uri(folder)


def url_key(url: F.Column, otherwise: F.Column) -> F.Column:
    """``com,example,www)/path?query`` of a URL; a text without scheme and host keeps its own characters behind ``)``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    turned = F.array_join(F.reverse(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")), ",")
    port = F.regexp_extract(host, r":[0-9]+$", 0)
    return F.coalesce(F.concat(turned, port, F.lit(")"), rest), otherwise)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url is not None else f"urn:page:{page_id}"
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        first = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{first}>", f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (behind the HTTP head) of a record; the payload of a revisit is empty."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archive(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``(page_id, url, html)`` as WARC files; return the captures ``(key, page_id, file, offset, length)``.

    A null ``html`` is an empty payload.  Pages with the smallest id of a payload are all responses if the id is
    repeated; a page without an id is a response if no page of its payload has one.  Other columns are not read.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.unhex(F.sha1("html")))
    first = source.groupBy("digest").agg(F.min("page_id").alias("first"))
    key = url_key(F.col("url"), F.concat(F.lit("page)"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = source.join(first, "digest").select(
        key.alias("key"), "page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first"))
        .when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        out, name = None, ""
        for batch in text_slices(batches, "html"):
            pages, places = [batch.column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to")], []
            for page_id, url, html, refers_to in zip(*pages):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode()
                member = _gzip(_record(page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers_to, date))
                out.write(member)
                places.append((f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            names, offsets, lengths = (list(x) for x in zip(*places))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page_id"), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return saved(rows.mapInArrow(write, CAPTURE))


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the sorted, compressed index of captures; return its parts, one row per partition."""
    folder = folder or f"{shared_folder(captures.sparkSession)}/index-{uuid.uuid4().hex}"
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        name, at, directory, lines, keys = f"{uuid.uuid4().hex}.cdx", 0, [], [], []
        out = files.open_output_stream(f"{base}/{name}", compression=None)

        def flush() -> int:
            block = zlib.compress(b"\n".join(lines), 4)
            out.write(block)
            directory.append([keys[0], keys[-1], at, len(block)])
            lines.clear()
            keys.clear()
            return at + len(block)

        for batch in batches:
            for row in batch.to_pylist():
                keys.append(row["key"])
                lines.append(json.dumps([row[x] for x in ("key", "page_id", "file", "offset", "length")]).encode())
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if lines:
            at = flush()
        if directory:
            packed = zlib.compress(json.dumps(directory).encode(), 4)
            out.write(packed)
        out.close()
        if directory:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{folder}/{name}"]), pa.array([directory[0][0].encode()], pa.binary()),
                    pa.array([directory[-1][1].encode()], pa.binary()), pa.array([at], pa.int64()), pa.array([len(packed)], pa.int64()),
                ],
                names=["file", "first_key", "last_key", "directory_offset", "directory_length"],
            )

    return saved(ordered.mapInArrow(write, PART))


def lookup(keys: DataFrame, parts: DataFrame) -> DataFrame:
    """All captures of the distinct ``key`` values; ``parts`` has one row per index partition and is sent to all tasks."""
    listed = sorted((bytes(r.first_key), bytes(r.last_key), r.file, r.directory_offset, r.directory_length) for r in parts.collect())
    first, last = [x[0] for x in listed], [x[1] for x in listed]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, which = [], []
            for key in batch.column("key").to_pylist():
                plain = key.encode()
                for i in range(bisect.bisect_left(last, plain), bisect.bisect_right(first, plain)):
                    found.append(key)
                    which.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(which, pa.int32())], names=["key", "part"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = directory = stream = block_at = None
        block: list = []
        for batch in batches:
            out = []
            for key, number in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                if number != part:
                    part, block_at = number, None
                    _, _, name, offset, length = listed[part]
                    files, path = opened(name)
                    stream = files.open_input_file(path)
                    rows = json.loads(zlib.decompress(stream.read_at(length, offset)))
                    directory = ([x[0].encode() for x in rows], [x[1].encode() for x in rows], rows)
                plain = key.encode()
                for i in range(bisect.bisect_left(directory[1], plain), bisect.bisect_right(directory[0], plain)):
                    if i != block_at:
                        _, _, offset, length = directory[2][i]
                        block = [json.loads(x) for x in zlib.decompress(stream.read_at(length, offset)).split(b"\n")]
                        block_keys, block_at = [x[0].encode() for x in block], i
                    out += block[bisect.bisect_left(block_keys, plain) : bisect.bisect_right(block_keys, plain)]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["key", "page_id", "file", "offset", "length"]
            )

    dealt = keys.select("key").distinct().mapInArrow(deal, "key string, part int")
    return dealt.repartition("part").sortWithinPartitions("part", "key").mapInArrow(search, CAPTURE)


def read_captures(captures: DataFrame) -> DataFrame:
    """Read records by their ranges: ``(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)``.

    The digest of a response is taken from the payload that was read and must agree with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = None
        for batch in batches:
            files, offsets, lengths = (batch.column(x).to_pylist() for x in ("file", "offset", "length"))
            i = 0
            while i < len(files):
                j, end = i, offsets[i]
                while (
                    j < len(files) and files[j] == files[i] and offsets[j] - end <= RANGE_GAP
                    and (j == i or offsets[j] + lengths[j] - offsets[i] <= RANGE_BYTES)
                ):
                    end = offsets[j] + lengths[j]
                    j += 1
                if files[i] != name:
                    name = files[i]
                    system, path = opened(name)
                    stream = system.open_input_file(path)
                data = stream.read_at(end - offsets[i], offsets[i])
                rows = []
                for k in range(i, j):
                    member = data[offsets[k] - offsets[i] : offsets[k] - offsets[i] + lengths[k]]
                    headers, payload = parse_record(zlib.decompress(member, 31))
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if actual != digest or len(payload) != int(headers["X-Payload-Length"]):
                            raise ValueError(f"{name}: the record at {offsets[k]} does not match its digest")
                    rows.append((
                        int(x) if (x := headers["X-Page-Id"]) else None, int(headers["X-Payload-Length"]), digest, kind,
                        int(headers["X-Refers-To-Page"]) if kind == "revisit" else None, payload if kind == "response" else None,
                    ))
                i = j
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )

    near = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return near.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look up every URL of the table and read the records back, without their payload."""
    captures = write_archive(pages)
    parts = build_index(captures)
    return read_captures(lookup(captures.select("key"), parts)).drop("payload")
