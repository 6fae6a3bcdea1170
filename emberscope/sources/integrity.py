"""Ledger of log files: what each file holds, and whether it is whole.

Reading a damaged compressed log ends at the damage without an error.  A broken last file shows as a missing end event
(``eventlog.unended_logs``), one in the middle of a rolled log does not show at all.  The ledger decodes every file once,
each in a task of its own and as a stream, and compares what it finds with the ends that the formats write: the length
and checksum behind each gzip member, the end of each zstd frame, the line feed behind the last line.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.sources.eventlog import application_of, is_log_file, rolled_file_number

_CHUNK = 1 << 20
_LEDGER = "file_path string, size long, codec string, bytes long, lines long, complete boolean, problem string"


def _gzip_member() -> Callable:
    return zlib.decompressobj(31)


def _zstd_frame() -> Callable:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


_OPENERS = {"gz": _gzip_member, "zst": _zstd_frame, "zstd": _zstd_frame}


def decoded(chunks: Iterator[bytes], opener: Callable) -> Iterator[bytes]:
    """Content of concatenated members or frames; raises ``EOFError`` if the last one has no end."""
    part, begun = opener(), False
    for chunk in chunks:
        while chunk:
            begun = True
            yield part.decompress(chunk)
            chunk = b""
            if part.eof:
                chunk, part, begun = part.unused_data, opener(), False
    if begun:
        raise EOFError("the file ends before its content does")


def checked(chunks: Iterator[bytes], codec: str) -> tuple[int, int, bool | None, str | None]:
    """Bytes and lines that can be read, whether that is all, and what is wrong if not."""
    size = lines = 0
    last, problem = b"\n", None
    if codec not in ("", *_OPENERS):
        return 0, 0, None, "codec is not checked"
    try:
        for part in decoded(chunks, _OPENERS[codec]) if codec else chunks:
            if part:
                size, lines, last = size + len(part), lines + part.count(b"\n"), part[-1:]
    except Exception as error:  # noqa: BLE001  a decoder raises errors of its own kinds
        problem = f"{type(error).__name__}: {error}"[:200]
    lines += last != b"\n"
    if problem is None and last != b"\n":
        problem = "the last line has no end"
    return size, lines, problem is None, problem


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, length, codec in zip(*(batch.column(x).to_pylist() for x in ("file_path", "size", "codec"))):
            files, place = fs.FileSystem.from_uri(path)
            with files.open_input_stream(place, compression=None) as stream:
                rows.append((path, length, codec, *checked(iter(lambda: stream.read(_CHUNK), b""), codec)))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        columns = zip(*rows) if rows else [()] * len(kinds)
        names = ["file_path", "size", "codec", "bytes", "lines", "complete", "problem"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def file_ledger(spark: SparkSession, path: str | list[str], tasks: int | None = None) -> DataFrame:
    """``(application_id, file_no, file_path, size, codec, bytes, lines, complete, problem)``, one row per log file.

    ``size`` is that of the file, ``bytes`` and ``lines`` what can be read of it; ``complete`` is NULL for codecs that are
    not checked.  Files without a byte are not listed.  Files are named by a listing; nothing of their content passes the driver.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    codec = F.regexp_extract(F.regexp_replace(name, r"\.inprogress$", ""), r"\.(gz|zst|zstd|lz4|snappy|lzf)$", 1)
    files = listed.where(is_log_file(F.regexp_replace(name, r"\.inprogress$", ""))).select(
        F.regexp_replace("path", r"^file:/+", "file:///").alias("file_path"), "size", codec.alias("codec")
    )
    spread = files.repartition("file_path") if tasks is None else files.repartition(tasks, "file_path")
    ledger = spread.mapInArrow(_check, _LEDGER)
    base = F.regexp_extract("file_path", r"([^/]+)$", 1)
    return ledger.select(application_of(F.col("file_path")).alias("application_id"), rolled_file_number(base).alias("file_no"), *[c.split()[0] for c in _LEDGER.split(", ")])


def damaged_files(ledger: DataFrame) -> DataFrame:
    """Files whose content is cut off or broken; lines after the damage are missing from every table."""
    return ledger.where(~F.col("complete"))
