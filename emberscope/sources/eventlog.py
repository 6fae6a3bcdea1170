"""Reading Spark event logs: plain, gzip or zstd files of JSON lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event names as they appear in logs.
_UI = "org.apache.spark.sql.execution.ui."
EVENTS = {
    "job_start": "SparkListenerJobStart",
    "job_end": "SparkListenerJobEnd",
    "stage_submitted": "SparkListenerStageSubmitted",
    "stage_completed": "SparkListenerStageCompleted",
    "task_end": "SparkListenerTaskEnd",
    "sql_start": _UI + "SparkListenerSQLExecutionStart",
    "sql_end": _UI + "SparkListenerSQLExecutionEnd",
    "sql_adaptive_update": _UI + "SparkListenerSQLAdaptiveExecutionUpdate",
    "driver_accum_updates": _UI + "SparkListenerDriverAccumUpdates",
    "sql_metric_updates": _UI + "SparkListenerSQLAdaptiveSQLMetricUpdates",
}

APPLICATION_END = "SparkListenerApplicationEnd"

#: A position is ``file number * 2^44 + byte offset of the split + row within the scan
#: partition``.  Rows never outnumber bytes, so positions grow with the log and stay
#: unique within an application, and a single number keeps first/last aggregates cheap.
_FILE_SHIFT = 44
_ROW_MASK = (1 << 33) - 1

#: Most rows of one landed file.
LANDED_RECORDS = 5_000_000

#: Lines that share an ``order_chunk``.
CHUNK_BITS = 16


def event_order(file_no: Column, block_start: Column, row_id: Column) -> Column:
    """Position of a line in the log of its application.

    ``row_id`` is ``monotonically_increasing_id`` above the scan: its low bits count
    rows of the scan partition.  A full-size split is alone in its partition, and
    compressed files are not split, so offset plus row never reaches the next split.
    """
    return (
        F.shiftleft(file_no.cast("bigint"), _FILE_SHIFT)
        + block_start.cast("bigint")
        + row_id.cast("bigint").bitwiseAND(F.lit(_ROW_MASK))
    )


def order_chunk(order: Column) -> Column:
    """Coarser position: at most 65,536 neighbouring positions share one."""
    return F.shiftright(order, CHUNK_BITS)


def rolled_file_number(file_name: Column) -> Column:
    """Number of a rolled log file (``events_3_...``), 0 for a log in one file."""
    return F.coalesce(F.regexp_extract(file_name, r"^events_(\d+)_", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def application_of(file_path: Column) -> Column:
    """Application (and attempt) a log belongs to, from its folder or file name."""
    folder = F.regexp_extract(file_path, r"eventlog_v2_([^/]+)/[^/]*$", 1)
    name = F.regexp_extract(file_path, r"([^/]+)$", 1)
    bare = F.regexp_replace(name, r"(\.inprogress)?(\.(gz|zstd|zst|lz4|snappy|lzf|json|txt|log))*(\.inprogress)?$", "")
    return F.when(folder != "", folder).otherwise(bare)


def is_log_file(file_name: Column) -> Column:
    """Compressed logs, names without a dot, and names that start with ``event``."""
    return (
        file_name.rlike(r"\.(gz|zst|zstd)$") | ~file_name.contains(".") | file_name.startswith("event")
    )


def _lines_of(spark: SparkSession, paths: list[str], select: bool) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(paths)
    lines = raw.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )
    if select:
        lines = lines.where(is_log_file(F.col("file_name")))
    return lines.withColumn("row_id", F.monotonically_increasing_id())


#: Slashes after a scheme; listings and scans write ``file:/`` and ``file:///``.
_SCHEME = r"^([^:/]+:)/+"


def _numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_path, file_no)`` from the listing that the scan keeps anyway; no line is read for it."""

    def place(path: str) -> tuple[int, str]:
        rolled = re.match(r"events_(\d+)_", path.rsplit("/", 1)[-1])
        return int(rolled.group(1)) if rolled else 0, path

    numbers = [(re.sub(_SCHEME, r"\1/", path), number) for number, path in enumerate(sorted(paths, key=place), start=1)]
    return spark.createDataFrame(numbers, "file_path STRING, file_no BIGINT")


def read_lines(
    spark: SparkSession, path: str | list[str], select_files: bool | None = None, application_id: str | None = None
) -> DataFrame:
    """Non-blank log lines with application and position; unreadable files are skipped.

    Each path is looked at by itself: one whose last segment has a dot is one file and is read as it is; a folder is
    read recursively and only its log files count.  ``select_files`` decides for all paths instead.
    Every log is its own application unless ``application_id`` names one for all
    files, which then follow each other by name.
    """
    by_kind: dict[bool, list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        folder = "." not in one.rstrip("/").rsplit("/", 1)[-1] if select_files is None else select_files
        by_kind.setdefault(folder, []).append(one)
    lines = reduce(DataFrame.unionByName, [_lines_of(spark, some, folder) for folder, some in by_kind.items()])
    if lines.isEmpty():
        raise FileNotFoundError(f"no event log lines found in {path}")
    if application_id is None:
        lines = lines.withColumn("file_no", rolled_file_number(F.col("file_name")))
        owner = application_of(F.col("file_path"))
    else:
        lines = lines.withColumn("file_path", F.regexp_replace("file_path", _SCHEME, "$1/")).join(_numbered(spark, lines.inputFiles()), "file_path")
        owner = F.lit(application_id)
    return lines.where(F.trim("value") != "").select(
        owner.alias("application_id"),
        event_order(F.col("file_no"), F.col("block_start"), F.col("row_id")).alias("event_order"),
        F.col("value").alias("body"),
    )


def route(lines: DataFrame) -> DataFrame:
    """Add the event name; ``malformed`` marks lines that are no JSON object."""
    shape = "Event STRING, _bad STRING"
    head = F.from_json("body", shape, {"columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_h", head).select(
        *lines.columns, F.col("_h.Event").alias("event"), F.col("_h._bad").isNotNull().alias("malformed")
    )


def events_of(lines: DataFrame) -> DataFrame:
    """Routed lines of the ten known events.

    ``inline`` keeps a line or drops it; a plain filter on a parsed field would be
    pushed below the parse and run it twice.
    """
    head = F.from_json("body", "Event STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    known = F.col("_h._bad").isNull() & F.col("_h.Event").isin(*EVENTS.values())
    kept = F.when(known, F.array(F.struct(F.col("_h.Event").alias("event"))))
    return lines.withColumn("_h", head).select(*lines.columns, F.inline(kept))


def malformed_counts(lines: DataFrame) -> DataFrame:
    """Skipped lines per application."""
    return route(lines).groupBy("application_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed_lines")
    )


def unended_logs(lines: DataFrame) -> DataFrame:
    """Applications whose log has no end event, with the lines found: still running, or a file of theirs broke off.

    Reading a damaged file ends at the damage without an error, so this is where a shortened log shows.
    """
    return (
        route(lines).groupBy("application_id")
        .agg(F.count(F.lit(1)).alias("lines"), F.max(F.col("event").eqNullSafe(APPLICATION_END)).alias("ended"))
        .where("not ended").drop("ended")
    )


def log_units(files: DataFrame) -> DataFrame:
    """``(log, rolled, running, path)`` for listed files with a ``path``; other files than logs drop out.

    A log is one file, or a folder of rolled files.  Spark names a single file ``.inprogress`` until its application ends.
    """
    path = F.col("path")
    name, folder = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"^(.*/eventlog_v2_[^/]+)/[^/]*$", 1)
    rolled = folder != ""
    wanted = F.when(rolled, name.startswith("events_")).otherwise(is_log_file(F.regexp_replace(name, r"\.inprogress$", "")))
    return files.where(wanted).select(
        F.when(rolled, folder).otherwise(path).alias("log"), rolled.alias("rolled"), (~rolled & name.endswith(".inprogress")).alias("running"), "path"
    )


def read_event_log(
    spark: SparkSession, path: str | list[str], select_files: bool | None = None, application_id: str | None = None
) -> DataFrame:
    """Events of one log or of a folder with any number of logs."""
    return events_of(read_lines(spark, path, select_files, application_id))


def write_landed(events: DataFrame, folder: str) -> None:
    """Write events foldered by event.

    The rows are brought together by event and application; AQE cuts what is large and joins what is small, so the
    number of files goes by the bytes and not by the input splits, and row groups can be pruned by application.
    """
    dealt = events.hint("rebalance", "event", "application_id").sortWithinPartitions("event", "application_id", "event_order")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", LANDED_RECORDS).partitionBy("event").parquet(folder)


def land_events(events: DataFrame, folder: str) -> DataFrame:
    """Write events once, foldered by event, and read them back.

    Every operator reads one or two event types; from the landed form it scans only
    those, and the log text is decompressed and routed a single time.
    """
    write_landed(events, folder)
    return read_landed(events.sparkSession, folder)


def read_landed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("application_id STRING, event_order BIGINT, body STRING, event STRING").parquet(folder)
