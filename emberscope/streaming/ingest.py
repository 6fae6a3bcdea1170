"""Incremental landing of event logs: each log is read once, when its application has ended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberscope.sources.eventlog import (
    APPLICATION_END, application_of, log_units, read_event_log, read_lines, rolled_file_number, route, write_landed,
)

_LISTING = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
_LEDGER = "log STRING, batch BIGINT"


def land_new_logs(spark: SparkSession, logs: str, folder: str, checkpoint: str, files_per_batch: int = 10_000) -> StreamingQuery:
    """Land every log that ended since the last run: rolled logs at once, single files by a stream that then stops.

    A single file is taken once it has lost its ``.inprogress`` suffix, a rolled log as a whole once its status file
    has; only where a rolled log has no status file is its last file read for the application's end.  What is still being
    written waits for a later run (``unfinished_logs``) and is not read.  The
    stream's checkpoint remembers the single files, ``<folder>/_rolled`` the rolled logs.  A batch overwrites its own
    folder, so a batch that is run again after a failure leaves no duplicates.  The driver holds names of logs only:
    ``files_per_batch`` of single files, and the rolled logs not landed yet.
    """
    _land_rolled(spark, logs, folder.rstrip("/"))
    found = (
        spark.readStream.format("binaryFile")
        .schema(_LISTING)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(logs)
        .select("path")
    )

    def land(batch: DataFrame, batch_id: int) -> None:
        ended = [r.log for r in log_units(batch).where("not rolled and not running").select("log").collect()]
        if ended:
            write_landed(read_event_log(batch.sparkSession, ended, select_files=True), f"{folder.rstrip('/')}/batch={batch_id}")

    return (
        found.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unfinished_logs(spark: SparkSession, logs: str, folder: str) -> DataFrame:
    """``(log)`` of the logs that landing still waits for; only names are read."""
    running = _listed(spark, logs).where("running").select("log")
    return running.unionByName(_open_rolled(spark, logs, folder.rstrip("/")).select("log"))


def _listed(spark: SparkSession, logs: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema(_LISTING).option("recursiveFileLookup", True).load(logs)
    return log_units(files.select("path"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(f"{folder}/_rolled")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def _open_rolled(spark: SparkSession, logs: str, folder: str) -> DataFrame:
    """``(log, last)``: rolled logs that are not landed, with their last file."""
    number = rolled_file_number(F.regexp_extract("path", r"([^/]+)$", 1))
    rolled = _listed(spark, logs).where("rolled").groupBy("log").agg(F.max_by("path", F.struct(number, F.col("path"))).alias("last"))
    return rolled.join(_ledger(spark, folder), "log", "left_anti")


def _running(spark: SparkSession, log: str) -> bool | None:
    """Whether a rolled log is still being written, by the name of the status file beside its files; None without one.

    Spark keeps that file empty, so the listings of file sources leave it out.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/appstatus_*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    names = [x.getPath().getName() for x in found or []]
    return all(x.endswith(".inprogress") for x in names) if names else None


def _land_rolled(spark: SparkSession, logs: str, folder: str) -> None:
    rows = _open_rolled(spark, logs, folder).select("log", "last", application_of(F.col("last")).alias("id")).collect()
    state = {r.log: _running(spark, r.log) for r in rows}
    waiting = [r for r in rows if not state[r.log]]
    unknown = [r.last for r in waiting if state[r.log] is None]
    ended_ids: set[str] = set()
    if unknown:
        ends = route(read_lines(spark, unknown, select_files=True)).where(F.col("event") == APPLICATION_END)
        ended_ids = {r.application_id for r in ends.select("application_id").distinct().collect()}
    ended = [r.log for r in waiting if state[r.log] is False or r.id in ended_ids]
    if ended:
        batch = _ledger(spark, folder).agg(F.coalesce(F.max("batch"), F.lit(0)) + 1).first()[0]
        write_landed(read_event_log(spark, ended, select_files=True), f"{folder}/batch=rolled-{batch}")
        spark.createDataFrame([(log, batch) for log in ended], _LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/_rolled")
