"""History payloads to the declared history tables.

Each function takes payload rows (key columns plus the payload fields of
``schemas.PAYLOADS``) and returns the matching table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope import schemas
from emberscope.functions.text import elapsed
from emberscope.operators.keyed import balanced_join
from emberscope.schemas import RUN_KEYS, conform, nested_by_path

_MIB = 1024 * 1024


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _or_text(name: str, default: str) -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(default))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 2)).otherwise(0.0)


def latest_attempt(attempts: Column, attempt_id: Column | None = None, strict: bool = False) -> Column:
    """The attempt with the given id, else the one with the newest epoch.

    ``strict`` returns NULL instead of falling back to the newest.  The newest is
    the first with the largest of lastUpdated, start or end epoch (first present).
    """
    epoch = lambda a: F.coalesce(a.lastUpdatedEpoch, a.startTimeEpoch, a.endTimeEpoch, F.lit(-1))
    newest_epoch = F.array_max(F.transform(attempts, epoch))
    newest = F.get(F.filter(attempts, lambda a: epoch(a) == newest_epoch), 0)
    if attempt_id is None:
        return newest
    same = F.get(F.filter(attempts, lambda a: a.attemptId == attempt_id.cast("string")), 0)
    return same if strict else F.coalesce(same, newest)


def applications(payload: DataFrame) -> DataFrame:
    """Application table; times and duration come from the chosen attempt."""
    wanted = F.col("attempt_id") if "attempt_id" in payload.columns else None
    rows = payload.withColumn("a", latest_attempt(F.col("attempts"), wanted))

    def either(name):
        return F.when(F.col("a").isNotNull(), F.col(f"a.{name}")).otherwise(F.col(name))

    start, end = either("startTimeEpoch"), either("endTimeEpoch")
    fallback = F.when(end > 0, end - start).otherwise(0)
    duration = F.coalesce(either("duration"), fallback, F.lit(0))
    result = rows.select(
        *[c for c in RUN_KEYS if c in rows.columns and c != "application_id"],
        F.col("id").alias("application_id"),
        F.coalesce("name", F.lit("Unknown")).alias("application_name"),
        duration.alias("duration_ms"),
        F.round(duration / 60000, 2).alias("duration_minutes"),
        either("startTime").alias("start_time"),
        either("endTime").alias("end_time"),
        F.coalesce(either("appSparkVersion"), F.col("sparkVersion"), F.lit("Unknown")).alias("spark_version"),
    )
    return conform(result, schemas.APPLICATIONS)


def jobs(payload: DataFrame) -> DataFrame:
    tasks, done = _or_zero("numTasks"), _or_zero("numCompletedTasks")
    result = payload.select(
        "*",
        F.col("jobId").alias("job_id"),
        F.coalesce("name", F.lit("Unknown")).alias("job_name"),
        F.col("submissionTime").alias("submission_time"),
        F.col("completionTime").alias("completion_time"),
        tasks.alias("num_tasks"),
        done.alias("num_completed_tasks"),
        _or_zero("numFailedTasks").alias("num_failed_tasks"),
        F.concat(F.lit("["), F.array_join(F.coalesce("stageIds", F.array()), ", "), F.lit("]")).alias("stage_ids"),
        _percent(done, tasks).alias("task_success_rate"),
    ).withColumn("status", F.coalesce("status", F.lit("UNKNOWN")))
    return conform(result, schemas.JOBS)


def stages(payload: DataFrame) -> DataFrame:
    """Stage table, one row per attempt of a stage.

    ``attempt_id`` is the application's attempt; ``stage_attempt_id`` is the stage's own, NULL where the payload names none.
    """
    tasks, done, busy = _or_zero("numTasks"), _or_zero("numCompleteTasks"), _or_zero("executorRunTime")
    moved = _or_zero("inputBytes") + _or_zero("outputBytes")
    shuffled = _or_zero("shuffleReadBytes") + _or_zero("shuffleWriteBytes")
    result = payload.select(
        *[c for c in RUN_KEYS if c in payload.columns],
        F.col("stageId").alias("stage_id"),
        _or_text("name", "Unknown").alias("stage_name"),
        _or_text("status", "UNKNOWN").alias("status"),
        tasks.alias("num_tasks"),
        _or_zero("numActiveTasks").alias("num_active_tasks"),
        done.alias("num_complete_tasks"),
        _or_zero("numFailedTasks").alias("num_failed_tasks"),
        busy.alias("executor_run_time"),
        _or_zero("executorCpuTime").alias("executor_cpu_time"),
        F.col("submissionTime").alias("submission_time"),
        F.col("firstTaskLaunchedTime").alias("first_task_launched_time"),
        F.col("completionTime").alias("completion_time"),
        _or_zero("inputBytes").alias("input_bytes"),
        _or_zero("outputBytes").alias("output_bytes"),
        _or_zero("shuffleReadBytes").alias("shuffle_read_bytes"),
        _or_zero("shuffleWriteBytes").alias("shuffle_write_bytes"),
        _or_zero("memoryBytesSpilled").alias("memory_bytes_spilled"),
        _or_zero("diskBytesSpilled").alias("disk_bytes_spilled"),
        _percent(done, tasks).alias("task_completion_rate"),
        F.when((tasks > 0) & (busy > 0), F.round(busy / tasks, 2)).otherwise(0.0).alias("avg_executor_run_time_per_task"),
        F.round(moved / _MIB, 2).alias("total_data_processed_mb"),
        F.round(shuffled / _MIB, 2).alias("shuffle_data_mb"),
        (F.col("attemptId").try_cast("bigint") if "attemptId" in payload.columns else F.lit(None)).alias("stage_attempt_id"),
    )
    return conform(result, schemas.STAGES)


def numbered_attempts(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage rows with a ``stage_attempt_id`` throughout.

    Rows without one are versions of their stage in the order they were submitted, counted from 0; a stage is tried
    again a few times at most, so the window holds a few rows.
    """
    order = Window.partitionBy(*keys, "stage_id").orderBy(F.col("submission_time").asc_nulls_first(), F.col("completion_time").asc_nulls_last())
    version = F.row_number().over(order).cast("bigint") - 1
    known = F.coalesce("stage_attempt_id", version) if "stage_attempt_id" in stages.columns else version
    return stages.withColumn("stage_attempt_id", known)


def tasks(payload: DataFrame) -> DataFrame:
    renamed = payload.withColumnsRenamed(
        {"taskId": "task_id", "launchTime": "launch_time", "executorId": "executor_id", "taskLocality": "task_locality"}
    )
    return conform(renamed, schemas.TASKS)


def sql(payload: DataFrame) -> DataFrame:
    """SQL table; the payload of an execution is kept as JSON text."""
    fields = [c for c in payload.columns if c not in RUN_KEYS]
    result = payload.select(
        *[c for c in RUN_KEYS if c in payload.columns],
        F.col("id").alias("sql_id"),
        F.coalesce("description", F.lit("N/A")).alias("description"),
        "status",
        _or_zero("duration").alias("duration_ms"),
        F.col("submissionTime").alias("submission_time"),
        F.to_json(F.struct(*fields)).alias("sql_raw_json"),
    )
    return conform(result, schemas.SQL)


def executors(payload: DataFrame) -> DataFrame:
    renamed = payload.withColumnsRenamed(
        {
            "id": "executor_id", "hostPort": "host_port", "isActive": "is_active", "rddBlocks": "rdd_blocks",
            "memoryUsed": "memory_used", "diskUsed": "disk_used", "totalCores": "total_cores", "maxTasks": "max_tasks",
            "activeTasks": "active_tasks", "failedTasks": "failed_tasks", "completedTasks": "completed_tasks",
            "totalTasks": "total_tasks", "totalDuration": "total_duration", "totalGCTime": "total_gc_time",
            "totalInputBytes": "total_input_bytes", "totalShuffleRead": "total_shuffle_read",
            "totalShuffleWrite": "total_shuffle_write", "maxMemory": "max_memory", "addTime": "add_time",
        }
    )
    return conform(
        renamed.withColumn("is_blacklisted", F.coalesce("isBlacklisted", F.lit(False)))
        .withColumn("executor_logs", F.coalesce(F.to_json("executorLogs"), F.lit("{}"))),
        schemas.EXECUTORS,
    )


def storage(payload: DataFrame) -> DataFrame:
    """Cached frames of the storage endpoint, one row each, beside the key columns of the payload."""
    keys = [c for c in payload.columns if c not in T.StructType.fromDDL(schemas.PAYLOADS["storage"]).fieldNames()]
    return payload.select(
        *keys, "id", _or_text("name", "Unknown").alias("name"), _or_zero("numPartitions").alias("num_partitions"),
        _or_zero("numCachedPartitions").alias("num_cached_partitions"), F.col("storageLevel").alias("storage_level"),
        _or_zero("memoryUsed").alias("memory_used"), _or_zero("diskUsed").alias("disk_used"),
    )


def streaming_statistics(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Streaming statistics, one row an answer; an answer that is no JSON object (no streaming context) gives none."""
    parsed = df.select(*keep, F.from_json(column, schemas.PAYLOADS["streaming"]).alias("s")).where("s.startTime is not null")
    return parsed.select(
        *keep, F.col("s.startTime").alias("start_time"), F.col("s.batchDuration").alias("batch_duration"),
        _or_zero("s.numReceivers").alias("num_receivers"), _or_zero("s.numActiveReceivers").alias("num_active_receivers"),
        _or_zero("s.numTotalCompletedBatches").alias("num_completed_batches"), _or_zero("s.numActiveBatches").alias("num_active_batches"),
        _or_zero("s.numProcessedRecords").alias("num_processed_records"), _or_zero("s.numReceivedRecords").alias("num_received_records"),
        F.col("s.avgInputRate").alias("avg_input_rate"), F.col("s.avgSchedulingDelay").alias("avg_scheduling_delay"),
        F.col("s.avgProcessingTime").alias("avg_processing_time"), F.col("s.avgTotalDelay").alias("avg_total_delay"),
    )


def task_summary_payload(summaries: DataFrame, probes, paths: dict[str, str] | None = None) -> DataFrame:
    """Quantile columns as the JSON text the task-summary table keeps."""
    paths = paths or {c: p for c, p in schemas.TASK_METRICS.items() if c in summaries.columns}
    shape = {"stageId": F.col("stage_id"), "attemptId": F.col("attempt_id"), "numTasks": F.col("num_tasks")}
    shape["quantiles"] = F.array(*[F.lit(float(q)) for q in probes])
    for column, path in paths.items():
        shape[path] = F.col(column)
    keys = [c for c in ("cluster_id", "cluster_name", "application_id") if c in summaries.columns]
    return summaries.select(
        *keys,
        "stage_id",
        F.col("attempt_id").cast("bigint").alias("stage_attempt_id"),
        F.to_json(nested_by_path(shape)).alias("raw_json"),
    )


def task_summaries(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Task-summary table from landed answers: stage, attempt (0 if none is named) and the JSON text as it came."""
    attempt = F.col("stage_attempt_id") if "stage_attempt_id" in payload.columns else F.lit(0)
    rows = payload.withColumns({"stage_attempt_id": F.coalesce(attempt, F.lit(0)), "raw_json": F.col(column)})
    return conform(rows, schemas.TASK_SUMMARIES)


def tagged(df: DataFrame, identities: DataFrame, on=("application_id",)) -> DataFrame:
    """Add the run keys from an application directory; a missing attempt becomes 0.

    Of several identities of an application the one with the highest attempt is taken, by number, then by the keys.
    """
    missing = [c for c in RUN_KEYS if c in identities.columns and c not in on and c not in df.columns]
    order = [F.col("attempt_id").try_cast("bigint").alias("_number")] if "attempt_id" in identities.columns else []
    newest = identities.groupBy(*on).agg(F.max(F.struct(*order, *missing)).alias("_newest")) if missing else identities.select(*on).distinct()
    tags = newest.select(*on, *[F.col(f"_newest.{c}").alias(c) for c in missing])
    joined = balanced_join(df, tags, list(on), "left")
    if "attempt_id" in missing:
        joined = joined.withColumn("attempt_id", F.coalesce(F.col("attempt_id").cast("string"), F.lit("0")))
    return joined


def run_seconds(df: DataFrame, start: str = "submission_time", end: str = "completion_time", name: str = "runtimesec") -> DataFrame:
    """Whole seconds between two stored times; NULL while running."""
    return df.withColumn(name, elapsed("SECOND", F.to_timestamp(start), F.to_timestamp(end)))
