"""Typed projections of event-log events.

Each function takes routed events (``application_id, event_order, body, event``)
and parses only the fields it needs with a declared schema.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.schemas import TASK_METRICS
from emberscope.sources.eventlog import EVENTS

KEY = "application_id"

_STAGE_INFO = (
    "`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, `Stage Name`: STRING, `Number of Tasks`: BIGINT, `Submission Time`: BIGINT, "
    "`Completion Time`: BIGINT, `Failure Reason`: STRING, Accumulables: ARRAY<STRUCT<Name: STRING, Value: STRING>>"
)
_ACCUMULABLES = "ARRAY<STRUCT<ID: BIGINT, Name: STRING, Value: STRING, Metadata: STRING>>"
# The parts of each event that are used.
_SHAPES = {
    "job_start": "`Job ID` BIGINT, `Submission Time` BIGINT, `Stage Infos` ARRAY<STRUCT<`Stage ID`: BIGINT, `Stage Name`: STRING, "
    "`Number of Tasks`: BIGINT>>, Properties MAP<STRING, STRING>",
    "job_end": "`Job ID` BIGINT, `Completion Time` BIGINT, `Job Result` STRUCT<Result: STRING>",
    "stage_submitted": f"`Stage Info` STRUCT<{_STAGE_INFO}>",
    "stage_completed": f"`Stage Info` STRUCT<{_STAGE_INFO}>",
    "task_end": "`Stage ID` BIGINT, `Stage Attempt ID` BIGINT, `Task End Reason` STRUCT<Reason: STRING>, "
    "`Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT, `Getting Result Time`: BIGINT>, "
    "`Task Metrics` STRUCT<`Executor Deserialize Time`: BIGINT, `Executor Deserialize CPU Time`: BIGINT, `Executor Run Time`: BIGINT, "
    "`Executor CPU Time`: BIGINT, `Result Size`: BIGINT, `JVM GC Time`: BIGINT, `Result Serialization Time`: BIGINT, "
    "`Peak Execution Memory`: BIGINT, `Memory Bytes Spilled`: BIGINT, `Disk Bytes Spilled`: BIGINT, "
    "`Input Metrics`: STRUCT<`Bytes Read`: BIGINT, `Records Read`: BIGINT>, "
    "`Output Metrics`: STRUCT<`Bytes Written`: BIGINT, `Records Written`: BIGINT>, "
    "`Shuffle Read Metrics`: STRUCT<`Remote Blocks Fetched`: BIGINT, `Local Blocks Fetched`: BIGINT, `Fetch Wait Time`: BIGINT, "
    "`Remote Bytes Read`: BIGINT, `Remote Bytes Read To Disk`: BIGINT, `Local Bytes Read`: BIGINT, `Total Records Read`: BIGINT, "
    "`Remote Requests Duration`: BIGINT, `Push Based Shuffle`: STRUCT<`Corrupt Merged Block Chunks`: BIGINT, "
    "`Merged Fetch Fallback Count`: BIGINT, `Merged Remote Blocks Fetched`: BIGINT, `Merged Local Blocks Fetched`: BIGINT, "
    "`Merged Remote Chunks Fetched`: BIGINT, `Merged Local Chunks Fetched`: BIGINT, `Merged Remote Bytes Read`: BIGINT, "
    "`Merged Local Bytes Read`: BIGINT, `Merged Remote Requests Duration`: BIGINT>>, "
    "`Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT, `Shuffle Records Written`: BIGINT, `Shuffle Write Time`: BIGINT>>",
    "sql_start": "executionId BIGINT, description STRING, time BIGINT, sparkPlanInfo STRING",
    "sql_end": "executionId BIGINT, time BIGINT, errorMessage STRING",
    "sql_adaptive_update": "executionId BIGINT, physicalPlanDescription STRING, sparkPlanInfo STRING",
    "driver_accum_updates": "executionId BIGINT, accumUpdates ARRAY<ARRAY<BIGINT>>",
    "sql_metric_updates": "executionId BIGINT, sqlPlanMetrics ARRAY<STRUCT<name: STRING, accumulatorId: BIGINT>>",
}

# Narrower shapes of task ends: most fields are only wanted for summaries.
_TASK_OUTCOME = (
    "`Stage ID` BIGINT, `Stage Attempt ID` BIGINT, `Task End Reason` STRUCT<Reason: STRING>, `Task Info` STRUCT<Failed: BOOLEAN, Killed: BOOLEAN>"
)
TASK_ACCUMULABLES = f"`Task Info` STRUCT<Accumulables: {_ACCUMULABLES}>"

# Stage accumulators behind each stage metric.
_STAGE_ACCUMULATORS = {
    "memory_bytes_spilled": ("internal.metrics.memoryBytesSpilled",),
    "disk_bytes_spilled": ("internal.metrics.diskBytesSpilled",),
    "input_bytes": ("internal.metrics.input.bytesRead",),
    "input_records": ("internal.metrics.input.recordsRead",),
    "output_bytes": ("internal.metrics.output.bytesWritten",),
    "output_records": ("internal.metrics.output.recordsWritten",),
    "shuffle_read_bytes": ("internal.metrics.shuffle.read.localBytesRead", "internal.metrics.shuffle.read.remoteBytesRead"),
    "shuffle_read_records": ("internal.metrics.shuffle.read.recordsRead",),
    "shuffle_write_bytes": ("internal.metrics.shuffle.write.bytesWritten",),
    "shuffle_write_records": ("internal.metrics.shuffle.write.recordsWritten",),
}
STAGE_METRICS = tuple(_STAGE_ACCUMULATORS)


def parsed(events: DataFrame, kind: str, shape: str | None = None) -> DataFrame:
    """Events of one kind with their parsed body ``e``.

    The one-element ``explode`` keeps the parse in one place: filters on parsed
    fields, such as the not-null checks joins add, would otherwise be pushed below
    it and parse every line a second time.
    """
    body = F.from_json("body", shape or _SHAPES[kind])
    return events.where(F.col("event") == EVENTS[kind]).select(KEY, "event_order", F.explode(F.array(body)).alias("e"))


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def accumulator(accumulables: Column, name: str, ignore_case: bool = False, last: bool = True) -> Column:
    """Value of a named accumulator as a number, 0 when absent or not a number."""
    if ignore_case:
        same = F.filter(accumulables, lambda a: F.lower(a.Name) == name.lower())
    else:
        same = F.filter(accumulables, lambda a: a.Name == name)
    chosen = F.try_element_at(same, F.lit(-1 if last else 1))
    return F.coalesce(chosen.getField("Value").try_cast("bigint"), F.lit(0))


def job_starts(events: DataFrame) -> DataFrame:
    e = parsed(events, "job_start")
    infos, props = F.coalesce("e.`Stage Infos`", F.array()), F.col("e.Properties")
    tags = F.transform(F.split(_text(props["spark.job.tags"]), ","), lambda t: F.trim(t))
    return e.select(
        KEY,
        F.col("e.`Job ID`").alias("job_id"),
        F.coalesce("e.`Submission Time`", F.lit(0)).alias("submission_ms"),
        _text(F.get(F.col("e.`Stage Infos`"), 0).getField("Stage Name")).alias("name"),
        _text(props["spark.job.description"]).alias("description"),
        _text(props["spark.jobGroup.id"]).alias("job_group"),
        F.filter(tags, lambda t: t != "").alias("job_tags"),
        props["spark.sql.execution.id"].try_cast("bigint").alias("execution_id"),
        F.transform(
            infos,
            lambda s: F.struct(s["Stage ID"].alias("stage_id"), F.coalesce(s["Number of Tasks"], F.lit(0)).alias("num_tasks")),
        ).alias("stage_infos"),
        F.col("event_order").alias("start_order"),
    ).withColumn("num_tasks", F.aggregate("stage_infos", F.lit(0).cast("bigint"), lambda a, s: a + s.num_tasks).cast("double"))


def job_stages(starts: DataFrame, *keep: str) -> DataFrame:
    """Job to stage relation with the task count each job announced."""
    return starts.select(KEY, "job_id", "start_order", *keep, F.inline("stage_infos"))


def job_ends(events: DataFrame) -> DataFrame:
    return parsed(events, "job_end").select(
        KEY,
        F.col("e.`Job ID`").alias("job_id"),
        F.coalesce("e.`Completion Time`", F.lit(0)).alias("completion_ms"),
        F.coalesce("e.`Job Result`.Result", F.lit("UNKNOWN")).alias("status"),
        F.col("event_order").alias("end_order"),
    )


def _stage_rows(events: DataFrame, kind: str) -> DataFrame:
    info = F.col("e.`Stage Info`")
    completed = kind == "stage_completed"
    rows = parsed(events, kind)
    if completed:
        # names and values backwards, so that the first match is the last one reported; the generator keeps them in one place
        items = info["Accumulables"]
        turned = F.struct(F.reverse(items["Name"]).alias("names"), F.reverse(items["Value"]).alias("values"))
        rows = rows.select("*", F.inline(F.array(turned)))

        def reported(name: str) -> Column:
            at = F.array_position("names", F.lit(name)).cast("int") - 1
            return F.coalesce(F.get("values", at).try_cast("bigint"), F.lit(0))

        metrics = F.struct(*[reduce(add, map(reported, names)).alias(metric) for metric, names in _STAGE_ACCUMULATORS.items()])
        failed = _text(info["Failure Reason"]) != ""
        status = F.when(failed, "FAILED").otherwise("COMPLETE")
    else:
        metrics = F.lit(None).cast("struct<" + ",".join(f"{m}:bigint" for m in STAGE_METRICS) + ">")
        status = F.lit(None).cast("string")
    return rows.select(
        KEY,
        info["Stage ID"].alias("stage_id"),
        F.coalesce(info["Stage Attempt ID"], F.lit(0)).alias("attempt_id"),
        _text(info["Stage Name"]).alias("name"),
        F.coalesce(info["Submission Time"], F.lit(0)).alias("submission_ms"),
        (F.coalesce(info["Completion Time"], F.lit(0)) if completed else F.lit(None).cast("bigint")).alias("completion_ms"),
        F.coalesce(info["Number of Tasks"], F.lit(0)).alias("num_tasks"),
        status.alias("status"),
        metrics.alias("metrics"),
        "event_order",
        F.lit(completed).alias("completed"),
    )


def stage_submissions(events: DataFrame) -> DataFrame:
    return _stage_rows(events, "stage_submitted")


def stage_rows(events: DataFrame) -> DataFrame:
    """Submissions and completions of stage attempts, told apart by ``completed``."""
    return _stage_rows(events, "stage_submitted").unionByName(_stage_rows(events, "stage_completed"))


def stage_attempts(events: DataFrame) -> DataFrame:
    return merged_attempts(stage_rows(events))


def merged_attempts(rows: DataFrame) -> DataFrame:
    """One row per stage attempt: submission and completion merged in a single grouping."""
    order = F.col("event_order")

    def first(column, condition):
        return F.min_by(column, F.when(condition, order))

    def last(column):
        return F.max_by(column, F.when(F.col("completed"), order))

    # an attempt has two rows or so, far apart: they move first and are sorted once, by the number that tells most
    keys = ["stage_id", "attempt_id", KEY]
    merged = rows.repartition(*keys).groupBy(*keys).agg(
        _text(first("name", F.col("name") != "")).alias("name"),
        F.coalesce(first("submission_ms", F.col("submission_ms") > 0), F.lit(0)).alias("submission_ms"),
        F.coalesce(last("completion_ms"), F.lit(0)).alias("completion_ms"),
        F.min_by("num_tasks", order).cast("double").alias("num_tasks"),
        _text(last("status")).alias("status"),
        last("metrics").alias("metrics"),
        F.min(order).alias("created_order"),
        F.max(F.when(F.col("completed"), order)).alias("completed_order"),
    )
    return merged.select(
        "*", *[F.coalesce(F.col("metrics")[m], F.lit(0)).alias(m) for m in STAGE_METRICS]
    ).drop("metrics")


def task_outcomes(events: DataFrame) -> DataFrame:
    """Stage attempt, outcome and order of every finished task."""
    info = F.col("e.`Task Info`")
    outcome = (
        F.when(F.col("e.`Task End Reason`.Reason") == "Success", "completed")
        .when(info["Failed"], "failed")
        .when(info["Killed"], "killed")
    )
    return parsed(events, "task_end", _TASK_OUTCOME).select(
        KEY,
        F.col("e.`Stage ID`").alias("stage_id"),
        F.coalesce("e.`Stage Attempt ID`", F.lit(0)).alias("attempt_id"),
        outcome.alias("outcome"),
        F.col("event_order").alias("task_order"),
    )


def task_metrics(events: DataFrame) -> DataFrame:
    """The metrics of every successful task, one flat column each."""
    m, info = F.col("e.`Task Metrics`"), F.col("e.`Task Info`")

    def zero(column):
        return F.coalesce(column, F.lit(0))

    read, pushed = m["Shuffle Read Metrics"], m["Shuffle Read Metrics"]["Push Based Shuffle"]
    written = m["Shuffle Write Metrics"]
    launch, finish = zero(info["Launch Time"]), zero(info["Finish Time"])
    duration = F.when((launch != 0) & (finish != 0), finish - launch).otherwise(0)
    fetching = zero(info["Getting Result Time"])
    deserialize, run = zero(m["Executor Deserialize Time"]), zero(m["Executor Run Time"])
    serialize = zero(m["Result Serialization Time"])
    columns = {
        "duration": duration,
        "executor_deserialize_time": deserialize,
        "executor_deserialize_cpu_time": zero(m["Executor Deserialize CPU Time"]),
        "executor_run_time": run,
        "executor_cpu_time": zero(m["Executor CPU Time"]),
        "result_size": zero(m["Result Size"]),
        "jvm_gc_time": zero(m["JVM GC Time"]),
        "result_serialization_time": serialize,
        "getting_result_time": fetching,
        "scheduler_delay": F.greatest(F.lit(0), duration - deserialize - run - serialize - fetching),
        "peak_execution_memory": zero(m["Peak Execution Memory"]),
        "memory_bytes_spilled": zero(m["Memory Bytes Spilled"]),
        "disk_bytes_spilled": zero(m["Disk Bytes Spilled"]),
        "input_bytes": zero(m["Input Metrics"]["Bytes Read"]),
        "input_records": zero(m["Input Metrics"]["Records Read"]),
        "output_bytes": zero(m["Output Metrics"]["Bytes Written"]),
        "output_records": zero(m["Output Metrics"]["Records Written"]),
        "shuffle_read_bytes": zero(read["Remote Bytes Read"]) + zero(read["Local Bytes Read"]),
        "shuffle_read_records": zero(read["Total Records Read"]),
        "remote_blocks_fetched": zero(read["Remote Blocks Fetched"]),
        "local_blocks_fetched": zero(read["Local Blocks Fetched"]),
        "fetch_wait_time": zero(read["Fetch Wait Time"]),
        "remote_bytes_read": zero(read["Remote Bytes Read"]),
        "remote_bytes_read_to_disk": zero(read["Remote Bytes Read To Disk"]),
        "total_blocks_fetched": zero(read["Remote Blocks Fetched"]) + zero(read["Local Blocks Fetched"]),
        "remote_reqs_duration": zero(read["Remote Requests Duration"]),
        "corrupt_merged_block_chunks": zero(pushed["Corrupt Merged Block Chunks"]),
        "merged_fetch_fallback_count": zero(pushed["Merged Fetch Fallback Count"]),
        "remote_merged_blocks_fetched": zero(pushed["Merged Remote Blocks Fetched"]),
        "local_merged_blocks_fetched": zero(pushed["Merged Local Blocks Fetched"]),
        "remote_merged_chunks_fetched": zero(pushed["Merged Remote Chunks Fetched"]),
        "local_merged_chunks_fetched": zero(pushed["Merged Local Chunks Fetched"]),
        "remote_merged_bytes_read": zero(pushed["Merged Remote Bytes Read"]),
        "local_merged_bytes_read": zero(pushed["Merged Local Bytes Read"]),
        "remote_merged_reqs_duration": zero(pushed["Merged Remote Requests Duration"]),
        "shuffle_write_bytes": zero(written["Shuffle Bytes Written"]),
        "shuffle_write_records": zero(written["Shuffle Records Written"]),
        "shuffle_write_time": zero(written["Shuffle Write Time"]),
    }
    assert tuple(columns) == tuple(TASK_METRICS)
    # the filter stays above the explode of the parse, so a line is parsed once; inlined, all columns would make one
    # method too large to be compiled
    successful = F.col("e.`Task End Reason`.Reason") == "Success"
    return parsed(events, "task_end").where(successful).select(
        KEY,
        F.col("e.`Stage ID`").alias("stage_id"),
        F.coalesce("e.`Stage Attempt ID`", F.lit(0)).alias("attempt_id"),
        *[column.alias(name) for name, column in columns.items()],
    )
