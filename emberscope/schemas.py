"""Declared schemas.  Nothing is inferred anywhere in the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that identify an application run in every history table.
RUN_KEYS = ("cluster_id", "cluster_name", "application_id", "attempt_id")

# Task metrics and where the history payload keeps each of them.
TASK_METRICS = {
    "duration": "duration",
    "executor_deserialize_time": "executorDeserializeTime",
    "executor_deserialize_cpu_time": "executorDeserializeCpuTime",
    "executor_run_time": "executorRunTime",
    "executor_cpu_time": "executorCpuTime",
    "result_size": "resultSize",
    "jvm_gc_time": "jvmGcTime",
    "result_serialization_time": "resultSerializationTime",
    "getting_result_time": "gettingResultTime",
    "scheduler_delay": "schedulerDelay",
    "peak_execution_memory": "peakExecutionMemory",
    "memory_bytes_spilled": "memoryBytesSpilled",
    "disk_bytes_spilled": "diskBytesSpilled",
    "input_bytes": "inputMetrics.bytesRead",
    "input_records": "inputMetrics.recordsRead",
    "output_bytes": "outputMetrics.bytesWritten",
    "output_records": "outputMetrics.recordsWritten",
    "shuffle_read_bytes": "shuffleReadMetrics.readBytes",
    "shuffle_read_records": "shuffleReadMetrics.readRecords",
    "remote_blocks_fetched": "shuffleReadMetrics.remoteBlocksFetched",
    "local_blocks_fetched": "shuffleReadMetrics.localBlocksFetched",
    "fetch_wait_time": "shuffleReadMetrics.fetchWaitTime",
    "remote_bytes_read": "shuffleReadMetrics.remoteBytesRead",
    "remote_bytes_read_to_disk": "shuffleReadMetrics.remoteBytesReadToDisk",
    "total_blocks_fetched": "shuffleReadMetrics.totalBlocksFetched",
    "remote_reqs_duration": "shuffleReadMetrics.remoteReqsDuration",
    "corrupt_merged_block_chunks": "shuffleReadMetrics.shufflePushReadMetricsDist.corruptMergedBlockChunks",
    "merged_fetch_fallback_count": "shuffleReadMetrics.shufflePushReadMetricsDist.mergedFetchFallbackCount",
    "remote_merged_blocks_fetched": "shuffleReadMetrics.shufflePushReadMetricsDist.remoteMergedBlocksFetched",
    "local_merged_blocks_fetched": "shuffleReadMetrics.shufflePushReadMetricsDist.localMergedBlocksFetched",
    "remote_merged_chunks_fetched": "shuffleReadMetrics.shufflePushReadMetricsDist.remoteMergedChunksFetched",
    "local_merged_chunks_fetched": "shuffleReadMetrics.shufflePushReadMetricsDist.localMergedChunksFetched",
    "remote_merged_bytes_read": "shuffleReadMetrics.shufflePushReadMetricsDist.remoteMergedBytesRead",
    "local_merged_bytes_read": "shuffleReadMetrics.shufflePushReadMetricsDist.localMergedBytesRead",
    "remote_merged_reqs_duration": "shuffleReadMetrics.shufflePushReadMetricsDist.remoteMergedReqsDuration",
    "shuffle_write_bytes": "shuffleWriteMetrics.writeBytes",
    "shuffle_write_records": "shuffleWriteMetrics.writeRecords",
    "shuffle_write_time": "shuffleWriteMetrics.writeTime",
}


def _table(text: str, keys: str = "cluster_id STRING, cluster_name STRING, application_id STRING, attempt_id STRING") -> str:
    return f"{keys}, {text}" if keys else text


# The history tables, as DDL strings.
APPLICATIONS = _table(
    "application_name STRING, duration_ms BIGINT, duration_minutes DOUBLE, start_time STRING, end_time STRING, spark_version STRING"
)
JOBS = _table(
    "job_id BIGINT, job_name STRING, status STRING, submission_time STRING, completion_time STRING, num_tasks BIGINT, "
    "num_completed_tasks BIGINT, num_failed_tasks BIGINT, stage_ids STRING, task_success_rate DOUBLE"
)
STAGES = _table(
    "stage_id BIGINT, stage_name STRING, status STRING, num_tasks BIGINT, num_active_tasks BIGINT, num_complete_tasks BIGINT, "
    "num_failed_tasks BIGINT, executor_run_time BIGINT, executor_cpu_time BIGINT, submission_time STRING, "
    "first_task_launched_time STRING, completion_time STRING, input_bytes BIGINT, output_bytes BIGINT, shuffle_read_bytes BIGINT, "
    "shuffle_write_bytes BIGINT, memory_bytes_spilled BIGINT, disk_bytes_spilled BIGINT, task_completion_rate DOUBLE, "
    "avg_executor_run_time_per_task DOUBLE, total_data_processed_mb DOUBLE, shuffle_data_mb DOUBLE, stage_attempt_id BIGINT"
)
TASKS = _table(
    "stage_id BIGINT, stage_attempt_id BIGINT, task_id BIGINT, index BIGINT, attempt BIGINT, launch_time STRING, duration BIGINT, "
    "executor_id STRING, host STRING, status STRING, task_locality STRING, speculative BOOLEAN"
)
SQL = _table(
    "sql_id BIGINT, description STRING, status STRING, duration_ms BIGINT, submission_time STRING, sql_raw_json STRING"
)
EXECUTORS = _table(
    "executor_id STRING, host_port STRING, is_active BOOLEAN, rdd_blocks BIGINT, memory_used BIGINT, disk_used BIGINT, "
    "total_cores BIGINT, max_tasks BIGINT, active_tasks BIGINT, failed_tasks BIGINT, completed_tasks BIGINT, total_tasks BIGINT, "
    "total_duration BIGINT, total_gc_time BIGINT, total_input_bytes BIGINT, total_shuffle_read BIGINT, total_shuffle_write BIGINT, "
    "is_blacklisted BOOLEAN, max_memory BIGINT, add_time STRING, executor_logs STRING"
)
TASK_SUMMARIES = _table("stage_id BIGINT, stage_attempt_id BIGINT, raw_json STRING")
CLUSTER_SUMMARIES = _table(
    "cluster_id STRING, cluster_name STRING, spark_context_id STRING, status STRING, analysis_status STRING, status_details STRING, "
    "total_applications INT, total_jobs INT, total_stages INT, total_tasks INT, total_sql_queries INT, total_executors INT, "
    "total_task_summaries INT",
    keys="",
)

CLUSTER_SUMMARIES_WITH_HOURS = CLUSTER_SUMMARIES.replace("spark_context_id STRING", "normalized_instance_hours INT")

# Payloads of the history endpoints, one element of each list.
PAYLOADS = {
    "applications": "id STRING, name STRING, sparkVersion STRING, duration BIGINT, startTime STRING, endTime STRING, "
    "startTimeEpoch BIGINT, endTimeEpoch BIGINT, appSparkVersion STRING, attempts ARRAY<STRUCT<attemptId: STRING, startTime: STRING, endTime: STRING, "
    "lastUpdated: STRING, duration: BIGINT, completed: BOOLEAN, appSparkVersion: STRING, startTimeEpoch: BIGINT, "
    "endTimeEpoch: BIGINT, lastUpdatedEpoch: BIGINT>>",
    "jobs": "jobId STRING, name STRING, description STRING, submissionTime STRING, completionTime STRING, stageIds ARRAY<BIGINT>, "
    "status STRING, numTasks DOUBLE, numCompletedTasks DOUBLE, numSkippedTasks DOUBLE, numFailedTasks DOUBLE, "
    "numCompletedStages DOUBLE, numSkippedStages DOUBLE, numFailedStages DOUBLE",
    "stages": "stageId STRING, attemptId STRING, name STRING, description STRING, submissionTime STRING, "
    "firstTaskLaunchedTime STRING, completionTime STRING, status STRING, numTasks DOUBLE, numActiveTasks DOUBLE, "
    "numCompleteTasks DOUBLE, numCompletedTasks DOUBLE, numSkippedTasks DOUBLE, numFailedTasks DOUBLE, numCompletedStages DOUBLE, "
    "numSkippedStages DOUBLE, numFailedStages DOUBLE, executorRunTime BIGINT, executorCpuTime BIGINT, memoryBytesSpilled BIGINT, "
    "diskBytesSpilled BIGINT, inputBytes BIGINT, inputRecords BIGINT, outputBytes BIGINT, outputRecords BIGINT, "
    "shuffleReadBytes BIGINT, shuffleReadRecords BIGINT, shuffleWriteBytes BIGINT, shuffleWriteRecords BIGINT",
    "tasks": "taskId BIGINT, index BIGINT, attempt BIGINT, launchTime STRING, duration BIGINT, executorId STRING, host STRING, "
    "status STRING, taskLocality STRING, speculative BOOLEAN, stage_id BIGINT, stage_attempt_id BIGINT",
    "sql": "id BIGINT, status STRING, description STRING, planDescription STRING, submissionTime STRING, duration BIGINT, "
    "successJobIds ARRAY<STRING>, failedJobIds STRING, nodes ARRAY<STRUCT<nodeId: INT, nodeName: STRING, "
    "metrics: ARRAY<STRUCT<name: STRING, value: STRING>>>>",
    "executors": "id STRING, hostPort STRING, isActive BOOLEAN, rddBlocks BIGINT, memoryUsed DOUBLE, diskUsed DOUBLE, "
    "totalCores DOUBLE, maxTasks DOUBLE, activeTasks BIGINT, failedTasks BIGINT, completedTasks DOUBLE, totalTasks DOUBLE, "
    "totalDuration DOUBLE, totalGCTime DOUBLE, totalInputBytes BIGINT, totalShuffleRead BIGINT, totalShuffleWrite BIGINT, "
    "isBlacklisted BOOLEAN, maxMemory BIGINT, addTime STRING, removeTime STRING, executorLogs MAP<STRING, STRING>",
}
PAYLOADS["environment"] = (
    "runtime MAP<STRING, STRING>, sparkProperties ARRAY<ARRAY<STRING>>, hadoopProperties ARRAY<ARRAY<STRING>>, "
    "systemProperties ARRAY<ARRAY<STRING>>, classpathEntries ARRAY<ARRAY<STRING>>"
)
PAYLOADS["storage"] = (
    "id BIGINT, name STRING, numPartitions BIGINT, numCachedPartitions BIGINT, storageLevel STRING, memoryUsed BIGINT, diskUsed BIGINT"
)
PAYLOADS["streaming"] = (
    "startTime STRING, batchDuration BIGINT, numReceivers BIGINT, numActiveReceivers BIGINT, numInactiveReceivers BIGINT, "
    "numTotalCompletedBatches BIGINT, numRetainedCompletedBatches BIGINT, numActiveBatches BIGINT, numProcessedRecords BIGINT, "
    "numReceivedRecords BIGINT, avgInputRate DOUBLE, avgSchedulingDelay BIGINT, avgProcessingTime BIGINT, avgTotalDelay BIGINT"
)
NODE_LIST = "array<struct<nodeId: int, nodeName: string, metrics: array<struct<name: string, value: string>>>>"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Order, cast and complete the columns to a declared table schema (a DDL string)."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(schema).fields
        ]
    )


def nested_by_path(paths: dict[str, Column]) -> Column:
    """Struct built from dotted paths, e.g. ``{"a.b": x}`` gives ``struct(struct(x as b) as a)``."""
    groups: dict[str, dict[str, Column]] = {}
    fields = []
    for path, column in paths.items():
        head, _, rest = path.partition(".")
        if not rest:
            fields.append(column.alias(head))
            continue
        if head not in groups:
            groups[head] = {}
            fields.append(head)
        groups[head][rest] = column
    return F.struct(
        *[nested_by_path(groups[f]).alias(f) if isinstance(f, str) else f for f in fields]
    )
