"""From an event log to metric tables, recommendations and exports in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.functions.text import iso_from_millis
from emberscope.operators import accounting, drill, sqlplans
from emberscope.operators import events as ev
from emberscope.plans import advisor, compat, overview
from emberscope.runtime import stored
from emberscope.schemas import TASK_METRICS, nested_by_path
from emberscope.sinks import tables as sink
from emberscope.sources import eventlog

KEY = ("application_id",)


@dataclass
class EventLog:
    """Metric frames of any number of application logs, all keyed by ``application_id``.

    ``events`` should be landed (:func:`sources.eventlog.land_events`) when more than
    one or two frames are wanted from a large log.  Frames that feed several others
    are stored when first used.

    ``corrected`` takes plan nodes and rules in their corrected form.  Logs of open-source Spark need it: their
    plans carry no ``explainId``, without which the published form finds no nodes with metrics.
    """

    events: DataFrame
    corrected: bool = False

    @classmethod
    def read(cls, spark: SparkSession, path, landed: str | None = None, corrected: bool = False) -> "EventLog":
        """Read logs; with ``landed`` the events are written there first."""
        events = eventlog.read_event_log(spark, path)
        return cls(events if landed is None else eventlog.land_events(events, landed), corrected)

    @cached_property
    def stage_rows(self) -> DataFrame:
        return stored(ev.stage_rows(self.events))

    @cached_property
    def attempts(self) -> DataFrame:
        return stored(ev.merged_attempts(self.stage_rows))

    @cached_property
    def stages(self) -> DataFrame:
        return stored(accounting.stages(self.events, self.stage_rows, self.attempts))

    @cached_property
    def jobs(self) -> DataFrame:
        return accounting.jobs(self.events, self.stages, self.stage_rows)

    @cached_property
    def task_summaries(self) -> DataFrame:
        return accounting.task_summaries(self.events)

    @cached_property
    def executions(self) -> DataFrame:
        return stored(sqlplans.executions(self.events))

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(sqlplans.plan_nodes(self.executions, self.corrected))

    @cached_property
    def node_metrics(self) -> DataFrame:
        return sqlplans.node_metrics(self.nodes, self.events, self.corrected)

    @cached_property
    def execution_jobs(self) -> DataFrame:
        return sqlplans.execution_jobs(self.events)

    # -- published shapes ------------------------------------------------------------------

    def job_metrics(self) -> DataFrame:
        zero = F.lit(0.0)
        return self.jobs.select(
            *KEY,
            F.col("job_id").cast("string").alias("jobId"), "name", "description",
            iso_from_millis(F.col("submission_ms")).alias("submissionTime"),
            iso_from_millis(F.col("completion_ms")).alias("completionTime"),
            F.transform("stage_ids", lambda s: s.cast("string")).alias("stageIds"),
            F.col("job_group").alias("jobGroup"), F.col("job_tags").alias("jobTags"), "status",
            F.col("num_tasks").alias("numTasks"), zero.alias("numActiveTasks"),
            F.col("num_completed_tasks").alias("numCompletedTasks"), F.col("num_skipped_tasks").alias("numSkippedTasks"),
            F.col("num_failed_tasks").alias("numFailedTasks"), zero.alias("numKilledTasks"), zero.alias("numActiveStages"),
            F.col("num_completed_stages").alias("numCompletedStages"), F.col("num_skipped_stages").alias("numSkippedStages"),
            F.col("num_failed_stages").alias("numFailedStages"),
        )

    def stage_metrics(self) -> DataFrame:
        zero = F.lit(0.0)
        return self.stages.select(
            *KEY,
            F.col("stage_id").cast("string").alias("stageId"), F.col("attempt_id").cast("string").alias("attemptId"), "name",
            F.lit("").alias("description"),
            iso_from_millis(F.col("submission_ms")).alias("submissionTime"),
            iso_from_millis(F.col("completion_ms")).alias("completionTime"), "status",
            F.col("num_tasks").alias("numTasks"), F.col("num_completed_tasks").alias("numCompletedTasks"),
            zero.alias("numSkippedTasks"), F.col("num_failed_tasks").alias("numFailedTasks"),
            zero.alias("numCompletedStages"), zero.alias("numSkippedStages"), zero.alias("numFailedStages"),
            F.col("memory_bytes_spilled").alias("memoryBytesSpilled"), F.col("disk_bytes_spilled").alias("diskBytesSpilled"),
            F.col("input_bytes").alias("inputBytes"), F.col("input_records").alias("inputRecords"),
            F.col("output_bytes").alias("outputBytes"), F.col("output_records").alias("outputRecords"),
            F.col("shuffle_read_bytes").alias("shuffleReadBytes"), F.col("shuffle_read_records").alias("shuffleReadRecords"),
            F.col("shuffle_write_bytes").alias("shuffleWriteBytes"), F.col("shuffle_write_records").alias("shuffleWriteRecords"),
        )

    def sql_metrics(self) -> DataFrame:
        """Executions with nested nodes and job lists, one row each."""
        nodes = sqlplans.nested_nodes(self.nodes, self.node_metrics)
        lists = sqlplans.execution_job_lists(self.execution_jobs)
        joined = self.executions.join(nodes, sqlplans.EXECUTION, "left").join(lists, sqlplans.EXECUTION, "left")
        return joined.select(
            *KEY,
            F.col("execution_id").alias("id"), "status", "description",
            F.col("plan_description").alias("planDescription"), iso_from_millis(F.col("start_ms")).alias("submissionTime"),
            F.col("duration_ms").alias("duration"),
            F.coalesce("success_job_ids", F.array().cast("array<string>")).alias("successJobIds"),
            F.coalesce("failed_job_ids", F.lit("")).alias("failedJobIds"),
            F.coalesce("nodes", F.array().cast("array<struct<nodeId:int,nodeName:string,metrics:array<struct<name:string,value:string>>>>")).alias("nodes"),
        )

    def task_summary_metrics(self) -> DataFrame:
        from emberscope.operators.quantiles import LOG_PROBES

        shape = {"quantiles": F.array(*[F.lit(q) for q in LOG_PROBES])}
        shape.update({path: F.col(column) for column, path in TASK_METRICS.items()})
        return self.task_summaries.select(
            *KEY,
            F.col("stage_id").cast("string").alias("stageId"), F.col("attempt_id").cast("string").alias("attemptId"),
            F.col("num_tasks").alias("numTasks"), nested_by_path(shape).alias("m"),
        ).select(*KEY, "stageId", "attemptId", "numTasks", "m.*")

    # -- analyses -----------------------------------------------------------------------------

    def recommendations(self) -> DataFrame:
        return advisor.recommend(
            KEY, jobs=self.jobs, stages=self.stages,
            executions=self.executions.withColumnRenamed("execution_id", "sql_id"),
            node_metrics=self.node_metrics.withColumnRenamed("execution_id", "sql_id"),
            summaries=self.task_summaries,
            corrected=self.corrected,
        )

    def report(self) -> DataFrame:
        """Report blocks; applications without findings get the fixed message."""
        found = self.recommendations()
        blocks = advisor.report_blocks(found, KEY)
        clean = advisor.clean_applications(self.events, found, KEY)
        return blocks.unionByName(clean, allowMissingColumns=True)

    def overview(self) -> tuple[DataFrame, DataFrame]:
        """Status counts per kind, and byte totals, per application.

        States and counted summaries need neither the tasks of a job or stage nor the quantiles of a summary.
        """
        jobs = accounting.job_states(ev.job_starts(self.events), ev.job_ends(self.events))
        frames = {"jobs": jobs, "stages": self.attempts, "sql_executions": self.executions}
        counts = overview.status_counts(frames, KEY)
        summaries = accounting.summarised_attempts(self.events).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        summaries = summaries.select(*KEY, F.lit("task_summaries").alias("kind"), F.lit("").alias("status"), "n")
        return counts.unionByName(summaries), overview.io_summary(self.attempts, KEY)

    def execution(self, execution_id: int) -> DataFrame:
        """Drill-down of one execution id (in every application that has it)."""
        rows = self.sql_metrics().where(F.col("id") == execution_id)
        renamed = rows.withColumnsRenamed({"id": "sql_id", "duration": "duration_ms"})
        totals = drill.execution_overview(renamed, ["application_id", "sql_id"])
        lists = renamed.select("application_id", "sql_id", "successJobIds", "failedJobIds", "nodes")
        return totals.join(lists, ["application_id", "sql_id"])

    def execution_node_types(self, execution_id: int) -> DataFrame:
        nodes = self.nodes.where(F.col("execution_id") == execution_id)
        return compat.node_types(nodes, ["application_id", "execution_id"])

    def export(self, output_dir: str) -> dict[str, str]:
        return sink.export_metrics(
            {
                "job_metrics": self.job_metrics(),
                "stage_metrics": self.stage_metrics(),
                "sql_metrics": self.sql_metrics(),
                "task_summary_metrics": self.task_summary_metrics(),
            },
            output_dir,
        )


def summary(recommendations: DataFrame, keys: Sequence[str] = KEY) -> dict[str, DataFrame]:
    """The three parts of a recommendation summary."""
    return {
        "by_severity": advisor.severity_counts(recommendations, keys),
        "by_category": advisor.category_counts(recommendations, keys),
        "high_priority": advisor.high_priority(recommendations, keys),
    }
