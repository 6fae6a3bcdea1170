"""Issue rules over completed stages with a task summary, and over executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.arrays import HIGH, MEDIAN, point_of_variant, point_or_zero
from emberscope.functions.text import fixed, plain_double
from emberscope.plans import texts
from emberscope.plans.advisor import APP, MIB


def _issue(fires: Column, kind: str, severity: Column, details: Column) -> Column:
    return F.when(
        fires,
        F.struct(F.lit(kind).alias("issue_type"), severity.alias("severity"), details.alias("details")),
    )


# Where a task-summary payload keeps the metrics the issue rules read.
SUMMARY_PATHS = {
    "run_time": "$.executorRunTime", "gc_time": "$.jvmGcTime", "memory_spill": "$.memoryBytesSpilled", "disk_spill": "$.diskBytesSpilled",
}


def summary_vectors(summaries: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Vectors for :func:`stage_issues` from the first attempts of a task-summary table; lists and objects are read."""
    parsed = summaries.where("stage_attempt_id = 0").select(*keys, "stage_id", F.try_parse_json("raw_json").alias("_v"))
    return parsed.select(
        *keys, "stage_id",
        *[F.array(*[point_of_variant(F.col("_v"), path, i) for i in range(5)]).alias(name) for name, path in SUMMARY_PATHS.items()],
    )


def stage_issues(stages: DataFrame, summaries: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Skew, GC, spill and small-task issues, all in one pass over the joined stages.

    ``summaries`` holds quantile vectors ``run_time``, ``gc_time``, ``memory_spill`` and
    ``disk_spill`` per (keys, stage_id); summaries of the first attempt are expected.
    """
    complete = stages.where(F.col("status") == "COMPLETE").select(
        *keys, "stage_id", "num_tasks",
        (F.coalesce("input_records", F.lit(0)) + F.coalesce("output_records", F.lit(0))).alias("records"),
    )
    vectors = summaries.select(*keys, "stage_id", "run_time", "gc_time", "memory_spill", "disk_spill")
    joined = complete.join(vectors, [*keys, "stage_id"])
    longest, median = point_or_zero(F.col("run_time"), HIGH), point_or_zero(F.col("run_time"), MEDIAN)
    gc_share = F.when(median > 0, point_or_zero(F.col("gc_time"), MEDIAN) / median).otherwise(0.0)
    memory, disk = point_or_zero(F.col("memory_spill"), HIGH), point_or_zero(F.col("disk_spill"), HIGH)
    tasks = F.col("num_tasks")
    per_task = F.try_divide(F.col("records"), tasks)
    skew = F.try_divide(longest, median)
    found = F.filter(
        F.array(
            _issue((longest > 0) & (median > 0) & (skew > 10), "DATA_SKEW", F.lit("HIGH"),
                   F.concat(F.lit("Max task duration ("), plain_double(longest), F.lit("ms) is "), fixed(skew, 1),
                            F.lit("x median ("), plain_double(median), F.lit("ms)"))),
            _issue(gc_share > 0.1, "HIGH_GC_TIME", F.lit("MEDIUM"),
                   F.concat(F.lit("GC time is "), fixed(gc_share * 100, 1), F.lit("% of task duration"))),
            _issue((memory > 0) | (disk > 0), "MEMORY_SPILL", F.when(disk == 0, "MEDIUM").otherwise("HIGH"),
                   F.concat(F.lit("Memory spill: "), fixed(memory / MIB, 1), F.lit("MB, Disk spill: "),
                            fixed(disk / MIB, 1), F.lit("MB"))),
            _issue((tasks > 200) & (per_task < 1000), "TOO_MANY_SMALL_TASKS", F.lit("LOW"),
                   F.concat(tasks.cast("bigint").cast("string"), F.lit(" tasks with ~"), fixed(per_task, 0), F.lit(" records each"))),
        ),
        lambda issue: issue.isNotNull(),
    )
    return joined.select(*keys, F.col("stage_id").cast("bigint").alias("stage_id"), F.inline(found))


def executor_issues(executors: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """GC share of all live executors above 10 %."""
    totals = executors.where("is_active").groupBy(*keys).agg(
        F.sum("total_gc_time").alias("gc"), F.sum("total_duration").alias("busy")
    )
    share = F.try_divide(F.col("gc"), F.col("busy"))
    return totals.where((F.col("busy") > 0) & (share > 0.1)).select(
        *keys,
        F.lit(None).cast("bigint").alias("stage_id"),
        F.lit("CLUSTER_WIDE_GC").alias("issue_type"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.lit("Cluster-wide GC is "), fixed(share * 100, 1), F.lit("% of total executor time")).alias("details"),
    )


def with_advice(issues: DataFrame) -> DataFrame:
    """Severity position and the recommendation that goes with each issue."""
    advice = F.lit(None).cast("string")
    for kind, text in texts.ISSUE_ADVICE.items():
        advice = F.when(F.col("issue_type") == kind, text).otherwise(advice)
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).when(F.col("severity") == "LOW", 2).otherwise(3)
    return issues.withColumn("severity_rank", rank).withColumn("recommendation", advice)


def ordered_issues(issues: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Issues in report order: severity, then stage and type."""
    return with_advice(issues).orderBy(*keys, "severity_rank", F.col("stage_id").asc_nulls_last(), "issue_type")


def issue_counts(issues: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues_found"))
