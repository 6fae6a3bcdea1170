"""Whole-log and per-application overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GIB = 1024**3


def status_counts(frames: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows (kind, status, n) for jobs, stages, SQL executions; each frame is counted on its own."""
    parts = None
    for kind, frame in frames.items():
        part = frame.groupBy(*keys, F.coalesce("status", F.lit("Unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(*keys, F.lit(kind).alias("kind"), "status", "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def io_summary(stages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes in, out and shuffled per application, with GB rounded to two places."""
    sums = stages.groupBy(*keys).agg(
        *[
            F.sum(F.coalesce(source, F.lit(0))).cast("bigint").alias(target)
            for source, target in (
                ("input_bytes", "total_input_bytes"),
                ("output_bytes", "total_output_bytes"),
                ("shuffle_read_bytes", "total_shuffle_read_bytes"),
                ("shuffle_write_bytes", "total_shuffle_write_bytes"),
            )
        ]
    )
    shuffled = F.col("total_shuffle_read_bytes") + F.col("total_shuffle_write_bytes")
    return sums.withColumn("total_input_gb", F.round(F.col("total_input_bytes") / GIB, 2)).withColumn(
        "total_shuffle_gb", F.round(shuffled / GIB, 2)
    )


def application_summary(
    applications: DataFrame, jobs: DataFrame, stages: DataFrame, executors: DataFrame,
    keys: Sequence[str] = ("application_id",), succeeded: str = "SUCCEEDED", failed: str = "FAILED",
) -> DataFrame:
    """Counts and capacity per application; every input is reduced before the joins."""
    on = list(keys)
    job_part = jobs.groupBy(*on).agg(
        F.count(F.lit(1)).alias("job_count"),
        F.count_if(F.col("status") == succeeded).alias("jobs_succeeded"),
        F.count_if(F.col("status") == failed).alias("jobs_failed"),
    )
    stage_part = stages.groupBy(*on).agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(F.col("status") == "COMPLETE").alias("stages_completed"),
        F.count_if(F.col("status") == "FAILED").alias("stages_failed"),
    )
    executor_part = executors.groupBy(*on).agg(
        F.count(F.lit(1)).alias("executor_count"),
        F.sum(F.coalesce("total_cores", F.lit(0))).cast("bigint").alias("total_cores"),
        (F.sum(F.coalesce("max_memory", F.lit(0))) / GIB).alias("total_memory_gb"),
    )
    counts = [c for part in (job_part, stage_part, executor_part) for c in part.columns if c not in on]
    joined = applications.join(job_part, on, "left").join(stage_part, on, "left").join(executor_part, on, "left")
    return joined.fillna(0, counts)
