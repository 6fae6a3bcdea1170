"""Efficiency flags per stage and the share of inefficient time per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.functions.arrays import HIGH, LOW, MEDIAN, point
from emberscope.functions.text import elapsed
from emberscope.operators.history import numbered_attempts
from emberscope.operators.keyed import balanced_join

# Thresholds of the flags (decimal bytes, ratios, percent).
SPILL_LIMIT = 256_000_000
CHUNK_LIMIT = 512_000_000
RATE_RANGE = (0.01, 10_000)
SPREAD = 2
INEFFICIENT_PERCENT = 25

_VECTORS = (
    "duration ARRAY<DOUBLE>, memoryBytesSpilled ARRAY<DOUBLE>, diskBytesSpilled ARRAY<DOUBLE>, "
    "inputMetrics STRUCT<bytesRead: ARRAY<DOUBLE>>, outputMetrics STRUCT<bytesWritten: ARRAY<DOUBLE>>, "
    "shuffleReadMetrics STRUCT<readBytes: ARRAY<DOUBLE>, fetchWaitTime: ARRAY<DOUBLE>>, "
    "shuffleWriteMetrics STRUCT<writeBytes: ARRAY<DOUBLE>>"
)
FLAGS = ("skewbinary", "spillbinary", "diskspillbinary", "chunkbinary", "prbinary")
IDENTITY = ("cluster_id", "cluster_name", "application_id", "attempt_id", "stage_id", "stage_attempt_id")


def _flag(condition):
    return F.when(condition, 1).otherwise(0)


def stage_flags(task_summaries: DataFrame, corrected: bool = False) -> DataFrame:
    """Five 0/1 flags per task summary, from one parse of its JSON.

    The published flags look at chunk sizes of the low quantile only, divide bytes
    read where bytes written are meant, and mark ordinary processing rates;
    ``corrected`` checks all quantiles and flags rates that differ more than twofold.
    """
    present = [c for c in IDENTITY if c in task_summaries.columns]
    parsed = task_summaries.select(*present, F.from_json("raw_json", _VECTORS).alias("m"))
    volumes = {
        "in": F.col("m.inputMetrics.bytesRead"),
        "out": F.col("m.outputMetrics.bytesWritten"),
        "read": F.col("m.shuffleReadMetrics.readBytes"),
        "write": F.col("m.shuffleWriteMetrics.writeBytes"),
    }
    time = F.col("m.duration")
    low, middle, high = point(time, LOW), point(time, MEDIAN), point(time, HIGH)

    def above(vector, limit):
        return (point(vector, MEDIAN) > limit) | (point(vector, HIGH) > limit)

    def chunks(index):
        return F.exists(F.array(*[point(v, index) for v in volumes.values()]), lambda v: v > CHUNK_LIMIT)

    def rates(index):
        sources = dict(volumes)
        if index == HIGH and not corrected:
            sources["out"] = sources["in"]
        return [F.try_divide(point(v, index), point(time, index)) for v in sources.values()]

    def usual(index):
        return F.exists(F.array(*rates(index)), lambda r: r.between(*RATE_RANGE))

    if corrected:
        chunk = chunks(LOW) | chunks(MEDIAN) | chunks(HIGH)
        rate = F.lit(False)
        for slow, mid, fast in zip(rates(LOW), rates(MEDIAN), rates(HIGH)):
            rate = rate | (F.greatest(slow, mid, fast) > SPREAD * F.least(slow, mid, fast))
    else:
        chunk = chunks(LOW)
        rate = usual(LOW) | usual(MEDIAN) | usual(HIGH)
    return parsed.select(
        *present,
        _flag((middle > SPREAD * low) | (high > SPREAD * middle)).alias("skewbinary"),
        _flag(above(F.col("m.memoryBytesSpilled"), SPILL_LIMIT)).alias("spillbinary"),
        _flag(above(F.col("m.diskBytesSpilled"), SPILL_LIMIT)).alias("diskspillbinary"),
        _flag(chunk).alias("chunkbinary"),
        _flag(rate).alias("prbinary"),
    )


def _raised(corrected: bool):
    counted = FLAGS if corrected else FLAGS[:-1]
    total = F.lit(0)
    for name in counted:
        total = total + F.col(name)
    return total


def _incomplete(corrected: bool):
    # the rate is a percentage, the published threshold treats it as a fraction
    return F.coalesce(F.col("task_completion_rate") < (90 if corrected else 0.9), F.lit(False))


def _stage_times(stages: DataFrame, keys, corrected: bool) -> DataFrame:
    started, ended = F.col("submission_time").cast("timestamp"), F.col("completion_time").cast("timestamp")
    attempts = [x for x in ("attempt_id", "stage_attempt_id") if x in stages.columns and x not in keys]
    return stages.select(
        *keys, "stage_id", *attempts, "task_completion_rate",
        _flag(_incomplete(corrected)).alias("incomplete"),
        elapsed("MILLISECOND", started, ended).alias("duration"),
        F.col("submission_time").alias("_submitted"),
        F.col("completion_time"),
    )


def _matched(flags: DataFrame, stages: DataFrame, keys: list[str], corrected: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Summaries, stage times, and the keys to join them on: the application's attempt and the stage's, as far as known.

    A stage table without the stage's attempt is numbered in the order of submission, and a summary belongs to the newest of
    these as of its own attempt.  Summaries that name no attempt belong to the newest one.
    """
    unnamed = "stage_attempt_id" not in stages.columns
    if "stage_attempt_id" in flags.columns:
        stages = numbered_attempts(stages, keys)
    times = _stage_times(stages, keys, corrected)
    both = [x for x in ("attempt_id",) if x in flags.columns and x in times.columns and x not in keys]
    key = [*keys, "stage_id", *both]
    if "stage_attempt_id" in flags.columns:
        flags = flags.withColumn("stage_attempt_id", F.coalesce("stage_attempt_id", F.lit(0)))
        if unnamed:
            newest = times.groupBy(*key).agg(F.max("stage_attempt_id").alias("_newest"))
            flags = flags.join(newest, key).withColumn("stage_attempt_id", F.least("stage_attempt_id", "_newest")).drop("_newest")
        key.append("stage_attempt_id")
    elif "stage_attempt_id" in times.columns:
        rest = [c for c in times.columns if c not in key]
        newest = F.max_by(F.struct(*rest), F.struct("stage_attempt_id", "_submitted"))
        times = times.groupBy(*key).agg(newest.alias("t")).select(*key, "t.*")
    shared = [c for c in ("attempt_id", "stage_attempt_id") if c in times.columns and c not in key]
    return flags, times.drop("_submitted", *shared), key


def inefficient_stages(
    task_summaries: DataFrame,
    stages: DataFrame,
    keys=("cluster_id", "application_id"),
    corrected: bool = False,
) -> DataFrame:
    """One row per stage attempt: flags, number of raised flags, completion rate and duration.

    The join uses the full key, with the attempts of application and stage.  (Joining on cluster and stage number
    alone pairs stages of unrelated applications, and each attempt with every other; the two agree when a cluster runs one
    application and no stage is tried again.)
    """
    flags, times, key = _matched(stage_flags(task_summaries, corrected), stages, list(keys), corrected)
    joined = flags.join(times, key)
    return joined.withColumn("goldcheckfilter", (_raised(corrected) + F.col("incomplete")).cast("int")).drop("incomplete")


def inefficient_clusters(
    task_summaries: DataFrame,
    stages: DataFrame,
    applications: DataFrame,
    corrected: bool = False,
    threshold: float = INEFFICIENT_PERCENT,
) -> DataFrame:
    """Clusters that spend more than ``threshold`` percent of stage time in flagged stages.

    The published score pairs every summary of a stage number with every stage of
    that number in the cluster.  The pairs are never built: for a stage number with
    ``n`` summaries, ``f`` of them flagged, and total duration ``d`` (``i`` of it
    incomplete), the pair sums are ``n * d`` and ``n * i + f * (d - i)``.
    ``corrected`` scores each application by its own stages instead, a summary with its own attempt.
    """
    scope = ["cluster_id", "application_id"] if corrected else ["cluster_id"]
    flagged = _flag(_raised(corrected) > 0)
    flags = stage_flags(task_summaries, corrected)
    if corrected:
        flags, times, key = _matched(flags, stages, scope, corrected)
    else:
        times, key = _stage_times(stages, scope, corrected), [*scope, "stage_id"]
    summaries = flags.groupBy(*key, "cluster_name").agg(F.count(F.lit(1)).alias("n"), F.sum(flagged).alias("f"))
    times = times.groupBy(*key).agg(
        F.sum("duration").alias("d"),
        F.sum(F.when(F.col("incomplete") == 1, F.col("duration")).otherwise(0)).alias("i"),
    )
    n, f, d, i = F.col("n"), F.col("f"), F.col("d"), F.col("i")
    score = (
        summaries.join(times, key)
        .groupBy(*scope, "cluster_name")
        .agg((F.try_divide(F.sum(n * i + f * (d - i)), F.sum(n * d)) * 100).alias("ineffstageagg"))
        .where(F.col("ineffstageagg") > threshold)
    )
    starts = applications.select("cluster_id", "application_id", "start_time")
    joined = balanced_join(starts, score, scope, "inner")
    return joined if corrected else joined.drop("application_id")
