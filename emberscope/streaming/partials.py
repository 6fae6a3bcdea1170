"""Incremental accounting: mergeable partial aggregates of each landed batch.

Every landed batch is read once, when it is new, and leaves three small tables: outcomes of its tasks per stage attempt,
states of its jobs, and quantile sketches of its task metrics.  Questions over all batches merge these tables and
read no event again.  A batch writes a folder of its own and overwrites it, so a run that failed half-way is simply
run again; the ledger of batches that are done is written last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.operators import events as ev
from emberscope.operators import sketches
from emberscope.operators.accounting import ATTEMPT
from emberscope.operators.quantiles import LOG_PROBES
from emberscope.runtime import stored
from emberscope.sources.eventlog import read_landed

#: Task metrics that are sketched.
METRICS = ("duration", "jvm_gc_time", "memory_bytes_spilled", "disk_bytes_spilled", "input_bytes", "shuffle_read_bytes", "shuffle_write_bytes")
_TABLES = ("outcomes", "jobs", "sketches")
_DONE = "batch STRING, lines BIGINT"


def batches(spark: SparkSession, landed: str) -> list[str]:
    """Names of the landed batches, from the folder listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{landed.rstrip('/')}/batch=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().getName() for x in found or [])


def done_batches(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, lines)``: batches whose partial aggregates are written, with the events that were read for them."""
    try:
        return spark.read.schema(_DONE).parquet(f"{folder.rstrip('/')}/done")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DONE)


def update(spark: SparkSession, landed: str, folder: str, metrics: Sequence[str] = METRICS) -> int:
    """Aggregate the batches that are new since the last run; returns how many there were."""
    folder = folder.rstrip("/")
    known = {r.batch for r in done_batches(spark, folder).select("batch").collect()}  # one row a run
    new = [x for x in batches(spark, landed) if x not in known]
    for batch in new:
        events = read_landed(spark, f"{landed.rstrip('/')}/{batch}")
        outcome = F.col("outcome")
        outcomes = ev.task_outcomes(events).groupBy(*ATTEMPT).agg(*[F.count_if(outcome == o).alias(o) for o in ("completed", "failed", "killed")])
        ends = ev.job_ends(events).groupBy("application_id", "status").agg(F.count(F.lit(1)).alias("jobs"))
        tasks = stored(ev.task_metrics(events).select(*ATTEMPT, *metrics))
        parts = {"outcomes": outcomes, "jobs": ends, "sketches": sketches.metric_sketches(tasks, ATTEMPT, metrics)}
        for name in _TABLES:
            parts[name].write.mode("overwrite").parquet(f"{folder}/{name}/{batch}")
        spark.createDataFrame([(batch, events.count())], _DONE).coalesce(1).write.mode("append").parquet(f"{folder}/done")
    return len(new)


def _parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of one table that belong to batches that are done."""
    rows = spark.read.option("basePath", f"{folder.rstrip('/')}/{name}").parquet(f"{folder.rstrip('/')}/{name}")
    done = done_batches(spark, folder).select(F.regexp_replace("batch", "^batch=", "").alias("batch")).distinct()
    return rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(done), "batch", "left_semi").drop("batch")


def outcome_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Completed, failed and killed tasks per stage attempt over all batches (as ``accounting.outcome_counts``)."""
    return _parts(spark, folder, "outcomes").groupBy(*ATTEMPT).agg(*[F.sum(c).alias(c) for c in ("completed", "failed", "killed")])


def job_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Ended jobs per application and status over all batches."""
    return _parts(spark, folder, "jobs").groupBy("application_id", "status").agg(F.sum("jobs").alias("jobs"))


def metric_quantiles(spark: SparkSession, folder: str, keys: Sequence[str] = ATTEMPT, probes: Sequence[float] = LOG_PROBES) -> DataFrame:
    """Quantiles with the stated rank error of ``sketches``, per key (or any part of it) and metric over all batches."""
    return sketches.sketch_quantiles(sketches.merged(_parts(spark, folder, "sketches"), list(keys)), probes)
