"""Job, stage and task-summary tables of event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.operators import events as ev
from emberscope.operators.keyed import counts_before, running_totals
from emberscope.operators.quantiles import LOG_PROBES, group_quantiles
from emberscope.runtime import stored
from emberscope.schemas import TASK_METRICS
from emberscope.sources.eventlog import order_chunk

STAGE = ["application_id", "stage_id"]
ATTEMPT = ["application_id", "stage_id", "attempt_id"]
#: The same keys as they are best sorted: by numbers that tell rows apart, then by text that few rows differ in.
STAGE_SORT, ATTEMPT_SORT, JOB_SORT = ["stage_id", "application_id"], ["stage_id", "attempt_id", "application_id"], ["job_id", "application_id"]


def stages(events: DataFrame, rows: DataFrame | None = None, attempts: DataFrame | None = None) -> DataFrame:
    """Stage attempts with the tasks that had ended when the attempt completed.

    ``rows``: the stored submissions and completions (``events.stage_rows``), ``attempts``: what they merge to, if at hand.
    """
    if attempts is None:
        attempts = stored(ev.merged_attempts(ev.stage_rows(events) if rows is None else rows))
    ends = attempts.where(F.col("completed_order").isNotNull())
    outcome = F.col("outcome")
    counts = counts_before(
        ev.task_outcomes(events), ATTEMPT_SORT, "task_order", ends, "completed_order",
        {"num_completed_tasks": outcome == "completed", "num_failed_tasks": outcome == "failed"},
    )
    joined = attempts.join(counts, ATTEMPT_SORT, "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("num_completed_tasks", "num_failed_tasks")}
    )


def outcome_counts(events: DataFrame) -> DataFrame:
    """Completed, failed and killed tasks per stage attempt over the whole log."""
    outcome = F.col("outcome")
    return ev.task_outcomes(events).groupBy(*ATTEMPT).agg(
        *[F.count_if(outcome == o).alias(o) for o in ("completed", "failed", "killed")]
    )


def task_summaries(events: DataFrame, metrics: Sequence[str] = tuple(TASK_METRICS)) -> DataFrame:
    """Quantile vectors of the successful tasks of each stage attempt."""
    return group_quantiles(stored(ev.task_metrics(events).select(*ATTEMPT, *metrics)), ATTEMPT, metrics, LOG_PROBES)


def stage_references(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Job to stage relation with start and end position of the job."""
    closing = ends.select("application_id", "job_id", "end_order")
    known = starts.join(closing, JOB_SORT, "left")
    return ev.job_stages(known, "end_order")


def job_states(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Jobs with their end; open jobs have an empty status."""
    joined = starts.join(ends, JOB_SORT, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit(""))).withColumn("completion_ms", F.coalesce("completion_ms", F.lit(0)))


def summarised_attempts(events: DataFrame) -> DataFrame:
    """Stage attempts that have task summaries: those with a successful task."""
    return ev.task_outcomes(events).where("outcome = 'completed'").select(*ATTEMPT).distinct()


#: What the first attempt of a stage adds to the timeline of the stage.
_FIRST = ("first_tasks", "first_done", "first_failed", "first_completed_tasks", "first_failed_tasks")


def references_at_end(references: DataFrame, submissions: DataFrame, stage_table: DataFrame) -> DataFrame:
    """For every ended job and stage: what was known about the stage when the job ended.

    ``started`` and ``closed`` count jobs that refer to the stage, ``last_submit`` is
    the latest submission so far, the ``first_*`` columns describe the stage's first
    attempt once it exists.  All are running values over the stage's own timeline,
    so jobs that share a stage are never paired and nothing is joined to them.
    """
    first = stage_table.groupBy(*STAGE_SORT).agg(
        F.min("created_order").alias("position"),
        F.min_by(
            F.struct("completed_order", "status", "num_tasks", "num_completed_tasks", "num_failed_tasks"), "created_order"
        ).alias("a"),
    )
    columns = {
        "opens": "bigint", "closes": "bigint", "submit": "bigint", "job_id": "bigint", "start_order": "bigint", "job_stage_tasks": "bigint",
        "first_tasks": "double", "first_done": "bigint", "first_failed": "int", "first_completed_tasks": "double", "first_failed_tasks": "double",
    }

    def moment(frame, position, **known):
        values = {n: known.get(n, F.lit(None)) for n in columns}
        return frame.select(
            *STAGE, F.col(position).alias("position"), *[v.cast(columns[n]).alias(n) for n, v in values.items()]
        )

    ended = references.where(F.col("end_order").isNotNull())
    timeline = (
        moment(references, "start_order", opens=F.lit(1))
        .unionByName(moment(ended, "end_order", closes=F.lit(1), job_id=F.col("job_id"), start_order=F.col("start_order"), job_stage_tasks=F.col("num_tasks")))
        .unionByName(moment(submissions, "event_order", submit=F.col("event_order")))
        .unionByName(
            moment(
                first, "position", first_tasks=F.col("a.num_tasks"), first_done=F.col("a.completed_order"),
                first_failed=(F.col("a.status") == "FAILED").cast("int"),
                first_completed_tasks=F.col("a.num_completed_tasks"), first_failed_tasks=F.col("a.num_failed_tasks"),
            )
        )
        .withColumn("chunk", order_chunk(F.col("position")))
    )
    running = running_totals(
        timeline, STAGE_SORT, "chunk", "position",
        sums={"started": "opens", "closed": "closes"},
        maxes={"last_submit": "submit", **{f"known_{c}": c for c in _FIRST}},
    )
    return running.where(F.col("job_id").isNotNull()).drop("opens", "closes", "submit", "chunk", *_FIRST)


def job_accounting(at_end: DataFrame) -> DataFrame:
    """Completed, failed and skipped stages and tasks per ended job.

    A stage that was submitted while the job was open counts by its first attempt.
    One that was never submitted is skipped if no other job refers to it or another
    referring job is still open.
    """
    done = F.col("known_first_done") < F.col("position")
    ran = F.coalesce((F.col("last_submit") > F.col("start_order")) & done, F.lit(False))
    never = F.col("last_submit").isNull()
    # the job itself has just been closed, what remains open are others
    skipped = never & ((F.col("started") <= 1) | (F.col("started") > F.col("closed")))
    failed = ran & (F.col("known_first_failed") == 1)
    completed = ran & (F.col("known_first_failed") == 0)
    announced = F.coalesce("known_first_tasks", F.col("job_stage_tasks").cast("double"))

    def total(condition, value):
        return F.sum(F.when(condition, value).otherwise(0.0))

    return at_end.groupBy(*JOB_SORT).agg(
        total(completed, 1.0).alias("num_completed_stages"),
        total(failed, 1.0).alias("num_failed_stages"),
        total(skipped, 1.0).alias("num_skipped_stages"),
        total(ran, F.col("known_first_completed_tasks")).alias("num_completed_tasks"),
        total(ran, F.col("known_first_failed_tasks")).alias("num_failed_tasks"),
        F.greatest(F.lit(0.0), total(skipped, announced)).alias("num_skipped_tasks"),
    )


ACCOUNTED = (
    "num_completed_stages", "num_failed_stages", "num_skipped_stages",
    "num_completed_tasks", "num_failed_tasks", "num_skipped_tasks",
)


def jobs(events: DataFrame, stage_table: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Job table with stage and task accounting; open jobs have an empty status.

    Each kind of event is parsed once and stored in the columns that are used.
    """
    rows = stored(ev.stage_rows(events)) if rows is None else rows
    stage_table = stored(stages(events, rows)) if stage_table is None else stage_table
    starts, ends = stored(ev.job_starts(events)), stored(ev.job_ends(events))
    at_end = references_at_end(stage_references(starts, ends), rows.where("not completed"), stage_table)
    joined = job_states(starts, ends).join(job_accounting(at_end), JOB_SORT, "left")
    return (
        joined.withColumn("stage_ids", F.transform("stage_infos", lambda s: s.stage_id))
        .fillna(0.0, list(ACCOUNTED))
        .drop("stage_infos", "start_order", "end_order")
    )
