"""Tuning rules: metric frames in, recommendation rows out.

Application-wide rules are one map-side-combined ``groupBy`` each; stage and node
rules are row-wise.  Several rules over the same frame are emitted in one pass.
All frames carry the ``keys`` columns that name an application.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.functions.arrays import HIGH, LOW, LOWER_QUARTILE, MEDIAN, UPPER_QUARTILE, point
from emberscope.functions.text import fixed
from emberscope.plans import texts
from emberscope.runtime import reliable_checkpoint

APP = ("cluster_id", "application_id")

GIB = 1024**3
MIB = 1024**2
PARTITION_LIMIT = 512 * MIB
SLOW_RATE = 1.0
LONG_SQL_SECONDS = 300

FIELDS = ("rule_no", "subject", "category", "severity", "title", "description",
          "current_value", "recommended_action", "config_suggestion")


@dataclass
class Rule:
    """One conditional recommendation over the columns of a frame."""

    number: int
    when: Column
    category: str
    severity: Column | str
    title: Column | str
    description: Column
    current: Column | str
    action: str
    config: str | None = None
    subject: Column | None = None

    def row(self) -> Column:
        def text(value):
            return value if isinstance(value, Column) else F.lit(value).cast("string")

        subject = F.lit(None) if self.subject is None else self.subject
        return F.when(
            self.when,
            F.struct(
                F.lit(self.number).alias("rule_no"),
                subject.cast("bigint").alias("subject"),
                text(self.category).alias("category"),
                text(self.severity).alias("severity"),
                text(self.title).alias("title"),
                text(self.description).alias("description"),
                text(self.current).alias("current_value"),
                text(self.action).alias("recommended_action"),
                text(self.config).alias("config_suggestion"),
            ),
        )


def emit(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """Evaluate all rules on every row in one pass."""
    fired = F.filter(F.array(*[r.row() for r in rules]), lambda r: r.isNotNull())
    return df.select(*keys, F.inline(fired))


def _say(template: str, *values: Column) -> Column:
    """Fill ``{}`` slots with already rendered columns."""
    parts = template.split("{}")
    pieces = []
    for i, literal in enumerate(parts):
        if literal:
            pieces.append(F.lit(literal))
        if i < len(values):
            pieces.append(values[i].cast("string"))
    return F.concat(*pieces)


def _grade(ratio: Column, high_above: float, otherwise: str = "medium") -> Column:
    return F.when(ratio > high_above, "high").otherwise(otherwise)


def job_rules(jobs: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Failed jobs; a job without an end counts as failed."""
    totals = jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("status").eqNullSafe("JobSucceeded")).alias("failed"),
    )
    failed, total = F.col("failed"), F.col("total")
    rate = failed / total * 100
    return emit(totals, keys, [
        Rule(1, failed > 0, "Job Reliability", _grade(rate, 10), "Job Failures Detected",
             _say("{} out of {} jobs failed ({}% failure rate).", failed, total, fixed(rate, 1)),
             _say("{} failed jobs", failed), texts.REVIEW_JOBS),
    ])


def stage_total_rules(stages: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Rules on application-wide stage totals: failures, retries, spill, shuffle, parallelism."""
    totals = stages.groupBy(*keys).agg(
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("attempt_id").cast("bigint") > 0).alias("retried"),
        F.sum(F.coalesce("memory_bytes_spilled", F.lit(0))).cast("double").alias("memory_spill"),
        F.sum(F.coalesce("disk_bytes_spilled", F.lit(0))).cast("double").alias("disk_spill"),
        F.sum(F.coalesce("shuffle_read_bytes", F.lit(0))).cast("double").alias("read"),
        F.sum(F.coalesce("shuffle_write_bytes", F.lit(0))).cast("double").alias("written"),
        F.min("num_tasks").alias("fewest"),
        F.max("num_tasks").alias("most"),
        F.avg("num_tasks").alias("mean"),
    )
    failed, retried = F.col("failed"), F.col("retried")
    memory, disk = F.col("memory_spill"), F.col("disk_spill")
    spill = (memory + disk) / GIB
    read, written = F.col("read"), F.col("written")
    shuffle = (read + written) / GIB
    fewest, most = F.col("fewest"), F.col("most")
    return emit(totals, keys, [
        Rule(2, failed > 0, "Stage Reliability", "high", "Stage Failures Detected",
             _say("{} stages failed during execution.", failed), _say("{} failed stages", failed), texts.REVIEW_STAGES),
        Rule(3, retried > 0, "Stage Reliability", "medium", "Stage Retries Detected",
             _say("{} stages required retry attempts.", retried), _say("{} retried stages", retried),
             texts.REVIEW_RETRIES, texts.SPECULATION),
        Rule(5, (memory > 0) | (disk > 0), "Memory Management",
             F.when(spill > 10, "high").when(spill > 1, "medium").otherwise("low"), "Data Spill Detected",
             _say("Total spill: {} GB (Memory: {} GB, Disk: {} GB).", fixed(spill, 2), fixed(memory / GIB, 2), fixed(disk / GIB, 2)),
             _say("{} GB spilled", fixed(spill, 2)), texts.AVOID_SPILL, texts.SPILL_CONFIG),
        Rule(6, shuffle > 100, "Shuffle Optimization", "high", "Large Shuffle Volume",
             _say("Total shuffle data: {} GB (Read: {} GB, Write: {} GB).", fixed(shuffle, 1), fixed(read / GIB, 1), fixed(written / GIB, 1)),
             _say("{} GB shuffle", fixed(shuffle, 1)), texts.REDUCE_SHUFFLE, texts.ADAPTIVE_COALESCE),
        Rule(6, (shuffle > 10) & (shuffle <= 100), "Shuffle Optimization", "info", "Moderate Shuffle Volume",
             _say("Total shuffle data: {} GB.", fixed(shuffle, 1)), _say("{} GB shuffle", fixed(shuffle, 1)),
             texts.MONITOR_SHUFFLE, texts.ADAPTIVE),
        Rule(10, most > 10000, "Parallelism", "medium", "Very High Task Count",
             _say("Maximum task count: {}. This may cause scheduler overhead.", fixed(most, 1)),
             _say("Max: {}, Avg: {}", fixed(most, 1), fixed(F.col("mean"), 0)),
             texts.FEWER_PARTITIONS, texts.FEWER_PARTITIONS_CONFIG),
        Rule(11, (fewest < 10) & (most > 1000), "Parallelism", "low", "Variable Parallelism",
             _say("Task counts vary significantly (min: {}, max: {}).", fixed(fewest, 1), fixed(most, 1)),
             _say("Range: {} - {}", fixed(fewest, 1), fixed(most, 1)), texts.DYNAMIC_PARTITIONS, texts.ADAPTIVE_COALESCE),
    ])


def stage_task_rules(stages: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Stages in which more than 5 % of the tasks failed."""
    failed, tasks = F.col("num_failed_tasks"), F.col("num_tasks")
    rate = failed / tasks * 100
    fires = (tasks > 0) & (failed > 0) & (F.try_divide(failed, tasks) * 100 > 5)
    return emit(stages.where(fires), keys, [
        Rule(4, F.lit(True), "Task Reliability", _grade(rate, 20),
             _say("High Task Failure Rate in Stage {}", F.col("stage_id")),
             _say("{}/{} tasks failed ({}%).", fixed(failed, 1), fixed(tasks, 1), fixed(rate, 1)),
             _say("{}% failure rate", fixed(rate, 1)), texts.REVIEW_TASKS, texts.TASK_RETRIES, F.col("stage_id")),
    ])


def join_skew_rules(node_metrics: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Join nodes whose skew indicator is raised (one row per node metric comes in)."""
    joins = F.col("node_name").contains("SortMergeJoin") | F.col("node_name").contains("ShuffledHashJoin")
    raised = (F.col("metric_name") == "Cancellation Is Skewed") & (F.col("metric_value") != "0")
    return emit(node_metrics.where(joins & raised), keys, [
        Rule(7, F.lit(True), "Data Skew", "high", _say("Join Skew Detected in SQL {}", F.col("sql_id")),
             _say("Skew detected in {} (Node {}).", F.col("node_name"), F.col("node_id")),
             "Skewed join detected", texts.SALT_JOIN, texts.SKEW_JOIN, F.col("sql_id")),
    ])


def sql_rules(executions: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Failed executions, and executions of more than five minutes."""
    broken = F.col("status") == "FAILED"
    seconds = F.coalesce("duration_ms", F.lit(0)) / 1000
    slow = ~broken & (seconds > LONG_SQL_SECONDS)
    totals = executions.groupBy(*keys).agg(
        F.count_if(broken).alias("failed"),
        F.count_if(slow).alias("slow"),
        F.avg(F.when(slow, seconds)).alias("mean"),
    )
    failed, slow_n, mean = F.col("failed"), F.col("slow"), F.col("mean")
    return emit(totals, keys, [
        Rule(8, failed > 0, "SQL Reliability", "high", "Failed SQL Queries",
             _say("{} SQL queries failed.", failed), _say("{} failed queries", failed), texts.REVIEW_SQL),
        Rule(9, slow_n > 0, "SQL Performance", "medium", "Long Running Queries",
             _say("{} queries took over 5 minutes (avg: {}s).", slow_n, fixed(mean, 0)),
             _say("Avg duration: {}s", fixed(mean, 0)), texts.REVIEW_PLANS),
    ])


def summary_rules(summaries: DataFrame, keys: Sequence[str] = APP, corrected: bool = False) -> DataFrame:
    """Duration skew, stragglers, partition sizes and processing rate from quantile vectors.

    ``corrected`` tests the upper quartile of input sizes before the 95th
    percentile, which otherwise always hides it.
    """
    stage, attempt, n = F.col("stage_id"), F.col("attempt_id"), F.col("num_tasks")
    p5, p25, p50, p75, p95 = (point(F.col("duration"), i) for i in (LOW, LOWER_QUARTILE, MEDIAN, UPPER_QUARTILE, HIGH))
    in50, in75, in95 = (point(F.col("input_bytes"), i) for i in (MEDIAN, UPPER_QUARTILE, HIGH))
    sh50, sh95 = (point(F.col("shuffle_read_bytes"), i) for i in (MEDIAN, HIGH))
    where = "Stage {} (attempt {}, {} tasks): "

    input_large, input_wide = in95 > PARTITION_LIMIT, in75 > PARTITION_LIMIT
    if corrected:
        input_large = input_large & ~input_wide
    else:
        input_wide = input_wide & ~input_large

    volume = F.when(in50 > 0, in50).when(sh50 > 0, sh50)
    origin = F.when(in50 > 0, "input").otherwise("shuffle read")
    volume_mb, seconds = volume / MIB, p50 / 1000.0
    rate = F.try_divide(volume_mb, seconds)

    return emit(summaries, keys, [
        Rule(12, (n >= 10) & (p5 > 0) & (p50 > 2 * p5), "Task Duration Skew", _grade(F.try_divide(p50, p5), 10),
             _say("Task Duration Skew (Median vs Min) in Stage {}", stage),
             _say(where + "Median task duration ({}ms) is {}x the p5 duration ({}ms). "
                  "Distribution: p5={}ms, p25={}ms, p50={}ms, p75={}ms, p95={}ms.",
                  stage, attempt, n, fixed(p50, 0), fixed(F.try_divide(p50, p5), 1), fixed(p5, 0),
                  fixed(p5, 0), fixed(p25, 0), fixed(p50, 0), fixed(p75, 0), fixed(p95, 0)),
             _say("Median/Min ratio: {}x", fixed(F.try_divide(p50, p5), 1)), texts.EVEN_KEYS, texts.SKEW_JOIN_256M, stage),
        Rule(13, (n >= 10) & (p50 > 0) & (p95 > 2 * p50), "Task Duration Skew", _grade(F.try_divide(p95, p50), 5),
             _say("Straggler Tasks (Tail Skew) in Stage {}", stage),
             _say(where + "p95 task duration ({}ms) is {}x the median ({}ms). "
                  "The slowest tasks are significantly lagging behind the majority.",
                  stage, attempt, n, fixed(p95, 0), fixed(F.try_divide(p95, p50), 1), fixed(p50, 0)),
             _say("p95/Median ratio: {}x", fixed(F.try_divide(p95, p50), 1)), texts.TAIL_TASKS, texts.TAIL_CONFIG, stage),
        Rule(14, (n >= 2) & input_large, "Partition Sizing", _grade(in95, GIB),
             _say("Excessive Input Partition Size in Stage {}", stage),
             _say(where + "p95 input size per task is {} MB (median: {} MB). "
                  "Partitions exceeding 512 MB can cause GC pressure, spill, and OOM risks.",
                  stage, attempt, n, fixed(in95 / MIB, 0), fixed(in50 / MIB, 0)),
             _say("p95 input: {} MB/task", fixed(in95 / MIB, 0)), texts.MORE_PARTITIONS, texts.MORE_PARTITIONS_CONFIG, stage),
        Rule(15, (n >= 2) & input_wide, "Partition Sizing", "medium", _say("Large Input Partitions in Stage {}", stage),
             _say("Stage {}: p75 input size per task is {} MB. "
                  "A significant portion of tasks are processing partitions near or above 512 MB.", stage, fixed(in75 / MIB, 0)),
             _say("p75 input: {} MB/task", fixed(in75 / MIB, 0)), texts.SMALLER_INPUT, texts.SMALLER_INPUT_CONFIG, stage),
        Rule(16, (n >= 2) & (sh95 > PARTITION_LIMIT), "Partition Sizing", _grade(sh95, GIB),
             _say("Excessive Shuffle Partition Size in Stage {}", stage),
             _say(where + "p95 shuffle read per task is {} MB (median: {} MB). "
                  "Large shuffle partitions indicate skewed keys or insufficient partition count.",
                  stage, attempt, n, fixed(sh95 / MIB, 0), fixed(sh50 / MIB, 0)),
             _say("p95 shuffle read: {} MB/task", fixed(sh95 / MIB, 0)), texts.SMALLER_SHUFFLE, texts.SMALLER_SHUFFLE_CONFIG, stage),
        Rule(17, (n >= 50) & (p50 >= 1000) & (volume > 0) & (rate < SLOW_RATE), "Processing Rate",
             F.when(rate < 0.1, "high").otherwise("medium"), _say("Low Processing Rate in Stage {}", stage),
             _say(where + "Median processing rate is {} MB/s ({}: {} MB median / {}s median duration). Expected minimum: 1.0 MB/s.",
                  stage, attempt, n, fixed(rate, 3), origin, fixed(volume_mb, 1), fixed(seconds, 1)),
             _say("{} MB/s", fixed(rate, 3)), texts.SLOW_TASKS, texts.SLOW_TASKS_CONFIG, stage),
    ])


def recommend(
    keys: Sequence[str] = APP,
    jobs: DataFrame | None = None,
    stages: DataFrame | None = None,
    executions: DataFrame | None = None,
    node_metrics: DataFrame | None = None,
    summaries: DataFrame | None = None,
    corrected: bool = False,
) -> DataFrame:
    """Run every rule whose input is given and return all recommendation rows."""
    parts = []
    if jobs is not None:
        parts.append(job_rules(jobs, keys))
    if stages is not None:
        parts += [stage_total_rules(stages, keys), stage_task_rules(stages, keys)]
    if node_metrics is not None:
        parts.append(join_skew_rules(node_metrics, keys))
    if executions is not None:
        parts.append(sql_rules(executions, keys))
    if summaries is not None:
        parts.append(summary_rules(summaries, keys, corrected))
    if not parts:
        raise ValueError("at least one metric frame is needed")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def severity_rank(column: str = "severity") -> Column:
    """Position of a severity in reports."""
    order = F.array(*[F.lit(s) for s in texts.SEVERITY_LABELS])
    return F.array_position(order, F.col(column)).cast("int")


def severity_counts(recommendations: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """One row per application: total and the four severities, zeros kept."""
    return recommendations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in texts.SEVERITY_LABELS],
    )


def category_counts(recommendations: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    return recommendations.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("recommendations"))


def high_priority(recommendations: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Title, description and action of the high ones."""
    return recommendations.where(F.col("severity") == "high").select(
        *keys, "title", "description", F.col("recommended_action").alias("action")
    )


def report_blocks(recommendations: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Markdown report as ordered blocks, one row per heading or recommendation.

    Text of an application is its blocks in ``(severity_rank, rule_no, subject)``
    order.  Blocks stay rows so an application with very many findings is never
    assembled inside one task; ``sinks.write_report`` writes them out in order.
    """
    recommendations = reliable_checkpoint(recommendations)  # read three times below
    none = F.lit(None)
    config = F.when(
        F.col("config_suggestion").isNotNull(),
        _say("\n**Suggested Config:**\n```\n{}\n```\n", F.col("config_suggestion")),
    ).otherwise("")
    findings = recommendations.select(
        *keys,
        severity_rank().alias("severity_rank"),
        "rule_no",
        "subject",
        F.concat(
            _say("### {}\n**Category:** {}\n**Current:** {}\n", F.col("title"), F.col("category"), F.col("current_value")),
            _say("\n{}\n\n**Recommendation:** {}\n", F.col("description"), F.col("recommended_action")),
            config,
        ).alias("block"),
    )
    labels = F.lit("")
    for rank, label in enumerate(texts.SEVERITY_LABELS.values(), start=1):
        labels = F.when(F.col("severity_rank") == rank, F.lit(f"\n## {label}\n")).otherwise(labels)
    headings = (
        findings.select(*keys, "severity_rank").distinct()
        .select(*keys, "severity_rank", F.lit(0).alias("rule_no"), none.cast("bigint").alias("subject"), labels.alias("block"))
    )
    titles = (
        recommendations.select(*keys).distinct()
        .select(*keys, F.lit(0).alias("severity_rank"), F.lit(0).alias("rule_no"),
                none.cast("bigint").alias("subject"), F.lit(texts.REPORT_TITLE).alias("block"))
    )
    return titles.unionByName(headings).unionByName(findings)


def clean_applications(applications: DataFrame, recommendations: DataFrame, keys: Sequence[str] = APP) -> DataFrame:
    """Applications for which no rule fired, with the fixed message."""
    return (
        applications.select(*keys).distinct()
        .join(recommendations.select(*keys).distinct(), list(keys), "left_anti")
        .withColumn("block", F.lit(texts.NOTHING_TO_TUNE))
    )
