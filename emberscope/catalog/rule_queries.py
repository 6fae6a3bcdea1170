"""Quantile, recommendation and issue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.catalog.registry import CHECKS, Data, query
from emberscope.operators import history
from emberscope.operators.quantiles import LOG_PROBES, SERVER_PROBES, group_quantiles
from emberscope.plans import advisor, issues, texts

STAGE = ["cluster_id", "application_id", "stage_id"]
ATTEMPT = "case when application_id % 5 = 1 and stage_id = 3 then 1 else 0 end"
APPLICATION = ["application_id"]


def successful_tasks(data: Data):
    return data("tel_tasks").where("status = 'SUCCESS'").withColumn("attempt_id", F.expr(ATTEMPT)).withColumnRenamed("duration_ms", "duration")


def log_summaries(data: Data, metrics=("duration", "input_bytes", "shuffle_read_bytes")):
    """Per-stage quantile vectors of the successful tasks."""
    return group_quantiles(successful_tasks(data), [*STAGE, "attempt_id"], metrics, LOG_PROBES)


def server_summaries(data: Data):
    tasks = data("tel_tasks").where("status = 'SUCCESS'").withColumnsRenamed(
        {"duration_ms": "run_time", "gc_ms": "gc_time", "memory_bytes_spilled": "memory_spill", "disk_bytes_spilled": "disk_spill"}
    )
    return group_quantiles(tasks, STAGE, ("run_time", "gc_time", "memory_spill", "disk_spill"), SERVER_PROBES)


RECOMMENDATION = ("rule_no", "subject", "category", "severity", "title", "description", "current_value")


def rules(df, numbers, keys=advisor.APP):
    return df.where(F.col("rule_no").isin(*numbers)).select(*keys, *RECOMMENDATION)


QUANTILES = f"""
q as (select cluster_id, application_id, stage_id, {ATTEMPT} as attempt_id, count(*) as n,
  quantile_cont(duration_ms, [0.05, 0.25, 0.5, 0.75, 0.95]) as d, quantile_cont(input_bytes, [0.05, 0.25, 0.5, 0.75, 0.95]) as i,
  quantile_cont(shuffle_read_bytes, [0.05, 0.25, 0.5, 0.75, 0.95]) as s
  from tel_tasks where status = 'SUCCESS' group by cluster_id, application_id, stage_id)"""
WHERE = "'Stage ' || stage_id || ' (attempt ' || attempt_id || ', ' || n || ' tasks): '"


@query(
    "task_summary_quantiles",
    f"""with {QUANTILES}
select cluster_id, application_id, stage_id, cast(attempt_id as integer) as attempt_id, n as num_tasks,
 round(d[1], 4) as duration_p5, round(d[2], 4) as duration_p25, round(d[3], 4) as duration_p50, round(d[4], 4) as duration_p75, round(d[5], 4) as duration_p95,
 round(i[1], 4) as input_p5, round(i[3], 4) as input_p50, round(i[5], 4) as input_p95,
 round(s[1], 4) as shuffle_p5, round(s[3], 4) as shuffle_p50, round(s[5], 4) as shuffle_p95 from q""",
)
def task_summary_quantiles(data):
    def at(metric, index, name):
        return F.round(F.get(metric, index), 4).alias(name)

    return log_summaries(data).select(
        *STAGE, "attempt_id", "num_tasks",
        *[at("duration", i, f"duration_p{p}") for i, p in enumerate((5, 25, 50, 75, 95))],
        *[at("input_bytes", i, f"input_p{p}") for i, p in ((0, 5), (2, 50), (4, 95))],
        *[at("shuffle_read_bytes", i, f"shuffle_p{p}") for i, p in ((0, 5), (2, 50), (4, 95))],
    )


@query(
    "task_summary_by_metric",
    """with long as (
 select cluster_id, 'duration' as metric, duration_ms as v from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'gc_ms', gc_ms from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'input_bytes', input_bytes from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'shuffle_read_bytes', shuffle_read_bytes from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'memory_bytes_spilled', memory_bytes_spilled from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'disk_bytes_spilled', disk_bytes_spilled from tel_tasks where status = 'SUCCESS')
select cluster_id, metric, count(*) as num_tasks, cast(min(v) as double) as low, round(quantile_cont(v, 0.25), 4) as lower_quartile,
 round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.75), 4) as upper_quartile, cast(max(v) as double) as high
from long group by cluster_id, metric""",
)
def task_summary_by_metric(data):
    metrics = ("duration", "gc_ms", "input_bytes", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")
    # a cluster holds far more tasks than a stage: rank its values across tasks when it is hot
    wide = group_quantiles(successful_tasks(data), ["cluster_id"], metrics, SERVER_PROBES)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    names = ("low", "lower_quartile", "median", "upper_quartile", "high")
    return wide.select("cluster_id", "num_tasks", F.inline(rows)).select(
        "cluster_id", "metric", "num_tasks", *[F.round(F.get("v", i), 4).alias(n) for i, n in enumerate(names)]
    )


SKEW_ROW = f"""12 as rule_no, stage_id as subject, 'Task Duration Skew' as category,
 case when d[3] / d[1] > 10 then 'high' else 'medium' end as severity,
 'Task Duration Skew (Median vs Min) in Stage ' || stage_id as title,
 {WHERE} || 'Median task duration (' || printf('%.0f', d[3]) || 'ms) is ' || printf('%.1f', d[3] / d[1]) || 'x the p5 duration ('
  || printf('%.0f', d[1]) || 'ms). Distribution: p5=' || printf('%.0f', d[1]) || 'ms, p25=' || printf('%.0f', d[2]) || 'ms, p50='
  || printf('%.0f', d[3]) || 'ms, p75=' || printf('%.0f', d[4]) || 'ms, p95=' || printf('%.0f', d[5]) || 'ms.' as description,
 'Median/Min ratio: ' || printf('%.1f', d[3] / d[1]) || 'x' as current_value
from q where n >= 10 and d[1] > 0 and d[3] > 2 * d[1]"""


@query(
    "task_duration_skew",
    f"""with {QUANTILES}
select cluster_id, application_id, {SKEW_ROW}""",
)
def task_duration_skew(data):
    return rules(advisor.summary_rules(log_summaries(data)), [12])


STRAGGLER_ROW = f"""13 as rule_no, stage_id as subject, 'Task Duration Skew' as category,
 case when d[5] / d[3] > 5 then 'high' else 'medium' end as severity,
 'Straggler Tasks (Tail Skew) in Stage ' || stage_id as title,
 {WHERE} || 'p95 task duration (' || printf('%.0f', d[5]) || 'ms) is ' || printf('%.1f', d[5] / d[3]) || 'x the median ('
  || printf('%.0f', d[3]) || 'ms). The slowest tasks are significantly lagging behind the majority.' as description,
 'p95/Median ratio: ' || printf('%.1f', d[5] / d[3]) || 'x' as current_value
from q where n >= 10 and d[3] > 0 and d[5] > 2 * d[3]"""


@query(
    "stragglers",
    f"""with {QUANTILES}
select cluster_id, application_id, {STRAGGLER_ROW}""",
)
def stragglers(data):
    return rules(advisor.summary_rules(log_summaries(data)), [13])


@query(
    "partition_size_input",
    f"""with {QUANTILES}
select cluster_id, application_id, 14 as rule_no, stage_id as subject, 'Partition Sizing' as category,
 case when i[5] > 1073741824 then 'high' else 'medium' end as severity,
 'Excessive Input Partition Size in Stage ' || stage_id as title,
 {WHERE} || 'p95 input size per task is ' || printf('%.0f', i[5] / 1048576) || ' MB (median: ' || printf('%.0f', i[3] / 1048576)
  || ' MB). Partitions exceeding 512 MB can cause GC pressure, spill, and OOM risks.' as description,
 'p95 input: ' || printf('%.0f', i[5] / 1048576) || ' MB/task' as current_value
from q where n >= 2 and i[5] > 536870912""",
)
def partition_size_input(data):
    return rules(advisor.summary_rules(log_summaries(data)), [14, 15])


@query(
    "partition_size_shuffle",
    f"""with {QUANTILES}
select cluster_id, application_id, 16 as rule_no, stage_id as subject, 'Partition Sizing' as category,
 case when s[5] > 1073741824 then 'high' else 'medium' end as severity,
 'Excessive Shuffle Partition Size in Stage ' || stage_id as title,
 {WHERE} || 'p95 shuffle read per task is ' || printf('%.0f', s[5] / 1048576) || ' MB (median: ' || printf('%.0f', s[3] / 1048576)
  || ' MB). Large shuffle partitions indicate skewed keys or insufficient partition count.' as description,
 'p95 shuffle read: ' || printf('%.0f', s[5] / 1048576) || ' MB/task' as current_value
from q where n >= 2 and s[5] > 536870912""",
)
def partition_size_shuffle(data):
    return rules(advisor.summary_rules(log_summaries(data)), [16])


@query(
    "processing_rate",
    f"""with {QUANTILES}, r as (select *, case when i[3] > 0 then i[3] else s[3] end / 1048576 as mb, d[3] / 1000.0 as sec,
  case when i[3] > 0 then 'input' else 'shuffle read' end as origin from q where n >= 50 and d[3] >= 1000 and (i[3] > 0 or s[3] > 0))
select cluster_id, application_id, 17 as rule_no, stage_id as subject, 'Processing Rate' as category,
 case when mb / sec < 0.1 then 'high' else 'medium' end as severity, 'Low Processing Rate in Stage ' || stage_id as title,
 {WHERE} || 'Median processing rate is ' || printf('%.3f', mb / sec) || ' MB/s (' || origin || ': ' || printf('%.1f', mb) || ' MB median / '
  || printf('%.1f', sec) || 's median duration). Expected minimum: 1.0 MB/s.' as description,
 printf('%.3f', mb / sec) || ' MB/s' as current_value
from r where mb / sec < 1""",
)
def processing_rate(data):
    return rules(advisor.summary_rules(log_summaries(data)), [17])


@query(
    "task_failure_rate",
    """select cluster_id, application_id, 4 as rule_no, stage_id as subject, 'Task Reliability' as category,
 case when num_failed_tasks / num_tasks * 100 > 20 then 'high' else 'medium' end as severity,
 'High Task Failure Rate in Stage ' || stage_id as title,
 printf('%.1f', num_failed_tasks::double) || '/' || printf('%.1f', num_tasks::double) || ' tasks failed (' || printf('%.1f', num_failed_tasks / num_tasks * 100) || '%).' as description,
 printf('%.1f', num_failed_tasks / num_tasks * 100) || '% failure rate' as current_value
from tel_stages where num_failed_tasks / num_tasks * 100 > 5""",
)
def task_failure_rate(data):
    return rules(advisor.stage_task_rules(data("tel_stages")), [4])


def stage_totals(data):
    return advisor.stage_total_rules(data("tel_stages").withColumn("shuffle_write_bytes", F.lit(0)))


@query(
    "spill_total",
    """with t as (select cluster_id, application_id, cast(sum(memory_bytes_spilled) as double) as m, cast(sum(disk_bytes_spilled) as double) as k
  from tel_stages group by cluster_id, application_id)
select cluster_id, application_id, 5 as rule_no, cast(null as bigint) as subject, 'Memory Management' as category,
 case when (m + k) / 1073741824 > 10 then 'high' when (m + k) / 1073741824 > 1 then 'medium' else 'low' end as severity,
 'Data Spill Detected' as title,
 'Total spill: ' || printf('%.2f', (m + k) / 1073741824) || ' GB (Memory: ' || printf('%.2f', m / 1073741824) || ' GB, Disk: ' || printf('%.2f', k / 1073741824) || ' GB).' as description,
 printf('%.2f', (m + k) / 1073741824) || ' GB spilled' as current_value
from t where m > 0 or k > 0""",
)
def spill_total(data):
    return rules(stage_totals(data), [5])


@query(
    "shuffle_volume",
    """with t as (select cluster_id, application_id, cast(sum(shuffle_read_bytes) as double) / 1073741824 as g from tel_stages group by cluster_id, application_id)
select cluster_id, application_id, 6 as rule_no, cast(null as bigint) as subject, 'Shuffle Optimization' as category,
 case when g > 100 then 'high' else 'info' end as severity,
 case when g > 100 then 'Large Shuffle Volume' else 'Moderate Shuffle Volume' end as title,
 'Total shuffle data: ' || printf('%.1f', g) || ' GB' || case when g > 100 then ' (Read: ' || printf('%.1f', g) || ' GB, Write: 0.0 GB).' else '.' end as description,
 printf('%.1f', g) || ' GB shuffle' as current_value
from t where g > 10""",
)
def shuffle_volume(data):
    return rules(stage_totals(data), [6])


@query(
    "parallelism",
    """with j as (select application_id, job_id % 50 as stage_id, cast(sum(num_tasks) as bigint) as num_tasks from tel_jobs group by application_id, job_id % 50),
s as (select application_id, min(num_tasks) as a, max(num_tasks) as b, avg(num_tasks) as m from (
  select application_id, num_tasks from j union all select application_id, stage_id from j) u group by application_id)
select application_id, 10 as rule_no, cast(null as bigint) as subject, 'Parallelism' as category, 'medium' as severity, 'Very High Task Count' as title,
 'Maximum task count: ' || printf('%.1f', b::double) || '. This may cause scheduler overhead.' as description,
 'Max: ' || printf('%.1f', b::double) || ', Avg: ' || printf('%.0f', m) as current_value from s where b > 10000
union all
select application_id, 11, cast(null as bigint), 'Parallelism', 'low', 'Variable Parallelism',
 'Task counts vary significantly (min: ' || printf('%.1f', a::double) || ', max: ' || printf('%.1f', b::double) || ').',
 'Range: ' || printf('%.1f', a::double) || ' - ' || printf('%.1f', b::double) from s where a < 10 and b > 1000""",
)
def parallelism(data):
    jobs = data("tel_jobs").groupBy("application_id", (F.col("job_id") % 50).alias("stage_id")).agg(F.sum("num_tasks").alias("num_tasks"))
    # wide and narrow stages of one application, from the task counts of its jobs
    narrow = jobs.select("application_id", "stage_id", F.col("stage_id").alias("num_tasks"))
    stages = jobs.unionByName(narrow).select(
        "*", F.lit(0).alias("attempt_id"), F.lit("COMPLETE").alias("status"), F.lit(0).alias("memory_bytes_spilled"),
        F.lit(0).alias("disk_bytes_spilled"), F.lit(0).alias("shuffle_read_bytes"), F.lit(0).alias("shuffle_write_bytes"),
    )
    return rules(advisor.stage_total_rules(stages, APPLICATION), [10, 11], APPLICATION)


@query(
    "job_failures",
    """with t as (select application_id, count(*) as n, sum(case when status <> 'JobSucceeded' then 1 else 0 end)::bigint as f from tel_jobs group by application_id)
select application_id, 1 as rule_no, cast(null as bigint) as subject, 'Job Reliability' as category,
 case when f / n * 100 > 10 then 'high' else 'medium' end as severity, 'Job Failures Detected' as title,
 f || ' out of ' || n || ' jobs failed (' || printf('%.1f', f / n * 100) || '% failure rate).' as description, f || ' failed jobs' as current_value
from t where f > 0""",
)
def job_failures(data):
    return rules(advisor.job_rules(data("tel_jobs"), APPLICATION), [1], APPLICATION)


@query(
    "stage_failures",
    """select cluster_id, application_id, 2 as rule_no, cast(null as bigint) as subject, 'Stage Reliability' as category, 'high' as severity,
 'Stage Failures Detected' as title, count(*) || ' stages failed during execution.' as description, count(*) || ' failed stages' as current_value
from tel_stages where status = 'FAILED' group by cluster_id, application_id""",
)
def stage_failures(data):
    return rules(stage_totals(data), [2])


@query(
    "stage_retries",
    """select cluster_id, application_id, 3 as rule_no, cast(null as bigint) as subject, 'Stage Reliability' as category, 'medium' as severity,
 'Stage Retries Detected' as title, count(*) || ' stages required retry attempts.' as description, count(*) || ' retried stages' as current_value
from tel_stages where attempt_id > 0 group by cluster_id, application_id""",
)
def stage_retries(data):
    return rules(stage_totals(data), [3])


@query(
    "failed_sql",
    """select application_id, 8 as rule_no, cast(null as bigint) as subject, 'SQL Reliability' as category, 'high' as severity,
 'Failed SQL Queries' as title, count(*) || ' SQL queries failed.' as description, count(*) || ' failed queries' as current_value
from tel_sql where status = 'FAILED' group by application_id""",
)
def failed_sql(data):
    return rules(advisor.sql_rules(data("tel_sql"), APPLICATION), [8], APPLICATION)


@query(
    "long_sql",
    """with t as (select application_id, count(*) as n, avg(duration_ms / 1000) as m from tel_sql
  where status <> 'FAILED' and duration_ms / 1000 > 300 group by application_id)
select application_id, 9 as rule_no, cast(null as bigint) as subject, 'SQL Performance' as category, 'medium' as severity,
 'Long Running Queries' as title, n || ' queries took over 5 minutes (avg: ' || printf('%.0f', m) || 's).' as description,
 'Avg duration: ' || printf('%.0f', m) || 's' as current_value from t""",
)
def long_sql(data):
    return rules(advisor.sql_rules(data("tel_sql"), APPLICATION), [9], APPLICATION)


def skew_metrics(data):
    return data("tel_sql_nodes").select(
        "application_id", "sql_id", "node_id", "node_name",
        F.lit("Cancellation Is Skewed").alias("metric_name"), F.col("skew_indicator").alias("metric_value"),
    )


@query(
    "join_skew_nodes",
    """select application_id, 7 as rule_no, sql_id as subject, 'Data Skew' as category, 'high' as severity, 'Join Skew Detected in SQL ' || sql_id as title,
 'Skew detected in ' || node_name || ' (Node ' || node_id || ').' as description, 'Skewed join detected' as current_value
from tel_sql_nodes where node_name in ('SortMergeJoin', 'ShuffledHashJoin') and skew_indicator <> '0'""",
)
def join_skew_nodes(data):
    return rules(advisor.join_skew_rules(skew_metrics(data), APPLICATION), [7], APPLICATION)


def all_recommendations(data):
    return advisor.recommend(
        stages=data("tel_stages").withColumn("shuffle_write_bytes", F.lit(0)), summaries=log_summaries(data)
    )


FIRED = f"""with {QUANTILES}, t as (select cluster_id, application_id, sum(case when status = 'FAILED' then 1 else 0 end) as f,
  sum(case when attempt_id > 0 then 1 else 0 end) as r, cast(sum(memory_bytes_spilled + disk_bytes_spilled) as double) / 1073741824 as p,
  cast(sum(shuffle_read_bytes) as double) / 1073741824 as g, min(num_tasks) as a, max(num_tasks) as b from tel_stages group by cluster_id, application_id),
fired as (
 select cluster_id, application_id, 'Stage Reliability' as category, 'high' as severity from t where f > 0
 union all select cluster_id, application_id, 'Stage Reliability', 'medium' from t where r > 0
 union all select cluster_id, application_id, 'Task Reliability', case when num_failed_tasks / num_tasks * 100 > 20 then 'high' else 'medium' end
   from tel_stages where num_failed_tasks / num_tasks * 100 > 5
 union all select cluster_id, application_id, 'Memory Management', case when p > 10 then 'high' when p > 1 then 'medium' else 'low' end from t where p > 0
 union all select cluster_id, application_id, 'Shuffle Optimization', case when g > 100 then 'high' else 'info' end from t where g > 10
 union all select cluster_id, application_id, 'Parallelism', 'medium' from t where b > 10000
 union all select cluster_id, application_id, 'Parallelism', 'low' from t where a < 10 and b > 1000
 union all select cluster_id, application_id, 'Task Duration Skew', case when d[3] / d[1] > 10 then 'high' else 'medium' end from q where n >= 10 and d[1] > 0 and d[3] > 2 * d[1]
 union all select cluster_id, application_id, 'Task Duration Skew', case when d[5] / d[3] > 5 then 'high' else 'medium' end from q where n >= 10 and d[3] > 0 and d[5] > 2 * d[3]
 union all select cluster_id, application_id, 'Partition Sizing', case when i[5] > 1073741824 then 'high' else 'medium' end from q where n >= 2 and i[5] > 536870912
 union all select cluster_id, application_id, 'Partition Sizing', case when s[5] > 1073741824 then 'high' else 'medium' end from q where n >= 2 and s[5] > 536870912
 union all select cluster_id, application_id, 'Processing Rate', case when v / 1048576 / (m / 1000.0) < 0.1 then 'high' else 'medium' end
   from (select *, d[3] as m, case when i[3] > 0 then i[3] else s[3] end as v from q) w where n >= 50 and m >= 1000 and v > 0 and v / 1048576 / (m / 1000.0) < 1)"""


@query(
    "recommendation_summary",
    FIRED + """select cluster_id, application_id, count(*) as total_recommendations, count(*) filter (where severity = 'high') as high,
 count(*) filter (where severity = 'medium') as medium, count(*) filter (where severity = 'low') as low, count(*) filter (where severity = 'info') as info
from fired group by cluster_id, application_id""",
)
def recommendation_summary(data):
    return advisor.severity_counts(all_recommendations(data))


@query(
    "recommendation_categories",
    FIRED + "select cluster_id, application_id, category, count(*) as recommendations from fired group by cluster_id, application_id, category",
)
def recommendation_categories(data):
    return advisor.category_counts(all_recommendations(data))


# Advice and suggested setting by rule; rule 6 goes by severity too.
ADVICE = (
    (1, None, texts.REVIEW_JOBS, None),
    (2, None, texts.REVIEW_STAGES, None),
    (3, None, texts.REVIEW_RETRIES, texts.SPECULATION),
    (4, None, texts.REVIEW_TASKS, texts.TASK_RETRIES),
    (5, None, texts.AVOID_SPILL, texts.SPILL_CONFIG),
    (6, "high", texts.REDUCE_SHUFFLE, texts.ADAPTIVE_COALESCE),
    (6, "info", texts.MONITOR_SHUFFLE, texts.ADAPTIVE),
    (7, None, texts.SALT_JOIN, texts.SKEW_JOIN),
    (8, None, texts.REVIEW_SQL, None),
    (9, None, texts.REVIEW_PLANS, None),
    (10, None, texts.FEWER_PARTITIONS, texts.FEWER_PARTITIONS_CONFIG),
    (11, None, texts.DYNAMIC_PARTITIONS, texts.ADAPTIVE_COALESCE),
    (12, None, texts.EVEN_KEYS, texts.SKEW_JOIN_256M),
    (13, None, texts.TAIL_TASKS, texts.TAIL_CONFIG),
    (14, None, texts.MORE_PARTITIONS, texts.MORE_PARTITIONS_CONFIG),
    (16, None, texts.SMALLER_SHUFFLE, texts.SMALLER_SHUFFLE_CONFIG),
    (17, None, texts.SLOW_TASKS, texts.SLOW_TASKS_CONFIG),
)


def _quoted(value) -> str:
    return "null" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


ADVICE_VALUES = ", ".join("(" + ", ".join(map(_quoted, row)) + ")" for row in ADVICE)
_LABELS = ", ".join(f"({rank}, {_quoted(name)}, {_quoted(label)})" for rank, (name, label) in enumerate(texts.SEVERITY_LABELS.items(), start=1))
_RULE_STATEMENTS = (
    "stage_failures", "stage_retries", "task_failure_rate", "spill_total", "shuffle_volume",
    "task_duration_skew", "stragglers", "partition_size_input", "partition_size_shuffle", "processing_rate",
)
_ROW = "cluster_id, application_id, rule_no, subject, category, severity, title, description, current_value"

#: The report from the statements of the single rules; rules 10 and 11 over the stages the other stage rules read.
REPORT = f"""with fired as ({" union all ".join(f"select {_ROW} from ({CHECKS[name]})" for name in _RULE_STATEMENTS)}
 union all select cluster_id, application_id, 10, null, 'Parallelism', 'medium', 'Very High Task Count',
  'Maximum task count: ' || printf('%.1f', max(num_tasks)::double) || '. This may cause scheduler overhead.',
  'Max: ' || printf('%.1f', max(num_tasks)::double) || ', Avg: ' || printf('%.0f', avg(num_tasks)) from tel_stages group by 1, 2 having max(num_tasks) > 10000
 union all select cluster_id, application_id, 11, null, 'Parallelism', 'low', 'Variable Parallelism',
  'Task counts vary significantly (min: ' || printf('%.1f', min(num_tasks)::double) || ', max: ' || printf('%.1f', max(num_tasks)::double) || ').',
  'Range: ' || printf('%.1f', min(num_tasks)::double) || ' - ' || printf('%.1f', max(num_tasks)::double)
  from tel_stages group by 1, 2 having min(num_tasks) < 10 and max(num_tasks) > 1000),
advice(rule, grade, action, config) as (values {ADVICE_VALUES}),
labels(place, grade, label) as (values {_LABELS}),
said as (select f.*, a.action, a.config, l.place, l.label from fired f join advice a on f.rule_no = a.rule and (a.grade is null or a.grade = f.severity) join labels l on l.grade = f.severity),
blocks as (
 select distinct cluster_id, application_id, 0 as severity_rank, 0 as rule_no, cast(null as bigint) as subject, {_quoted(texts.REPORT_TITLE)} as block from said
 union all select distinct cluster_id, application_id, place, 0, null, chr(10) || '## ' || label || chr(10) from said
 union all select cluster_id, application_id, place, rule_no, subject, '### ' || title || chr(10) || '**Category:** ' || category || chr(10) || '**Current:** ' || current_value || chr(10)
  || chr(10) || description || chr(10) || chr(10) || '**Recommendation:** ' || action || chr(10)
  || coalesce(chr(10) || '**Suggested Config:**' || chr(10) || '```' || chr(10) || config || chr(10) || '```' || chr(10), '') from said)
select cluster_id, application_id, cast(severity_rank as integer) as severity_rank, cast(rule_no as integer) as rule_no, subject, block from blocks"""


@query("recommendation_report", REPORT)
def recommendation_report(data):
    return advisor.report_blocks(all_recommendations(data)).orderBy(
        *advisor.APP, "severity_rank", "rule_no", F.col("subject").asc_nulls_first()
    )


def high_priority(data):
    return advisor.high_priority(all_recommendations(data))


query(
    "recommendation_high_priority",
    FIRED + "select cluster_id, application_id, count(*) as actions from fired where severity = 'high' group by cluster_id, application_id",
)(lambda data: high_priority(data).groupBy(*advisor.APP).agg(F.count("action").alias("actions")))


ISSUE_QUANTILES = """
q as (select cluster_id, application_id, stage_id, quantile_cont(duration_ms, 0.5) as mid, max(duration_ms)::double as top,
  quantile_cont(gc_ms, 0.5) as gc, max(memory_bytes_spilled)::double as mem, max(disk_bytes_spilled)::double as disk
  from tel_tasks where status = 'SUCCESS' group by cluster_id, application_id, stage_id),
j as (select q.*, t.num_tasks, r.records from q join tel_stages t using (cluster_id, application_id, stage_id)
  join (select s_nationkey as cluster_id, l_suppkey as application_id, l_partkey % 5 as stage_id, cast(sum(cast(l_quantity as bigint)) as bigint) as records
    from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3) r using (cluster_id, application_id, stage_id) where t.status = 'COMPLETE'),
issues as (
 select cluster_id, application_id, stage_id, 'DATA_SKEW' as issue_type, 'HIGH' as severity,
  'Max task duration (' || cast(top as varchar) || 'ms) is ' || printf('%.1f', top / mid) || 'x median (' || cast(mid as varchar) || 'ms)' as details
  from j where top > 0 and mid > 0 and top / mid > 10
 union all select cluster_id, application_id, stage_id, 'HIGH_GC_TIME', 'MEDIUM', 'GC time is ' || printf('%.1f', gc / mid * 100) || '% of task duration'
  from j where mid > 0 and gc / mid > 0.1
 union all select cluster_id, application_id, stage_id, 'MEMORY_SPILL', case when disk > 0 then 'HIGH' else 'MEDIUM' end,
  'Memory spill: ' || printf('%.1f', mem / 1048576) || 'MB, Disk spill: ' || printf('%.1f', disk / 1048576) || 'MB' from j where mem > 0 or disk > 0
 union all select cluster_id, application_id, stage_id, 'TOO_MANY_SMALL_TASKS', 'LOW', num_tasks || ' tasks with ~' || printf('%.0f', records / num_tasks) || ' records each'
  from j where num_tasks > 200 and records / num_tasks < 1000)"""


def with_records(data):
    tasks = data("supplied_lineitem")
    records = tasks.groupBy(
        F.col("s_nationkey").alias("cluster_id"), F.col("l_suppkey").alias("application_id"), (F.col("l_partkey") % 5).alias("stage_id")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("input_records"))
    return data("tel_stages").join(records, STAGE).withColumn("output_records", F.lit(0))


def stage_issue_rows(data):
    return issues.stage_issues(with_records(data), server_summaries(data))


ISSUE = ("cluster_id", "application_id", "stage_id", "issue_type", "severity", "details")


def _issue_query(name, kind):
    @query(name, f"with {ISSUE_QUANTILES} select * from issues where issue_type = '{kind}'")
    def run(data):
        return stage_issue_rows(data).where(F.col("issue_type") == kind).select(*ISSUE)


_issue_query("issues_data_skew", "DATA_SKEW")
_issue_query("issues_gc", "HIGH_GC_TIME")
_issue_query("issues_spill", "MEMORY_SPILL")
@query(
    "issues_small_tasks",
    """with j as (select s_nationkey as cluster_id, l_suppkey as application_id, cast(l_linenumber % 2 as bigint) as stage_id, count(*) as num_tasks,
  cast(sum(cast(l_quantity as bigint) * case when l_suppkey % 2 = 0 then 100 else 1 end) as bigint) as records from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2, 3)
select cluster_id, application_id, stage_id, 'TOO_MANY_SMALL_TASKS' as issue_type, 'LOW' as severity,
 num_tasks || ' tasks with ~' || printf('%.0f', records / num_tasks) || ' records each' as details from j where num_tasks > 200 and records / num_tasks < 1000""",
)
def issues_small_tasks(data):
    tasks = data("supplied_lineitem")
    weight = F.when(F.col("l_suppkey") % 2 == 0, 100).otherwise(1)
    wide = tasks.groupBy(
        F.col("s_nationkey").alias("cluster_id"), F.col("l_suppkey").alias("application_id"), (F.col("l_linenumber") % 2).cast("bigint").alias("stage_id")
    ).agg(F.count(F.lit(1)).alias("num_tasks"), F.sum(F.col("l_quantity").cast("bigint") * weight).alias("input_records"))
    stages = wide.withColumn("output_records", F.lit(0)).withColumn("status", F.lit("COMPLETE"))
    flat = F.array(*[F.lit(1.0)] * 5)
    quiet = wide.select(*STAGE, flat.alias("run_time"), *[F.lit(None).cast("array<double>").alias(c) for c in ("gc_time", "memory_spill", "disk_spill")])
    return issues.stage_issues(stages, quiet).select(*ISSUE)


@query(
    "issues_cluster_gc",
    """with t as (select application_id, sum(total_gc_time) as g, sum(total_duration) as b from tel_executors where is_active group by application_id)
select application_id, cast(null as bigint) as stage_id, 'CLUSTER_WIDE_GC' as issue_type, 'HIGH' as severity,
 'Cluster-wide GC is ' || printf('%.1f', g / b * 100) || '% of total executor time' as details from t where b > 0 and g / b > 0.1""",
)
def issues_cluster_gc(data):
    return issues.executor_issues(data("tel_executors"), APPLICATION)


@query(
    "issues_all",
    f"""with {ISSUE_QUANTILES} select *, case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end as severity_rank,
 issue_type || ': ' || details as line from issues""",
)
def issues_all(data):
    ordered = issues.ordered_issues(stage_issue_rows(data))
    return ordered.select(*ISSUE, "severity_rank", F.concat("issue_type", F.lit(": "), "details").alias("line"))


@query(
    "issue_counts",
    f"with {ISSUE_QUANTILES} select cluster_id, application_id, count(*) as issues_found from issues group by cluster_id, application_id",
)
def issue_counts(data):
    return issues.issue_counts(stage_issue_rows(data))


def summary_table(data):
    """Task summaries as they land: JSON lists for even stages, min, median and max by name for odd ones."""
    names = {"run_time": "executorRunTime", "gc_time": "jvmGcTime", "memory_spill": "memoryBytesSpilled", "disk_spill": "diskBytesSpilled"}

    def named(column):
        return F.struct(F.get(column, 0).alias("min"), F.get(column, 2).alias("median"), F.get(column, 4).alias("max"))

    listed = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]))
    by_name = F.to_json(F.struct(*[named(c).alias(n) for c, n in names.items()]))
    payload = F.when(F.col("stage_id") % 2 == 0, listed).otherwise(by_name)
    return history.task_summaries(server_summaries(data).select(*STAGE, payload.alias("payload")))


@query(
    "task_summary_payload",
    f"""with {ISSUE_QUANTILES.split("j as (")[0].rstrip().rstrip(",")}
select cast(cluster_id as varchar) as cluster_id, cast(application_id as varchar) as application_id, cast(stage_id as bigint) as stage_id,
 round(mid, 4) as median_run_time, round(top, 4) as longest_run_time, round(gc, 4) as median_gc_time, round(mem, 4) as most_memory_spill, round(disk, 4) as most_disk_spill from q""",
)
def task_summary_payload(data):
    vectors = issues.summary_vectors(summary_table(data))
    return vectors.select(
        *STAGE, F.round(F.get("run_time", 2), 4).alias("median_run_time"), F.round(F.get("run_time", 4), 4).alias("longest_run_time"),
        F.round(F.get("gc_time", 2), 4).alias("median_gc_time"), F.round(F.get("memory_spill", 4), 4).alias("most_memory_spill"),
        F.round(F.get("disk_spill", 4), 4).alias("most_disk_spill"),
    )


@query(
    "issues_from_payload",
    f"""with {ISSUE_QUANTILES} select cast(cluster_id as varchar) as cluster_id, cast(application_id as varchar) as application_id,
 cast(stage_id as bigint) as stage_id, issue_type, severity, details from issues""",
)
def issues_from_payload(data):
    stages = with_records(data).withColumns({key: F.col(key).cast("string") for key in advisor.APP}).withColumn("stage_id", F.col("stage_id").cast("bigint"))
    return issues.stage_issues(stages, issues.summary_vectors(summary_table(data))).select(*ISSUE)
