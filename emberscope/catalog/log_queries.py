"""Event-log queries over lines built from the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.catalog import logs
from emberscope.catalog.registry import query
from emberscope.catalog.rule_queries import ADVICE_VALUES, SKEW_ROW, STRAGGLER_ROW
from emberscope.operators import accounting, sqlplans
from emberscope.operators import events as ev
from emberscope.plans import advisor, overview
from emberscope.plans.eventlog import EventLog
from emberscope.schemas import TASK_METRICS
from emberscope.sources import eventlog

JOBS = """
o as (select o_orderkey as ok, o_orderkey // 3 % 10 + 1 as app, o_orderkey * 1000 as s, case when o_orderkey % 11 <> 0 then o_orderkey * 1000 + 30 + 20001 * (o_orderkey % 7) end as e,
  o_orderstatus as st, o_orderpriority as pr from orders),
refs as (select app, ok, s, e, 3 * ok as stage, 4 + ok % 3 as n from o union all select app, ok, s, e, 3 * ok + 1, 2 from o
  union all select app, ok, s, e, 3 * (ok // 200 * 200) + 2, 5 from o),
done as (select app, 3 * ok as stage, 0 as attempt, s + 1 as tick, s + case when ok % 5 = 0 then 15 else 20 end as completed, case when st = 'P' and ok % 3 = 0 then 'FAILED' else 'COMPLETE' end as status,
   4 + ok % 3 as n, ok % 100 as spill, ok % 10 + ok % 7 as shuffle, s + 1 as submitted, s + 20 as completion from o
  union all select app, 3 * ok + 1, 0, s + 3, s + 25, 'COMPLETE', 2, 0, 0, s + 3, s + 25 from o where ok % 2 = 1
  union all select app, 3 * (ok // 200 * 200) + 2, (ok // 50) % 4, s + 5, s + 9, case when ok % 100 = 7 then 'FAILED' else 'COMPLETE' end, 5, 0, 0, s + 5, s + 9 from o where ok % 50 = 7),
tk as (select o.app, 3 * o.ok as stage, o.s + 10 + l_linenumber as tick, case when l_returnflag = 'R' then 'failed' when l_returnflag = 'A' and l_linenumber = 3 then 'killed' else 'completed' end as outcome
  from lineitem join o on l_orderkey = o.ok),
stg as (select d.app, d.stage, d.attempt, any_value(d.status) as status, any_value(d.tick) as tick, any_value(d.completed) as completed, any_value(d.n)::double as n, any_value(d.spill) as spill,
   any_value(d.shuffle) as shuffle, any_value(d.submitted) as submitted, any_value(d.completion) as completion,
   (count(*) filter (where outcome = 'completed' and tk.tick < d.completed))::double as ok_tasks, (count(*) filter (where outcome = 'failed' and tk.tick < d.completed))::double as bad_tasks
  from done d left join tk on tk.app = d.app and tk.stage = d.stage and d.attempt = 0 and d.stage % 3 = 0 group by 1, 2, 3)"""


@query(
    "log_jobs",
    f"""with {JOBS},
head as (select *, row_number() over (partition by app, stage order by tick) as p from stg),
r as (select a.app, a.ok, a.stage, a.n, a.s, a.e,
  (select count(*) from refs b where b.app = a.app and b.stage = a.stage and b.s < a.e) as started,
  (select count(*) from refs b where b.app = a.app and b.stage = a.stage and b.e <= a.e) as closed,
  (select max(d.tick) from done d where d.app = a.app and d.stage = a.stage and d.tick < a.e) as last_submit from refs a where a.e is not null),
x as (select r.app, r.ok, r.n, last_submit, started, closed, r.s, f.status, f.ok_tasks, f.bad_tasks, f.n as fn, f.tick < r.e as known,
  coalesce(last_submit > r.s and f.completed < r.e, false) as ran, last_submit is null and (started <= 1 or started > closed) as skipped
  from r left join head f on f.app = r.app and f.stage = r.stage and f.p = 1),
t as (select app, ok, sum(case when ran and status = 'COMPLETE' then 1 else 0 end)::double as a, sum(case when ran and status = 'FAILED' then 1 else 0 end)::double as b,
  sum(case when skipped then 1 else 0 end)::double as c, sum(case when ran then ok_tasks else 0 end)::double as d, sum(case when ran then bad_tasks else 0 end)::double as f,
  sum(case when skipped then n else 0 end)::double as g from x group by 1, 2)
select cast(app as varchar) as application_id, ok as job_id, case when e is null then '' when st = 'P' then 'JobFailed' else 'JobSucceeded' end as status, pr as description,
 (11 + ok % 3)::double as num_tasks, coalesce(a, 0) as num_completed_stages, coalesce(b, 0) as num_failed_stages, coalesce(c, 0) as num_skipped_stages,
 coalesce(d, 0) as num_completed_tasks, coalesce(f, 0) as num_failed_tasks, coalesce(g, 0) as num_skipped_tasks, 'etl,nightly' as tags
 from o left join t using (app, ok)""",
)
def log_jobs(data):
    jobs = accounting.jobs(logs.job_events(data))
    return jobs.select(
        "application_id", "job_id", "status", "description", "num_tasks", *accounting.ACCOUNTED, F.array_join("job_tags", ",").alias("tags")
    )


@query(
    "log_stages",
    f"""with {JOBS} select cast(app as varchar) as application_id, stage as stage_id, cast(attempt as bigint) as attempt_id, status, n as num_tasks, ok_tasks as num_completed_tasks, bad_tasks as num_failed_tasks,
 spill as memory_bytes_spilled, 0::bigint as input_bytes, shuffle as shuffle_read_bytes, submitted as submission_ms, completion as completion_ms from stg""",
)
def log_stages(data):
    return accounting.stages(logs.job_events(data)).select(
        "application_id", "stage_id", "attempt_id", "status", "num_tasks", "num_completed_tasks", "num_failed_tasks",
        "memory_bytes_spilled", "input_bytes", "shuffle_read_bytes", "submission_ms", "completion_ms",
    )


@query(
    "log_stage_metrics_text",
    f"""with {JOBS} select cast(app as varchar) as application_id, cast(stage as varchar) as "stageId", cast(attempt as varchar) as "attemptId",
 case when submitted = 0 then '' when submitted % 1000 = 0 then strftime(make_timestamp(submitted * 1000), '%Y-%m-%dT%H:%M:%S') else strftime(make_timestamp(submitted * 1000), '%Y-%m-%dT%H:%M:%S.%f') end as "submissionTime" from stg""",
)
def log_stage_metrics_text(data):
    metrics = EventLog(logs.job_events(data)).stage_metrics()
    return metrics.select("application_id", "stageId", "attemptId", "submissionTime")


@query(
    "log_task_outcomes",
    f"""with {JOBS} select cast(app as varchar) as application_id, stage as stage_id, 0::bigint as attempt_id, count(*) filter (where outcome = 'completed') as completed,
 count(*) filter (where outcome = 'failed') as failed, count(*) filter (where outcome = 'killed') as killed from tk group by app, stage""",
)
def log_task_outcomes(data):
    return accounting.outcome_counts(logs.order_task_lines(data))


@query(
    "log_io_summary",
    f"""with {JOBS} select cast(app as varchar) as application_id, 0::bigint as total_input_bytes, 0::bigint as total_output_bytes, sum(shuffle)::bigint as total_shuffle_read_bytes,
 0::bigint as total_shuffle_write_bytes, 0.0::double as total_input_gb, round(sum(shuffle) / 1073741824, 2) as total_shuffle_gb from stg group by 1""",
)
def log_io_summary(data):
    return overview.io_summary(accounting.stages(logs.job_events(data)), ["application_id"])


TASKS = """
t as (select cast(l_suppkey as varchar) as application_id, l_partkey % 5 as stage_id, case when l_partkey % 40 = 3 then 1 else 0 end::bigint as attempt_id, cast(l_quantity as bigint) as q, l_linenumber as ln,
  cast(floor(l_extendedprice) as bigint) as w from lineitem where l_returnflag <> 'R' and not (l_returnflag = 'A' and l_linenumber = 3))"""


@query(
    "log_task_summary",
    f"""with {TASKS} select application_id, stage_id, attempt_id, count(*) as num_tasks, round(quantile_cont(q * 10 + ln * 7, 0.05), 4) as duration_p5, round(quantile_cont(q * 10 + ln * 7, 0.5), 4) as duration_p50,
 round(quantile_cont(q * 10 + ln * 7, 0.95), 4) as duration_p95, round(quantile_cont(greatest(0, ln * 7 - 5), 0.25), 4) as delay_p25, round(quantile_cont(q * 9, 0.75), 4) as shuffle_p75,
 round(quantile_cont(w, 0.5), 4) as written_p50, round(quantile_cont(ln, 0.5), 4) as blocks_p50, round(quantile_cont(q % 3, 0.95), 4) as gc_p95 from t group by 1, 2, 3""",
)
def log_task_summary(data):
    summaries = accounting.task_summaries(logs.supplier_task_lines(data))

    def at(metric, index, name):
        return F.round(F.get(metric, index), 4).alias(name)

    return summaries.select(
        *accounting.ATTEMPT, "num_tasks", at("duration", 0, "duration_p5"), at("duration", 2, "duration_p50"), at("duration", 4, "duration_p95"),
        at("scheduler_delay", 1, "delay_p25"), at("shuffle_read_bytes", 3, "shuffle_p75"), at("shuffle_write_bytes", 2, "written_p50"),
        at("total_blocks_fetched", 2, "blocks_p50"), at("jvm_gc_time", 4, "gc_p95"),
    )


#: What the lines give for each metric, by the names of ``t``; metrics that are not listed are 0 in every line.
_SUPPLIED = {
    "duration": "q * 10 + ln * 7", "executor_deserialize_time": "5", "executor_run_time": "q * 10", "jvm_gc_time": "q % 3",
    "scheduler_delay": "greatest(0, ln * 7 - 5)", "input_bytes": "q * 1000", "input_records": "q", "shuffle_read_bytes": "q * 9",
    "local_blocks_fetched": "ln", "remote_bytes_read": "q * 7", "total_blocks_fetched": "ln", "shuffle_write_bytes": "w",
}
_ALL_METRICS = " union all ".join(
    f"select application_id, stage_id, attempt_id, '{name}' as metric, quantile_cont({_SUPPLIED.get(name, '0')}, [0.05, 0.25, 0.5, 0.75, 0.95]) as v from t group by 1, 2, 3"
    for name in TASK_METRICS
)


@query(
    "log_task_metrics",
    f"with {TASKS} select application_id, stage_id, attempt_id, metric, round(v[1], 4) as p5, round(v[2], 4) as p25, round(v[3], 4) as p50, round(v[4], 4) as p75, round(v[5], 4) as p95 from ({_ALL_METRICS})",
)
def log_task_metrics(data):
    summaries = accounting.task_summaries(logs.supplier_task_lines(data))
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("v")) for name in TASK_METRICS])
    probes = [F.round(F.get("v", i), 4).alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))]
    return summaries.select(*accounting.ATTEMPT, F.inline(rows)).select(*accounting.ATTEMPT, "metric", *probes)


SQL = """
p as (select p_partkey as k, p_partkey // 16 as ex, (p_partkey // 16) % 10 + 1 as app, cast(p_size as bigint) as size,
  case p_partkey % 12 when 0 then 'MapElements' when 1 then 'Scan csv ' when 2 then 'SortMergeJoin' when 3 then 'PythonUDF' when 7 then 'ShuffledHashJoin' else 'Project' end as name from part),
x as (select distinct ex, app from p),
node as (select app, ex, k + 1 as id, name from p where ex % 8 <> 0 union all select app, ex, 0, 'Root' from x where ex % 8 <> 0
  union all select app, ex, id, name from x, (values (1, 'Scan parquet'), (2, 'Project'), (3, 'Adaptive'), (7, 'Output: x')) v(id, name) where ex % 8 = 0),
named as (select app, max_by(size * 10, k) filter (where k % 3 = 1) as rows, max(1) filter (where k % 24 = 2) as skew from p group by app),
lowest as (select ex, case when ex * 16 % 3 = 0 then size + case when k % 6 = 0 then 100 else 0 end when k % 3 = 1 then size * 10 end as v from p where k = ex * 16),
metric as (
 select app, ex, k + 1 as id, name, 'number of output rows' as metric, case k % 3 when 0 then size + case when k % 6 = 0 then 100 else 0 end when 1 then size * 10 else n.rows end as v from p join named n using (app)
 union all select app, ex, k + 1, name, 'Cancellation Is Skewed', n.skew from p join named n using (app)
 union all select app, ex, k + 1, name, 'mapped rows', l.v from p join lowest l using (ex) where ex % 2 = 0 and ex % 5 <> 0)"""


@query(
    "log_plan_nodes",
    f"with {SQL} select cast(app as varchar) as application_id, ex as execution_id, cast(id as integer) as node_id, name as node_name from node",
)
def log_plan_nodes(data):
    nodes = sqlplans.plan_nodes(sqlplans.executions(logs.sql_lines(data)))
    return nodes.select(*sqlplans.EXECUTION, "node_id", "node_name")


@query(
    "log_node_metrics",
    f"""with {SQL} select cast(app as varchar) as application_id, ex as execution_id, cast(id as integer) as node_id, name as node_name, metric as metric_name, cast(v as varchar) as metric_value
 from metric where ex % 8 <> 0 and v is not null""",
)
def log_node_metrics(data):
    events = logs.sql_lines(data)
    nodes = sqlplans.plan_nodes(sqlplans.executions(events))
    return sqlplans.node_metrics(nodes, events).drop("metric_no")


POSITIONS = """
pos as (select k, ex, app, size, name, row_number() over (partition by ex order by k) as id from p)"""


@query(
    "log_plan_nodes_corrected",
    f"""with {SQL}, {POSITIONS} select cast(app as varchar) as application_id, ex as execution_id, cast(id as integer) as node_id, name as node_name from pos
 union all select cast(app as varchar), ex, 0, 'Root' from x""",
)
def log_plan_nodes_corrected(data):
    nodes = sqlplans.plan_nodes(sqlplans.executions(logs.sql_lines(data, explained=False)), corrected=True)
    return nodes.select(*sqlplans.EXECUTION, "node_id", "node_name")


@query(
    "log_node_metrics_corrected",
    f"""with {SQL}, {POSITIONS}, found as (
 select app, ex, id, name, 'number of output rows' as metric, case k % 3 when 0 then size + case when k % 6 = 0 then 100 else 0 end when 1 then size * 10 end as v from pos
 union all select app, ex, id, name, 'Cancellation Is Skewed', case when k % 24 = 2 then 1 end from pos
 union all select app, ex, id, name, 'mapped rows', l.v from pos join lowest l using (ex) where ex % 2 = 0 and ex % 5 <> 0)
select cast(app as varchar) as application_id, ex as execution_id, cast(id as integer) as node_id, name as node_name, metric as metric_name, cast(v as varchar) as metric_value
 from found where v is not null""",
)
def log_node_metrics_corrected(data):
    events = logs.sql_lines(data, explained=False)
    nodes = sqlplans.plan_nodes(sqlplans.executions(events), corrected=True)
    return sqlplans.node_metrics(nodes, events, corrected=True).drop("metric_no")


@query(
    "log_sql",
    f"""with {SQL} select cast(app as varchar) as application_id, ex as execution_id, case when ex % 9 = 0 then 'RUNNING' when ex % 13 = 5 then 'FAILED' else 'COMPLETED' end as status,
 'query ' || ex as description, case when ex % 9 = 0 then 0 else (ex % 700) * 1000 end as duration_ms,
 case when ex % 12 = 0 then 27 when ex % 8 = 0 then 107 else 0 end as plan_length from x""",
)
def log_sql(data):
    return sqlplans.executions(logs.sql_lines(data)).select(
        *sqlplans.EXECUTION, "status", "description", "duration_ms", F.length("plan_description").alias("plan_length")
    )


@query(
    "log_sql_jobs",
    f"""with {SQL}, j as (select o_orderkey as job, o_orderkey // 3 % 10 + 1 as app, o_orderkey // 64 as ex, o_orderstatus as st from orders where o_orderkey % 17 <> 0 and o_orderkey % 11 <> 0)
select cast(app as varchar) as application_id, ex as execution_id, coalesce(string_agg(job, ',' order by job) filter (where st <> 'P'), '') as success_job_ids,
 coalesce(string_agg(job, ',' order by job) filter (where st = 'P'), '') as failed_job_ids from j join x using (app, ex) group by 1, 2""",
)
def log_sql_jobs(data):
    events = logs.job_lines(data).unionByName(logs.sql_lines(data))
    lists = sqlplans.execution_job_lists(sqlplans.execution_jobs(events))
    return lists.withColumn("success_job_ids", F.array_join("success_job_ids", ","))


@query(
    "log_join_skew",
    f"""with {SQL} select cast(app as varchar) as application_id, 7 as rule_no, ex as subject, 'Skew detected in ' || name || ' (Node ' || id || ').' as description
 from metric where ex % 8 <> 0 and metric = 'Cancellation Is Skewed' and v <> 0 and name in ('SortMergeJoin', 'ShuffledHashJoin')""",
)
def log_join_skew(data):
    events = logs.sql_lines(data)
    metrics = sqlplans.node_metrics(sqlplans.plan_nodes(sqlplans.executions(events)), events).withColumnRenamed("execution_id", "sql_id")
    return advisor.join_skew_rules(metrics, ["application_id"]).select("application_id", "rule_no", "subject", "description")


@query(
    "log_execution_overview",
    f"""with {SQL}, m as (select ex, id, count(v) as c from metric where ex % 8 <> 0 group by 1, 2)
select cast(app as varchar) as application_id, ex as sql_id, cast(count(*) as integer) as total_nodes, cast(count(*) filter (where coalesce(c, 0) > 0) as integer) as nodes_with_metrics,
 cast(coalesce(sum(c), 0) as integer) as total_metrics_collected from node left join m using (ex, id) group by 1, 2""",
)
def log_execution_overview(data):
    from emberscope.operators import drill

    metrics = EventLog(logs.sql_lines(data)).sql_metrics().withColumnsRenamed({"id": "sql_id", "duration": "duration_ms"})
    return drill.execution_overview(metrics, ["application_id", "sql_id"]).select(
        "application_id", "sql_id", "total_nodes", "nodes_with_metrics", "total_metrics_collected"
    )


@query(
    "log_malformed",
    """select cast(o_orderkey // 3 % 10 + 1 as varchar) as application_id, count(*) as lines, count(*) filter (where o_orderkey % 13 = 0) as malformed_lines from orders group by 1""",
)
def log_malformed(data):
    starts = logs.job_lines(data).where(F.col("event") == eventlog.EVENTS["job_start"])
    job = F.get_json_object("body", "$['Job ID']").cast("bigint")
    torn = F.when(job % 13 == 0, F.expr("left(body, length(body) - 3)")).otherwise(F.col("body"))
    return eventlog.malformed_counts(starts.withColumn("body", torn).drop("event"))


@query(
    "log_accumulators",
    """select cast(o_orderkey // 3 % 10 + 1 as varchar) as application_id, o_orderkey as job, (case when o_orderkey % 2 = 0 then 1 else o_orderkey end) as spilled, 0::bigint as absent from orders""",
)
def log_accumulators(data):
    item = F.struct(F.lit("Internal.Metrics.Spilled").alias("Name"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise(F.col("o_orderkey").cast("string")).alias("Value"))
    later = F.struct(F.lit("internal.metrics.spilled").alias("Name"), F.lit("77").alias("Value"))
    items = F.array(item, later)
    return data("orders").select(
        logs.order_application().alias("application_id"), F.col("o_orderkey").alias("job"),
        ev.accumulator(items, "internal.metrics.spilled", ignore_case=True, last=False).alias("spilled"),
        ev.accumulator(items, "missing").alias("absent"),
    )


def whole_log(data):
    """Jobs, stages and tasks of ten applications, and SQL executions of ten others."""
    sql = logs.sql_lines(data).withColumn("application_id", F.concat(F.lit("sql-"), "application_id"))
    return EventLog(logs.job_events(data).unionByName(sql))


@query(
    "log_overview",
    f"""with {JOBS}, {SQL} select cast(app as varchar) as application_id, 'jobs' as kind, case when e is null then '' when st = 'P' then 'JobFailed' else 'JobSucceeded' end as status, count(*) as n from o group by 1, 3
 union all select cast(app as varchar), 'stages', status, count(*) from stg group by 1, 3
 union all select 'sql-' || app, 'sql_executions', case when ex % 9 = 0 then 'RUNNING' when ex % 13 = 5 then 'FAILED' else 'COMPLETED' end, count(*) from x group by 1, 3
 union all select cast(app as varchar), 'task_summaries', '', count(distinct stage) from tk where outcome = 'completed' group by 1
 union all select 'sql-' || app, 'task_summaries', '', count(distinct ex) from p where k % 3 = 1 or k % 24 = 2 group by 1""",
)
def log_overview(data):
    return whole_log(data).overview()[0]


@query(
    "log_recommendations",
    f"""with {JOBS}, {SQL},
jt as (select cast(app as varchar) as a, count(*) as n, count(*) filter (where e is null or st = 'P') as f from o group by 1),
st as (select cast(app as varchar) as a, count(*) filter (where status = 'FAILED') as f, count(*) filter (where attempt > 0) as r, sum(spill)::double / 1073741824 as g from stg group by 1),
late as (select 'sql-' || app as a, count(*) filter (where ex % 13 = 5) as f, count(*) filter (where ex % 13 <> 5 and ex % 700 > 300) as n,
  avg((ex % 700)::double) filter (where ex % 13 <> 5 and ex % 700 > 300) as m from x where ex % 9 <> 0 group by 1),
q as (select cast(o.app as varchar) as a, 3 * o.ok as stage_id, 0 as attempt_id, count(*) as n, quantile_cont(cast(l_quantity as bigint) * 10 + l_linenumber * 7, [0.05, 0.25, 0.5, 0.75, 0.95]) as d
  from lineitem join o on l_orderkey = o.ok where l_returnflag <> 'R' and not (l_returnflag = 'A' and l_linenumber = 3) group by 1, 2),
fired as (
 select a, 1 as rule_no, null as subject, 'Job Reliability' as category, case when f / n * 100 > 10 then 'high' else 'medium' end as severity, 'Job Failures Detected' as title,
  f || ' out of ' || n || ' jobs failed (' || printf('%.1f', f / n * 100) || '% failure rate).' as description, f || ' failed jobs' as current_value from jt where f > 0
 union all select a, 2, null, 'Stage Reliability', 'high', 'Stage Failures Detected', f || ' stages failed during execution.', f || ' failed stages' from st where f > 0
 union all select a, 3, null, 'Stage Reliability', 'medium', 'Stage Retries Detected', r || ' stages required retry attempts.', r || ' retried stages' from st where r > 0
 union all select cast(app as varchar), 4, stage, 'Task Reliability', case when bad_tasks / n * 100 > 20 then 'high' else 'medium' end, 'High Task Failure Rate in Stage ' || stage,
  printf('%.1f', bad_tasks) || '/' || printf('%.1f', n) || ' tasks failed (' || printf('%.1f', bad_tasks / n * 100) || '%).', printf('%.1f', bad_tasks / n * 100) || '% failure rate'
  from stg where bad_tasks / n * 100 > 5
 union all select a, 5, null, 'Memory Management', case when g > 10 then 'high' when g > 1 then 'medium' else 'low' end, 'Data Spill Detected',
  'Total spill: ' || printf('%.2f', g) || ' GB (Memory: ' || printf('%.2f', g) || ' GB, Disk: 0.00 GB).', printf('%.2f', g) || ' GB spilled' from st where g > 0
 union all select 'sql-' || app, 7, ex, 'Data Skew', 'high', 'Join Skew Detected in SQL ' || ex, 'Skew detected in ' || name || ' (Node ' || id || ').', 'Skewed join detected'
  from metric where ex % 8 <> 0 and metric = 'Cancellation Is Skewed' and v <> 0 and name in ('SortMergeJoin', 'ShuffledHashJoin')
 union all select a, 8, null, 'SQL Reliability', 'high', 'Failed SQL Queries', f || ' SQL queries failed.', f || ' failed queries' from late where f > 0
 union all select a, 9, null, 'SQL Performance', 'medium', 'Long Running Queries', n || ' queries took over 5 minutes (avg: ' || printf('%.0f', m) || 's).',
  'Avg duration: ' || printf('%.0f', m) || 's' from late where n > 0
 union all select a, {SKEW_ROW}
 union all select a, {STRAGGLER_ROW}),
advice(rule, grade, recommended_action, config_suggestion) as (values {ADVICE_VALUES})
select a as application_id, cast(rule_no as integer) as rule_no, cast(subject as bigint) as subject, category, severity, title, description, current_value, recommended_action, config_suggestion
 from fired join advice on rule_no = rule and (grade is null or grade = severity)""",
)
def log_recommendations(data):
    return whole_log(data).recommendations()
