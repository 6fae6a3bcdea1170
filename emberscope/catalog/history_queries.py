"""History tables, status, drill-down, efficiency and compatibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.catalog.registry import query
from emberscope.catalog.rule_queries import ATTEMPT, STAGE
from emberscope.operators import clusters, drill, history, status
from emberscope.operators.keyed import balanced_join
from emberscope.operators.quantiles import SERVER_PROBES, group_quantiles
from emberscope.plans import compat, efficiency, overview
from emberscope.sources import history as landed


def paged(df, keys, page, fields, column="payload"):
    """JSON lists of bounded length per key: pages of a landed endpoint response."""
    return df.groupBy(*keys, page.alias("page")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias(column))


# -- payloads to tables ------------------------------------------------------------------

@query(
    "app_performance",
    """select cast(s_nationkey as varchar) as cluster_id, cast(s_suppkey as varchar) as application_id, cast(s_suppkey % 3 as varchar) as attempt_id,
 s_name as application_name, case when s_suppkey % 3 = 2 then 0 else (abs(cast(floor(s_acctbal) as bigint)) + s_suppkey % 3) * 1000 end as duration_ms,
 case when s_suppkey % 3 = 2 then 0.0 else round((abs(cast(floor(s_acctbal) as bigint)) + s_suppkey % 3) * 1000 / 60000, 2) end as duration_minutes,
 case when s_suppkey % 3 = 2 then 'start2' else 'start' || (s_suppkey % 3) end as start_time, case when s_suppkey % 3 = 2 then '4.1.2' else 'Unknown' end as spark_version from supplier""",
)
def app_performance(data):
    base = F.abs(F.floor("s_acctbal").cast("bigint"))
    attempt = F.col("s_suppkey") % 3

    def one(i, duration, version):
        return F.struct(
            F.lit(str(i)).alias("attemptId"), F.lit(f"start{i}").alias("startTime"), duration.alias("duration"),
            F.lit(version).alias("appSparkVersion"), F.lit(1000 + i).alias("startTimeEpoch"), F.lit(0).alias("endTimeEpoch"),
        )

    none = F.lit(None).cast("bigint")
    # the third attempt has no duration; ids the list does not hold fall back to the newest attempt
    attempts = F.array(one(0, base * 1000, None), one(1, (base + 1) * 1000, None), one(2, none, "4.1.2"))
    rows = data("supplier").select(
        F.col("s_nationkey").alias("cluster_id"), F.when(attempt == 2, 9).otherwise(attempt).cast("string").alias("attempt_id"),
        attempt.cast("string").alias("shown"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), attempts.alias("attempts"),
    )
    pages = paged(rows, ["cluster_id", "attempt_id", "shown"], F.expr("cast(id as bigint) div 500"), ["id", "name", "attempts"])
    payload = landed.typed_list(pages, "payload", "applications", ["cluster_id", "attempt_id", "shown"])
    table = history.applications(payload)
    return table.select(
        "cluster_id", "application_id", F.when(F.col("attempt_id") == "9", "2").otherwise(F.col("attempt_id")).alias("attempt_id"),
        "application_name", "duration_ms", "duration_minutes", "start_time", "spark_version",
    )


def job_pages(data):
    jobs = data("tel_jobs").select(
        "application_id", "job_id", F.col("job_id").cast("string").alias("jobId"), F.col("job_name").alias("name"),
        F.when(F.col("status") == "JobSucceeded", "SUCCEEDED").otherwise("FAILED").alias("status"),
        F.date_format("submission_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'").alias("submissionTime"),
        F.date_format("completion_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'").alias("completionTime"),
        F.col("num_tasks").alias("numTasks"), F.col("num_completed_tasks").alias("numCompletedTasks"),
        F.array(F.col("job_id") * 2, F.col("job_id") * 2 + 1).alias("stageIds"),
    )
    return paged(jobs, ["application_id"], F.expr("job_id div 1000"),
                 ["jobId", "name", "status", "submissionTime", "completionTime", "numTasks", "numCompletedTasks", "stageIds"])


def job_table(data):
    return history.jobs(landed.typed_list(job_pages(data), "payload", "jobs", ["application_id"]))


@query(
    "job_performance",
    """select cast(application_id as varchar) as application_id, job_id, job_name, case when status = 'JobSucceeded' then 'SUCCEEDED' else 'FAILED' end as status,
 num_tasks, num_completed_tasks, '[' || job_id * 2 || ', ' || job_id * 2 + 1 || ']' as stage_ids,
 case when num_tasks > 0 then round(num_completed_tasks / num_tasks * 100.0, 2) else 0.0 end as task_success_rate from tel_jobs""",
)
def job_performance(data):
    return job_table(data).select(
        "application_id", "job_id", "job_name", "status", "num_tasks", "num_completed_tasks", "stage_ids", "task_success_rate"
    )


def stage_table(data):
    payload = data("tel_stages").select(
        "cluster_id", "application_id", F.col("attempt_id").cast("string").alias("attempt_id"),
        F.col("stage_id").cast("string").alias("stageId"), F.lit("").alias("name"), "status", F.col("num_tasks").alias("numTasks"),
        F.lit(None).cast("bigint").alias("numActiveTasks"), F.col("num_complete_tasks").alias("numCompleteTasks"),
        F.col("num_failed_tasks").alias("numFailedTasks"), F.col("executor_run_time").alias("executorRunTime"),
        F.lit(None).cast("bigint").alias("executorCpuTime"), F.date_format("submission_time", "yyyy-MM-dd HH:mm:ss").alias("submissionTime"),
        F.lit(None).cast("string").alias("firstTaskLaunchedTime"), F.date_format("completion_time", "yyyy-MM-dd HH:mm:ss").alias("completionTime"),
        F.col("input_bytes").alias("inputBytes"), F.lit(None).cast("bigint").alias("outputBytes"),
        F.col("shuffle_read_bytes").alias("shuffleReadBytes"), F.lit(None).cast("bigint").alias("shuffleWriteBytes"),
        F.col("memory_bytes_spilled").alias("memoryBytesSpilled"), F.col("disk_bytes_spilled").alias("diskBytesSpilled"),
    )
    return history.stages(payload)


@query(
    "stage_performance",
    """select cast(cluster_id as varchar) as cluster_id, cast(application_id as varchar) as application_id, stage_id, 'Unknown' as stage_name, status,
 num_tasks, 0::bigint as num_active_tasks, num_failed_tasks, executor_run_time, round(num_complete_tasks / num_tasks * 100.0, 2) as task_completion_rate,
 round(executor_run_time / num_tasks, 2) as avg_executor_run_time_per_task, round(input_bytes / 1048576, 2) as total_data_processed_mb,
 round(shuffle_read_bytes / 1048576, 2) as shuffle_data_mb from tel_stages""",
)
def stage_performance(data):
    return stage_table(data).select(
        "cluster_id", "application_id", "stage_id", "stage_name", "status", "num_tasks", "num_active_tasks", "num_failed_tasks",
        "executor_run_time", "task_completion_rate", "avg_executor_run_time_per_task", "total_data_processed_mb", "shuffle_data_mb",
    )


@query(
    "task_projection",
    """select cast(cluster_id as varchar) as cluster_id, cast(application_id as varchar) as application_id, stage_id, task_order as task_id,
 cast(task_index as bigint) as index, duration_ms as duration, status, strftime(launch_time, '%Y-%m-%d %H:%M:%S') as launch_time from tel_tasks""",
)
def task_projection(data):
    payload = data("tel_tasks").select(
        "cluster_id", "application_id", "stage_id", F.col("task_order").alias("taskId"), F.col("task_index").alias("index"),
        F.date_format("launch_time", "yyyy-MM-dd HH:mm:ss").alias("launchTime"), F.col("duration_ms").alias("duration"), "status",
    )
    return history.tasks(payload).select(
        "cluster_id", "application_id", "stage_id", "task_id", "index", "duration", "status", "launch_time"
    )


def executor_payload(data):
    return data("tel_executors").select(
        "application_id", F.col("executor_id").alias("id"), F.col("is_active").alias("isActive"), F.col("total_cores").alias("totalCores"),
        F.col("max_memory").alias("maxMemory"), F.col("total_duration").alias("totalDuration"), F.col("total_gc_time").alias("totalGCTime"),
        F.lit(None).cast("boolean").alias("isBlacklisted"), F.lit(None).cast("map<string,string>").alias("executorLogs"),
    )


@query(
    "executor_projection",
    """select cast(application_id as varchar) as application_id, executor_id, is_active, cast(total_cores as bigint) as total_cores, max_memory, total_duration,
 total_gc_time, false as is_blacklisted, '{}' as executor_logs from tel_executors""",
)
def executor_projection(data):
    return history.executors(executor_payload(data)).select(
        "application_id", "executor_id", "is_active", "total_cores", "max_memory", "total_duration", "total_gc_time", "is_blacklisted", "executor_logs"
    )


# -- SQL executions ------------------------------------------------------------------------

def sql_payload(data):
    """Executions of 20 nodes each, in the shape of the SQL endpoint."""
    nodes = data("tel_sql_nodes").withColumn("execution_id", F.expr("node_id div 20"))
    metric = F.struct(F.lit("number of output rows").alias("name"), F.col("output_rows").cast("string").alias("value"))
    node = F.struct(F.col("node_id").cast("int").alias("nodeId"), F.col("node_name").alias("nodeName"), F.array(metric).alias("metrics"))
    return nodes.groupBy("execution_id").agg(
        F.sort_array(F.collect_list(node)).alias("nodes"), (F.sum("output_rows") * 1000).alias("duration")
    ).select(
        (F.col("execution_id") % 7).alias("cluster_id"), F.concat(F.lit("cluster "), F.col("execution_id") % 7).alias("cluster_name"),
        (F.col("execution_id") % 10 + 1).alias("application_id"), F.col("execution_id").alias("id"),
        F.when(F.col("execution_id") % 13 == 5, "FAILED").otherwise("COMPLETED").alias("status"), F.lit(None).cast("string").alias("description"),
        F.lit("2024-01-01T00:00:00.000GMT").alias("submissionTime"), "duration", "nodes",
    )


EXECUTIONS = """
n as (select node_id // 20 as sql_id, node_id, node_name, output_rows, (node_id // 20) % 7 as cluster_id, 'cluster ' || ((node_id // 20) % 7) as cluster_name,
  (node_id // 20) % 10 + 1 as application_id from tel_sql_nodes),
e as (select sql_id, cluster_id, cluster_name, application_id, case when sql_id % 13 = 5 then 'FAILED' else 'COMPLETED' end as status,
  cast(sum(output_rows) * 1000 as bigint) as duration_ms, count(*) as nodes,
  '[' || string_agg('{"nodeId":' || node_id || ',"nodeName":"' || node_name || '","metrics":[{"name":"number of output rows","value":"' || output_rows || '"}]}', ',' order by node_id) || ']' as nodestring
  from n group by all)"""


def sql_table(data):
    return history.sql(sql_payload(data))


@query(
    "sql_projection",
    f"""with {EXECUTIONS} select cast(cluster_id as varchar) as cluster_id, cast(application_id as varchar) as application_id, sql_id, 'N/A' as description, status,
 duration_ms, cast(nodes as integer) as nodes_in_json from e""",
)
def sql_projection(data):
    size = F.size(F.from_json(F.get_json_object("sql_raw_json", "$.nodes"), "array<string>"))
    return sql_table(data).select(
        "cluster_id", "application_id", "sql_id", "description", "status", "duration_ms", size.alias("nodes_in_json")
    )


FLAG = "case when node_name in ('MapElements','MapPartitions','Scan csv','Scan json','PythonUDF','ScalaUDF','FlatMapGroupsInPandas','DeserializeToObject','SerializeFromObject') then 0 else 1 end"
LIKE = "case when regexp_matches(node_name, 'MapElements|MapPartitions|Scan csv|Scan json|PythonUDF|ScalaUDF|FlatMapGroupsInPandas|DeserializeToObject|SerializeFromObject') then 0 else 1 end"


def _compat(name, flag, keys, substring, select):
    @query(
        name,
        f"""with {EXECUTIONS} select {select}cast(sum({flag}) as bigint) as compatible_nodes, count(*) as total_nodes, sum({flag}) / count(*) as compatible_ratio
 from n {"group by all" if keys else ""}""",
    )
    def run(data):
        return compat.compatibility(compat.exploded_nodes(sql_table(data), ("cluster_name", "application_id", "sql_id")), keys, substring)


_compat("compat_exact", FLAG, ("cluster_name", "application_id"), False, "cluster_name, cast(application_id as varchar) as application_id, ")
_compat("compat_like", LIKE, ("cluster_name", "application_id"), True, "cluster_name, cast(application_id as varchar) as application_id, ")
_compat("compat_by_sql", LIKE, ("sql_id", "cluster_name"), True, "sql_id, cluster_name, ")
_compat("compat_overall", FLAG, (), False, "")


@query("node_histogram", f"with {EXECUTIONS} select node_name, count(*) as nodes from n group by node_name")
def node_histogram(data):
    return compat.node_histogram(compat.exploded_nodes(sql_table(data)))


@query(
    "node_types",
    f"with {EXECUTIONS} select sql_id, split_part(trim(node_name), ' ', 1) as node_type, count(*) as nodes from n group by 1, 2",
)
def node_types(data):
    return compat.node_types(compat.exploded_nodes(sql_table(data), ("sql_id",)), ["sql_id"])


@query(
    "sql_drilldown",
    f"""with {EXECUTIONS} select application_id, sql_id, status, duration_ms, '' as description, cast(nodes as integer) as total_nodes,
 cast(nodes as integer) as nodes_with_metrics, cast(nodes as integer) as total_metrics_collected from e""",
)
def sql_drilldown(data):
    return drill.execution_overview(sql_payload(data).withColumnsRenamed({"id": "sql_id", "duration": "duration_ms"}))


@query(
    "rank_sql_by_size",
    f"""with {EXECUTIONS}, r as (select cluster_id, application_id, sql_id, nodestring, strlen(nodestring) as stringlength,
  rank() over (partition by cluster_id, application_id order by strlen(nodestring) desc) as rank from e)
select cluster_id, application_id, sql_id, nodestring, cast(stringlength as integer) as stringlength, rank from r where stringlength < 2200""",
)
def rank_sql_by_size(data):
    executions = sql_payload(data).withColumnRenamed("id", "sql_id")
    return drill.sql_snippets(executions, ["cluster_id", "application_id"], limit=2200).select(
        "cluster_id", "application_id", "sql_id", "nodestring", "stringlength", "rank"
    )


@query(
    "rank_tasks_by_duration",
    """select application_id, task_order, task_index, stage_id, cast(duration_ms as integer) as stringlength,
 rank() over (partition by application_id order by duration_ms desc) as rank from tel_tasks""",
)
def rank_tasks_by_duration(data):
    ranked = drill.rank_by_size(data("tel_tasks"), ["application_id"], F.col("duration_ms").cast("int"), ["task_order", "task_index"])
    return ranked.select("application_id", "task_order", "task_index", "stage_id", "stringlength", "rank")


# -- listings and lookups --------------------------------------------------------------------

def job_seconds(data):
    return history.run_seconds(job_table(data))


JOB_SECONDS = """j as (select cast(application_id as varchar) as application_id, job_id, date_sub('second', submission_time::timestamp, completion_time::timestamp) as runtimesec from tel_jobs)"""


@query("slowest_jobs", f"with {JOB_SECONDS} select * from j")
def slowest_jobs(data):
    return drill.slowest(job_seconds(data), ties=["job_id"]).select("application_id", "job_id", "runtimesec")


@query(
    "slowest_jobs_top",
    f"with {JOB_SECONDS} select *, row_number() over (partition by application_id order by runtimesec desc, job_id) as place from j qualify place <= 10",
)
def slowest_jobs_top(data):
    top = drill.slowest_per(job_seconds(data), ["application_id"], "runtimesec", ["job_id"], 10)
    return top.select("application_id", "job_id", "runtimesec", F.col("place").cast("bigint").alias("place"))


@query(
    "slowest_stages",
    """select cast(application_id as varchar) as application_id, stage_id, date_sub('second', submission_time, completion_time) as runtimesec from tel_stages""",
)
def slowest_stages(data):
    timed = history.run_seconds(stage_table(data))
    return drill.slowest(timed, ties=["application_id", "stage_id"]).select("application_id", "stage_id", "runtimesec")


@query("slowest_sql", f"with {EXECUTIONS} select cast(application_id as varchar) as application_id, sql_id, duration_ms from e")
def slowest_sql(data):
    return drill.slowest(sql_table(data), "duration_ms", ["sql_id"]).select("application_id", "sql_id", "duration_ms")


@query("slow_executions", "select application_id, sql_id, duration_ms from tel_sql where duration_ms > 300000")
def slow_executions(data):
    return drill.slow_executions(data("tel_sql")).select("application_id", "sql_id", "duration_ms")


@query(
    "job_lookup",
    f"with {JOB_SECONDS} select j.* from j where job_id in (select l_orderkey from lineitem where l_quantity >= 50)",
)
def job_lookup(data):
    wanted = data("lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("job_id")).distinct()
    return job_seconds(data).join(wanted, "job_id", "left_semi").select("application_id", "job_id", "runtimesec")


@query("stage_lookup", "select cast(application_id as varchar) as application_id, stage_id, num_tasks from tel_stages where stage_id in (1, 4)")
def stage_lookup(data):
    return drill.lookup(stage_table(data), "stage_id", [1, 4]).select("application_id", "stage_id", "num_tasks")


@query(
    "executor_lookup",
    """select application_id, executor_id, date_sub('second', o.lo, o.hi) as uptime from tel_executors
 join (select o_custkey, min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by o_custkey) o on executor_id = cast(o_custkey as varchar)""",
)
def executor_lookup(data):
    spans = data("orders").groupBy(F.col("o_custkey").cast("string").alias("executor_id")).agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'").alias("add_time"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'").alias("remove_time"),
    )
    up = history.run_seconds(data("tel_executors").join(spans, "executor_id"), "add_time", "remove_time", "uptime")
    return up.select("application_id", "executor_id", "uptime")


@query(
    "live_executors",
    "select application_id, count(*) as executors, count(*) filter (where is_active) as live from tel_executors group by application_id",
)
def live_executors(data):
    everyone = data("tel_executors")
    live = drill.live_executors(everyone).groupBy("application_id").agg(F.count(F.lit(1)).alias("live"))
    return drill.live_executors(everyone, include_dead=True).groupBy("application_id").agg(F.count(F.lit(1)).alias("executors")).join(live, "application_id", "left").fillna(0, ["live"])


@query(
    "first_application",
    "select cluster_id, min(application_id) as application_id from tel_applications group by cluster_id",
)
def first_application(data):
    return drill.first_application(data("tel_applications").withColumn("start_time", F.lit("")))


def raw_summaries(data):
    """Task-summary table: min, quartiles and max of successful tasks as JSON text."""
    tasks = data("tel_tasks").where("status = 'SUCCESS'").withColumn("attempt_id", F.expr(ATTEMPT)).withColumnRenamed("duration_ms", "duration")
    metrics = ("duration", "input_bytes", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")
    summaries = group_quantiles(tasks, [*STAGE, "attempt_id"], metrics, SERVER_PROBES)
    names = data("tel_clusters").select("cluster_id", "cluster_name")
    named = balanced_join(summaries, names, ["cluster_id"], "inner")
    return history.task_summary_payload(named, SERVER_PROBES)


@query(
    "task_summary_lookup",
    """select cluster_id, application_id, stage_id, count(*) as num_tasks, round(quantile_cont(duration_ms, 0.5), 4) as median_duration,
 cast(max(input_bytes) as double) as largest_input from tel_tasks where status = 'SUCCESS' and not (application_id % 5 = 1 and stage_id = 3) group by 1, 2, 3""",
)
def task_summary_lookup(data):
    first = drill.lookup(raw_summaries(data), "stage_attempt_id", 0)
    parsed = F.from_json("raw_json", "numTasks BIGINT, duration ARRAY<DOUBLE>, inputMetrics STRUCT<bytesRead: ARRAY<DOUBLE>>")
    return first.select(*STAGE, parsed.alias("s")).select(
        *STAGE, F.col("s.numTasks").alias("num_tasks"), F.round(F.get("s.duration", 2), 4).alias("median_duration"),
        F.get("s.inputMetrics.bytesRead", 4).alias("largest_input"),
    )


@query(
    "stage_details",
    """select s.application_id, s.stage_id, s.num_tasks, t.median from tel_stages s left join (select application_id, stage_id, quantile_cont(duration_ms, 0.5) as median
 from tel_tasks where status = 'FAILED' group by 1, 2) t using (application_id, stage_id)""",
)
def stage_details(data):
    failed = data("tel_tasks").where("status = 'FAILED'")
    medians = group_quantiles(failed, ["application_id", "stage_id"], ["duration_ms"], (0.5,)).drop("num_tasks")
    return drill.stage_details(data("tel_stages"), medians, ["application_id", "stage_id"]).select(
        "application_id", "stage_id", "num_tasks", F.get("duration_ms", 0).alias("median")
    )


@query(
    "application_listing",
    """select 'applications' as section, application_id, count(*) as items from tel_applications group by 2 union all select 'jobs', application_id, count(*) from tel_jobs group by 2
 union all select 'stages', application_id, count(*) from tel_stages group by 2 union all select 'executors', application_id, count(*) from tel_executors group by 2
 union all select 'sql_queries', application_id, count(*) from tel_sql group by 2""",
)
def application_listing(data):
    report = drill.full_report(
        {"applications": data("tel_applications"), "jobs": data("tel_jobs"), "stages": data("tel_stages"),
         "executors": data("tel_executors"), "sql_queries": data("tel_sql")}
    )
    return report.groupBy("section", F.col("application_id").cast("bigint").alias("application_id")).agg(F.count("payload").alias("items"))


# -- summaries ----------------------------------------------------------------------------------

@query(
    "app_summary",
    """select a.application_id, coalesce(j.job_count, 0) as job_count, coalesce(j.ok, 0) as jobs_succeeded, coalesce(j.bad, 0) as jobs_failed,
 coalesce(s.n, 0) as stage_count, coalesce(s.ok, 0) as stages_completed, coalesce(s.bad, 0) as stages_failed, coalesce(e.n, 0) as executor_count,
 coalesce(e.cores, 0) as total_cores, coalesce(e.gb, 0.0) as total_memory_gb from tel_applications a
 left join (select application_id, count(*) as job_count, count(*) filter (where status = 'JobSucceeded') as ok, count(*) filter (where status = 'JobFailed') as bad from tel_jobs group by 1) j using (application_id)
 left join (select application_id, count(*) as n, count(*) filter (where status = 'COMPLETE') as ok, count(*) filter (where status = 'FAILED') as bad from tel_stages group by 1) s using (application_id)
 left join (select application_id, count(*) as n, cast(sum(total_cores) as bigint) as cores, sum(max_memory) / 1073741824 as gb from tel_executors group by 1) e using (application_id)""",
)
def app_summary(data):
    return overview.application_summary(
        data("tel_applications").select("application_id"), data("tel_jobs"), data("tel_stages"), data("tel_executors"),
        succeeded="JobSucceeded", failed="JobFailed",
    )


def tables_by_cluster(data):
    apps = data("tel_applications")
    owner = apps.select("application_id", "cluster_id")
    return {
        "applications": apps,
        "jobs": balanced_join(data("tel_jobs"), owner, ["application_id"], "inner"),
        "stages": data("tel_stages"),
        "tasks": data("tel_tasks"),
        "sql": balanced_join(data("tel_sql"), owner, ["application_id"], "inner"),
        "executors": balanced_join(data("tel_executors"), owner, ["application_id"], "inner"),
        "task_summaries": data("tel_stages").where("num_complete_tasks > 0"),
    }


TOTALS = """
o as (select application_id, cluster_id from tel_applications),
u as (select cluster_id, 1 as k from tel_applications union all select cluster_id, 2 from tel_jobs join o using (application_id)
 union all select cluster_id, 3 from tel_stages union all select cluster_id, 4 from tel_tasks union all select cluster_id, 5 from tel_sql join o using (application_id)
 union all select cluster_id, 6 from tel_executors join o using (application_id) union all select cluster_id, 7 from tel_stages where num_complete_tasks > 0),
t as (select cluster_id, count(*) filter (where k = 1) as total_applications, count(*) filter (where k = 2) as total_jobs, count(*) filter (where k = 3) as total_stages,
 count(*) filter (where k = 4) as total_tasks, count(*) filter (where k = 5) as total_sql_queries, count(*) filter (where k = 6) as total_executors,
 count(*) filter (where k = 7) as total_task_summaries from u group by cluster_id)"""


@query("cluster_totals", f"with {TOTALS} select * from t")
def cluster_totals(data):
    return status.cluster_totals(tables_by_cluster(data))


@query(
    "run_summary",
    f"""with {TOTALS}, c as (select cluster_id, coalesce(total_applications, 0) as a, coalesce(total_jobs, 0) as j, coalesce(total_stages, 0) as s, coalesce(total_tasks, 0) as k,
 coalesce(total_sql_queries, 0) as q, coalesce(total_executors, 0) as e, coalesce(total_task_summaries, 0) as m from tel_clusters left join t using (cluster_id)),
r as (select count(*) as n, count(*) filter (where a > 0) as x, count(*) filter (where a > 0 and j > 0 and s > 0 and k > 0 and q > 0 and e > 0 and m > 0) as f,
 sum(a)::bigint as a, sum(j)::bigint as j, sum(s)::bigint as s, sum(k)::bigint as k, sum(q)::bigint as q, sum(e)::bigint as e, sum(m)::bigint as m from c)
select n as clusters_discovered_count, x as clusters_extracted_count, f as clusters_fully_analyzed_count, coalesce(round(f / x * 100.0, 2), 0.0) as "cluster_analysis_success_rate %",
 a as total_applications, j as total_jobs, s as total_stages, k as total_tasks, q as total_sql_queries, e as total_executors, m as total_task_summaries from r""",
)
def run_summary(data):
    totals = status.cluster_totals(tables_by_cluster(data))
    landed_status = totals.select("cluster_id", F.when(F.col("total_applications") > 0, "COMPLETED").otherwise("NO_APPLICATIONS(No data)").alias("analysis_status"))
    details = totals.select("cluster_id", F.lit("{}").alias("status_details"))
    clusters_ = data("tel_clusters").withColumnRenamed("state", "status")
    return status.run_summary(status.cluster_summaries(clusters_, totals, details, landed_status))


FETCH = """
f as (select user_id as cluster_id, ['applications','jobs','stages','tasks','sql','executors','task_summaries'][event_id % 7 + 1] as endpoint, event_id as seq,
 event_type <> 'view' as attempted, case when event_type = 'purchase' and user_id % 3 = 0 then 5 else 0 end as rows,
 case when event_type = 'error' then 'HTTP_' || (500 + event_id % 5) when event_type = 'click' and user_id % 2 = 1 then 'TIMEOUT' end as error_code,
 case when event_type = 'view' then 'Skipped due to prior failures of ' || event_id end as skip_reason from events)"""


def fetch_log(data):
    names = F.array(*[F.lit(e) for e in status.ENDPOINTS])
    kind = F.col("event_type")
    return data("events").select(
        F.col("user_id").alias("cluster_id"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("endpoint"), F.col("event_id").alias("seq"),
        (kind != "view").alias("attempted"), F.when((kind == "purchase") & (F.col("user_id") % 3 == 0), 5).otherwise(0).alias("rows"),
        status.error_code(
            F.when(kind == "error", "HTTPError").when((kind == "click") & (F.col("user_id") % 2 == 1), "ReadTimeout"), F.lit(""), 500 + F.col("event_id") % 5, F.lit(None)
        ).alias("error_code"),
        F.when(kind == "view", F.concat(F.lit("Skipped due to prior failures of "), F.col("event_id"))).alias("skip_reason"),
    ).withColumn("error_code", F.when(F.col("error_code") != "UNKNOWN_ERROR", F.col("error_code")))


ENDPOINT_ROWS = FETCH + """,
c as (select cluster_id, endpoint, sum(rows)::bigint as rows, bool_or(attempted) as attempted, arg_min(skip_reason, seq) filter (where skip_reason is not null) as reason from f group by 1, 2),
x as (select cluster_id, endpoint, string_agg(error_code, ',' order by seq) as codes from (select *, row_number() over (partition by cluster_id, endpoint order by seq) as p from f where error_code is not null) where p <= 3 group by 1, 2),
s as (select cluster_id, endpoint, rows, attempted, case when rows > 0 then 'OK' when attempted and codes is not null then 'FAILED(' || codes || ')'
 else 'SKIPPED(' || case when length(coalesce(reason, 'No data')) > 30 then left(reason, 27) || '...' else coalesce(reason, 'No data') end || ')' end as status
 from c left join x using (cluster_id, endpoint))"""


@query("endpoint_status", f"with {ENDPOINT_ROWS} select cluster_id, endpoint, rows, attempted, status from s")
def endpoint_status(data):
    return status.endpoint_status(fetch_log(data))


@query(
    "status_details",
    f"""with {ENDPOINT_ROWS} select cluster_id, '{{' || string_agg('"' || name || '":"' || coalesce(status, 'SKIPPED(No data)') || '"', ',' order by pos) || '}}' as status_details
 from (select cluster_id, name, pos from (select distinct cluster_id from f), (values ('applications', 1), ('jobs', 2), ('stages', 3), ('tasks', 4), ('sql', 5), ('executors', 6), ('task_summaries', 7)) v(name, pos)) g
 left join s using (cluster_id) where s.endpoint = name or not exists (select 1 from s z where z.cluster_id = g.cluster_id and z.endpoint = name) group by cluster_id""",
)
def status_details(data):
    return status.status_details(status.endpoint_status(fetch_log(data)))


@query(
    "cluster_status",
    f"""with {ENDPOINT_ROWS}, d as (select cluster_id, string_agg(error_code, ',' order by first) as codes from (select *, row_number() over (partition by cluster_id order by first, error_code) as p
  from (select cluster_id, error_code, min(seq) as first from f where error_code is not null group by 1, 2)) where p <= 3 group by 1),
w as (select cluster_id, sum(rows) as rows, bool_or(attempted) as attempted, coalesce(bool_or(endpoint = 'applications' and attempted), false) as asked from s group by 1)
select cluster_id, case when rows > 0 then 'COMPLETED' when asked then 'NO_APPLICATIONS(No data)' when codes is not null then 'FAILED(' || codes || ')'
 when attempted then 'FAILED(UNKNOWN)' else 'FAILED(NO_DATA)' end as analysis_status from w left join d using (cluster_id)""",
)
def cluster_status(data):
    log = fetch_log(data)
    return status.cluster_status(log, status.endpoint_status(log))


@query(
    "cluster_failure_messages",
    f"""with {FETCH}, g as (select cluster_id, endpoint, seq, attempted, rows, case when cluster_id % 2 = 1 then error_code end as error_code from f where endpoint <> 'applications'),
d as (select cluster_id, string_agg(error_code, ',' order by first) as codes from (select *, row_number() over (partition by cluster_id order by first, error_code) as p
  from (select cluster_id, error_code, min(seq) as first from g where error_code is not null group by 1, 2)) where p <= 3 group by 1),
w as (select cluster_id, sum(rows) as rows, bool_or(attempted) as attempted, case when cluster_id % 4 = 0 then 'lost (cluster ' || cluster_id || ') ' || repeat('x', cluster_id * 7 % 1000) end as said from g group by 1)
select cluster_id, case when rows > 0 then 'COMPLETED' when codes is not null then 'FAILED(' || codes || ')' when attempted and said is not null
 then 'FAILED(' || translate(case when length(said) > 500 then left(said, 497) || '...' else said end, '()', '[]') || ')'
 when attempted then 'FAILED(UNKNOWN)' else 'FAILED(NO_DATA)' end as analysis_status from w left join d using (cluster_id)""",
)
def cluster_failure_messages(data):
    log = fetch_log(data).where("endpoint <> 'applications'").withColumn("error_code", F.when(F.col("cluster_id") % 2 == 1, F.col("error_code")))
    said = F.concat(F.lit("lost (cluster "), F.col("cluster_id"), F.lit(") "), F.expr("repeat('x', int(cluster_id * 7 % 1000))"))
    failures = log.where("cluster_id % 4 = 0").select("cluster_id", said.alias("message"))
    return status.cluster_status(log, status.endpoint_status(log), failures)


@query(
    "run_summary_collected",
    f"""with {TOTALS}, {ENDPOINT_ROWS},
d as (select cluster_id, string_agg(error_code, ',' order by first) as codes from (select *, row_number() over (partition by cluster_id order by first, error_code) as p
  from (select cluster_id, error_code, min(seq) as first from f where error_code is not null group by 1, 2)) where p <= 3 group by 1),
w as (select cluster_id, sum(rows) as rows from s group by 1),
k as (select g.cluster_id, coalesce(total_applications, 0) as a, coalesce(total_jobs, 0) as j, coalesce(total_stages, 0) as st, coalesce(total_tasks, 0) as tk, coalesce(total_sql_queries, 0) as q,
  coalesce(total_executors, 0) as e, coalesce(total_task_summaries, 0) as m, coalesce(w.rows, 0) > 0 as done from tel_clusters g left join t using (cluster_id) left join w using (cluster_id)),
r as (select count(*) as n, count(*) filter (where done) as z, count(*) filter (where a > 0 and j > 0 and st > 0 and tk > 0 and q > 0 and e > 0 and m > 0) as u,
 sum(a)::bigint as a, sum(j)::bigint as j, sum(st)::bigint as st, sum(tk)::bigint as tk, sum(q)::bigint as q, sum(e)::bigint as e, sum(m)::bigint as m from k)
select n as clusters_discovered_count, z as clusters_extracted_count, u as clusters_fully_analyzed_count, coalesce(round(u / z * 100.0, 2), 0.0) as "cluster_analysis_success_rate %",
 a as total_applications, j as total_jobs, st as total_stages, tk as total_tasks, q as total_sql_queries, e as total_executors, m as total_task_summaries from r""",
)
def run_summary_collected(data):
    """The summary of a run from its call log: status and details of every cluster come from the calls."""
    log = fetch_log(data)
    rows = status.endpoint_status(log)
    clusters_ = data("tel_clusters").withColumnRenamed("state", "status")
    totals = status.cluster_totals(tables_by_cluster(data))
    return status.run_summary(status.cluster_summaries(clusters_, totals, status.status_details(rows), status.cluster_status(log, rows)))


# -- clusters --------------------------------------------------------------------------------------

@query(
    "cluster_filter",
    """select cluster_id, cluster_name, state from tel_clusters where state in ('TERMINATED', 'WAITING') and contains(lower(cluster_name), 'a') and normalized_instance_hours >= 6
 and creation_date >= date '2024-01-03' and creation_date < date '2024-01-20' + interval 1 day order by creation_date, cluster_id limit 10""",
)
def cluster_filter(data):
    return clusters.discover(
        data("tel_clusters"), name_filter="A", min_hours=6, created_after="2024-01-03", created_before="2024-01-20", max_clusters=10
    ).select("cluster_id", "cluster_name", "state")


@query(
    "new_clusters",
    "select cluster_id, cluster_name from tel_clusters where cluster_id not in (select cluster_id from tel_applications where duration_ms > 4000000)",
)
def new_clusters(data):
    landed_apps = data("tel_applications").where("duration_ms > 4000000")
    return clusters.not_yet_analysed(data("tel_clusters"), landed_apps).select("cluster_id", "cluster_name")


@query(
    "analysable_clusters",
    "select cluster_id, state from tel_clusters where contains(cluster_name, 'A') and state in ('RUNNING', 'WAITING', 'TERMINATED')",
)
def analysable_clusters(data):
    installed = F.when(F.col("cluster_name").contains("A"), F.array(F.lit("Hadoop 3"), F.lit("Spark 4.1"))).otherwise(F.array(F.lit("Hive")))
    return clusters.analysable(data("tel_clusters").withColumn("applications", installed)).select("cluster_id", "state")


@query(
    "cluster_app_score",
    """select a.application_id, a.cluster_name, case when c.cluster_id is null then null else c.state end as state, r.ratio from (select application_id, cluster_id, n_name as cluster_name from tel_applications join nation on n_nationkey = cluster_id) a
 left join (select * from tel_clusters where state <> 'RUNNING') c using (cluster_id)
 join (select n_name, n_nationkey / 10 as ratio from nation) r on r.n_name = a.cluster_name""",
)
def cluster_app_score(data):
    names = data("tel_clusters").select("cluster_id", "cluster_name")
    summaries = data("tel_clusters").where("state <> 'RUNNING'")
    scores = names.select("cluster_name", (F.col("cluster_id") / 10).alias("ratio"))
    apps = balanced_join(data("tel_applications").select("application_id", "cluster_id"), names, ["cluster_id"], "inner")
    return clusters.scored_clusters(summaries, apps, scores).select("application_id", "cluster_name", "state", "ratio")


# -- efficiency ---------------------------------------------------------------------------------------

EFFICIENCY = """
v as (select cluster_id, application_id, stage_id, min(duration_ms) as d0, quantile_cont(duration_ms, 0.5) as d2, max(duration_ms) as d4,
  quantile_cont(memory_bytes_spilled, 0.5) as m2, max(memory_bytes_spilled) as m4, quantile_cont(disk_bytes_spilled, 0.5) as k2, max(disk_bytes_spilled) as k4,
  min(input_bytes) as i0, quantile_cont(input_bytes, 0.5) as i2, max(input_bytes) as i4, min(shuffle_read_bytes) as s0, quantile_cont(shuffle_read_bytes, 0.5) as s2, max(shuffle_read_bytes) as s4
  from tel_tasks where status = 'SUCCESS' group by 1, 2, 3),
g as (select cluster_id, application_id, stage_id, case when d2 > 2 * d0 or d4 > 2 * d2 then 1 else 0 end as skewbinary,
  case when m2 > 256000000 or m4 > 256000000 then 1 else 0 end as spillbinary, case when k2 > 256000000 or k4 > 256000000 then 1 else 0 end as diskspillbinary,
  case when i0 > 512000000 or s0 > 512000000 then 1 else 0 end as chunkbinary,
  case when i0 / d0 between 0.01 and 10000 or s0 / d0 between 0.01 and 10000 or i2 / d2 between 0.01 and 10000 or s2 / d2 between 0.01 and 10000
    or i4 / d4 between 0.01 and 10000 or s4 / d4 between 0.01 and 10000 then 1 else 0 end as prbinary from v),
st as (select cluster_id, application_id, stage_id, round(num_complete_tasks / num_tasks * 100.0, 2) as task_completion_rate,
  date_sub('millisecond', submission_time, completion_time) as duration from tel_stages)"""


@query("ineff_stage_flags", f"with {EFFICIENCY} select * from g")
def ineff_stage_flags(data):
    return efficiency.stage_flags(raw_summaries(data)).select(*STAGE, *efficiency.FLAGS)


@query(
    "ineff_stage_raw",
    f"""with {EFFICIENCY} select cluster_id, application_id, stage_id, skewbinary, spillbinary, diskspillbinary, chunkbinary, prbinary,
 skewbinary + spillbinary + diskspillbinary + chunkbinary + case when task_completion_rate < 0.9 then 1 else 0 end as goldcheckfilter, task_completion_rate, duration
 from g join st using (cluster_id, application_id, stage_id)""",
)
def ineff_stage_raw(data):
    return efficiency.inefficient_stages(raw_summaries(data), efficiency_stages(data)).select(
        *STAGE, *efficiency.FLAGS, "goldcheckfilter", "task_completion_rate", "duration"
    )


def attempt_summaries(data):
    """Task summaries of stages that were tried twice: every other task belongs to the second attempt."""
    tasks = data("tel_tasks").where("status = 'SUCCESS'").withColumn("attempt_id", F.col("task_order") % 2).withColumnRenamed("duration_ms", "duration")
    metrics = ("duration", "input_bytes", "shuffle_read_bytes", "memory_bytes_spilled", "disk_bytes_spilled")
    summaries = group_quantiles(tasks, [*STAGE, "attempt_id"], metrics, SERVER_PROBES)
    names = data("tel_clusters").select("cluster_id", "cluster_name")
    return history.task_summary_payload(balanced_join(summaries, names, ["cluster_id"], "inner"), SERVER_PROBES)


def attempt_stages(data):
    """Stage table with two attempts a stage, from a landed payload."""
    attempts = data("tel_tasks").groupBy(*STAGE, (F.col("task_order") % 2).alias("attempt")).agg(
        F.count(F.lit(1)).alias("numTasks"), F.count_if(F.col("status") == "SUCCESS").alias("numCompleteTasks"),
        F.sum("duration_ms").alias("executorRunTime"), F.min("launch_time").alias("first"), F.max("launch_time").alias("last"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    counters = ("numActiveTasks", "numFailedTasks", "executorCpuTime", "inputBytes", "outputBytes", "shuffleReadBytes", "shuffleWriteBytes", "memoryBytesSpilled", "diskBytesSpilled")
    payload = attempts.select(
        "cluster_id", "application_id", F.col("stage_id").cast("string").alias("stageId"), F.col("attempt").cast("string").alias("attemptId"),
        F.lit("").alias("name"), F.lit("COMPLETE").alias("status"), "numTasks", "numCompleteTasks", "executorRunTime",
        F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("submissionTime"), none.alias("firstTaskLaunchedTime"),
        F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("completionTime"), *[zero.alias(c) for c in counters],
    )
    typed = history.stages(payload)
    return typed.withColumns({"cluster_id": F.col("cluster_id").cast("int"), "application_id": F.col("application_id").cast("bigint")}).drop("attempt_id", "cluster_name")


ATTEMPTS = """
v as (select cluster_id, application_id, stage_id, task_order % 2 as stage_attempt_id, min(duration_ms) as d0, quantile_cont(duration_ms, 0.5) as d2, max(duration_ms) as d4,
  quantile_cont(memory_bytes_spilled, 0.5) as m2, max(memory_bytes_spilled) as m4, quantile_cont(disk_bytes_spilled, 0.5) as k2, max(disk_bytes_spilled) as k4,
  min(input_bytes) as i0, quantile_cont(input_bytes, 0.5) as i2, max(input_bytes) as i4, min(shuffle_read_bytes) as s0, quantile_cont(shuffle_read_bytes, 0.5) as s2, max(shuffle_read_bytes) as s4
  from tel_tasks where status = 'SUCCESS' group by 1, 2, 3, 4),
st as (select cluster_id, application_id, stage_id, task_order % 2 as stage_attempt_id, round(count(*) filter (where status = 'SUCCESS') / count(*) * 100.0, 2) as task_completion_rate,
  date_sub('millisecond', min(launch_time), max(launch_time)) as duration, count(*) as n from tel_tasks group by 1, 2, 3, 4)"""


@query(
    "ineff_stage_attempts",
    f"""with {ATTEMPTS}, g as (select *, case when d2 > 2 * d0 or d4 > 2 * d2 then 1 else 0 end as skewbinary,
  case when m2 > 256000000 or m4 > 256000000 then 1 else 0 end as spillbinary, case when k2 > 256000000 or k4 > 256000000 then 1 else 0 end as diskspillbinary,
  case when i0 > 512000000 or s0 > 512000000 then 1 else 0 end as chunkbinary from v)
select cluster_id, application_id, stage_id, stage_attempt_id, skewbinary, spillbinary, diskspillbinary, chunkbinary,
 skewbinary + spillbinary + diskspillbinary + chunkbinary + case when task_completion_rate < 0.9 then 1 else 0 end as goldcheckfilter, task_completion_rate, duration
 from g join st using (cluster_id, application_id, stage_id, stage_attempt_id)""",
)
def ineff_stage_attempts(data):
    rows = efficiency.inefficient_stages(attempt_summaries(data), attempt_stages(data))
    return rows.select(*STAGE, "stage_attempt_id", *efficiency.FLAGS[:-1], "goldcheckfilter", "task_completion_rate", "duration")


@query(
    "ineff_attempts_agg",
    f"""with {ATTEMPTS}, h as (select v.cluster_id, v.application_id, v.stage_id, v.stage_attempt_id, case when d2 > 2 * d0 or d4 > 2 * d2 then 1 else 0 end
   + case when m2 > 256000000 or m4 > 256000000 then 1 else 0 end + case when k2 > 256000000 or k4 > 256000000 then 1 else 0 end
   + case when greatest(i0, i2, i4, s0, s2, s4) > 512000000 then 1 else 0 end
   + case when greatest(i0 / d0, i2 / d2, i4 / d4) > 2 * least(i0 / d0, i2 / d2, i4 / d4) or greatest(s0 / d0, s2 / d2, s4 / d4) > 2 * least(s0 / d0, s2 / d2, s4 / d4) then 1 else 0 end as raised from v),
r as (select cluster_id, application_id, sum(case when raised > 0 or task_completion_rate < 90 then duration else 0 end) / sum(duration) * 100 as share
  from h join st using (cluster_id, application_id, stage_id, stage_attempt_id) group by 1, 2)
select cluster_id, application_id, round(share, 6) as ineffstageagg from r where share > 25""",
)
def ineff_attempts_agg(data):
    scored = efficiency.inefficient_clusters(attempt_summaries(data), attempt_stages(data), application_starts(data), corrected=True)
    return scored.select("cluster_id", "application_id", F.round("ineffstageagg", 6).alias("ineffstageagg"))


@query(
    "stage_attempt_details",
    f"""with {ATTEMPTS} select st.cluster_id, st.application_id, st.stage_id, st.stage_attempt_id, st.n as num_tasks, round(v.d2, 4) as median
 from st left join v using (cluster_id, application_id, stage_id, stage_attempt_id)""",
)
def stage_attempt_details(data):
    parsed = F.from_json("raw_json", "duration ARRAY<DOUBLE>")
    medians = attempt_summaries(data).select(*STAGE, "stage_attempt_id", F.round(F.get(parsed["duration"], 2), 4).alias("median"))
    return drill.stage_details(attempt_stages(data), medians, STAGE).select(*STAGE, "stage_attempt_id", "num_tasks", "median")


def efficiency_stages(data):
    stages = stage_table(data)
    return stages.select(
        F.col("cluster_id").cast("int").alias("cluster_id"), F.col("application_id").cast("bigint").alias("application_id"),
        "stage_id", "task_completion_rate", "submission_time", "completion_time",
    )


def application_starts(data):
    return data("tel_applications").select("cluster_id", "application_id", F.concat(F.lit("start "), "application_name").alias("start_time"))


@query(
    "ineff_cluster_agg",
    f"""with {EFFICIENCY}, p as (select g.cluster_id, case when skewbinary + spillbinary + diskspillbinary + chunkbinary > 0 or task_completion_rate < 0.9 then duration else 0 end as bad, duration
  from g join st on g.cluster_id = st.cluster_id and g.stage_id = st.stage_id),
r as (select cluster_id, sum(bad) / sum(duration) * 100 as share from p group by cluster_id)
select cluster_id, n_name as cluster_name, round(share, 6) as ineffstageagg, 'start ' || application_name as start_time
 from r join nation on n_nationkey = cluster_id join tel_applications using (cluster_id) where share > 25""",
)
def ineff_cluster_agg(data):
    scored = efficiency.inefficient_clusters(raw_summaries(data), efficiency_stages(data), application_starts(data))
    return scored.select("cluster_id", "cluster_name", F.round("ineffstageagg", 6).alias("ineffstageagg"), "start_time")


@query(
    "ineff_application_agg",
    f"""with {EFFICIENCY}, h as (select v.cluster_id, v.application_id, v.stage_id, case when d2 > 2 * d0 or d4 > 2 * d2 then 1 else 0 end
   + case when m2 > 256000000 or m4 > 256000000 then 1 else 0 end + case when k2 > 256000000 or k4 > 256000000 then 1 else 0 end
   + case when greatest(i0, i2, i4, s0, s2, s4) > 512000000 then 1 else 0 end
   + case when greatest(i0 / d0, i2 / d2, i4 / d4) > 2 * least(i0 / d0, i2 / d2, i4 / d4) or greatest(s0 / d0, s2 / d2, s4 / d4) > 2 * least(s0 / d0, s2 / d2, s4 / d4) then 1 else 0 end as raised from v),
r as (select cluster_id, application_id, sum(case when raised > 0 or task_completion_rate < 90 then duration else 0 end) / sum(duration) * 100 as share
  from h join st using (cluster_id, application_id, stage_id) group by 1, 2)
select cluster_id, application_id, round(share, 6) as ineffstageagg from r where share > 25""",
)
def ineff_application_agg(data):
    scored = efficiency.inefficient_clusters(raw_summaries(data), efficiency_stages(data), application_starts(data), corrected=True)
    return scored.select("cluster_id", "application_id", F.round("ineffstageagg", 6).alias("ineffstageagg"))


# -- sources inside queries ------------------------------------------------------------------------------

def envelopes(data):
    """One answered envelope per job page, and one failed call per application."""
    pages = job_pages(data)
    answered = F.concat(F.lit('{"success":true,"jobs":'), F.col("payload"), F.lit(',"count":1}'))
    failed = F.concat(F.lit('{"success":false,"error":"no connection to '), F.col("application_id"), F.lit('","error_type":"ConnectionError"}'))
    return pages.select("application_id", answered.alias("body")).unionByName(
        data("tel_applications").select("application_id", failed.alias("body"))
    )


@query(
    "envelope_errors",
    "select application_id, 'no connection to ' || application_id as error, 'ConnectionError' as error_type from tel_applications",
)
def envelope_errors(data):
    return landed.envelope_errors(envelopes(data), "body", ["application_id"])


@query(
    "envelope_jobs",
    "select application_id, count(*) as jobs, cast(sum(num_tasks) as double) as num_tasks from tel_jobs group by application_id",
)
def envelope_jobs(data):
    rows = landed.envelope_rows(envelopes(data), "body", "jobs", ["application_id"])
    return rows.groupBy("application_id").agg(F.count(F.lit(1)).alias("jobs"), F.sum("numTasks").alias("num_tasks"))


@query(
    "event_properties",
    "select event_type, count(*) as events, cast(sum(cast(json_extract(props, '$.k') as integer)) as bigint) as k from events group by event_type",
)
def event_properties(data):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return data("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(k).alias("k"))


@query(
    "configuration",
    """select s_suppkey as application_id, 'sparkProperties' as kind, 'spark.app.name' as property, s_name as value from supplier
 union all select s_suppkey, 'systemProperties', 'user.balance', cast(cast(floor(s_acctbal) as bigint) as varchar) from supplier""",
)
def configuration(data):
    def pair(name, value):
        return F.array(F.array(F.lit(name), value))

    text = F.to_json(
        F.struct(
            pair("spark.app.name", F.col("s_name")).alias("sparkProperties"),
            pair("user.balance", F.floor("s_acctbal").cast("string")).alias("systemProperties"),
        )
    )
    landed_text = data("supplier").select(F.col("s_suppkey").alias("application_id"), F.concat(F.lit("["), text, F.lit("]")).alias("body"))
    return drill.configuration(landed.typed_list(landed_text, "body", "environment", ["application_id"]))
