"""Full reports, listings of storage and streaming, SQL functions and quantile sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberscope.catalog.history_queries import EXECUTIONS, JOB_SECONDS, configuration, job_seconds, raw_summaries, sql_payload, stage_table
from emberscope.catalog.registry import query
from emberscope.catalog.rule_queries import ISSUE_QUANTILES, stage_issue_rows, successful_tasks
from emberscope.functions import sqlfunctions
from emberscope.operators import drill, history, report, sketches
from emberscope.operators.quantiles import LOG_PROBES
from emberscope.runtime import stored
from emberscope.sources import history as landed


# -- storage and streaming ------------------------------------------------------------------------

STORAGE = "st as (select p_partkey % 10 + 1 as application_id, p_partkey as id, p_name as name, p_size as parts, p_partkey % 3 as cached, p_size * 1000 as bytes from part)"


def storage_payload(data):
    """Answers of the storage endpoint, a page of cached frames each."""
    size = F.col("p_size").cast("bigint")
    rows = data("part").select(
        (F.col("p_partkey") % 10 + 1).alias("application_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), size.alias("numPartitions"),
        (F.col("p_partkey") % 3).alias("numCachedPartitions"), F.lit("Memory Deserialized 1x Replicated").alias("storageLevel"),
        (size * 1000).alias("memoryUsed"), F.lit(0).cast("bigint").alias("diskUsed"),
    )
    fields = [c for c in rows.columns if c != "application_id"]
    page = F.floor(F.col("id") / 500).alias("page")
    return rows.groupBy("application_id", page).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("payload"))


@query(
    "storage_listing",
    f"with {STORAGE} select application_id, id, name, cast(parts as bigint) as num_partitions, cached as num_cached_partitions, cast(bytes as bigint) as memory_used from st",
)
def storage_listing(data):
    rows = history.storage(landed.typed_list(storage_payload(data), "payload", "storage", ["application_id"]))
    return rows.select("application_id", "id", "name", "num_partitions", "num_cached_partitions", "memory_used")


STREAMS = """
b as (select user_id % 7 as application_id, count(*) as records, count(distinct event_id // 100) as batches, min(event_id) as first from events group by 1)"""


def streaming_payload(data):
    """One answer of the streaming-statistics endpoint per application, from the events it received."""
    stats = data("events").groupBy((F.col("user_id") % 7).alias("application_id")).agg(
        F.count(F.lit(1)).alias("numReceivedRecords"), F.countDistinct(F.floor(F.col("event_id") / 100)).alias("numTotalCompletedBatches"), F.min("event_id").alias("first")
    )
    body = F.struct(
        F.concat(F.lit("start "), F.col("first")).alias("startTime"), F.lit(1000).alias("batchDuration"), F.lit(2).alias("numReceivers"),
        "numTotalCompletedBatches", "numReceivedRecords", F.col("numReceivedRecords").alias("numProcessedRecords"),
        (F.col("numReceivedRecords") / F.col("numTotalCompletedBatches")).alias("avgInputRate"),
    )
    return stats.select("application_id", F.to_json(body).alias("payload"))


@query(
    "streaming_statistics",
    f"with {STREAMS} select application_id, 'start ' || first as start_time, 1000::bigint as batch_duration, batches as num_completed_batches, records as num_received_records, round(records / batches, 4) as avg_input_rate from b",
)
def streaming_statistics(data):
    rows = history.streaming_statistics(streaming_payload(data), "payload", ["application_id"])
    return rows.select("application_id", "start_time", "batch_duration", "num_completed_batches", "num_received_records", F.round("avg_input_rate", 4).alias("avg_input_rate"))


# -- one document per application -----------------------------------------------------------------------

@query(
    "application_documents",
    f"""with {ISSUE_QUANTILES}, {STORAGE},
a as (select application_id, min(application_name) as name from tel_applications group by 1),
ids as (select application_id from a union select application_id from tel_jobs union select application_id from tel_stages union select application_id from tel_executors
  union select application_id from tel_sql union select application_id from st union select application_id from issues)
select cast(application_id as varchar) as application_id, a.name as application_name,
 (select count(*) from tel_jobs j where j.application_id = i.application_id) as jobs, (select coalesce(sum(num_tasks), 0)::bigint from tel_jobs j where j.application_id = i.application_id) as job_tasks,
 (select count(*) from tel_stages s where s.application_id = i.application_id) as stages, (select count(*) from tel_executors e where e.application_id = i.application_id) as executors,
 (select count(*) from tel_sql q where q.application_id = i.application_id) as sql_queries, (select count(*) from st where st.application_id = i.application_id) as storage,
 (select coalesce(sum(bytes), 0)::bigint from st where st.application_id = i.application_id) as storage_bytes, (select count(*) from issues z where z.application_id = i.application_id) as issues,
 (select count(*) from supplier p where p.s_suppkey = i.application_id) * 2 as properties
 from ids i left join a using (application_id)""",
)
def application_documents(data):
    parts = {
        "application": data("tel_applications"), "jobs": data("tel_jobs"), "stages": data("tel_stages"), "executors": data("tel_executors"),
        "sql_queries": data("tel_sql"), "performance_analysis": stage_issue_rows(data), "environment": configuration(data),
        "storage": history.storage(landed.typed_list(storage_payload(data), "payload", "storage", ["application_id"])), "streaming": None,
    }
    pages = report.application_documents(parts)

    def section(name):
        return F.coalesce(F.try_variant_get("document", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    def number(name, field):
        return F.aggregate(section(name), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_variant_get(x, f"$.{field}", "long"), F.lit(0)))

    read = pages.select(
        "application_id", F.try_variant_get("document", "$.application[0].application_name", "string").alias("application_name"),
        *[F.size(section(name)).cast("long").alias(out) for name, out in (
            ("jobs", "jobs"), ("stages", "stages"), ("executors", "executors"), ("sql_queries", "sql_queries"), ("storage", "storage"),
            ("performance_analysis", "issues"), ("environment", "properties"))],
        number("jobs", "num_tasks").alias("job_tasks"), number("storage", "memory_used").alias("storage_bytes"),
    )
    sums = [c for c in read.columns if c not in ("application_id", "application_name")]
    return read.groupBy("application_id").agg(F.min("application_name").alias("application_name"), *[F.sum(c).alias(c) for c in sums])


#: Sections of a report as the checking statement writes them: source, and the fields with their kind of JSON value.
_SECTIONS = (
    ("application", "tel_applications", "cluster_id, application_name*, duration_ms"),
    ("jobs", "(select *, strftime(submission_time::timestamp, '%Y-%m-%d %H:%M:%S') as submitted, strftime(completion_time::timestamp, '%Y-%m-%d %H:%M:%S') as completed from tel_jobs)",
     "job_id, job_name*, status*, submitted*, completed*, num_tasks, num_completed_tasks"),
    ("stages", "tel_stages", "cluster_id, stage_id, attempt_id, status*, num_tasks, num_complete_tasks, num_failed_tasks, input_bytes, shuffle_read_bytes"),
    ("task_summaries", "(select application_id, cluster_id, stage_id, count(*) as num_tasks, min(duration_ms) as shortest, max(duration_ms) as longest from tel_tasks where status = 'SUCCESS' group by 1, 2, 3)",
     "cluster_id, stage_id, num_tasks, shortest, longest"),
    ("executors", "tel_executors", "executor_id*, is_active, total_cores, max_memory, total_duration, total_gc_time"),
    ("sql_queries", "tel_sql", "sql_id, status*, num_nodes, duration_ms"),
    ("environment", "(select s_suppkey as application_id, 'sparkProperties' as kind, 'spark.app.name' as property, s_name as value from supplier union all "
     "select s_suppkey, 'systemProperties', 'user.balance', cast(cast(floor(s_acctbal) as bigint) as varchar) from supplier)", "kind*, property*, value*"),
    ("storage", "st", "id, name*, parts, cached, bytes"),
    ("tasks", "tel_tasks", "stage_id, task_order, task_index, duration_ms, status*"),
    ("performance_analysis", "issues", "cluster_id, stage_id, issue_type*, severity*, details*"),
)


def _json_rows() -> str:
    def field(name: str) -> str:
        bare = name.rstrip("*")
        return f"""'"{bare}":' || {f"to_json({bare})" if name.endswith("*") else bare}"""

    return " union all ".join(
        f"select cast(application_id as varchar) as application_id, {i} as section_no, '{name}' as section, "
        f"'{{' || concat_ws(',', {', '.join(field(x) for x in fields.split(', '))}) || '}}' as payload from {source}"
        for i, (name, source, fields) in enumerate(_SECTIONS)
    )


@query("full_report", f"with {ISSUE_QUANTILES}, {STORAGE} {_json_rows()}")
def full_report(data):
    """All sections of the report, with environment, storage and tasks; one row an item."""
    minute = "yyyy-MM-dd HH:mm:ss"
    parsed = F.from_json("raw_json", "numTasks BIGINT, duration ARRAY<DOUBLE>")
    frames = {
        "application": data("tel_applications"),
        "jobs": data("tel_jobs").withColumns({"submitted": F.date_format("submission_time", minute), "completed": F.date_format("completion_time", minute)}),
        "stages": data("tel_stages"),
        "task_summaries": raw_summaries(data).select(
            "cluster_id", "application_id", "stage_id", parsed["numTasks"].alias("num_tasks"),
            F.get(parsed["duration"], 0).cast("long").alias("shortest"), F.get(parsed["duration"], 4).cast("long").alias("longest"),
        ),
        "executors": data("tel_executors"),
        "sql_queries": data("tel_sql"),
        "environment": configuration(data),
        "storage": history.storage(landed.typed_list(storage_payload(data), "payload", "storage", ["application_id"])).withColumnsRenamed(
            {"num_partitions": "parts", "num_cached_partitions": "cached", "memory_used": "bytes"}
        ),
        "tasks": data("tel_tasks"),
        "performance_analysis": stage_issue_rows(data),
    }
    fields = {name: [x.rstrip("*") for x in listed.split(", ")] for name, _, listed in _SECTIONS}
    return drill.full_report({name: frames[name].select("application_id", *fields[name]) for name in fields})


# -- SQL functions -----------------------------------------------------------------------------------------

def sql_session(data):
    """The session, with the functions over landed payloads."""
    jobs = data("tel_jobs").select(
        F.lit("c").alias("cluster_id"), F.col("job_id").cast("string").alias("jobId"), F.col("job_name").alias("name"), "status",
        F.date_format("submission_time", "yyyy-MM-dd HH:mm:ss").alias("submissionTime"), F.date_format("completion_time", "yyyy-MM-dd HH:mm:ss").alias("completionTime"),
        F.col("num_tasks").cast("double").alias("numTasks"),
    )
    stages = data("tel_stages").select(
        F.col("application_id").cast("string").alias("cluster_id"), F.col("stage_id").cast("string").alias("stageId"), "status", F.col("num_tasks").cast("double").alias("numTasks"),
        F.date_format("submission_time", "yyyy-MM-dd HH:mm:ss").alias("submissionTime"), F.date_format("completion_time", "yyyy-MM-dd HH:mm:ss").alias("completionTime"),
        F.col("input_bytes").alias("inputBytes"),
    )
    executors = data("tel_executors").select(
        F.lit("c").alias("cluster_id"), F.col("executor_id").alias("id"), F.col("total_cores").cast("double").alias("totalCores"), F.col("max_memory").alias("maxMemory")
    )
    applications = data("tel_applications").select("cluster_id", "application_id", F.concat(F.lit("t"), F.lpad((F.col("application_id") * 7919 % 1000).cast("string"), 4, "0")).alias("start_time"))
    summaries = history.task_summaries(data("tel_stages").select(
        F.col("cluster_id").cast("string").alias("cluster_id"), F.col("application_id").cast("string").alias("application_id"), "stage_id",
        F.concat(F.lit("summary "), F.col("application_id")).alias("payload"),
    ))
    frames = {
        "applications": applications, "jobs": jobs, "stages": stages, "executors": executors, "task_summaries": summaries,
        "sql": sql_payload(data).withColumn("cluster_id", F.lit("c")),
    }
    sqlfunctions.register(data.spark, frames)
    return data.spark


@query(
    "sql_slowest_jobs",
    f"""with {JOB_SECONDS} select cast(job_id as varchar) as job_id, runtimesec, rank() over (order by runtimesec desc) as place from j""",
)
def sql_slowest_jobs(data):
    rows = sql_session(data).sql("select jobId as job_id, runtimesec from getslowestjobs('c')")
    # the place of a listing is the number of slower rows, from counted run times: no window over the rows
    return drill.placed(rows, "runtimesec")


@query(
    "sql_job_metrics",
    f"with {JOB_SECONDS} select cast(job_id as varchar) as job_id, runtimesec from j where job_id in (select o_orderkey from orders where o_orderkey between 1 and 64)",
)
def sql_job_metrics(data):
    spark = sql_session(data)
    names = ", ".join(f"'{i}'" for i in range(1, 65))
    return spark.sql(f"select jobId as job_id, runtimesec from jobmetrics('c', array({names}))")


@query(
    "sql_stage_lookup",
    """select cast(application_id as varchar) as application_id, cast(stage_id as varchar) as stage_id, num_tasks::double as num_tasks, date_sub('second', submission_time, completion_time) as runtimesec
 from tel_stages where application_id = 7 and stage_id in (1, 2)""",
)
def sql_stage_lookup(data):
    spark = sql_session(data)
    one = spark.sql("select stageId as stage_id, numTasks as num_tasks, runtimesec from getstage('7', 1)")
    two = spark.sql("select stageId as stage_id, numTasks as num_tasks, runtimesec from stagemetrics('7', array('2'))")
    listed = spark.sql("select stageId as stage_id, numTasks as num_tasks, runtimesec from getsloweststages('7')").where("stage_id in ('1', '2')")
    return one.unionByName(two).intersect(listed).select(F.lit("7").alias("application_id"), "stage_id", "num_tasks", "runtimesec")


@query("sql_executor", "select executor_id as id, total_cores::double as total_cores, max_memory from tel_executors where executor_id in ('11', '25')")
def sql_executor(data):
    spark = sql_session(data)
    rows = [spark.sql(f"select id, totalCores as total_cores, maxMemory as max_memory from getexecutor('c', '{i}')") for i in (11, 25)]
    return rows[0].unionByName(rows[1])


@query(
    "sql_applications",
    """with t as (select cluster_id, count(distinct application_id) as n, 'summary ' || min(application_id) as summary from tel_stages where stage_id = 1 group by 1)
select cluster_id, cast(arg_min(application_id, 't' || lpad(cast(application_id * 7919 % 1000 as varchar), 4, '0') || application_id) as varchar) as application_id,
 count(*) as applications, max(case when t.n = 1 then t.summary end) as summary
 from tel_applications left join t using (cluster_id) group by cluster_id""",
)
def sql_applications(data):
    """First application of each cluster, and its task summary where the cluster has one application only."""
    spark = sql_session(data)
    ids = data("tel_applications").groupBy(F.col("cluster_id").cast("string").alias("cluster_id")).agg(F.count(F.lit(1)).alias("applications"))
    rows = spark.sql(
        "select cluster_id, applications, getappid(cluster_id) as application_id, taskmetrics(cluster_id, 1) as summary from {ids}", ids=ids
    )
    return rows.withColumn("cluster_id", F.col("cluster_id").cast("int"))


@query(
    "sql_snippets_by_size",
    f"with {EXECUTIONS} select count(*) as executions, true as listed from e",
)
def sql_snippets_by_size(data):
    spark = sql_session(data)
    found = spark.sql("select stringlength, rank from sqlmetrics('c', sizelimit => 1e12D)")
    slow = spark.sql("select id from getslowestsql('c')").agg(F.count(F.lit(1)).alias("n"))
    # ranks of sizes: the largest is the first, and a rank counts the larger ones
    return found.agg(F.count(F.lit(1)).alias("executions"), F.min("rank").alias("first")).join(slow, F.col("executions") == F.col("n")).select("executions", (F.col("first") == 1).alias("listed"))


# -- first applications and places ----------------------------------------------------------------------

@query(
    "first_application_by_start",
    """select cluster_id, arg_min(application_id, 't' || lpad(cast(application_id * 7919 % 1000 as varchar), 4, '0') || lpad(cast(application_id as varchar), 12, '0')) as application_id
 from tel_applications group by cluster_id""",
)
def first_application_by_start(data):
    start = F.concat(F.lit("t"), F.lpad((F.col("application_id") * 7919 % 1000).cast("string"), 4, "0"))
    return drill.first_application(data("tel_applications").withColumn("start_time", start))


@query(
    "slowest_jobs_places",
    f"with {JOB_SECONDS} select application_id, job_id, runtimesec, rank() over (order by runtimesec desc) as place from j",
)
def slowest_jobs_places(data):
    return drill.placed(job_seconds(data), "runtimesec").select("application_id", "job_id", "runtimesec", "place")


@query(
    "slowest_stages_places",
    """select cast(application_id as varchar) as application_id, stage_id, date_sub('second', submission_time, completion_time) as runtimesec,
 rank() over (order by date_sub('second', submission_time, completion_time) desc) as place from tel_stages""",
)
def slowest_stages_places(data):
    return drill.placed(history.run_seconds(stage_table(data)), "runtimesec").select("application_id", "stage_id", "runtimesec", "place")


# -- sketches ---------------------------------------------------------------------------------------------

@query(
    "sketched_quantiles",
    """with long as (
 select cluster_id, 'duration' as metric, duration_ms as v from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'input_bytes', input_bytes from tel_tasks where status = 'SUCCESS'
 union all select cluster_id, 'shuffle_read_bytes', shuffle_read_bytes from tel_tasks where status = 'SUCCESS')
select cluster_id, metric, count(v) as num_values, true as within_bound from long group by 1, 2 having count(v) > 0""",
)
def sketched_quantiles(data):
    """Sketches of stages, merged to clusters; the true ranks of the answers are within the stated bound."""
    metrics = ("duration", "input_bytes", "shuffle_read_bytes")
    tasks = successful_tasks(data)
    fine = sketches.metric_sketches(tasks, ["cluster_id", "application_id", "stage_id"], metrics)
    answers = stored(sketches.sketch_quantiles(sketches.merged(fine, ["cluster_id"]), LOG_PROBES))  # read three times below
    errors = sketches.rank_errors(tasks, ["cluster_id"], answers, LOG_PROBES)
    return answers.join(errors, ["cluster_id", "metric"]).select(
        "cluster_id", "metric", "num_values", (F.col("worst") <= sketches.RANK_ERROR).alias("within_bound")
    )
