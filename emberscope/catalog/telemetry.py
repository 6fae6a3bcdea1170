"""Telemetry-shaped views over the provided business tables.

The texts run unchanged in Spark and in the checking engine; ``{name}`` marks the
table or view a text reads.  Tables are never sampled.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.operators.keyed import balanced_join

VIEWS = {
    "tel_tasks": """
select s_nationkey as cluster_id, l_suppkey as application_id, stage_id, l_orderkey as task_order, l_linenumber as task_index, l_shipdate as launch_time,
 case kind when 1 then cast(floor(l_extendedprice / 10) as bigint)
           when 2 then 4000 + case when l_linenumber = 7 then 60000 else 0 end
           when 4 then 20000 + qty * 10 else 5000 + qty * 10 end as duration_ms,
 case kind when 1 then qty * 2000000 when 2 then qty * 20000000 when 3 then 0
           when 4 then qty * 100000 else 100000000 end as input_bytes,
 case when kind = 3 then qty * 25000000 else 0 end as shuffle_read_bytes,
 case when kind = 3 and l_discount >= 0.05 then qty * 10000000 else 0 end as memory_bytes_spilled,
 case when kind = 3 and l_discount >= 0.07 then qty * 8000000 else 0 end as disk_bytes_spilled,
 case when kind = 3 then 1000 + qty * 2 else 50 end as gc_ms,
 case when kind = 4 and l_returnflag = 'R' then 'FAILED'
      when kind = 3 and l_returnflag = 'R' and l_linenumber <= 2 then 'FAILED'
      when kind = 2 and l_returnflag = 'R' and l_linenumber = 1 then 'KILLED' else 'SUCCESS' end as status
from (select *, cast(l_quantity as bigint) as qty, l_partkey % 5 as stage_id,
             case when l_suppkey % 4 = 0 then 0 else l_partkey % 5 end as kind from {supplied_lineitem}) t""",
    "supplied_lineitem": "select * from lineitem join supplier on l_suppkey = s_suppkey",
    "tel_clusters": """
select n_nationkey as cluster_id, n_name as cluster_name, n_nationkey * 3 as normalized_instance_hours,
 date '2024-01-01' + n_nationkey as creation_date,
 case n_nationkey % 4 when 0 then 'TERMINATED' when 1 then 'WAITING' when 2 then 'RUNNING' else 'TERMINATED_WITH_ERRORS' end as state
from {nation}""",
    "tel_applications": """
select s_nationkey as cluster_id, s_suppkey as application_id, s_name as application_name,
 abs(cast(floor(s_acctbal) as bigint)) * 1000 as duration_ms from {supplier}""",
    "tel_stages": """
select cluster_id, application_id, stage_id,
 case when application_id % 5 = 1 and stage_id = 3 then 1 else 0 end as attempt_id,
 case when application_id % 3 = 1 and stage_id = 4 then 'FAILED' else 'COMPLETE' end as status,
 count(*) as num_tasks, cast(sum(case when status = 'SUCCESS' then 1 else 0 end) as bigint) as num_complete_tasks,
 cast(sum(case when status = 'FAILED' then 1 else 0 end) as bigint) as num_failed_tasks,
 cast(sum(input_bytes) as bigint) as input_bytes, cast(sum(shuffle_read_bytes) as bigint) as shuffle_read_bytes,
 cast(sum(memory_bytes_spilled) as bigint) as memory_bytes_spilled, cast(sum(disk_bytes_spilled) as bigint) as disk_bytes_spilled,
 cast(sum(duration_ms) as bigint) as executor_run_time, min(launch_time) as submission_time, max(launch_time) as completion_time
from {tel_tasks} group by cluster_id, application_id, stage_id""",
    "tel_jobs": """
select o_custkey % 10 + 1 as application_id, o_orderkey as job_id, o_orderpriority as job_name,
 case when o_orderstatus = 'P' then 'JobFailed' else 'JobSucceeded' end as status,
 o_orderdate as submission_time, o_orderdate + interval '1' second * cast(floor(o_totalprice / 1000) as int) as completion_time,
 cast(floor(o_totalprice / 1000) as bigint) as num_tasks,
 case when o_orderstatus = 'F' then cast(floor(o_totalprice / 1000) as bigint) else cast(floor(o_totalprice / 1000) as bigint) - cast(floor(o_totalprice / 10000) as bigint) end as num_completed_tasks
from {orders}""",
    "tel_executors": """
select c_custkey % 10 + 1 as application_id, cast(c_custkey as varchar(20)) as executor_id, c_custkey % 5 <> 0 as is_active,
 4 as total_cores, cast(4294967296 as bigint) as max_memory, abs(cast(floor(c_acctbal) as bigint)) * 1000 as total_duration,
 abs(cast(floor(c_acctbal) as bigint)) * case when c_custkey % 10 + 1 = 4 then 200 else 20 end as total_gc_time
from {customer}""",
    "tel_sql_nodes": """
select p_partkey % 10 + 1 as application_id, p_partkey % 40 as sql_id, p_partkey as node_id,
 case p_partkey % 12 when 0 then 'MapElements' when 1 then 'Scan csv ' when 2 then 'SortMergeJoin' when 3 then 'PythonUDF'
  when 4 then 'Scan parquet ' when 5 then 'HashAggregate' when 6 then 'Exchange' when 7 then 'ShuffledHashJoin'
  when 8 then 'DeserializeToObject' when 9 then 'Sort' when 10 then 'Project' else 'Filter' end as node_name,
 cast(p_size as bigint) as output_rows, case when p_partkey % 24 = 2 then '1' else '0' end as skew_indicator
from {part}""",
    "tel_sql": """
select application_id, sql_id, case when sql_id % 13 = 5 then 'FAILED' else 'COMPLETED' end as status,
 count(*) as num_nodes, cast(sum(output_rows) as bigint) * 240 as duration_ms from {tel_sql_nodes} group by application_id, sql_id""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _supplied_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier; a supplier may hold a large share of them."""
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    known = suppliers.withColumn("l_suppkey", F.col("s_suppkey"))
    return balanced_join(items, known, ["l_suppkey"], "inner")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry view, or a provided table, as a DataFrame."""
    if name == "supplied_lineitem":
        return _supplied_lineitem(spark, sf_dir)
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {ref: view(spark, sf_dir, ref) for ref in dict.fromkeys(_REFERENCE.findall(text))}
    return spark.sql(text, **inputs)


def with_views(statement: str) -> str:
    """Prefix a checking statement with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                needed.append(name)

    visit(statement)
    if not needed:
        return statement
    parts = [f"{name} as ({_REFERENCE.sub(lambda m: m.group(1), VIEWS[name]).strip()})" for name in needed]
    head = "with " + ",\n".join(parts)
    body = statement.strip()
    if body.lower().startswith("with recursive"):
        return head.replace("with ", "with recursive ", 1) + ",\n" + body[len("with recursive"):]
    if body.lower().startswith("with "):
        return head + ",\n" + body[len("with "):]
    return head + "\n" + body
