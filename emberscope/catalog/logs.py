"""Event-log lines built from the provided tables, every row of them.

Orders are jobs with three stages each, line items are tasks, parts are plan nodes
(16 to an execution).  Positions are chosen so that jobs overlap, stages are shared
and skipped, tasks end late, and accumulator look-ups take every path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.catalog.registry import Data
from emberscope.sources.eventlog import EVENTS, event_order


def order_key() -> Column:
    return F.col("o_orderkey")


def order_application() -> Column:
    return (F.floor(order_key() / 3) % 10 + 1).cast("string")


def _lines(df: DataFrame, kind: str, application: Column, position: Column, fields: dict[str, Column]) -> DataFrame:
    body = F.to_json(F.struct(F.lit(EVENTS[kind]).alias("Event"), *[c.alias(n) for n, c in fields.items()]))
    return df.select(
        application.alias("application_id"),
        event_order(F.lit(0), position, F.lit(0)).alias("event_order"),  # rows of one scan number 2^33 at most, positions do not
        body.alias("body"),
        F.lit(EVENTS[kind]).alias("event"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n.replace("_", " ")) for n, c in fields.items()])


def _shared() -> Column:
    return 3 * (F.floor(order_key() / 200) * 200) + 2


def job_lines(data: Data) -> DataFrame:
    """Job and stage events of every order."""
    orders, key, app = data("orders").repartition("o_orderkey"), order_key(), order_application()
    base, a_tasks = key * 1000, 4 + key % 3

    def info(stage, tasks, name="stage"):
        return _struct(Stage_ID=stage, Stage_Name=F.lit(name), Number_of_Tasks=tasks)

    infos = F.array(info(3 * key, a_tasks, "first"), info(3 * key + 1, F.lit(2).cast("bigint")), info(_shared(), F.lit(5).cast("bigint")))
    properties = F.create_map(
        F.lit("spark.job.description"), F.col("o_orderpriority"), F.lit("spark.job.tags"), F.lit(" etl, ,nightly"),
        F.lit("spark.sql.execution.id"), F.when(key % 17 == 0, "none").otherwise(F.floor(key / 64).cast("string")),
    )

    def stage(stage_id, attempt, tasks, submitted, completed=None, reason=None, accumulables=None):
        fields = {"Stage ID": stage_id, "Stage Attempt ID": attempt, "Stage Name": F.lit("run"), "Number of Tasks": tasks, "Submission Time": submitted}
        if completed is not None:
            fields |= {"Completion Time": completed, "Failure Reason": reason, "Accumulables": accumulables}
        return {"Stage Info": F.struct(*[c.alias(n) for n, c in fields.items()])}

    def accumulable(name, value):
        return F.struct(F.lit(f"internal.metrics.{name}").alias("Name"), value.cast("string").alias("Value"))

    spilled = F.array(
        accumulable("memoryBytesSpilled", F.lit(1)), accumulable("memoryBytesSpilled", key % 100), accumulable("input.bytesRead", F.lit("many")),
        accumulable("shuffle.read.localBytesRead", key % 10), accumulable("shuffle.read.remoteBytesRead", key % 7),
    )
    none = F.array().cast("array<struct<Name:string,Value:string>>")
    broken = F.when((F.col("o_orderstatus") == "P") & (key % 3 == 0), "lost")
    zero, attempt = F.lit(0).cast("bigint"), F.floor(key / 50) % 4
    some, two, five = key % 50 == 7, F.lit(2).cast("bigint"), F.lit(5).cast("bigint")
    return _union([
        _lines(orders, "job_start", app, base, {"Job ID": key, "Submission Time": base, "Stage Infos": infos, "Properties": properties}),
        _lines(orders.where(key % 11 != 0), "job_end", app, base + 30 + 20001 * (key % 7), {
            "Job ID": key, "Completion Time": base + 30,
            "Job Result": F.struct(F.when(F.col("o_orderstatus") == "P", "JobFailed").otherwise("JobSucceeded").alias("Result")),
        }),
        _lines(orders, "stage_submitted", app, base + 1, stage(3 * key, zero, a_tasks, base + 1)),
        _lines(orders, "stage_completed", app, base + F.when(key % 5 == 0, 15).otherwise(20), stage(3 * key, zero, a_tasks, base + 1, base + 20, broken, spilled)),
        _lines(orders.where(key % 2 == 1), "stage_submitted", app, base + 3, stage(3 * key + 1, zero, two, zero)),
        _lines(orders.where(key % 2 == 1), "stage_completed", app, base + 25, stage(3 * key + 1, zero, two, base + 3, base + 25, F.lit(""), none)),
        _lines(orders.where(some), "stage_submitted", app, base + 5, stage(_shared(), attempt, five, base + 5)),
        _lines(orders.where(some), "stage_completed", app, base + 9, stage(_shared(), attempt, five, base + 5, base + 9, F.when(key % 100 == 7, "lost"), none)),
    ])


def _task_fields(stage_id: Column, attempt: Column) -> dict[str, Column]:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("bigint")
    reason = F.when(flag == "R", "ExceptionFailure").when((flag == "A") & (line == 3), "TaskKilled").otherwise("Success")
    metrics = F.struct(
        (quantity * 10).alias("Executor Run Time"), F.lit(5).alias("Executor Deserialize Time"), (quantity % 3).alias("JVM GC Time"),
        F.struct((quantity * 1000).alias("Bytes Read"), quantity.alias("Records Read")).alias("Input Metrics"),
        F.struct((quantity * 7).alias("Remote Bytes Read"), (quantity * 2).alias("Local Bytes Read"), line.alias("Local Blocks Fetched")).alias("Shuffle Read Metrics"),
        F.struct(F.floor("l_extendedprice").alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
    )
    info = F.struct(
        F.lit(1000).alias("Launch Time"), (1000 + quantity * 10 + line * 7).alias("Finish Time"),
        (flag == "R").alias("Failed"), (reason == "TaskKilled").alias("Killed"),
    )
    return {"Stage ID": stage_id, "Stage Attempt ID": attempt, "Task End Reason": F.struct(reason.alias("Reason")), "Task Info": info, "Task Metrics": metrics}


def order_task_lines(data: Data) -> DataFrame:
    """Line items as tasks of the first stage of their order."""
    items = data("lineitem").repartition("l_orderkey", "l_linenumber").withColumn("o_orderkey", F.col("l_orderkey"))
    return _lines(items, "task_end", order_application(), order_key() * 1000 + 10 + F.col("l_linenumber"), _task_fields(3 * order_key(), F.lit(0)))


def supplier_task_lines(data: Data) -> DataFrame:
    """Line items as tasks of five large stages per supplier."""
    items, supplier = data("lineitem").repartition("l_orderkey", "l_linenumber"), F.col("l_suppkey")
    fields = _task_fields(F.col("l_partkey") % 5, F.when(F.col("l_partkey") % 40 == 3, 1).otherwise(0))
    return _lines(items, "task_end", supplier.cast("string"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), fields)


def job_events(data: Data) -> DataFrame:
    return job_lines(data).unionByName(order_task_lines(data))


def sql_lines(data: Data, explained: bool = True) -> DataFrame:
    """SQL events: executions of 16 parts each, a three-level plan, and accumulator updates.

    Plans of open-source Spark carry no ``explainId``: ``explained=False``.
    """
    numbered = (lambda column: [column.alias("explainId")]) if explained else (lambda column: [])
    part = F.col("p_partkey")
    execution = F.floor(part / 16)
    application = (F.col("execution") % 10 + 1).cast("string")
    name = F.expr(
        "case p_partkey % 12 when 0 then 'MapElements' when 1 then 'Scan csv ' when 2 then 'SortMergeJoin' when 3 then 'PythonUDF' "
        "when 7 then 'ShuffledHashJoin' else 'Project' end"
    )

    def metric(label, identifier):
        return F.struct(F.lit(label).alias("name"), identifier.cast("bigint").alias("accumulatorId"), F.lit("sum").alias("metricType"))

    metrics = F.array(metric("number of output rows", part * 2), metric("Cancellation Is Skewed", part * 2 + 1), metric("mapped rows", -part - 1))
    parts = data("part").select(
        "p_partkey", execution.alias("execution"), F.floor(part / 4).alias("branch"), F.col("p_size").cast("bigint").alias("size"),
        F.struct(name.alias("nodeName"), *numbered(part + 1), metrics.alias("metrics")).alias("node"),
    )
    # at most four nodes to a branch and four branches to an execution
    branches = parts.groupBy("execution", "branch").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "node"))).alias("nodes"))
    head, rest = F.get("nodes", 0), F.transform(F.slice("nodes", 2, 3), lambda n: n["node"])
    grown = branches.select(
        "execution", "branch",
        F.struct(
            head["node"]["nodeName"].alias("nodeName"), *(numbered(head["node"]["explainId"]) if explained else []),
            head["node"]["metrics"].alias("metrics"), rest.alias("children"),
        ).alias("tree"),
    )
    plans = grown.groupBy("execution").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("branch", "tree"))), lambda b: b["tree"]).alias("children")
    )
    root = F.struct(F.lit("Root").alias("nodeName"), *numbered(F.lit(0)), F.array().cast("array<struct<name:string,accumulatorId:bigint>>").alias("metrics"), "children")
    e = F.col("execution")
    base = e * 10000
    drivers = parts.where(part % 3 == 0).groupBy("execution").agg(F.sort_array(F.collect_list(F.array(part * 2, F.col("size")))).alias("pairs"))
    later = parts.where(part % 6 == 0).groupBy("execution").agg(F.sort_array(F.collect_list(F.array(part * 2, F.col("size") + 100))).alias("pairs"))
    named = F.lit("== Physical Plan ==\nAdaptive (3)\n+- * Project (2)\n   +- Scan parquet  (1)\n\n\n(1) Scan parquet \nOutput: x (7)")

    def reported(label, identifier, value):
        return F.struct(identifier.alias("ID"), F.lit(label).alias("Name"), value.cast("string").alias("Value"), F.lit("sql").alias("Metadata"))

    other = F.struct((part * 2).alias("ID"), F.lit("number of output rows").alias("Name"), F.lit("7").alias("Value"), F.lit("internal").alias("Metadata"))
    rows = F.when(part % 3 == 1, F.array(reported("number of output rows", part * 2, F.col("size") * 10), other)).otherwise(
        F.array(reported("Cancellation Is Skewed", part * 2 + 1, F.lit(1)), reported("broken", part, F.lit("no number")))
    )
    mapped = F.when(e % 5 == 0, F.lit(-99).cast("bigint")).otherwise(e * 32)
    return _union([
        _lines(plans, "sql_start", application, base, {"executionId": e, "description": F.concat(F.lit("query "), e), "time": e * 1000 + 1, "sparkPlanInfo": root}),
        _lines(plans.where("execution % 9 <> 0"), "sql_end", application, base + 9000, {
            "executionId": e, "time": e * 1000 + 1 + (e % 700) * 1000, "errorMessage": F.when(e % 13 == 5, "boom").otherwise(""),
        }),
        _lines(plans.where("execution % 8 = 0"), "sql_adaptive_update", application, base + 10, {"executionId": e, "physicalPlanDescription": named}),
        _lines(plans.where("execution % 12 = 0"), "sql_adaptive_update", application, base + 20, {"executionId": e, "physicalPlanDescription": F.lit("== Physical Plan ==\nnothing")}),
        _lines(drivers, "driver_accum_updates", application, base + 30, {"executionId": e, "accumUpdates": F.col("pairs")}),
        _lines(later, "driver_accum_updates", application, base + 31, {"executionId": e, "accumUpdates": F.col("pairs")}),
        _lines(plans.where("execution % 2 = 0 or execution % 5 = 0"), "sql_metric_updates", application, base + 32, {
            "executionId": e, "sqlPlanMetrics": F.array(F.struct(F.lit("mapped rows").alias("name"), mapped.alias("accumulatorId"))),
        }),
        _lines(parts.where((part % 3 == 1) | (part % 24 == 2)), "task_end", application, base + 100 + part % 16, {
            "Stage ID": e, "Stage Attempt ID": F.lit(0), "Task End Reason": F.struct(F.lit("Success").alias("Reason")),
            "Task Info": F.struct(rows.alias("Accumulables")),
        }),
    ])
