"""SQL executions, their plan nodes, node metrics and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.operators import events as ev
from emberscope.operators.keyed import balanced_join
from emberscope.runtime import stored

EXECUTION = ["application_id", "execution_id"]

_OPEN = "array<struct<path:array<int>,fields:map<string,variant>>>"
_NODE = "struct<path:array<int>,node_id:int,node_name:string,metrics:array<struct<name:string,accumulator_id:bigint>>>"


def _fields(value: Column) -> Column:
    """The fields of a JSON object, one level deep; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _node_entry(node: Column) -> Column:
    fields = node["fields"]
    metrics = F.transform(
        F.transform(_items(fields["metrics"]), _fields),
        lambda m: F.struct(
            F.try_variant_get(m["name"], "$", "string").alias("name"),
            F.try_variant_get(m["accumulatorId"], "$", "bigint").alias("accumulator_id"),
        ),
    )
    return F.struct(
        node["path"].alias("path"), F.try_variant_get(fields["explainId"], "$", "int").alias("node_id"),
        F.coalesce(F.try_variant_get(fields["nodeName"], "$", "string"), F.lit("")).alias("node_name"),
        F.filter(metrics, lambda m: m["name"].isNotNull() & m["accumulator_id"].isNotNull()).alias("metrics"),
    )


def _child_nodes(node: Column) -> Column:
    found = F.transform(
        _items(node["fields"]["children"]),
        lambda child, i: F.struct(F.concat(node["path"], F.array(i)).alias("path"), _fields(child).alias("fields")),
    )
    return F.filter(found, lambda child: child["fields"].isNotNull())


def plan_tree_nodes(plan: Column, by_position: bool = False) -> Column:
    """Flatten a plan tree held as JSON text, depth first; the first node of an id wins.

    Trees nest without a fixed depth.  They are walked breadth first as variants, a level a step: a frontier of open nodes with
    the path of child numbers that leads to each.  Paths in order give the depth-first order.  No level lies below
    the number of times ``children`` occurs in the text, and steps without a frontier do nothing.
    """
    empty = F.array().cast(_OPEN)
    root = F.filter(F.array(F.struct(F.array().cast("array<int>").alias("path"), _fields(F.try_parse_json(plan)).alias("fields"))), lambda n: n["fields"].isNotNull())
    word = '"children"'
    levels = F.coalesce(F.floor((F.length(plan) - F.length(F.replace(plan, F.lit(word), F.lit("")))) / len(word)).cast("int"), F.lit(0))
    start = F.struct(root.cast(_OPEN).alias("open"), F.array().cast(f"array<{_NODE}>").alias("done"))

    def deeper(state: Column, _: Column) -> Column:
        next_level = F.struct(
            F.flatten(F.transform(state["open"], _child_nodes)).alias("open"),
            F.concat(state["done"], F.transform(state["open"], _node_entry)).alias("done"),
        )
        return F.when(F.size(state["open"]) > 0, next_level).otherwise(state)

    walked = F.aggregate(F.sequence(F.lit(0), levels), start, deeper, lambda state: F.array_sort(state["done"]))
    number = (lambda node, i: i) if by_position else (lambda node, i: node["node_id"])
    numbered = F.transform(
        walked,
        lambda node, i: F.struct(
            i.alias("position"), number(node, i).alias("node_id"), node["node_name"].alias("node_name"), node["metrics"].alias("metrics")
        ),
    )
    named = F.filter(numbered, lambda node: node["node_id"].isNotNull() & (node["node_name"] != ""))
    if by_position:
        return named
    both = F.array(F.struct(named.alias("nodes"), F.transform(named, lambda node: node["node_id"]).alias("ids")))
    firsts = F.transform(both, lambda b: F.filter(b["nodes"], lambda node, i: F.array_position(b["ids"], node["node_id"]) == i + 1))
    return F.get(firsts, 0)


def _plan_lines(text: Column) -> Column:
    """Lines of a plan text, stripped of white space and tree drawing."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("=="))
    return F.transform(kept, lambda x: F.regexp_replace(x, r"^[+\- *:|]+", ""))


# Fixed value: a node line of a formatted plan.
_NODE_LINE = r"^(.+?)\s*\((\d+)\)"


def plan_text_nodes(plans: DataFrame, text: str = "plan_description") -> DataFrame:
    """Nodes named in a formatted plan, one row per id (first line wins)."""
    lines = plans.select(*EXECUTION, F.posexplode(_plan_lines(F.col(text))).alias("position", "line")).where(
        F.col("line").rlike(_NODE_LINE)
    )
    found = lines.select(
        *EXECUTION,
        "position",
        F.regexp_extract("line", _NODE_LINE, 2).try_cast("int").alias("node_id"),
        F.trim(F.regexp_extract("line", _NODE_LINE, 1)).alias("node_name"),
    ).where(F.col("node_id").isNotNull() & (F.col("node_name") != ""))
    return found.groupBy(*EXECUTION, "node_id").agg(
        F.min("position").alias("position"), F.min_by("node_name", "position").alias("node_name")
    )


def sql_starts(events: DataFrame) -> DataFrame:
    return ev.parsed(events, "sql_start").select(
        "application_id",
        F.coalesce("e.executionId", F.lit(0)).alias("execution_id"),
        F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce("e.time", F.lit(0)).alias("start_ms"),
        F.col("e.sparkPlanInfo").alias("plan_info"),
    )


def sql_ends(events: DataFrame) -> DataFrame:
    failed = F.coalesce("e.errorMessage", F.lit("")) != ""
    return ev.parsed(events, "sql_end").select(
        "application_id",
        F.coalesce("e.executionId", F.lit(0)).alias("execution_id"),
        F.coalesce("e.time", F.lit(0)).alias("end_ms"),
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("end_status"),
    )


def adaptive_plans(events: DataFrame) -> DataFrame:
    """Latest plan text and tree per execution, and the latest text that names nodes.

    The positions of the winners are found on narrow rows; the texts, which are long, are fetched afterwards by them, so
    no aggregation holds one.
    """
    text = F.col("e.physicalPlanDescription")
    names_nodes = F.exists(_plan_lines(F.coalesce(text, F.lit(""))), lambda x: x.rlike(_NODE_LINE))
    order = F.col("event_order")
    updates = stored(
        ev.parsed(events, "sql_adaptive_update")
        .select("application_id", F.col("e.executionId").alias("execution_id"), text.alias("text"),
                F.col("e.sparkPlanInfo").alias("tree"), names_nodes.alias("named"), "event_order")
        .withColumns({"has_text": F.col("text").isNotNull(), "has_tree": F.col("tree").isNotNull()})
    )
    newest = updates.groupBy(*EXECUTION).agg(
        F.max(F.when(F.col("has_text"), order)).alias("plan_order"),
        F.max(F.when(F.col("named"), order)).alias("named_order"),
        F.max(F.when(F.col("has_tree"), order)).alias("tree_order"),
    )

    def fetched(position: str, column: str, name: str) -> DataFrame:
        wanted = newest.where(F.col(position).isNotNull()).select(*EXECUTION, F.col(position).alias("event_order"))
        return updates.select(*EXECUTION, "event_order", F.col(column).alias(name)).join(wanted, [*EXECUTION, "event_order"]).drop("event_order")

    return (
        newest.select(*EXECUTION)
        .join(fetched("plan_order", "text", "plan_description"), EXECUTION, "left")
        .join(fetched("named_order", "text", "named_plan"), EXECUTION, "left")
        .join(fetched("tree_order", "tree", "latest_tree"), EXECUTION, "left")
    )


def executions(events: DataFrame) -> DataFrame:
    """One row per SQL execution: status, duration and plan texts."""
    joined = (
        sql_starts(events)
        .join(sql_ends(events), EXECUTION, "left")
        .join(adaptive_plans(events), EXECUTION, "left")
    )
    both = (F.col("start_ms") != 0) & (F.coalesce("end_ms", F.lit(0)) != 0)
    return joined.select(
        *EXECUTION,
        F.coalesce("end_status", F.lit("RUNNING")).alias("status"),
        "description",
        F.coalesce("plan_description", F.lit("")).alias("plan_description"),
        "start_ms",
        F.when(both, F.col("end_ms") - F.col("start_ms")).otherwise(0).alias("duration_ms"),
        "plan_info",
        "named_plan",
        "latest_tree",
    )


def plan_nodes(execution_rows: DataFrame, corrected: bool = False) -> DataFrame:
    """Plan nodes per execution with their metric definitions.

    Nodes named by an adaptive plan text replace those of the start event and carry
    no metrics; ids come from ``explainId``.  ``corrected`` flattens the latest tree
    and numbers nodes by position, which also works for logs without that field.
    """
    tree = F.coalesce("latest_tree", "plan_info") if corrected else F.col("plan_info")
    source = execution_rows if corrected else execution_rows.where(F.col("named_plan").isNull())
    from_tree = source.select(*EXECUTION, F.inline(plan_tree_nodes(tree, corrected)))
    if corrected:
        return from_tree
    named = execution_rows.where(F.col("named_plan").isNotNull())
    none = F.array().cast("array<struct<name:string,accumulator_id:bigint>>")
    from_text = plan_text_nodes(named, "named_plan").withColumn("metrics", none)
    return from_tree.unionByName(from_text)


def task_accumulators(events: DataFrame) -> DataFrame:
    """SQL accumulables reported by tasks: id, name, value and position."""
    items = F.posexplode("e.`Task Info`.Accumulables").alias("item_no", "item")
    rows = ev.parsed(events, "task_end", ev.TASK_ACCUMULABLES).select("application_id", "event_order", items)
    return rows.where((F.col("item.Metadata") == "sql") & F.col("item.ID").isNotNull()).select(
        "application_id",
        F.col("item.ID").alias("accumulator_id"),
        F.coalesce("item.Name", F.lit("")).alias("metric_name"),
        F.coalesce("item.Value", F.lit("0")).try_cast("bigint").alias("value"),
        F.struct("event_order", "item_no").alias("seen"),
    ).where(F.col("value").isNotNull())


def latest_task_values(events: DataFrame) -> DataFrame:
    """``(application_id, accumulator_id, metric_name, value)``: the last value by id (no name), and by name (no id).

    One aggregation with both groupings, combined on the map side, so task ends are parsed once.
    """
    by = [["application_id", "accumulator_id"], ["application_id", "metric_name"]]
    folded = task_accumulators(events).groupingSets(by, "application_id", "accumulator_id", "metric_name").agg(
        F.max_by("value", "seen").alias("value"), F.grouping("metric_name").alias("nameless")
    )
    return folded.where((F.col("nameless") == 1) | (F.col("metric_name") != ""))


def driver_accumulators(events: DataFrame) -> DataFrame:
    """Last driver-side value per execution and accumulator."""
    rows = ev.parsed(events, "driver_accum_updates").select(
        "application_id", F.col("e.executionId").alias("execution_id"), "event_order",
        F.posexplode("e.accumUpdates").alias("item_no", "pair"),
    )
    return rows.where(F.size("pair") >= 2).groupBy(*EXECUTION, F.get("pair", 0).alias("accumulator_id")).agg(
        F.max_by(F.get("pair", 1), F.struct("event_order", "item_no")).alias("value")
    )


def metric_mappings(events: DataFrame) -> DataFrame:
    """Last accumulator id per execution and metric name from adaptive metric updates."""
    rows = ev.parsed(events, "sql_metric_updates").select(
        "application_id", F.col("e.executionId").alias("execution_id"), "event_order",
        F.posexplode("e.sqlPlanMetrics").alias("item_no", "m"),
    )
    usable = F.col("m.accumulatorId").isNotNull() & (F.coalesce("m.name", F.lit("")) != "")
    return rows.where(usable).groupBy(*EXECUTION, F.col("m.name").alias("metric_name")).agg(
        F.max_by("m.accumulatorId", F.struct("event_order", "item_no")).alias("mapped_id")
    )


def node_metrics(nodes: DataFrame, events: DataFrame, corrected: bool = False) -> DataFrame:
    """One row per node metric that has a value.

    A value is looked up in the execution's driver updates, in task accumulators by
    id, through the adaptive name mapping, and last by metric name over the whole
    log.  A mapping whose target has no value ends the search.  ``corrected`` keeps
    looking by id only and never borrows a value from another execution.
    """
    defined = nodes.select(
        *EXECUTION, "node_id", "node_name", F.posexplode("metrics").alias("metric_no", "m")
    ).select(*EXECUTION, "node_id", "node_name", "metric_no", F.col("m.name").alias("metric_name"), F.col("m.accumulator_id").alias("accumulator_id"))
    driver = stored(driver_accumulators(events))
    tasks = stored(latest_task_values(events))
    by_id = tasks.where("nameless = 1").select("application_id", "accumulator_id", "value")

    def renamed(frame, **names):
        return frame.withColumnsRenamed(names)

    # mappings are resolved on their own: few metrics have one, and NULL ids would pile up in a join
    mappings = (
        metric_mappings(events)
        .join(renamed(driver, value="mapped_own", accumulator_id="mapped_id"), [*EXECUTION, "mapped_id"], "left")
        .join(renamed(by_id, value="mapped_seen", accumulator_id="mapped_id"), ["application_id", "mapped_id"], "left")
        .select(*EXECUTION, "metric_name", "mapped_id", F.coalesce("mapped_own", "mapped_seen").alias("mapped_value"))
    )
    rows = (
        defined.join(renamed(driver, value="own"), [*EXECUTION, "accumulator_id"], "left")
        .join(renamed(by_id, value="seen_id"), ["application_id", "accumulator_id"], "left")
        .join(mappings, [*EXECUTION, "metric_name"], "left")
    )
    direct, mapped = F.coalesce("own", "seen_id"), F.col("mapped_value")
    if corrected:
        value = F.coalesce(direct, mapped)
    else:
        by_name = tasks.where("nameless = 0").select("application_id", "metric_name", F.col("value").alias("named"))
        # a common metric name is shared by most rows of an application
        rows = balanced_join(rows, by_name, ["application_id", "metric_name"], "left")
        value = F.when(direct.isNotNull(), direct).when(F.col("mapped_id").isNotNull(), mapped).otherwise(F.col("named"))
    return rows.select(
        *EXECUTION, "node_id", "node_name", "metric_no", "metric_name", value.cast("string").alias("metric_value")
    ).where(F.col("metric_value").isNotNull())


def execution_jobs(events: DataFrame) -> DataFrame:
    """Ended jobs of every known execution, one row per job.

    A join over the whole log, so the order of events does not matter.
    """
    starts = ev.job_starts(events).where(F.col("execution_id").isNotNull()).select("application_id", "job_id", "execution_id")
    ends = ev.job_ends(events).where("status <> ''").select("application_id", "job_id", "status")
    known = sql_starts(events).select(*EXECUTION).distinct()
    ended = starts.join(ends, ["application_id", "job_id"])
    return balanced_join(ended, known, EXECUTION, "inner")


def execution_job_lists(jobs: DataFrame) -> DataFrame:
    """Succeeded job ids as a list, failed ones joined by commas; one row per execution.

    The list is part of the published shape of an execution; the relation itself is ``execution_jobs``.
    """
    ok = F.col("status") == "JobSucceeded"

    def listed(condition):
        ids = F.array_sort(F.collect_list(F.when(condition, F.col("job_id"))))
        return F.transform(ids, lambda j: j.cast("string"))

    return jobs.groupBy(*EXECUTION).agg(
        listed(ok).alias("success_job_ids"), F.array_join(listed(~ok), ",").alias("failed_job_ids")
    )


def nested_nodes(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Nodes of an execution as one array; all of them come from a single plan event."""
    key = [*EXECUTION, "node_id"]
    listed = metrics.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("metric_no", F.col("metric_name").alias("name"), F.col("metric_value").alias("value")))),
            lambda m: F.struct(m["name"].alias("name"), m["value"].alias("value")),
        ).alias("metric_values")
    )
    empty = F.array().cast("array<struct<name:string,value:string>>")
    full = nodes.select(*key, "node_name", "position").join(listed, key, "left")
    entry = F.struct(
        "position", F.col("node_id").alias("nodeId"), F.col("node_name").alias("nodeName"), F.coalesce("metric_values", empty).alias("metrics")
    )
    ordered = F.array_sort(F.collect_list(entry))
    return full.groupBy(*EXECUTION).agg(
        F.transform(ordered, lambda n: F.struct(n["nodeId"].alias("nodeId"), n["nodeName"].alias("nodeName"), n["metrics"].alias("metrics"))).alias("nodes")
    )
