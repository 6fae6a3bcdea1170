"""Hand-written logs, and a real log written by Spark itself."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from emberscope.operators import accounting, sqlplans
from emberscope.operators import events as ev
from emberscope.plans.eventlog import EventLog
from emberscope.sources import eventlog

UI = "org.apache.spark.sql.execution.ui."


def job_start(job, stages, **properties):
    return {
        "Event": "SparkListenerJobStart", "Job ID": job, "Submission Time": 1000 * job + 1,
        "Stage Infos": [{"Stage ID": s, "Stage Name": f"stage {s}", "Number of Tasks": n} for s, n in stages],
        "Properties": {"spark.jobGroup.id": "g", **properties},
    }


def job_end(job, result="JobSucceeded"):
    return {"Event": "SparkListenerJobEnd", "Job ID": job, "Completion Time": 1000 * job + 900, "Job Result": {"Result": result}}


def submitted(stage, attempt=0, tasks=2):
    return {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": stage, "Stage Attempt ID": attempt, "Stage Name": f"stage {stage}", "Number of Tasks": tasks, "Submission Time": 5}}


def completed(stage, attempt=0, tasks=2, reason=None, accumulables=()):
    info = {"Stage ID": stage, "Stage Attempt ID": attempt, "Stage Name": f"stage {stage}", "Number of Tasks": tasks, "Submission Time": 5, "Completion Time": 77, "Accumulables": list(accumulables)}
    if reason:
        info["Failure Reason"] = reason
    return {"Event": "SparkListenerStageCompleted", "Stage Info": info}


def task(stage, reason="Success", attempt=0, run=10, launch=100, finish=150, accumulables=(), **info):
    return {
        "Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": attempt, "Task End Reason": {"Reason": reason},
        "Task Info": {"Launch Time": launch, "Finish Time": finish, "Getting Result Time": 0, "Accumulables": list(accumulables), **info},
        "Task Metrics": {"Executor Run Time": run, "Shuffle Read Metrics": {"Remote Bytes Read": 3, "Local Bytes Read": 4}},
    }


def write(path, events):
    with open(path, "w") as f:
        for e in events:
            f.write((e if isinstance(e, str) else json.dumps(e)) + "\n")
    return str(path)


def jobs_of(spark, path):
    rows = accounting.jobs(eventlog.read_event_log(spark, path)).collect()
    return {r.job_id: r for r in rows}


def test_skipped_shared_and_retried_stages(spark, tmp_path):
    path = write(tmp_path / "app-1", [
        job_start(0, [(1, 2), (2, 3), (9, 4)]),
        submitted(1), task(1), task(1, "ExceptionFailure", Failed=True), task(1, "TaskKilled", Killed=True, Failed=False), completed(1),
        task(1),  # ends after the stage: not counted for the stage
        job_start(1, [(9, 4), (3, 1)]),
        job_end(0),                     # stage 2 skipped (only reference), stage 9 skipped (job 1 still open)
        submitted(3), completed(3, reason="lost"), submitted(3, 1), completed(3, 1),
        job_end(1, "JobFailed"),        # stage 9: last referring job, not skipped; stage 3: first attempt failed
        job_start(2, [(1, 2)]), job_end(2),  # stage 1 ran before this job: neither run nor skipped
        job_start(3, [(4, 1)], **{"spark.job.tags": " a, ,b"}),
    ])
    jobs = jobs_of(spark, path)

    def counts(j):
        r = jobs[j]
        return (r.num_completed_stages, r.num_failed_stages, r.num_skipped_stages, r.num_completed_tasks, r.num_failed_tasks, r.num_skipped_tasks)

    assert counts(0) == (1, 0, 2, 1, 1, 7)
    assert counts(1) == (0, 1, 0, 0, 0, 0)
    assert counts(2) == (0, 0, 0, 0, 0, 0)
    assert counts(3) == (0, 0, 0, 0, 0, 0)
    assert [jobs[j].status for j in range(4)] == ["JobSucceeded", "JobFailed", "JobSucceeded", ""]
    assert jobs[3].job_tags == ["a", "b"] and jobs[3].num_tasks == 1.0 and jobs[3].job_group == "g" and jobs[0].name == "stage 1"
    outcomes = {r.stage_id: (r.completed, r.failed, r.killed) for r in accounting.outcome_counts(eventlog.read_event_log(spark, path)).collect()}
    assert outcomes == {1: (2, 1, 1)}


def test_malformed_blank_and_unknown_lines(spark, tmp_path):
    path = write(tmp_path / "log", [job_start(0, []), "", "   ", '{"Event":"SparkListenerJobEnd","Job ID":0,', "no json", {"Event": "SparkListenerUnpersistRDD"}, job_end(0)])
    assert jobs_of(spark, path)[0].status == "JobSucceeded"
    assert [tuple(r)[1:] for r in eventlog.malformed_counts(eventlog.read_lines(spark, path)).collect()] == [(5, 2)]


def test_file_selection_compression_and_applications(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "eventlog_v2_app-7").mkdir(parents=True)
    write(folder / "eventlog_v2_app-7" / "events_2_app-7", [job_end(0, "JobFailed")])
    write(folder / "eventlog_v2_app-7" / "events_10_app-7", [job_end(1)])
    write(folder / "eventlog_v2_app-7" / "events_1_app-7", [job_start(0, []), job_start(1, [])])
    with gzip.open(folder / "app-8.gz", "wt") as f:
        f.write(json.dumps(job_start(5, [])) + "\n")
    with open(folder / "app-9.gz", "wb") as f:
        f.write(b"\x1f\x8bthis is no gzip")
    write(folder / "settings.json", [job_start(99, [])])
    rows = accounting.jobs(eventlog.read_event_log(spark, str(folder))).collect()
    assert {(r.application_id, r.job_id, r.status) for r in rows} == {("app-7", 0, "JobFailed"), ("app-7", 1, "JobSucceeded"), ("app-8", 5, "")}
    one = eventlog.read_event_log(spark, str(folder), application_id="all")
    assert one.select("application_id").distinct().collect()[0][0] == "all"
    assert one.groupBy("event_order").count().where("count > 1").count() == 0
    order = [json.loads(r.body)["Job ID"] for r in one.where(F.col("body").contains("JobEnd")).orderBy("event_order").collect()]
    assert order == [0, 1]
    write(folder / "app é 10", [job_start(7, [])])  # a name that paths escape
    assert eventlog.read_event_log(spark, str(folder), application_id="all").count() == one.count() + 1
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        eventlog.read_event_log(spark, str(tmp_path / "empty"))


def test_order_survives_splits(spark, tmp_path):
    path = write(tmp_path / "big", [job_start(i, []) for i in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = eventlog.read_event_log(spark, path)
        assert lines.rdd.getNumPartitions() > 2
        got = [r.job_id for r in ev.job_starts(lines).orderBy("start_order").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(4000))


def test_stage_accumulables(spark, tmp_path):
    acc = [
        {"Name": "internal.metrics.diskBytesSpilled", "Value": 1}, {"Name": "internal.metrics.diskBytesSpilled", "Value": "9"},
        {"Name": "internal.metrics.input.bytesRead", "Value": "none"}, {"Name": "internal.metrics.shuffle.read.localBytesRead", "Value": 5},
        {"Name": "internal.metrics.shuffle.read.remoteBytesRead", "Value": 6}, {"Name": "internal.metrics.updatedBlockStatuses", "Value": [{"x": 1}]},
    ]
    path = write(tmp_path / "log", [submitted(1), completed(1, accumulables=acc), submitted(2), completed(3)])
    rows = {r.stage_id: r for r in accounting.stages(eventlog.read_event_log(spark, path)).collect()}
    assert (rows[1].disk_bytes_spilled, rows[1].input_bytes, rows[1].shuffle_read_bytes, rows[1].output_bytes) == (9, 0, 11, 0)
    assert (rows[2].status, rows[2].completion_ms, rows[3].status, rows[3].num_tasks) == ("", 0, "COMPLETE", 2.0)


def test_task_metrics(spark, tmp_path):
    path = write(tmp_path / "log", [
        task(1, run=20, launch=100, finish=150), task(1, run=90, launch=100, finish=150), task(1, launch=0, finish=150), task(1, "ExceptionFailure", run=5000, Failed=True),
    ])
    rows = ev.task_metrics(eventlog.read_event_log(spark, path)).orderBy("executor_run_time").collect()
    assert [(r.duration, r.scheduler_delay, r.shuffle_read_bytes) for r in rows] == [(0, 0, 7), (50, 30, 7), (50, 0, 7)]
    summary = accounting.task_summaries(eventlog.read_event_log(spark, path)).collect()[0]
    assert summary.num_tasks == 3 and summary.duration == [5.0, 25.0, 50.0, 50.0, 50.0]


def plan(name, explain=None, metrics=(), children=()):
    node = {"nodeName": name, "simpleString": name, "children": list(children), "metadata": {}, "metrics": [{"name": n, "accumulatorId": a, "metricType": "sum"} for n, a in metrics]}
    if explain is not None:
        node["explainId"] = explain
    return node


def sql_events():
    tree = plan("A", 1, [("rows", 10)], [plan("B", 2, [("rows", 11), ("mapped", 50), ("lost", 51), ("borrowed", 52)], [plan("C", 1), plan("D", None, [("rows", 12)])]), plan("E", 3)])
    start = lambda i, t, p: {"Event": UI + "SparkListenerSQLExecutionStart", "executionId": i, "description": f"q{i}", "time": t, "sparkPlanInfo": p}
    return [
        job_start(0, [], **{"spark.sql.execution.id": "0"}), job_end(0),  # job ends before its execution starts
        start(0, 1000, tree), start(1, 1000, plan("X", 1, [("rows", 10)])), start(2, 0, plan("Y", 4)),
        job_start(1, [], **{"spark.sql.execution.id": "0"}), job_end(1, "JobFailed"), job_start(2, [], **{"spark.sql.execution.id": "zero"}), job_end(2),
        job_start(3, [], **{"spark.sql.execution.id": "0"}), job_end(3, "JobFailed"), job_start(4, [], **{"spark.sql.execution.id": "77"}), job_end(4),
        {"Event": UI + "SparkListenerDriverAccumUpdates", "executionId": 0, "accumUpdates": [[10, 1], [10, 2]]},
        {"Event": UI + "SparkListenerDriverAccumUpdates", "executionId": 0, "accumUpdates": [[10, 3]]},
        task(1, accumulables=[
            {"ID": 11, "Name": "rows", "Value": "5", "Metadata": "sql"}, {"ID": 60, "Name": "m", "Value": "8", "Metadata": "sql"},
            {"ID": 12, "Name": "rows", "Value": "99", "Metadata": "other"}, {"ID": 12, "Name": "rows", "Value": "x", "Metadata": "sql"},
        ]),
        task(1, accumulables=[{"ID": 11, "Name": "rows", "Value": "7", "Metadata": "sql"}, {"ID": 90, "Name": "borrowed", "Value": "4", "Metadata": "sql"}, {"ID": 91, "Name": "lost", "Value": "6", "Metadata": "sql"}]),
        {"Event": UI + "SparkListenerSQLAdaptiveSQLMetricUpdates", "executionId": 0, "sqlPlanMetrics": [{"name": "mapped", "accumulatorId": 60, "metricType": "sum"}, {"name": "lost", "accumulatorId": 61, "metricType": "sum"}]},
        {"Event": UI + "SparkListenerSQLAdaptiveExecutionUpdate", "executionId": 1, "physicalPlanDescription": "== Physical Plan ==\n* Sort (3)\n+- :- Scan  csv   (1)\n   +- Scan again (1)\n\n(3) Sort\n(2) [no name]", "sparkPlanInfo": plan("Z", None, [("rows", 10)])},
        {"Event": UI + "SparkListenerSQLExecutionEnd", "executionId": 0, "time": 4500, "errorMessage": ""},
        {"Event": UI + "SparkListenerSQLExecutionEnd", "executionId": 1, "time": 2000, "errorMessage": "boom"},
    ]


def test_sql_executions_nodes_and_metrics(spark, tmp_path):
    log = EventLog.read(spark, write(tmp_path / "log", sql_events()))
    rows = {r.id: r for r in log.sql_metrics().collect()}
    assert [(rows[i].status, rows[i].duration) for i in range(3)] == [("COMPLETED", 3500), ("FAILED", 1000), ("RUNNING", 0)]
    assert rows[0].successJobIds == ["0"] and rows[0].failedJobIds == "1,3" and rows[2].successJobIds == []
    nodes = [(n.nodeId, n.nodeName, {m.name: m.value for m in n.metrics}) for n in rows[0].nodes]
    # "lost" is mapped to an accumulator without value, which ends the search
    assert nodes == [(1, "A", {"rows": "3"}), (2, "B", {"rows": "7", "mapped": "8", "borrowed": "4"}), (3, "E", {})]
    assert [(n.nodeId, n.nodeName, n.metrics) for n in rows[1].nodes] == [(3, "Sort", []), (1, "Scan  csv", [])]
    overview = {r.sql_id: r for r in log.execution(0).collect()}[0]
    assert (overview.total_nodes, overview.nodes_with_metrics, overview.total_metrics_collected) == (3, 2, 4)
    assert {r.node_type: r.nodes for r in log.execution_node_types(1).collect()} == {"Sort": 1, "Scan": 1}
    fixed = sqlplans.plan_nodes(log.executions, corrected=True)
    assert [(r.node_id, r.node_name) for r in fixed.where("execution_id = 0").orderBy("node_id").collect()] == [(0, "A"), (1, "B"), (2, "C"), (3, "D"), (4, "E")]
    values = {(r.execution_id, r.node_name, r.metric_name): r.metric_value for r in sqlplans.node_metrics(fixed, log.events, corrected=True).collect()}
    assert values == {(0, "A", "rows"): "3", (0, "B", "rows"): "7", (0, "B", "mapped"): "8"}


def test_join_skew_recommendation(spark, tmp_path):
    skewed = plan("SortMergeJoin", 5, [("Cancellation Is Skewed", 1)], [plan("ShuffledHashJoin x", 6, [("Cancellation Is Skewed", 2)]), plan("Sort", 7, [("Cancellation Is Skewed", 1)])])
    log = EventLog.read(spark, write(tmp_path / "log", [
        {"Event": UI + "SparkListenerSQLExecutionStart", "executionId": 4, "description": "", "time": 1, "sparkPlanInfo": skewed},
        {"Event": UI + "SparkListenerDriverAccumUpdates", "executionId": 4, "accumUpdates": [[1, 1], [2, 0]]},
    ]))
    got = [r for r in log.recommendations().collect() if r.rule_no == 7]
    assert [r.description for r in got] == ["Skew detected in SortMergeJoin (Node 5)."]


def test_deep_plan_is_flattened(spark):
    tree = plan("leaf", 0)
    for i in range(1, 400):
        tree = plan(f"n{i}", i, (), [tree])
    df = spark.createDataFrame([(json.dumps(tree),), (None,)], "p STRING").select(F.size(sqlplans.plan_tree_nodes(F.col("p"))).alias("n"))
    assert sorted(r.n for r in df.collect()) == [0, 400]


def test_an_execution_keeps_one_row_whatever_its_job_numbers(spark):
    jobs = spark.createDataFrame([("a", 1, j, "JobSucceeded") for j in (3, 65535, 65536)], "application_id STRING, execution_id BIGINT, job_id BIGINT, status STRING")
    assert [r.success_job_ids for r in sqlplans.execution_job_lists(jobs).collect()] == [["3", "65535", "65536"]]


def test_each_path_of_a_list_is_looked_at_by_itself(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    write(tmp_path / "folder" / "app-1", [{"Event": "SparkListenerJobEnd", "Job ID": 1}])
    (tmp_path / "folder" / "notes.txt").write_text("no log\n")
    single = write(tmp_path / "one.json", [{"Event": "SparkListenerJobEnd", "Job ID": 2}])
    for paths in ([str(tmp_path / "folder"), single], [single, str(tmp_path / "folder")]):
        assert eventlog.read_lines(spark, paths).count() == 2


def test_accumulator_lookup(spark):
    items = F.expr("array(named_struct('Name','X','Value','4'), named_struct('Name','x','Value','5'))")
    row = spark.range(1).select(
        ev.accumulator(items, "x", ignore_case=True, last=False).alias("a"), ev.accumulator(items, "x").alias("b"), ev.accumulator(items, "y").alias("c")
    ).first()
    assert tuple(row) == (4, 5, 0)


def test_order_chunks_and_late_tasks_across_stretches(spark):
    from emberscope.operators.keyed import counts_before, running_totals

    rows = [(1, i * 7, i % 3) for i in range(300)] + [(2, i, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "g INT, pos BIGINT, v INT")
    cuts = spark.createDataFrame([(1, 1000), (2, 0)], "g INT, cut BIGINT")
    got = {r.g: r.zeros for r in counts_before(df, ["g"], "pos", cuts, "cut", {"zeros": F.col("v") == 0}, bits=5).collect()}
    assert got == {1: sum(1 for g, p, v in rows if g == 1 and p < 1000 and v == 0), 2: 0}
    chunked = df.withColumn("chunk", F.shiftright("pos", 6)).withColumn("x", F.when(F.col("v") == 1, F.col("pos")))
    run = running_totals(chunked, ["g"], "chunk", "pos", sums={"s": "v"}, maxes={"m": "x"}).collect()
    for r in run:
        before = [t for t in rows if t[0] == r.g and t[1] <= r.pos]
        assert r.s == sum(t[2] for t in before)
        assert r.m == max([t[1] for t in before if t[2] == 1], default=None)


@pytest.fixture(scope="module")
def real_log(spark, log_dir):
    """Run a join, an aggregate and a failing job, then read the log of this very session."""
    facts = spark.range(5000).withColumn("k", F.col("id") % 50)
    other = spark.range(50).withColumnRenamed("id", "k")
    facts.hint("merge").join(other, "k").groupBy("k").count().collect()
    with pytest.raises(Exception):
        spark.range(3).selectExpr("raise_error('planned')").collect()
    return log_dir


def test_real_log(spark, real_log, tmp_path):
    path = [os.path.join(real_log, d) for d in os.listdir(real_log)]
    folder = tmp_path / "copy"
    folder.mkdir()
    # the session still writes its log: take a copy of what is there, without the open tail
    import zstandard

    copied = 0
    for root in path:
        for name in sorted(os.listdir(root)):
            if not name.startswith("events_"):
                continue
            with open(os.path.join(root, name), "rb") as f:
                text = b""
                reader = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
                try:
                    while block := reader.read(1 << 16):
                        text += block
                except zstandard.ZstdError:
                    pass
            if text:
                copied += 1
                (folder / name.split(".")[0]).write_bytes(text)
    if not copied:
        pytest.skip("the log is not flushed yet")
    log = EventLog.read(spark, str(folder), landed=str(tmp_path / "landed"))
    ours = ev.job_starts(log.events)
    assert ours.count() > 0
    assert log.jobs.where("status = 'JobSucceeded'").count() > 0
    stages = log.stages.where("status = 'COMPLETE'")
    assert stages.where("num_completed_tasks > num_tasks").count() == 0
    assert log.task_summaries.where("duration IS NULL").count() == 0
    # open-source plans carry no explainId: the corrected form finds their nodes
    corrected = EventLog(log.events, corrected=True)
    assert corrected.nodes.count() > 0


def test_task_lines_are_parsed_once_into_flat_columns(spark):
    lines = spark.createDataFrame([("a", 1, "{}", eventlog.EVENTS["task_end"])], "application_id STRING, event_order BIGINT, body STRING, event STRING")
    plan = ev.task_metrics(lines)._jdf.queryExecution().executedPlan().toString()
    # an inline of all columns was one method too large to be compiled
    assert plan.count("from_json") == 1 and "inline" not in plan


def test_an_overview_makes_no_quantiles_and_no_accounting(spark, sf_dir, monkeypatch):
    from emberscope.catalog import logs
    from emberscope.catalog.registry import Data

    events = logs.job_events(Data(spark, sf_dir))
    want = {(r.application_id): r.n for r in accounting.task_summaries(events, ("duration",)).groupBy("application_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name in ("task_summaries", "job_accounting", "counts_before"):
        monkeypatch.setattr(accounting, name, None)
    counts, _ = EventLog(events).overview()
    assert {r.application_id: r.n for r in counts.where("kind = 'task_summaries'").collect()} == want
