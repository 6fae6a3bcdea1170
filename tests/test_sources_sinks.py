"""Snapshots, envelopes, sinks, SQL functions, history tables and incremental ingest."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberscope import schemas
from emberscope.functions import sqlfunctions
from emberscope.functions.arrays import point_from_json
from emberscope.operators import clusters, drill, history, status
from emberscope.plans import advisor, issues
from emberscope.sinks import tables as sink
from emberscope.sources import eventlog
from emberscope.sources import history as landed
from emberscope.streaming.ingest import land_new_logs, unfinished_logs

STAGE_JOB = {"jobId": 1, "name": "a", "status": "SUCCEEDED", "submissionTime": "2024-01-01T00:00:00.000GMT", "completionTime": "2024-01-01T00:01:30.900GMT", "stageIds": [1, 2], "numTasks": 4, "numCompletedTasks": 3}


def put(root, endpoint, cluster, app, text):
    folder = root / endpoint / f"cluster_id={cluster}" / f"application_id={app}"
    folder.mkdir(parents=True)
    (folder / "part.json").write_text(text)


def test_snapshot_reads_keys_lists_and_bad_records(spark, tmp_path):
    put(tmp_path, "jobs", "c1", "a1", json.dumps([STAGE_JOB, {**STAGE_JOB, "jobId": 2}]) + "\n")
    put(tmp_path, "jobs", "c2", "a2", json.dumps(STAGE_JOB) + "\n{broken\n")
    rows = landed.read_snapshot(spark, str(tmp_path), "jobs").cache()
    assert {(r.cluster_id, r.application_id, r.jobId) for r in landed.good_rows(rows).collect()} == {("c1", "a1", "1"), ("c1", "a1", "2"), ("c2", "a2", "1")}
    assert [(r.cluster_id, r.record) for r in landed.bad_rows(rows).collect()] == [("c2", "{broken")]
    table = history.jobs(landed.good_rows(rows))
    assert [f.name for f in table.schema] == [p.split()[0] for p in schemas.JOBS.split(", ")]
    row = history.run_seconds(table).where("cluster_id = 'c2'").first()
    assert (row.stage_ids, row.task_success_rate, row.runtimesec, row.num_failed_tasks) == ("[1, 2]", 75.0, 90, 0)


def test_envelopes(spark):
    good = json.dumps({"success": True, "jobs": [STAGE_JOB], "count": 1})
    bad = json.dumps({"success": False, "error": "gone", "error_type": "HTTP_404"})
    df = spark.createDataFrame([("a", good), ("b", bad), ("c", "<html>")], "app STRING, body STRING")
    assert [r.app for r in landed.envelope_rows(df, "body", "jobs", ["app"]).collect()] == ["a"]
    assert sorted(tuple(r) for r in landed.envelope_errors(df, "body", ["app"]).collect()) == [("b", "gone", "HTTP_404"), ("c", "unreadable response", "UNKNOWN_ERROR")]


def test_latest_attempt(spark):
    rows = [("x", [("1", 5, None), ("2", 9, None), ("3", None, 9)])]
    df = spark.createDataFrame(rows, "id STRING, attempts ARRAY<STRUCT<attemptId: STRING, lastUpdatedEpoch: BIGINT, startTimeEpoch: BIGINT>>")
    df = df.withColumn("attempts", F.transform("attempts", lambda a: a.withField("endTimeEpoch", F.lit(None).cast("bigint"))))
    a = F.col("attempts")
    got = df.select(
        history.latest_attempt(a).attemptId, history.latest_attempt(a, F.lit("1")).attemptId, history.latest_attempt(a, F.lit("7")).attemptId,
        history.latest_attempt(a, F.lit("7"), strict=True).attemptId,
    ).first()
    assert tuple(got) == ("2", "1", "2", None)


def test_error_codes(spark):
    rows = [("ReadTimeout", "", None, None), ("ConnectionError", "", None, None), ("HTTPError", "", 503, None), ("ClientError", "", None, "Throttling"), ("ClientError", "", None, None),
            ("ValueError", "No presigned URL found", None, None), ("KeyError", "", None, None)]
    df = spark.createDataFrame(rows, "k STRING, m STRING, h INT, s STRING")
    got = [r[0] for r in df.select(status.error_code(F.col("k"), F.col("m"), F.col("h"), F.col("s"))).collect()]
    assert got == ["TIMEOUT", "CONNECTION_ERROR", "HTTP_503", "AWS_Throttling", "AWS_CLIENT_ERROR", "PERSISTENT_UI_NO_PRESIGNED_URL", "UNKNOWN_ERROR"]


def test_tagging_and_clusters(spark):
    ids = spark.createDataFrame([("c", "n", "a", None)], "cluster_id STRING, cluster_name STRING, application_id STRING, attempt_id STRING")
    tagged = history.tagged(spark.createDataFrame([("a", 1)], "application_id STRING, x INT"), ids).first()
    assert (tagged.cluster_id, tagged.attempt_id) == ("c", "0")
    listed = spark.createDataFrame([(1, "Alpha", "TERMINATED", 0, dt.datetime(2024, 1, 2, 23, 59)), (2, "beta", "RUNNING", 9, dt.datetime(2024, 1, 1)), (3, "alpha2", "WAITING", 3, dt.datetime(2024, 1, 3))],
                                   "cluster_id INT, cluster_name STRING, state STRING, normalized_instance_hours INT, creation_date TIMESTAMP")
    assert [r.cluster_id for r in clusters.discover(listed, name_filter="ALPHA", created_before="2024-01-02").collect()] == [1]
    assert [r.cluster_id for r in clusters.discover(listed, min_hours=1).collect()] == [3]
    assert [r.cluster_id for r in clusters.discover(listed, max_clusters=1).collect()] == [1]
    with pytest.raises(ValueError):
        clusters.discover(listed, created_after="2024-02-01", created_before="2024-01-01")


def test_quantile_accessor(spark):
    df = spark.createDataFrame([('{"g":[1,2,3,4,5]}',), ('{"g":{"min":1,"median":7,"max":9}}',), ('{"g":[1]}',), ("x",)], "j STRING")
    got = [tuple(r) for r in df.select(point_from_json(F.col("j"), "$.g", 2), point_from_json(F.col("j"), "$.g", 4)).collect()]
    assert got == [(3.0, 5.0), (7.0, 9.0), (0.0, 0.0), (0.0, 0.0)]


def test_sinks(spark, tmp_path):
    sink.create_schema(spark, "metrics_test")
    df = spark.range(3)
    assert sink.append_tables({"t": df, "none": None}, "metrics_test") == ["metrics_test.t"]
    sink.append_tables({"t": df}, "metrics_test")
    assert sink.append_tables({"t": df}, "metrics_test", enabled=False) == []
    assert spark.table("metrics_test.t").count() == 6
    sink.replace_table(df, "metrics_test.t2")
    sink.replace_table(spark.range(1), "metrics_test.t2")
    assert spark.table("metrics_test.t2").count() == 1
    paths = sink.write_dated({"jobs": df, "none": None}, str(tmp_path), dt.date(2024, 5, 6))
    assert list(paths.values()) == [f"{tmp_path}/2024-05-06/jobs"] and spark.read.parquet(paths["jobs"]).count() == 3
    exported = sink.export_metrics({"job_metrics": df}, str(tmp_path / "out"))
    assert spark.read.schema("id BIGINT").json(exported["job_metrics"]).count() == 3


def test_report_is_written_in_order(spark, tmp_path):
    rows = [(a, s, 0, "COMPLETE", 100.0, float(30 + s), 0, 0, 0, 0) for a in (1, 2) for s in range(40)]
    stages = spark.createDataFrame(rows, "application_id INT, stage_id BIGINT, attempt_id INT, status STRING, num_tasks DOUBLE, num_failed_tasks DOUBLE, memory_bytes_spilled BIGINT, disk_bytes_spilled BIGINT, shuffle_read_bytes BIGINT, shuffle_write_bytes BIGINT")
    blocks = advisor.report_blocks(advisor.stage_task_rules(stages, ["application_id"]), ["application_id"])
    sink.write_report(blocks, str(tmp_path / "report"), ["application_id"], ["severity_rank", "rule_no", "subject"])
    for a in (1, 2):
        files = sorted((tmp_path / "report" / f"application_id={a}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        numbers = [int(x.split("\n")[0]) for x in text.split("Rate in Stage ")[1:]]
        assert text.startswith("# Spark Tuning Recommendations") and numbers == list(range(40))


def test_sql_functions(spark, sf_dir):
    jobs = spark.createDataFrame([("c1", "1", "2024-01-01T00:00:00.000GMT", "2024-01-01T00:00:05.000GMT"), ("c1", "2", "2024-01-01T00:00:00.000GMT", "2024-01-01T00:00:50.000GMT"), ("c2", "3", None, None)],
                                 "cluster_id STRING, jobId STRING, submissionTime STRING, completionTime STRING")
    stages = jobs.select("cluster_id", F.col("jobId").alias("stageId"), "submissionTime", "completionTime")
    executors = spark.createDataFrame([("c1", "driver", "2024-01-01T00:00:00.000GMT", "2024-01-01T00:00:07.000GMT")], "cluster_id STRING, id STRING, addTime STRING, removeTime STRING")
    node = "array<struct<nodeId:int,nodeName:string,metrics:array<struct<name:string,value:string>>>>"
    sql = spark.createDataFrame([("c1", 1, 10, [(1, "Scan csv", []), (2, "Sort", [])]), ("c1", 2, 20, [(1, "Scan csv x", [])]), ("c2", 3, 5, [])], f"cluster_id STRING, id BIGINT, duration BIGINT, nodes {node}")
    summaries = spark.createDataFrame([("c1", 1, 0, "{}"), ("c1", 1, 1, "x")], "cluster_id STRING, stage_id BIGINT, stage_attempt_id BIGINT, raw_json STRING")
    apps = spark.createDataFrame([("c1", "b", "2"), ("c1", "a", "1")], "cluster_id STRING, application_id STRING, start_time STRING")
    made = sqlfunctions.register(spark, {"applications": apps, "jobs": jobs, "stages": stages, "sql": sql, "executors": executors, "task_summaries": summaries})
    assert len(made) == 12
    one = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert one("select jobId, runtimesec from getslowestjobs('c1')") == [("2", 50), ("1", 5)]
    assert one("select jobId from jobmetrics('c1', array('1', '3'))") == [("1",)]
    assert one("select stageId, runtimesec from getsloweststages('c1')") == [("2", 50), ("1", 5)]
    assert one("select stageId from getstage('c1', 2)") == [("2",)]
    assert one("select stageId from stagemetrics('c1', array('2'))") == [("2",)]
    assert one("select id, uptime from getexecutor('c1', 'driver')") == [("driver", 7)]
    assert one("select id from getslowestsql('c1')") == [(2,), (1,)]
    assert one("select rank from sqlmetrics('c1')") == [(1.0,), (2.0,)]
    assert one("select rank from sqlmetrics('c1', sizelimit => 60)") == [(2.0,)]
    assert one("select rank from sqlmetrics('c1', ranking => 1)") == [(1.0,)]
    assert one("select compatmetrics('c1'), getappid('c1'), taskmetrics('c1', 1)") == [(2 / 3, "a", "{}")]
    assert sorted(one("select sql_id, compatible_nodes, total_nodes from compatanalysis('c1')")) == [(1, 1, 2), (2, 0, 1)]


def test_rank_matches_window(spark):
    rows = [(k, i, (i * 7919) % 97 * 1000) for k in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "k INT, i INT, size INT")
    got = {(r.k, r.i): r["rank"] for r in drill.rank_by_size(df, ["k"], F.col("size"), ["i"]).collect()}
    want = {(r.k, r.i): r.r for r in df.selectExpr("*", "rank() over (partition by k order by size desc) r").collect()}
    assert got == want


def test_incremental_ingest(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    event = {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 3, "Job Result": {"Result": "JobSucceeded"}}
    (logs / "app-1").write_text(json.dumps(event) + "\nbroken\n")
    folder, state = str(tmp_path / "landed"), str(tmp_path / "state")
    land_new_logs(spark, str(logs), folder, state).awaitTermination()
    assert eventlog.read_landed(spark, folder).count() == 1
    (logs / "app-2").write_text(json.dumps(event) + "\n")
    land_new_logs(spark, str(logs), folder, state).awaitTermination()
    rows = eventlog.read_landed(spark, folder).select("application_id", "event").collect()
    assert sorted(tuple(r) for r in rows) == [("app-1", "SparkListenerJobEnd"), ("app-2", "SparkListenerJobEnd")]


def test_logs_still_being_written_wait(spark, tmp_path):
    logs, folder, state = tmp_path / "running", str(tmp_path / "landed_running"), str(tmp_path / "state_running")
    rolled = logs / "eventlog_v2_app-5"
    rolled.mkdir(parents=True)

    def line(job):
        return json.dumps({"Event": "SparkListenerJobEnd", "Job ID": job, "Completion Time": 1, "Job Result": {"Result": "JobSucceeded"}}) + "\n"

    (logs / "app 1").write_text(line(1))
    (logs / "app-2.inprogress").write_text(line(2))
    (logs / "notes.txt").write_text("no log")
    (rolled / "events_1_app-5").write_text(line(3))
    land_new_logs(spark, str(logs), folder, state).awaitTermination()
    found = eventlog.read_landed(spark, folder)
    assert [(r.application_id, json.loads(r.body)["Job ID"]) for r in found.collect()] == [("app%201", 1)]
    waiting = {r.log.rsplit("/", 1)[-1] for r in unfinished_logs(spark, str(logs), folder).collect()}
    assert waiting == {"app-2.inprogress", "eventlog_v2_app-5"}
    (logs / "app-2.inprogress").write_text(line(2) + line(4))
    (logs / "app-2.inprogress").rename(logs / "app-2")
    with open(rolled / "events_1_app-5", "a") as f:
        f.write(line(6))
    (rolled / "events_2_app-5").write_text(line(5) + json.dumps({"Event": "SparkListenerApplicationEnd"}) + "\n")
    for _ in range(2):
        land_new_logs(spark, str(logs), folder, state).awaitTermination()
        rows = eventlog.read_landed(spark, folder).orderBy("application_id", "event_order").collect()
        assert [json.loads(r.body)["Job ID"] for r in rows] == [1, 2, 4, 3, 6, 5]
    assert unfinished_logs(spark, str(logs), folder).isEmpty()


def test_a_damaged_log_shows(spark, tmp_path):
    import gzip
    import random

    draw = random.Random(1)
    body = "".join(json.dumps({"Event": "SparkListenerJobEnd", "Job ID": draw.getrandbits(60)}) + "\n" for _ in range(40_000))
    whole = gzip.compress((body + json.dumps({"Event": "SparkListenerApplicationEnd"}) + "\n").encode())
    (tmp_path / "app-1.gz").write_bytes(whole)
    (tmp_path / "app-2.gz").write_bytes(whole[: len(whole) // 2])
    got = eventlog.unended_logs(eventlog.read_lines(spark, str(tmp_path))).collect()
    assert [r.application_id for r in got] == ["app-2"] and 0 < got[0].lines < 40_000


def test_landing_makes_few_files(spark, tmp_path):
    rows = spark.range(20_000, numPartitions=40).select(
        (F.col("id") % 3).cast("string").alias("application_id"), F.col("id").alias("event_order"), F.lit("{}").alias("body"),
        F.when(F.col("id") % 10 == 0, "SparkListenerJobEnd").otherwise("SparkListenerTaskEnd").alias("event"),
    )
    folder = tmp_path / "few"
    assert eventlog.land_events(rows, str(folder)).count() == 20_000
    assert len(list(folder.glob("event=*/part-*"))) <= 8


def test_task_summaries_of_several_applications(spark):
    rows = [("c1", "b", 1, '{"executorRunTime":[1,2,3,4,5]}'), ("c1", "a", 1, '{"executorRunTime":{"min":1,"median":7,"max":9},"jvmGcTime":null}'), ("c1", "c", 1, "x")]
    table = history.task_summaries(spark.createDataFrame(rows, "cluster_id STRING, application_id STRING, stage_id BIGINT, payload STRING"))
    assert [f.name for f in table.schema] == [p.split()[0] for p in schemas.TASK_SUMMARIES.split(", ")]
    sqlfunctions.register(spark, {"task_summaries": table})
    assert [r[0] for r in spark.sql("select taskmetrics('c1', 1) union all select taskmetrics('c1', 1, 'b') union all select taskmetrics('c1', 1, 'd')").collect()] == [rows[1][3], rows[0][3], None]
    got = {r.application_id: (r.run_time, r.gc_time[2]) for r in issues.summary_vectors(table).collect()}
    assert got == {"a": ([1.0, 0.0, 7.0, 0.0, 9.0], 0.0), "b": ([1.0, 2.0, 3.0, 4.0, 5.0], 0.0), "c": ([0.0] * 5, 0.0)}


def test_the_newest_attempt_names_an_application(spark):
    ids = spark.createDataFrame([("c", "n", "a", "9"), ("c", "n", "a", "10"), ("b", "m", "a", None)], "cluster_id STRING, cluster_name STRING, application_id STRING, attempt_id STRING")
    row = history.tagged(spark.createDataFrame([("a", 1)], "application_id STRING, x INT"), ids).collect()
    assert [(r.cluster_id, r.attempt_id) for r in row] == [("c", "10")]
