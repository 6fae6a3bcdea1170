"""Rules at their thresholds."""

import pytest
from pyspark.sql import functions as F

from emberscope.functions.text import fixed, iso_from_millis, plain_double, shorten
from emberscope.plans import advisor, efficiency, issues, texts
from emberscope.plans.advisor import GIB, MIB

KEY = ["application_id"]
SUMMARY = "application_id INT, stage_id BIGINT, attempt_id INT, num_tasks BIGINT, duration ARRAY<DOUBLE>, input_bytes ARRAY<DOUBLE>, shuffle_read_bytes ARRAY<DOUBLE>"
FLAT = [1.0] * 5


def fired(spark, rows, **kw):
    df = spark.createDataFrame(rows, SUMMARY)
    return {(r.subject, r.rule_no): r for r in advisor.summary_rules(df, KEY, **kw).collect()}


def vector(p5, p50, p95, p75=None):
    return [float(p5), float(p5), float(p50), float(p50 if p75 is None else p75), float(p95)]


def test_duration_rules(spark):
    got = fired(spark, [
        (1, 1, 0, 10, vector(10, 20, 40), FLAT, FLAT),       # exactly twofold
        (1, 2, 0, 10, vector(10, 20.5, 41.5), FLAT, FLAT),   # just above
        (1, 3, 0, 9, vector(10, 200, 4000), FLAT, FLAT),     # too few tasks
        (1, 4, 0, 10, vector(10, 101, 506), FLAT, FLAT),     # above tenfold and fivefold
        (1, 5, 0, 10, vector(0, 20, 10**9), FLAT, FLAT),     # no low end
        (1, 6, 0, 10, [1.0, 2.0], FLAT, FLAT),               # short vector
    ])
    assert {k for k in got if k[1] in (12, 13)} == {(2, 12), (2, 13), (4, 12), (4, 13), (5, 13)}
    assert got[(2, 12)].severity == "medium" and got[(4, 12)].severity == "high" and got[(4, 13)].severity == "high"
    assert got[(2, 12)].description.startswith("Stage 2 (attempt 0, 10 tasks): Median task duration (20ms) is 2.0x the p5 duration (10ms).")


def test_partition_sizes(spark):
    limit = 512 * MIB
    got = fired(spark, [
        (1, 1, 0, 2, FLAT, vector(0, 0, limit), FLAT),
        (1, 2, 0, 2, FLAT, vector(0, 0, limit + 1), vector(0, 0, GIB + 1)),
        (1, 3, 0, 1, FLAT, vector(0, 0, GIB * 9), FLAT),
        (1, 4, 0, 2, FLAT, vector(0, 0, GIB + 1, p75=GIB), FLAT),
    ])
    assert {k for k in got if k[1] in (14, 15, 16)} == {(2, 14), (2, 16), (4, 14)}
    assert got[(2, 14)].severity == "medium" and got[(2, 16)].severity == "high" and got[(4, 14)].severity == "high"
    corrected = fired(spark, [(1, 4, 0, 2, FLAT, vector(0, 0, GIB + 1, p75=GIB), FLAT)], corrected=True)
    assert set(corrected) == {(4, 15)}


def test_processing_rate(spark):
    slow = vector(0, MIB, MIB)
    got = fired(spark, [
        (1, 1, 0, 50, vector(0, 1000, 1500), slow, FLAT),           # exactly 1 MB/s
        (1, 2, 0, 50, vector(0, 1001, 1500), slow, FLAT),
        (1, 3, 0, 49, vector(0, 90000, 90000), slow, FLAT),
        (1, 4, 0, 50, vector(0, 999, 1000), vector(0, 1, 1), FLAT),
        (1, 5, 0, 50, vector(0, 20000, 20000), vector(0, 0, 0), slow),  # falls back to shuffle
    ])
    assert {k for k in got if k[1] == 17} == {(2, 17), (5, 17)}
    assert got[(5, 17)].severity == "high" and "(shuffle read: 1.0 MB median / 20.0s median duration)" in got[(5, 17)].description


STAGES = (
    "application_id INT, stage_id BIGINT, attempt_id INT, status STRING, num_tasks DOUBLE, num_failed_tasks DOUBLE, "
    "memory_bytes_spilled BIGINT, disk_bytes_spilled BIGINT, shuffle_read_bytes BIGINT, shuffle_write_bytes BIGINT"
)


def test_stage_total_rules(spark):
    rows = [
        (1, 1, 0, "COMPLETE", 5.0, 0.0, 0, 0, 60 * GIB, 41 * GIB), (1, 2, 1, "FAILED", 20000.0, 0.0, 11 * GIB, 0, 0, 0),
        (2, 1, 0, "COMPLETE", 10.0, 0.0, 1, 0, 10 * GIB, 0), (2, 2, 0, "COMPLETE", 1001.0, 0.0, 0, 0, 0, 0),
        (3, 1, 0, "COMPLETE", 10000.0, 0.0, 0, 0, 11 * GIB, 0),
    ]
    got = advisor.stage_total_rules(spark.createDataFrame(rows, STAGES), KEY).collect()
    found = {(r.application_id, r.rule_no): r for r in got}
    assert set(found) == {(1, 2), (1, 3), (1, 5), (1, 6), (1, 10), (1, 11), (2, 5), (3, 6)}
    assert found[(1, 5)].severity == "high" and found[(2, 5)].severity == "low"
    assert found[(1, 6)].severity == "high" and found[(3, 6)].severity == "info"
    assert found[(1, 10)].description == "Maximum task count: 20000.0. This may cause scheduler overhead."
    assert found[(1, 6)].description == "Total shuffle data: 101.0 GB (Read: 60.0 GB, Write: 41.0 GB)."


def test_task_failure_rate(spark):
    rows = [(1, s, 0, "COMPLETE", 100.0, float(f), 0, 0, 0, 0) for s, f in ((1, 5), (2, 6), (3, 20), (4, 21), (5, 0))]
    rows.append((1, 6, 0, "COMPLETE", 0.0, 3.0, 0, 0, 0, 0))
    got = {r.subject: r for r in advisor.stage_task_rules(spark.createDataFrame(rows, STAGES), KEY).collect()}
    assert set(got) == {2, 3, 4}
    assert [got[i].severity for i in (2, 3, 4)] == ["medium", "medium", "high"]
    assert got[2].description == "6.0/100.0 tasks failed (6.0%)."


def test_job_and_sql_rules(spark):
    jobs = spark.createDataFrame([(1, "JobSucceeded")] * 9 + [(1, None), (2, "JobSucceeded"), (3, "JobFailed")], "application_id INT, status STRING")
    got = {r.application_id: r for r in advisor.job_rules(jobs, KEY).collect()}
    assert set(got) == {1, 3} and got[1].severity == "medium" and got[3].severity == "high"
    runs = spark.createDataFrame([(1, "COMPLETED", 300000), (2, "COMPLETED", 300001), (2, "FAILED", 10**9)], "application_id INT, status STRING, duration_ms BIGINT")
    rules = {(r.application_id, r.rule_no): r for r in advisor.sql_rules(runs, KEY).collect()}
    assert set(rules) == {(2, 8), (2, 9)} and rules[(2, 9)].current_value == "Avg duration: 300s"


def test_report_text(spark):
    rows = [(1, 2, 0, "FAILED", 4.0, 0.0, 0, 0, 0, 0), (1, 3, 1, "COMPLETE", 4.0, 0.0, 0, 0, 0, 0)]
    found = advisor.stage_total_rules(spark.createDataFrame(rows, STAGES), KEY)
    blocks = advisor.report_blocks(found, KEY).orderBy("severity_rank", "rule_no").collect()
    text = "\n".join(b.block for b in blocks)
    assert text.startswith("# Spark Tuning Recommendations\n\n\n## 🔴 HIGH PRIORITY\n\n### Stage Failures Detected\n**Category:** Stage Reliability\n")
    assert text.endswith("**Suggested Config:**\n```\nspark.speculation=true\n```\n")
    everyone = spark.createDataFrame([(1,), (2,)], "application_id INT")
    assert [(r[0], r[1]) for r in advisor.clean_applications(everyone, found, KEY).collect()] == [(2, texts.NOTHING_TO_TUNE)]


def test_issue_thresholds(spark):
    stages = spark.createDataFrame(
        [(1, 1, "COMPLETE", 201, 100, 99), (1, 2, "FAILED", 900, 0, 0), (1, 3, "COMPLETE", 200, 0, 0), (1, 4, "COMPLETE", 201, 201000, 0)],
        "application_id INT, stage_id BIGINT, status STRING, num_tasks BIGINT, input_records BIGINT, output_records BIGINT",
    )
    summary = [(1, s, run, gc, mem, disk) for s, run, gc, mem, disk in (
        (1, [0.0, 0.0, 10.0, 0.0, 100.0], [0.0, 0.0, 1.0, 0.0, 0.0], FLAT, [0.0] * 5),
        (2, [0.0, 0.0, 1.0, 0.0, 100.0], FLAT, FLAT, FLAT),
        (3, [0.0, 0.0, 10.0, 0.0, 100.5], [0.0, 0.0, 1.1, 0.0, 0.0], None, FLAT),
        (4, None, None, None, None),
    )]
    vectors = spark.createDataFrame(summary, "application_id INT, stage_id BIGINT, run_time ARRAY<DOUBLE>, gc_time ARRAY<DOUBLE>, memory_spill ARRAY<DOUBLE>, disk_spill ARRAY<DOUBLE>")
    got = issues.ordered_issues(issues.stage_issues(stages, vectors, KEY), KEY).collect()
    assert [(r.stage_id, r.issue_type, r.severity) for r in got] == [
        (3, "DATA_SKEW", "HIGH"), (3, "MEMORY_SPILL", "HIGH"), (1, "MEMORY_SPILL", "MEDIUM"), (3, "HIGH_GC_TIME", "MEDIUM"), (1, "TOO_MANY_SMALL_TASKS", "LOW"),
    ]
    assert got[0].details == "Max task duration (100.5ms) is 10.1x median (10.0ms)" or got[0].details == "Max task duration (100.5ms) is 10.0x median (10.0ms)"
    assert got[0].recommendation == texts.ISSUE_ADVICE["DATA_SKEW"]


def test_cluster_score_equals_pairs(spark):
    """The closed form equals joining every summary with every stage of its number."""
    payload = '{{"duration":[1,1,{m},1,{h}],"memoryBytesSpilled":[0,0,0,0,0]}}'
    summaries = spark.createDataFrame(
        [(1, "c", a, s, payload.format(m=1 + (a * s) % 3, h=2)) for a in range(4) for s in range(3)],
        "cluster_id INT, cluster_name STRING, application_id INT, stage_id BIGINT, raw_json STRING",
    )
    stages = spark.createDataFrame(
        [(1, a, s, 0.5 if (a + s) % 4 == 0 else 100.0, "2024-01-01 00:00:00", f"2024-01-01 00:0{a}:0{s + 1}") for a in range(4) for s in range(3)],
        "cluster_id INT, application_id INT, stage_id BIGINT, task_completion_rate DOUBLE, submission_time STRING, completion_time STRING",
    )
    apps = spark.createDataFrame([(1, 0, "x")], "cluster_id INT, application_id INT, start_time STRING")
    got = efficiency.inefficient_clusters(summaries, stages, apps, threshold=0).collect()[0].ineffstageagg
    flags = [(r.stage_id, r.skewbinary + r.spillbinary + r.diskspillbinary + r.chunkbinary) for r in efficiency.stage_flags(summaries).collect()]
    bad = total = 0
    for stage, raised in flags:
        for r in stages.collect():
            if r.stage_id == stage:
                spent = int(r.completion_time[-4]) * 60 + int(r.completion_time[-2:])
                total += spent
                bad += spent if raised or r.task_completion_rate < 0.9 else 0
    assert got == pytest.approx(bad / total * 100)


def test_text_helpers(spark):
    row = spark.range(1).select(
        fixed(F.lit(12.5), 0).alias("a"), fixed(F.lit(0.15), 1).alias("b"), plain_double(F.lit(1.25e8)).alias("c"), plain_double(F.lit(3.0)).alias("d"),
        iso_from_millis(F.lit(0).cast("bigint")).alias("e"), iso_from_millis(F.lit(1000).cast("bigint")).alias("f"), iso_from_millis(F.lit(1001).cast("bigint")).alias("g"),
        shorten(F.lit("x" * 31), 30).alias("h"), shorten(F.lit("x" * 30), 30).alias("i"),
    ).first()
    assert tuple(row) == ("12", "0.1", "125000000.0", "3.0", "", "1970-01-01T00:00:01", "1970-01-01T00:00:01.001000", "x" * 27 + "...", "x" * 30)


FLAGGED = '{"duration":[1,1,9,9,9],"memoryBytesSpilled":[0,0,0,0,0]}'
CALM = '{"duration":[5,5,5,5,5],"memoryBytesSpilled":[0,0,0,0,0]}'


def attempts(spark, named_summaries=True, named_stages=True):
    summaries = spark.createDataFrame(
        [(1, "c", 7, "1", 3, 0, CALM), (1, "c", 7, "1", 3, 1, FLAGGED)],
        "cluster_id INT, cluster_name STRING, application_id INT, attempt_id STRING, stage_id BIGINT, stage_attempt_id BIGINT, raw_json STRING",
    )
    stages = spark.createDataFrame(
        [(1, 7, "1", 3, 1, 100.0, "2024-01-01 00:01:00", "2024-01-01 00:01:30"), (1, 7, "1", 3, 0, 50.0, "2024-01-01 00:00:00", "2024-01-01 00:00:10")],
        "cluster_id INT, application_id INT, attempt_id STRING, stage_id BIGINT, stage_attempt_id BIGINT, task_completion_rate DOUBLE, submission_time STRING, completion_time STRING",
    )
    return summaries if named_summaries else summaries.drop("stage_attempt_id"), stages if named_stages else stages.drop("stage_attempt_id")


def test_two_attempts_of_a_stage_are_two_rows(spark):
    for named in (True, False):  # unnamed stage rows are numbered in the order they were submitted
        rows = efficiency.inefficient_stages(*attempts(spark, named_stages=named)).collect()
        assert sorted((r.stage_attempt_id, r.skewbinary, r.duration) for r in rows) == [(0, 0, 10000), (1, 1, 30000)]
    rows = efficiency.inefficient_stages(*attempts(spark, named_summaries=False)).collect()
    assert sorted((r.skewbinary, r.duration) for r in rows) == [(0, 30000), (1, 30000)]  # as of the newest attempt
    apps = spark.createDataFrame([(1, 7, "x")], "cluster_id INT, application_id INT, start_time STRING")
    (score,) = efficiency.inefficient_clusters(*attempts(spark), apps, corrected=True, threshold=0).collect()
    assert score.ineffstageagg == pytest.approx(100.0)  # the first attempt completed half of its tasks, the second is skewed


def test_a_late_summary_belongs_to_the_newest_version_before_it(spark):
    summaries, stages = attempts(spark, named_stages=False)
    late = summaries.where("stage_attempt_id = 1").withColumn("stage_attempt_id", F.lit(5).cast("long"))
    (row,) = efficiency.inefficient_stages(late, stages).collect()
    assert (row.stage_attempt_id, row.duration) == (1, 30000)


def test_stage_table_names_the_attempt(spark):
    from emberscope import schemas
    from emberscope.operators import drill, history

    empty = spark.createDataFrame([], schemas.PAYLOADS["stages"])
    fields = {f.name: F.lit(None).cast(f.dataType) for f in empty.schema.fields}
    payload = spark.range(2).select(*[
        (F.lit("3") if n == "stageId" else F.col("id").cast("string") if n == "attemptId" else c).alias(n) for n, c in fields.items()
    ])
    table = history.stages(payload)
    assert sorted(r.stage_attempt_id for r in table.collect()) == [0, 1] and table.schema["stage_attempt_id"].dataType.simpleString() == "bigint"
    found = spark.createDataFrame([(3, 1, "x")], "stage_id BIGINT, stage_attempt_id BIGINT, summary STRING")
    details = drill.stage_details(table.select("stage_id", "stage_attempt_id"), found, ["stage_id"]).collect()
    assert sorted((r.stage_attempt_id, r.summary) for r in details) == [(0, None), (1, "x")]
