"""Damaged files are found wherever they stand in a log."""

import gzip
import json

import pytest
import zstandard

from emberscope.sources import eventlog, integrity


def body(n, first=0):
    return "".join(json.dumps({"Event": "SparkListenerJobEnd", "Job ID": first + i, "note": "x" * 50}) + "\n" for i in range(n)).encode()


def rolled(folder, suffix, files):
    folder.mkdir(parents=True)
    for number, content in enumerate(files, start=1):
        (folder / f"events_{number}_app{suffix}").write_bytes(content)
    return str(folder)


@pytest.mark.parametrize("suffix, pack", [(".gz", gzip.compress), (".zstd", zstandard.ZstdCompressor().compress)])
@pytest.mark.parametrize("cut", [1, 9, 200])
def test_a_cut_file_in_the_middle_of_a_rolled_log(spark, tmp_path, suffix, pack, cut):
    parts = [pack(body(400, i * 400)) for i in range(3)]
    parts[1] = parts[1][: -min(cut, len(parts[1]) // 2)]
    parts[2] += pack(body(10, 5000))  # a second member or frame
    path = rolled(tmp_path / "eventlog_v2_app", suffix, parts)
    ledger = {r.file_no: r for r in integrity.file_ledger(spark, path).collect()}
    assert [ledger[i].complete for i in (1, 2, 3)] == [True, False, True]
    assert ledger[1].lines == 400 and ledger[3].lines == 410 and ledger[2].lines <= 400
    assert ledger[1].bytes == len(body(400)) and ledger[1].size == len(parts[0]) and ledger[2].problem
    (row,) = integrity.damaged_files(integrity.file_ledger(spark, path)).collect()
    assert row.application_id == "app" and row.file_no == 2


def test_plain_and_other_files(spark, tmp_path):
    (tmp_path / "app-1").write_bytes(body(5))
    (tmp_path / "app-2").write_bytes(body(5)[:-10])
    (tmp_path / "app-3").write_bytes(b"")
    (tmp_path / "notes.txt").write_text("no log")
    (tmp_path / "app-4.gz").write_bytes(b"no gzip at all")
    got = {r.application_id: (r.lines, r.complete) for r in integrity.file_ledger(spark, str(tmp_path)).collect()}
    assert got == {"app-1": (5, True), "app-2": (5, False), "app-4": (0, False)}
    whole = eventlog.read_lines(spark, str(tmp_path / "app-1"))
    assert whole.count() == 5


def test_a_codec_that_is_not_checked():
    assert integrity.checked(iter([b"x"]), "lz4") == (0, 0, None, "codec is not checked")


def test_a_rolled_log_is_landed_by_the_name_of_its_status_file(spark, tmp_path, monkeypatch):
    from emberscope.streaming import ingest

    logs, landed = tmp_path / "logs", str(tmp_path / "landed")
    start = json.dumps({"Event": "SparkListenerApplicationStart", "App ID": "app"}).encode() + b"\n"
    rolled(logs / "eventlog_v2_app", "", [start + body(3), body(4, 3)])
    status = logs / "eventlog_v2_app" / "appstatus_app.inprogress"
    status.write_text("")
    read = []
    original = ingest.read_lines
    monkeypatch.setattr(ingest, "read_lines", lambda spark, paths, **more: read.append(paths) or original(spark, paths, **more))
    run = lambda: ingest.land_new_logs(spark, str(logs), landed, str(tmp_path / "checkpoint")).awaitTermination()
    run()
    assert [r.log.rsplit("/", 1)[1] for r in ingest.unfinished_logs(spark, str(logs), landed).collect()] == ["eventlog_v2_app"]
    (logs / "eventlog_v2_app" / "appstatus_app").write_text("")
    status.unlink()
    run()
    run()
    assert read == []  # no file of an open log was read to learn whether it has ended
    assert ingest.unfinished_logs(spark, str(logs), landed).count() == 0
    assert spark.read.parquet(landed).where("event = 'SparkListenerJobEnd'").count() == 7


def task(stage, n, ok=True):
    return json.dumps({
        "Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0, "Task End Reason": {"Reason": "Success" if ok else "ExceptionFailure"},
        "Task Info": {"Launch Time": 1, "Finish Time": 1 + n, "Failed": not ok, "Killed": False}, "Task Metrics": {"JVM GC Time": n},
    }) + "\n"


def test_three_runs_of_partial_aggregates_equal_one(spark, tmp_path):
    from emberscope.operators import accounting
    from emberscope.streaming import ingest, partials

    logs, landed, folder = tmp_path / "logs", str(tmp_path / "landed"), str(tmp_path / "partials")
    logs.mkdir()

    def log(name, first, running=False):
        ends = json.dumps({"Event": "SparkListenerJobEnd", "Job ID": first, "Completion Time": 3, "Job Result": {"Result": "JobSucceeded"}}) + "\n"
        (logs / (name + ".inprogress" * running)).write_text("".join(task(i % 2, first + i, i % 7 > 0) for i in range(40)) + ends)

    read = []
    for run, names in enumerate((["app-a", "app-b"], ["app-c"], [])):
        for k, name in enumerate(names):
            log(name, 1 + 100 * run + 10 * k)
        log("app-z", 1000 + run, running=True)
        ingest.land_new_logs(spark, str(logs), landed, str(tmp_path / "state")).awaitTermination()
        read.append(partials.update(spark, landed, folder))
    assert read == [1, 1, 0]  # each batch once, and nothing of the log that is still open
    assert sum(r.lines for r in partials.done_batches(spark, folder).collect()) == 3 * 41
    from emberscope.sources.eventlog import read_landed

    events = read_landed(spark, landed)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert rows(partials.outcome_totals(spark, folder)) == rows(accounting.outcome_counts(events))
    assert rows(partials.job_totals(spark, folder)) == [(a, 1, "JobSucceeded") for a in ("app-a", "app-b", "app-c")]
    exact = {(r.application_id, r.stage_id): r for r in accounting.task_summaries(events, ("duration",)).collect()}
    for r in partials.metric_quantiles(spark, folder).where("metric = 'duration'").collect():
        want = exact[r.application_id, r.stage_id]
        assert r.num_values == want.num_tasks and abs(r.quantiles[2] - want.duration[2]) <= 2
    whole = partials.metric_quantiles(spark, folder, ["application_id"]).where("metric = 'duration' and application_id = 'app-a'").first()
    assert whole.num_values == sum(x.num_tasks for (a, _), x in exact.items() if a == "app-a")
