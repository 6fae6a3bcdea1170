"""Joins on hot keys: only measured heavy hitters are dealt out, whatever the keys are."""

import pytest
from pyspark.sql import functions as F

from emberscope.operators import keyed


def frames(spark, hot):
    rows = spark.range(40_000).select(F.when(F.col("id") < hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"), F.col("id").alias("v"))
    one = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") * 2).alias("w")).union(spark.sql("select 'hot', -1L"))
    return rows.union(spark.sql("select cast(null as string), 7L")), one.union(spark.sql("select cast(null as string), 9L"))


@pytest.mark.parametrize("hot", [0, 39_000, 40_000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_balanced_join_equals_join(spark, monkeypatch, hot, how):
    monkeypatch.setattr(keyed, "ONE_TASK", -1)
    rows, one = frames(spark, hot)
    got = keyed.balanced_join(rows, one, ["k"], how, small=-1)
    want = rows.join(one, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    spread = keyed.balanced_join(rows, one, ["k"], how, ["v"], small=-1)
    assert spread.exceptAll(want).count() == want.exceptAll(spread).count() == 0


def test_slices_follow_the_measured_share(spark):
    rows, _ = frames(spark, 30_000)
    found = {r["_mark"]: r["_slices"] for r in keyed.heavy_hitters(rows, ["k"]).collect()}
    hot = spark.sql("select xxhash64('hot') as h").first().h
    assert found.keys() == {hot} and 0.7 * keyed.SLICES < found[hot] <= 0.8 * keyed.SLICES
    assert keyed.heavy_hitters(spark.range(5000), ["id"]).count() == 0


def test_a_small_unique_side_is_broadcast_and_moves_no_row(spark, tmp_path):
    rows, one = frames(spark, 10)
    one.write.parquet(str(tmp_path / "one"))
    joined = keyed.balanced_join(rows, spark.read.parquet(str(tmp_path / "one")), ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_stored_frames_go_with_the_session_folder(spark, tmp_path, monkeypatch):
    import os

    from emberscope import runtime

    monkeypatch.setattr(runtime, "shared_folder", lambda _: str(tmp_path))
    frame = runtime.stored(spark.range(5))
    assert frame.count() == 5 and len(os.listdir(tmp_path)) == 1
    runtime.release(spark)
    assert os.listdir(tmp_path) == []


def test_counts_before_a_cut_off_join_and_store_nothing(spark, monkeypatch):
    monkeypatch.setattr(keyed, "stored", None)
    rows = [("a", p, p % 2) for p in range(0, 400, 3)] + [("b", 5, 1), ("c", 9, 1)]
    df = spark.createDataFrame(rows, "g STRING, pos BIGINT, v INT")
    cuts = spark.createDataFrame([("a", 200), ("b", 5), ("d", 1)], "g STRING, cut BIGINT")
    counted = keyed.counts_before(df, ["g"], "pos", cuts, "cut", {"odd": F.col("v") == 1}, bits=4)
    assert {r.g: r.odd for r in counted.collect()} == {"a": sum(v for g, p, v in rows if g == "a" and p < 200), "b": 0, "d": 0}
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
