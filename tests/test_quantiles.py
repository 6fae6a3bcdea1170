"""Exact quantiles: edge sizes, NULL keys, a dominating key and properties."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberscope.operators import quantiles
from emberscope.operators.quantiles import LOG_PROBES, SERVER_PROBES, group_quantiles


def by_key(df):
    return {r[0]: r for r in df.collect()}


def interpolated(values, probes):
    return np.quantile(np.array(values, dtype=float), probes)


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(v), float(v) / 3) for k, n in ((1, 1), (2, 2), (3, 60), (4, 700)) for v in rng.integers(0, 90, n)]
    df = spark.createDataFrame(rows, "k INT, a BIGINT, b DOUBLE")
    got = by_key(group_quantiles(df, ["k"], ["a", "b"], LOG_PROBES))
    for k in (1, 2, 3, 4):
        values = [r[1] for r in rows if r[0] == k]
        assert got[k].num_tasks == len(values)
        np.testing.assert_allclose(got[k].a, interpolated(values, LOG_PROBES))
        np.testing.assert_allclose(got[k].b, interpolated(np.array(values) / 3, LOG_PROBES))


def test_null_values_are_ignored_and_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(1, None), (1, 4), (1, 8), (2, None), (None, 3), (None, 5)], "k INT, a BIGINT")
    got = by_key(group_quantiles(df, ["k"], ["a"], SERVER_PROBES))
    assert got[1].a == [4.0, 5.0, 6.0, 7.0, 8.0]
    assert got[1].num_tasks == 3
    assert got[2].a is None and got[2].num_tasks == 1
    assert got[None].a == [3.0, 3.5, 4.0, 4.5, 5.0] and got[None].num_tasks == 2


def test_same_digits_as_percentile_with_a_dominating_key(spark):
    df = spark.range(30_000).selectExpr("if(id % 10 < 9, null, id % 7) as k", "rand(5) * 1e6 - 1000 as a", "cast(id % 13 as double) as b")
    points = F.array(*[F.lit(q) for q in LOG_PROBES])
    want = by_key(df.groupBy("k").agg(F.percentile("a", points).alias("a"), F.percentile("b", points).alias("b")))
    got = by_key(group_quantiles(df, ["k"], ["a", "b"]))
    assert {k: (r.a, r.b) for k, r in got.items()} == {k: (r.a, r.b) for k, r in want.items()}


def test_plan_reads_the_rows_once(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 as k", "id as a", "id * 2 as b").write.parquet(str(tmp_path / "t"))
    df = group_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], ["a", "b"])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.one_of(st.integers(-(10**12), 10**12), st.floats(-1e300, 1e300)), min_size=1, max_size=40))
def test_property(spark, values):
    df = spark.createDataFrame([(1, float(v)) for v in values], "k INT, a DOUBLE")
    got = by_key(group_quantiles(df, ["k"], ["a"], LOG_PROBES))
    np.testing.assert_allclose(got[1].a, interpolated(values, LOG_PROBES), rtol=1e-9, atol=1e-3 * max(map(abs, values), default=0) * 1e-9)


def test_selection_agrees_with_percentile_for_groups_of_every_size(spark):
    df = spark.createDataFrame(
        [(k, v) for k, values in {
            "one": [3.5], "two": [1.0, -2.0], "equal": [7.0] * 50, "none": [None] * 4, None: [float(i % 17) for i in range(300)],
            "odd": [float("inf"), float("-inf"), 0.0, -0.0, 1e-300, -1e300, None], "wide": [float((-3) ** (i % 40)) for i in range(500)],
        }.items() for v in values], "k STRING, a DOUBLE",
    ).withColumn("b", F.col("a") * 2)
    got = by_key(group_quantiles(df, ["k"], ["a", "b"], SERVER_PROBES, hot_rows=0))
    want = by_key(group_quantiles(df, ["k"], ["a", "b"], SERVER_PROBES, hot_rows=10**9))
    assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in want.items()}


def test_second_pass_moves_few_rows(spark):
    df = spark.range(200_000).selectExpr("'hot' as k", "rand(3) * 1e6 as a", "exp(randn(4) * 3) as b")
    picks = quantiles.stretch_picks(df, ["k"], ["a", "b"], LOG_PROBES)
    assert picks.count() <= 2 * 2 * len(LOG_PROBES)
    moved = quantiles.picked_values(df, picks, ["k"], ["a", "b"]).agg(F.sum("times")).first()[0]
    assert 0 < moved < 0.1 * 2 * 200_000
    points = F.array(*[F.lit(q) for q in LOG_PROBES])
    want = df.agg(F.percentile("a", points).alias("a"), F.percentile("b", points).alias("b")).first()
    got = group_quantiles(df, ["k"], ["a", "b"]).first()
    assert (got.a, got.b) == (want.a, want.b) and got.num_tasks == 200_000


def test_rows_of_ordinary_groups_move_before_they_are_aggregated(spark, tmp_path):
    spark.range(100).selectExpr("id % 30 as k", "id as a", "id * 2 as b").write.parquet(str(tmp_path / "t"))
    df = group_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], ["a", "b"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and plan.count("RepartitionByExpression") == 1


def test_whole_numbers_have_the_digits_of_percentile(spark):
    df = spark.range(9_000).selectExpr("id % 90 as k", "id * 7919 % 10007 as a", "if(id % 3 = 0, null, id * 31 % 997) as b")
    points = F.array(*[F.lit(q) for q in LOG_PROBES])
    want = by_key(df.groupBy("k").agg(F.percentile("a", points).alias("a"), F.percentile("b", points).alias("b")))
    got = by_key(group_quantiles(df, ["k"], ["a", "b"]))
    assert {k: (r.a, r.b) for k, r in got.items()} == {k: (r.a, r.b) for k, r in want.items()}
