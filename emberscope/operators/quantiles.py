"""Exact quantiles of many metrics per group.

Groups are counted first.  Rows of ordinary ones, up to ``HOT_ROWS`` rows, are brought together once, and each metric
becomes one sorted list.  A group with more rows never lies in one place.  It is selected from in two passes:

1. rows are counted per stretch of neighbouring values, 1/256 of an octave wide and combined on the map side, and
   running counts over the stretches tell in which of them each wanted rank lies: two stretches a probe at most;
2. only the values in those stretches are counted one by one, and ranked within their stretch.

Both ways give the digits of ``percentile``.  Keys may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probes used for event logs (ends are the 5th and 95th percentile).
LOG_PROBES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Probes requested from history servers (ends are minimum and maximum).
SERVER_PROBES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Groups with more rows are selected from in two passes; others fit the memory of a task many times over.
HOT_ROWS = 1 << 15
#: Stretches per octave of values.
STRETCHES = 256


def value_stretch(value: Column) -> Column:
    """Number of the stretch a value lies in; it grows with the value, NaN being the largest."""
    # doubles lie between 2^-1075 and 2^1024, so the shifted number of a positive value is positive
    size = F.floor(F.log2(F.abs(value)) * STRETCHES) + 1100 * STRETCHES
    stretch = F.when(value == 0, 0).when(value > 0, size).otherwise(-size)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.signum(value) * 3000 * STRETCHES).otherwise(stretch).cast("long")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], metrics: Sequence[str], probes: Sequence[float] = LOG_PROBES, hot_rows: int | None = None
) -> DataFrame:
    """One row per key: ``num_tasks`` and an ``array<double>`` per metric.

    Interpolates linearly at ``q * (n - 1)``; NULL values do not count, and a metric without values is NULL.
    Groups are counted in a pass over the keys, so ``df`` should be cheap to read again (a stored frame, a table).
    """
    keys, metrics = list(keys), list(metrics)
    rows = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    limit = HOT_ROWS if hot_rows is None else hot_rows
    # eight bytes for each group of more than `limit` rows; groups whose hashes meet are both selected from
    hot = F.broadcast(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(F.xxhash64(*keys).alias("_hot")).distinct()
    )
    same = F.xxhash64(*keys) == F.col("_hot")
    # rows move before they are aggregated: aggregates of a few rows each on the map side would be larger than the rows
    dealt = rows.join(hot, same, "left_anti").repartition(*keys)
    lists = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_tasks"), *[F.sort_array(F.collect_list(m)).alias(m) for m in metrics])
    points = F.array(*[F.lit(float(q)) for q in probes])

    def vector(m: str) -> Column:
        def at(q: Column) -> Column:
            place = q * (F.size(m) - 1)
            return _between(F.get(m, F.floor(place).cast("int")), F.get(m, F.ceil(place).cast("int")), place)

        return F.when(F.size(m) > 0, F.transform(points, at))

    ordinary = lists.select(*keys, "num_tasks", *[vector(m).alias(m) for m in metrics])
    return ordinary.unionByName(selected_quantiles(rows.join(hot, same, "left_semi"), keys, metrics, probes))


def _between(low: Column, high: Column, place: Column) -> Column:
    """The value at ``place`` from those at the ranks around it, as ``percentile`` computes it."""
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def stretch_picks(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], probes: Sequence[float]) -> DataFrame:
    """First pass: per key, metric and stretch that holds a wanted rank, the rows below it and the number of values.

    A metric without values has one row, without a stretch.
    """
    slot = [*keys, "metric"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), value_stretch(F.col(m)).alias("stretch")) for m in metrics])
    counts = rows.select(*keys, F.inline(pairs)).groupBy(*slot, "stretch").agg(F.count(F.lit(1)).alias("rows"))
    held = F.when(F.col("stretch").isNotNull(), F.col("rows")).otherwise(0)
    whole = Window.partitionBy(*slot)
    below = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *slot, "stretch", held.alias("held"), F.coalesce(F.sum(held).over(below), F.lit(0)).alias("skipped"),
        F.sum(held).over(whole).alias("total"), F.sum("rows").over(whole).alias("num_tasks"),
    )
    first, last = F.col("skipped"), F.col("skipped") + F.col("held") - 1
    ranks = [r for q in probes for r in (F.floor(F.lit(float(q)) * (F.col("total") - 1)), F.ceil(F.lit(float(q)) * (F.col("total") - 1)))]
    wanted = F.exists(F.array(*ranks), lambda r: (first <= r) & (r <= last))
    return placed.where((F.col("total") == 0) | (wanted & F.col("stretch").isNotNull())).drop("held")


def picked_values(rows: DataFrame, picks: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Second pass: ``keys, metric, stretch, value, times``, counted values of the picked stretches only."""
    wanted = picks.where("stretch is not null").groupBy(*keys).agg(
        *[F.collect_list(F.when(F.col("metric") == m, F.col("stretch"))).alias(f"_{i}") for i, m in enumerate(metrics)]
    )
    renamed = wanted.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = rows.join(renamed, _null_safe(keys, [f"_{k}" for k in keys]))

    def kept(i: int, m: str) -> Column:
        stretch = value_stretch(F.col(m))
        return F.when(F.array_contains(f"_{i}", stretch), F.struct(F.lit(m).alias("metric"), stretch.alias("stretch"), F.col(m).alias("value")))

    pairs = F.array_compact(F.array(*[kept(i, m) for i, m in enumerate(metrics)]))
    return joined.select(*keys, F.inline(pairs)).groupBy(*keys, "metric", "stretch", "value").agg(F.count(F.lit(1)).alias("times"))


def selected_quantiles(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], probes: Sequence[float]) -> DataFrame:
    """The same by two-pass selection, whatever the number of rows of a key."""
    keys, metrics = list(keys), list(metrics)
    slot = [*keys, "metric"]
    picks = stretch_picks(rows, keys, metrics, probes)
    inside = Window.partitionBy(*slot, "stretch").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = picked_values(rows, picks, keys, metrics).withColumn("upto", F.sum("times").over(inside))
    values = counted.select(*[F.col(c).alias(f"_{c}") for c in [*slot, "stretch"]], "value", "times", "upto")
    ranked = picks.join(values, _null_safe([*slot, "stretch"], [f"_{c}" for c in [*slot, "stretch"]]), "left")
    last = F.col("skipped") + F.col("upto") - 1
    first = last - F.col("times") + 1

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("total") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("value")))

    found = ranked.groupBy(*slot).agg(
        F.max("num_tasks").alias("rows"), F.max("total").alias("total"),
        *[at(F.floor(position(q))).alias(f"low{i}") for i, q in enumerate(probes)],
        *[at(F.ceil(position(q))).alias(f"high{i}") for i, q in enumerate(probes)],
    )

    vector = F.when(F.col("total") > 0, F.array(*[_between(F.col(f"low{i}"), F.col(f"high{i}"), position(q)) for i, q in enumerate(probes)]))
    return found.withColumn("vector", vector).groupBy(*keys).agg(
        F.max(F.when(F.col("metric") == metrics[0], F.col("rows"))).alias("num_tasks"),
        *[F.max(F.when(F.col("metric") == m, F.col("vector"))).alias(m) for m in metrics],
    )
