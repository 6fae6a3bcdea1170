"""Quantile sketches that are stored once and merged over attempts, applications or days.

For questions that allow a stated error of rank instead of exact quantiles: a sketch has a fixed size whatever the
number of tasks, is built on the map side, and sketches of any parts of the tasks merge to that of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.operators.keyed import balanced_join
from emberscope.operators.quantiles import LOG_PROBES

#: Accuracy parameter, and the share of all values that the rank of an answer may be off by with it.  The published
#: error of such sketches is 1.33 % for 200 and falls with the parameter; the bound leaves room for many merges.
SIZE, RANK_ERROR = 2048, 0.005


def metric_sketches(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], size: int = SIZE) -> DataFrame:
    """``keys, metric, num_values, sketch``: one sketch a key and metric, NULL values left out, none without values."""
    wide = rows.groupBy(*keys).agg(
        *[F.count(m).alias(f"_n{i}") for i, m in enumerate(metrics)],
        *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(size)).alias(f"_s{i}") for i, m in enumerate(metrics)],
    )
    entries = [F.struct(F.lit(m).alias("metric"), F.col(f"_n{i}").alias("num_values"), F.col(f"_s{i}").alias("sketch")) for i, m in enumerate(metrics)]
    return wide.select(*keys, F.inline(F.array(*entries))).where("num_values > 0")


def merged(sketches: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of coarser keys from stored finer ones."""
    return sketches.groupBy(*keys, "metric").agg(
        F.sum("num_values").alias("num_values"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, probes: Sequence[float] = LOG_PROBES) -> DataFrame:
    """``quantiles array<double>`` in place of ``sketch``."""
    return sketches.withColumn("quantiles", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in probes])).drop("sketch")


def rank_errors(rows: DataFrame, keys: Sequence[str], quantiles: DataFrame, probes: Sequence[float] = LOG_PROBES) -> DataFrame:
    """``keys, metric, worst``: how far the true rank of an answer is from the one asked for, as a share of the values.

    ``quantiles`` is read twice, so it should be stored; a stored one of few keys is broadcast and no value moves, and of
    many the values of a hot key are dealt out.
    """
    keys = list(keys)
    metrics = [r.metric for r in quantiles.select("metric").distinct().collect()]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    values = rows.select(*keys, F.inline(pairs)).where("value is not null")
    joined = balanced_join(values, quantiles.select(*keys, "metric", "quantiles"), [*keys, "metric"], "inner")

    def off(i: int, q: float) -> Column:
        low = F.avg((F.col("value") < F.get("quantiles", i)).cast("double"))
        high = F.avg((F.col("value") <= F.get("quantiles", i)).cast("double"))
        return F.greatest(low - q, q - high, F.lit(0.0))

    return joined.groupBy(*keys, "metric").agg(reduce(F.greatest, [off(i, q) for i, q in enumerate(probes)]).alias("worst"))
