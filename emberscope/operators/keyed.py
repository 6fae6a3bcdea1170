"""Joins and running totals that stay balanced when one key is hot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.runtime import stored

#: Keys the sketch reports, and keys it tracks: any key with more than a thousandth part of the rows is among them.
HOT_KEYS, TRACKED = 1000, 10_000
#: Tasks that a key with all rows is spread over.
SLICES = 256
#: Bytes that a single task may hold whatever their keys are; smaller inputs need no balance.
ONE_TASK = 128 << 20


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer expects ``df`` to hold, from file sizes; it errs upwards."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def heavy_hitters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(_mark, _slices)``: hashes of the keys with most rows, and the slices their measured share calls for.

    One pass with a sketch of fixed size, combined on the map side; at most ``HOT_KEYS`` rows come out, none for a key of
    less than the share of one slice.
    """
    found = rows.select(F.xxhash64(*keys).alias("_mark")).agg(
        F.expr(f"approx_top_k(_mark, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    listed = found.select("total", F.inline("top"))
    slices = F.ceil(F.col("count") * SLICES / F.col("total")).cast("int")
    return listed.select(F.col("item").alias("_mark"), slices.alias("_slices")).where("_slices > 1")


def balanced_join(
    rows: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "left", spread_by: Sequence[str] = (), small: int | None = None
) -> DataFrame:
    """Join many ``rows`` to at most one ``unique`` row per key.

    A unique side whose size by the file sizes is below ``small`` bytes (the session's broadcast threshold) is broadcast
    and no row moves; rows that one task can hold as a whole are joined as they are.  Otherwise heavy hitters are
    measured first: only their rows are dealt to slices (by ``spread_by`` or row number), as many as their share calls
    for, and only their unique rows are copied, once a slice.
    """
    if how not in ("left", "inner"):
        raise ValueError("the copied side must not decide which rows survive")
    keys = list(keys)
    if small is None:
        threshold = rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
        small = int(rows.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(threshold))
    if estimated_bytes(unique) <= small:
        return rows.join(F.broadcast(unique), keys, how)
    if estimated_bytes(rows) <= ONE_TASK:
        return rows.join(unique, keys, how)
    hot = F.broadcast(heavy_hitters(rows, keys))

    def marked(df: DataFrame) -> DataFrame:
        joined = df.withColumn("_mark", F.xxhash64(*keys)).join(hot, "_mark", "left")
        return joined.withColumn("_slices", F.coalesce("_slices", F.lit(1))).drop("_mark")

    number = F.xxhash64(*spread_by) if spread_by else F.monotonically_increasing_id()
    dealt = marked(rows).withColumn("_slice", F.pmod(number, F.col("_slices").cast("long")).cast("int")).drop("_slices")
    copies = marked(unique).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return dealt.join(copies, [*keys, "_slice"], how).drop("_slice")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    chunk: str,
    order: str,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums and maxima per group in two bounded steps.

    ``chunk`` must grow with ``order`` and hold a bounded number of rows.  Totals
    run inside each chunk, the totals of earlier chunks are added afterwards, so
    no task ever holds a whole group.  The input is read twice, so it is
    stored instead of being computed twice.
    """
    df = stored(df)
    sums, maxes = dict(sums or {}), dict(maxes or {})
    whole = [F.sum(src).alias(f"_c_{out}") for out, src in sums.items()]
    whole += [F.max(src).alias(f"_c_{out}") for out, src in maxes.items()]
    per_chunk = df.groupBy(*group, chunk).agg(*whole)

    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *group,
        chunk,
        *[F.sum(f"_c_{out}").over(earlier).alias(f"_b_{out}") for out in sums],
        *[F.max(f"_c_{out}").over(earlier).alias(f"_b_{out}") for out in maxes],
    )

    inside = (
        Window.partitionBy(*group, chunk)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.select(
        "*",
        *[F.sum(src).over(inside).alias(f"_i_{out}") for out, src in sums.items()],
        *[F.max(src).over(inside).alias(f"_i_{out}") for out, src in maxes.items()],
    )
    joined = local.join(carried, [*group, chunk], "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_i_{o}", zero) + F.coalesce(f"_b_{o}", zero)).alias(o) for o in sums],
        *[F.greatest(f"_i_{o}", f"_b_{o}").alias(o) for o in maxes],
    )


def counts_before(
    df: DataFrame, group: Sequence[str], order: str, cutoffs: DataFrame, cutoff: str, counts: Mapping[str, Column], bits: int = 16
) -> DataFrame:
    """Conditional counts of the rows that come before a cut-off of their group; one row per cut-off.

    Rows and cut-offs move once, by group and range of ``2 ** bits`` positions, so a group of any size lies in many places.
    Ranges that end before the cut-off count whole, in the range the cut-off tears rows are held against it; then the
    counts of the ranges, one row each, are added.
    """
    group, names = list(group), list(counts)
    none = F.lit(None).cast("bigint")

    def placed(frame: DataFrame, position: str, **known: Column) -> DataFrame:
        conditions = [known.get(n, F.lit(False)).alias(n) for n in names]
        return frame.select(
            *group, F.shiftright(F.col(position), bits).alias("_range"), known.get("_order", none).alias("_order"), known.get("_cut", none).alias("_cut"), *conditions
        )

    rows = placed(df, order, _order=F.col(order).cast("bigint"), **counts)
    cuts = placed(cutoffs, cutoff, _cut=F.col(cutoff).cast("bigint"))
    torn = rows.unionByName(cuts).withColumn("_cut", F.max("_cut").over(Window.partitionBy(*group, "_range")))
    early = F.col("_cut").isNull() | (F.col("_order") < F.col("_cut"))
    ranges = torn.groupBy(*group, "_range").agg(F.max("_cut").alias("_cut"), *[F.count_if(F.col(n) & early).alias(n) for n in names])
    known = ranges.withColumn("_cut", F.max("_cut").over(Window.partitionBy(*group))).where("_cut is not null")
    before = F.col("_range") <= F.shiftright("_cut", bits)
    return known.groupBy(*group).agg(*[F.sum(F.when(before, F.col(n)).otherwise(0)).alias(n) for n in names])
