"""Drill-downs: slowest-first listings, lookups, rankings and the full report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope.operators.keyed import balanced_join


def slowest(df: DataFrame, by: str = "runtimesec", ties: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Whole listing, slowest first; ``limit`` turns it into a top-k without a full sort."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), *ties)
    return ordered if limit is None else ordered.limit(limit)


def slowest_per(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], k: int) -> DataFrame:
    """The ``k`` slowest rows of every key.  Spark prunes to k per partition before shuffling."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), *ties))
    return df.withColumn("place", place).where(F.col("place") <= k)


def lookup(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows of one id, or of a list of ids; ids compare as text so ``driver`` is fine."""
    value = F.col(column).cast("string")
    if isinstance(wanted, (list, tuple, set)):
        return df.where(value.isin(*[str(w) for w in wanted]))
    return df.where(value == str(wanted))


def first_application(applications: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Earliest application of each cluster."""
    return applications.groupBy(*keys).agg(
        F.min_by("application_id", F.struct("start_time", "application_id")).alias("application_id")
    )


def live_executors(executors: DataFrame, include_dead: bool = False) -> DataFrame:
    return executors if include_dead else executors.where("is_active")


def stage_details(stages: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage attempts with their task summary when there is one; the attempt counts where both sides name it."""
    attempt = [c for c in ("stage_attempt_id",) if c in stages.columns and c in summaries.columns and c not in keys]
    return stages.join(summaries, [*keys, *attempt], "left")


# Property lists of the environment payload.
PROPERTY_LISTS = ("sparkProperties", "hadoopProperties", "systemProperties", "classpathEntries")


def configuration(environment: DataFrame, keys: Sequence[str] = ("application_id",)) -> DataFrame:
    """Environment payloads as rows: list, property, value."""

    def rows(name: str) -> Column:
        pairs = F.coalesce(name, F.array().cast("array<array<string>>"))
        return F.transform(
            pairs, lambda pair: F.struct(F.lit(name).alias("kind"), F.get(pair, 0).alias("property"), F.get(pair, 1).alias("value"))
        )

    return environment.select(*keys, F.inline(F.concat(*[rows(name) for name in PROPERTY_LISTS])))


def slow_executions(executions: DataFrame, threshold_seconds: int = 300) -> DataFrame:
    return executions.where(F.col("duration_ms") > 1000 * threshold_seconds)


def execution_overview(executions: DataFrame, keys: Sequence[str] = ("application_id", "sql_id")) -> DataFrame:
    """Node and metric totals of each execution from its nested ``nodes``."""
    nodes = F.coalesce("nodes", F.array())
    per_node = F.transform(nodes, lambda n: F.coalesce(F.size(n.metrics), F.lit(0)))
    return executions.select(
        *keys,
        "status",
        "duration_ms",
        F.left(F.coalesce("description", F.lit("")), F.lit(200)).alias("description"),
        F.size(nodes).alias("total_nodes"),
        F.size(F.filter(per_node, lambda n: n > 0)).alias("nodes_with_metrics"),
        F.aggregate(per_node, F.lit(0), lambda a, b: a + b).alias("total_metrics_collected"),
    )


#: Sizes that share a coarse step when ranking; both ranking steps stay this small.
RANK_STEP = 65_536


def rank_by_size(df: DataFrame, keys: Sequence[str], size: Column, spread_by: Sequence[str] = ()) -> DataFrame:
    """``rank()`` by descending size within ``keys`` without a window over the rows.

    Sizes are counted, ranked in two steps (coarse steps of 65,536, then the sizes
    inside a step), and joined back in balance, so a key or a size with most of
    the rows is neither sorted nor joined in one task.
    """
    sized = df.withColumn("stringlength", size)
    size_key = [*keys, "stringlength"]
    per_size = sized.groupBy(*size_key).agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_step", F.floor(F.col("stringlength") / RANK_STEP)
    )
    larger = Window.unboundedPreceding, -1
    above_step = Window.partitionBy(*keys).orderBy(F.desc("_step")).rowsBetween(*larger)
    above_size = Window.partitionBy(*keys, "_step").orderBy(F.desc("stringlength")).rowsBetween(*larger)
    steps = per_size.groupBy(*keys, "_step").agg(F.sum("_rows").alias("_rows")).select(
        *keys, "_step", F.coalesce(F.sum("_rows").over(above_step), F.lit(0)).alias("_before")
    )
    ranks = (
        per_size.withColumn("_inside", F.coalesce(F.sum("_rows").over(above_size), F.lit(0)))
        .join(steps, [*keys, "_step"])
        .select(*size_key, (F.col("_before") + F.col("_inside") + 1).alias("rank"))
    )
    return balanced_join(sized, ranks, size_key, "inner", spread_by)


def placed(df: DataFrame, by: str = "runtimesec", keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``place``: one more than the number of rows (of a key) that took longer; NULL where ``by`` is."""
    ranked = rank_by_size(df.where(F.col(by).isNotNull()), list(keys), F.col(by).cast("long"))
    timed = ranked.withColumnRenamed("rank", "place").select(*df.columns, "place")
    return timed.unionByName(df.where(F.col(by).isNull()).withColumn("place", F.lit(None).cast("long")))


def sql_snippets(executions: DataFrame, keys: Sequence[str], limit: float = 20000, ranking: int = 0) -> DataFrame:
    """Node payloads as JSON text with their size rank, below a size limit.

    The rank counts all payloads of the key, also those the limit removes.
    """
    text = F.to_json("nodes")
    ranked = rank_by_size(
        executions.withColumn("nodestring", text), keys, F.octet_length("nodestring"), ["sql_id"]
    )
    kept = ranked.where(F.col("stringlength") < limit)
    return kept if ranking == 0 else kept.where(F.col("rank") == ranking)


def full_report(parts: dict[str, DataFrame], keys: Sequence[str] = ("application_id",)) -> DataFrame:
    """All that is known about applications as ordered sections of JSON payloads.

    ``parts`` maps a section name to a frame with the key columns, in report order;
    absent sections are left out.  One row per item, so a huge application is
    written by many tasks: order by ``(keys, section_no, item)`` to read it.
    """
    rows = None
    for number, (section, frame) in enumerate(parts.items()):
        fields = [c for c in frame.columns if c not in keys]
        part = frame.select(
            *[F.col(k).cast("string").alias(k) for k in keys],
            F.lit(number).alias("section_no"),
            F.lit(section).alias("section"),
            F.to_json(F.struct(*fields)).alias("payload"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows
