"""Writing results: managed tables, dated parquet, JSON lines and text reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_schema(spark: SparkSession, schema: str) -> None:
    spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name)", args={"name": schema})


def append_tables(frames: Mapping[str, DataFrame | None], schema: str, source_format: str = "parquet", enabled: bool = True) -> list[str]:
    """Append every given frame to ``schema.<name>``; nothing is written when disabled."""
    written = []
    for name, frame in frames.items():
        if frame is None or not enabled:
            continue
        frame.write.format(source_format).mode("append").saveAsTable(f"{schema}.{name}")
        written.append(f"{schema}.{name}")
    return written


def replace_table(frame: DataFrame, table: str, source_format: str = "parquet") -> None:
    """Create or replace a result table."""
    frame.write.format(source_format).mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def write_dated(frames: Mapping[str, DataFrame | None], root: str, run_date: dt.date | None = None) -> dict[str, str]:
    """Overwrite ``<root>/<date>/<name>`` as parquet."""
    day = (run_date or dt.date.today()).isoformat()
    paths = {}
    for name, frame in frames.items():
        if frame is None:
            continue
        paths[name] = f"{root.rstrip('/')}/{day}/{name}"
        frame.write.mode("overwrite").parquet(paths[name])
    return paths


def export_metrics(frames: Mapping[str, DataFrame], output_dir: str) -> dict[str, str]:
    """JSON lines under ``<output_dir>/<name>``, written in parallel."""
    paths = {}
    for name, frame in frames.items():
        paths[name] = f"{output_dir.rstrip('/')}/{name}"
        frame.write.mode("overwrite").json(paths[name])
    return paths


def write_report(blocks: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Report blocks as text, globally in order; one folder per key.

    Range partitioning on (keys, order) keeps the text of an application in order
    across files without pulling one application into one task.
    """
    ordered = blocks.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    named = ordered.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("block").alias("value"))
    named.write.mode("overwrite").partitionBy(*keys).text(path)
