"""How much of the SQL work runs in operators a vectorised engine can take over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.schemas import NODE_LIST

# Operators that stay row-at-a-time.
ROW_OPERATORS = (
    "MapElements",
    "MapPartitions",
    "Scan csv",
    "Scan json",
    "PythonUDF",
    "ScalaUDF",
    "FlatMapGroupsInPandas",
    "DeserializeToObject",
    "SerializeFromObject",
)


def exploded_nodes(sql: DataFrame, keep: Sequence[str] = ("cluster_name", "application_id", "sql_id")) -> DataFrame:
    """One row per plan node from ``sql_raw_json``; executions without nodes drop out."""
    nodes = F.try_variant_get(F.try_parse_json("sql_raw_json"), "$.nodes", NODE_LIST)
    return sql.select(*keep, F.inline(nodes)).withColumnsRenamed({"nodeId": "node_id", "nodeName": "node_name"})


def vectorisable(node_name: Column, substring: bool = False, operators: Sequence[str] = ROW_OPERATORS) -> Column:
    """1 unless the node is (or, with ``substring``, contains) a row-at-a-time operator."""
    if substring:
        hit = F.lit(False)
        for name in operators:
            hit = hit | node_name.contains(name)
    else:
        hit = node_name.isin(*operators)
    return F.when(hit, 0).otherwise(1)


def compatibility(nodes: DataFrame, keys: Sequence[str] = ("cluster_name", "application_id"), substring: bool = False) -> DataFrame:
    """Share of vectorisable nodes per key; no keys gives one overall ratio."""
    flag = vectorisable(F.col("node_name"), substring)
    return nodes.groupBy(*keys).agg(
        F.sum(flag).cast("bigint").alias("compatible_nodes"),
        F.count(F.lit(1)).alias("total_nodes"),
        F.try_divide(F.sum(flag), F.count(F.lit(1))).alias("compatible_ratio"),
    )


def node_histogram(nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return nodes.groupBy(*keys, "node_name").agg(F.count(F.lit(1)).alias("nodes"))


def node_types(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by the first word of the node name."""
    kind = F.element_at(F.split(F.trim("node_name"), r"\s+"), 1)
    return nodes.withColumn("node_type", kind).where("node_type <> ''").groupBy(*keys, "node_type").agg(
        F.count(F.lit(1)).alias("nodes")
    )
