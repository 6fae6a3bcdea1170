"""Cluster selection, incremental discovery and cluster-level joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.operators.keyed import balanced_join

# Cluster states.
DEFAULT_STATES = ("TERMINATED", "WAITING")
ANALYSABLE_STATES = ("RUNNING", "WAITING", "TERMINATED")


def discover(
    clusters: DataFrame,
    states=DEFAULT_STATES,
    name_filter: str | None = None,
    min_hours: int = 0,
    created_after: str | None = None,
    created_before: str | None = None,
    max_clusters: int | None = None,
    order_by=("creation_date", "cluster_id"),
) -> DataFrame:
    """Clusters that match all criteria; the last day of the range is inclusive."""
    if created_after and created_before and created_after > created_before:
        raise ValueError("created_after must not be later than created_before")
    chosen = clusters.where(F.col("state").isin(*states))
    if name_filter:
        chosen = chosen.where(F.lower("cluster_name").contains(name_filter.lower()))
    if min_hours > 0:
        chosen = chosen.where(F.coalesce("normalized_instance_hours", F.lit(0)) >= min_hours)
    if created_after:
        chosen = chosen.where(F.col("creation_date") >= F.to_timestamp(F.lit(created_after)))
    if created_before:
        chosen = chosen.where(F.col("creation_date") < F.to_timestamp(F.lit(created_before)) + F.expr("interval 1 day"))
    if max_clusters is not None:
        chosen = chosen.orderBy(*order_by).limit(max_clusters)
    return chosen


def analysable(clusters: DataFrame) -> DataFrame:
    """Clusters with Spark installed, in a state that keeps history."""
    has_spark = F.exists("applications", lambda a: a.contains("Spark"))
    return clusters.where(has_spark & F.col("state").isin(*ANALYSABLE_STATES))


def not_yet_analysed(clusters: DataFrame, applications: DataFrame) -> DataFrame:
    """Clusters without any landed application."""
    return clusters.join(applications.select("cluster_id").distinct(), "cluster_id", "left_anti")


def scored_clusters(cluster_summaries: DataFrame, applications: DataFrame, scores: DataFrame) -> DataFrame:
    """Applications with their cluster summary (kept even without one), joined to scores.

    Scores are per cluster name, or per cluster name and application.
    """
    summaries = cluster_summaries.drop("cluster_name")
    all_apps = balanced_join(applications, summaries, ["cluster_id"], "left")
    on = ["cluster_name"] + (["application_id"] if "application_id" in scores.columns else [])
    return balanced_join(all_apps, scores, on, "inner")
