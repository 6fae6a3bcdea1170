"""Collection status: which endpoint of which cluster delivered what."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberscope import schemas
from emberscope.functions.text import shorten
from emberscope.schemas import conform

# Endpoints in report order and the totals column of each.
ENDPOINTS = {
    "applications": "total_applications",
    "jobs": "total_jobs",
    "stages": "total_stages",
    "tasks": "total_tasks",
    "sql": "total_sql_queries",
    "executors": "total_executors",
    "task_summaries": "total_task_summaries",
}
MAX_CODES = 3
REASON_LENGTH = 30
MESSAGE_LENGTH = 500


def error_code(kind: Column, message: Column, http_status: Column, service_code: Column) -> Column:
    """Short code of a failed call from its exception type, status and message."""
    return (
        F.when(kind.isin("ReadTimeout", "Timeout"), "TIMEOUT")
        .when(kind == "ConnectionError", "CONNECTION_ERROR")
        .when((kind == "HTTPError") & http_status.isNotNull(), F.concat(F.lit("HTTP_"), http_status.cast("string")))
        .when((kind == "ClientError") & service_code.isNotNull(), F.concat(F.lit("AWS_"), service_code))
        .when(kind == "ClientError", "AWS_CLIENT_ERROR")
        .when((kind == "ValueError") & message.contains("Persistent App UI did not become ready"), "PERSISTENT_UI_NOT_READY")
        .when((kind == "ValueError") & message.contains("No presigned URL"), "PERSISTENT_UI_NO_PRESIGNED_URL")
        .when((kind == "ValueError") & message.contains("No persistent UI ID"), "PERSISTENT_UI_NO_ID")
        .otherwise("UNKNOWN_ERROR")
    )


def _first_codes(fetch_log: DataFrame, keys: list[str], distinct: bool) -> DataFrame:
    """First error codes per key in call order, joined by commas."""
    errors = fetch_log.where(F.col("error_code").isNotNull()).select(*keys, "error_code", "seq")
    if distinct:
        errors = errors.groupBy(*keys, "error_code").agg(F.min("seq").alias("seq"))
    # the row-number limit is applied per partition before the shuffle
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "error_code"))
    first = errors.withColumn("place", place).where(F.col("place") <= MAX_CODES)
    listed = F.array_sort(F.collect_list(F.struct("place", "error_code")))
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda e: e.error_code), ",").alias("codes"))


def endpoint_status(fetch_log: DataFrame) -> DataFrame:
    """OK, FAILED(codes) or SKIPPED(reason) per cluster and endpoint.

    ``fetch_log`` has one row per call: cluster_id, endpoint, attempted, rows,
    error_code, seq (call order), skip_reason.
    """
    keys = ["cluster_id", "endpoint"]
    calls = fetch_log.groupBy(*keys).agg(
        F.sum(F.coalesce("rows", F.lit(0))).alias("rows"),
        F.bool_or(F.coalesce("attempted", F.lit(False))).alias("attempted"),
        F.min_by("skip_reason", F.when(F.col("skip_reason").isNotNull(), F.col("seq"))).alias("reason"),
    )
    joined = calls.join(_first_codes(fetch_log, keys, distinct=False), keys, "left")
    reason = shorten(F.coalesce("reason", F.lit("No data")), REASON_LENGTH)
    status = (
        F.when(F.col("rows") > 0, "OK")
        .when(F.col("attempted") & F.col("codes").isNotNull(), F.concat(F.lit("FAILED("), F.col("codes"), F.lit(")")))
        .otherwise(F.concat(F.lit("SKIPPED("), reason, F.lit(")")))
    )
    return joined.select(*keys, "rows", "attempted", status.alias("status"))


def status_details(endpoint_rows: DataFrame) -> DataFrame:
    """One JSON object per cluster, all seven endpoints in order."""
    cells = [
        F.coalesce(F.max(F.when(F.col("endpoint") == e, F.col("status"))), F.lit("SKIPPED(No data)")).alias(e)
        for e in ENDPOINTS
    ]
    wide = endpoint_rows.groupBy("cluster_id").agg(*cells)
    return wide.select("cluster_id", F.to_json(F.struct(*ENDPOINTS)).alias("status_details"))


def cluster_status(fetch_log: DataFrame, endpoint_rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """COMPLETED, NO_APPLICATIONS(No data) or FAILED(...) per cluster.

    ``failures``: ``(cluster_id, message)`` of collections that broke off; the message stands in for codes where there
    are none, cut to 500 characters and with square brackets for round ones.  Of several messages the first by text.
    """
    totals = endpoint_rows.groupBy("cluster_id").agg(
        F.sum("rows").alias("rows"),
        F.bool_or(F.col("attempted")).alias("attempted"),
        F.coalesce(F.bool_or((F.col("endpoint") == "applications") & (F.col("rows") > 0)), F.lit(False)).alias("has_apps"),
        F.coalesce(F.bool_or((F.col("endpoint") == "applications") & F.col("attempted")), F.lit(False)).alias("asked_apps"),
    )
    codes = _first_codes(fetch_log, ["cluster_id"], distinct=True)
    status = (
        F.when(F.col("rows") > 0, "COMPLETED")
        .when(F.col("asked_apps") & ~F.col("has_apps"), "NO_APPLICATIONS(No data)")
        .when(F.col("codes").isNotNull(), F.concat(F.lit("FAILED("), F.col("codes"), F.lit(")")))
        .when(F.col("attempted") & (F.col("message") != ""), F.concat(F.lit("FAILED("), F.translate(shorten(F.col("message"), MESSAGE_LENGTH), "()", "[]"), F.lit(")")))
        .when(F.col("attempted"), "FAILED(UNKNOWN)")
        .otherwise("FAILED(NO_DATA)")
    )
    joined = totals.join(codes, "cluster_id", "left")
    if failures is None:
        joined = joined.withColumn("message", F.lit(None).cast("string"))
    else:
        joined = joined.join(failures.groupBy("cluster_id").agg(F.min("message").alias("message")), "cluster_id", "left")
    return joined.select("cluster_id", status.alias("analysis_status"))


def cluster_totals(tables: Mapping[str, DataFrame], key: str = "cluster_id") -> DataFrame:
    """Row counts of every table per cluster; each table is counted before anything is joined."""
    counted = None
    for endpoint, total in ENDPOINTS.items():
        if endpoint not in tables:
            continue
        part = tables[endpoint].groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("endpoint", F.lit(endpoint))
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("endpoint") == e, F.col("n"))), F.lit(0)).cast("bigint").alias(total)
            for e, total in ENDPOINTS.items()
        ]
    )


def cluster_summaries(
    clusters: DataFrame, totals: DataFrame, details: DataFrame, statuses: DataFrame, schema: str = schemas.CLUSTER_SUMMARIES
) -> DataFrame:
    """Summary table of the clusters; ``schema`` picks one of the two published layouts."""
    joined = (
        clusters.join(totals, "cluster_id", "left")
        .join(details, "cluster_id", "left")
        .join(statuses, "cluster_id", "left")
        .fillna(0, list(ENDPOINTS.values()))
    )
    return conform(joined, schema)


def run_summary(summaries: DataFrame) -> DataFrame:
    """One row about a whole collection run (every discovered cluster has a summary)."""
    everything = F.lit(True)
    for total in ENDPOINTS.values():
        everything = everything & (F.col(total) > 0)
    row = summaries.agg(
        F.count(F.lit(1)).alias("clusters_discovered_count"),
        F.count_if(F.col("analysis_status") == "COMPLETED").alias("clusters_extracted_count"),
        F.count_if(everything).alias("clusters_fully_analyzed_count"),
        *[F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias(total) for total in ENDPOINTS.values()],
    )
    share = F.try_divide(F.col("clusters_fully_analyzed_count"), F.col("clusters_extracted_count"))
    return row.withColumn("cluster_analysis_success_rate %", F.coalesce(F.round(share * 100.0, 2), F.lit(0.0)))
