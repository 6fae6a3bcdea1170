"""Landed history snapshots: endpoint payloads as files, JSON text columns or envelopes.

Fetching is not Spark's job; payloads are expected under
``<root>/<endpoint>/cluster_id=<id>/application_id=<id>/`` as JSON (one object or
one list per line), so one read covers all clusters and partitions prune by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.schemas import PAYLOADS, RUN_KEYS

BAD_RECORD = "_bad_record"

# Key of the list inside an envelope.
ENVELOPE_KEYS = {endpoint: endpoint for endpoint in PAYLOADS}


def read_snapshot(spark: SparkSession, root: str, endpoint: str, multi_line: bool = False) -> DataFrame:
    """Payload rows of one endpoint, key columns taken from the path.

    Unreadable records come back with ``_bad_record`` set and everything else NULL;
    split them off with :func:`good_rows` and :func:`bad_rows`.
    """
    keys = "cluster_id STRING, application_id STRING"
    return (
        spark.read.schema(f"{PAYLOADS[endpoint]}, {BAD_RECORD} STRING, {keys}")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("multiLine", multi_line)
        .json(f"{root.rstrip('/')}/{endpoint}")
    )


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def bad_rows(rows: DataFrame) -> DataFrame:
    """Keys and text of records that did not parse."""
    return rows.where(F.col(BAD_RECORD).isNotNull()).select(
        *[k for k in RUN_KEYS if k in rows.columns], F.col(BAD_RECORD).alias("record")
    )


def typed_list(df: DataFrame, column: str, endpoint: str, keep: Sequence[str]) -> DataFrame:
    """Rows of a JSON list held as text, typed by the endpoint's schema."""
    items = F.from_json(column, f"ARRAY<STRUCT<{_colons(PAYLOADS[endpoint])}>>")
    return df.select(*keep, F.inline(items))


def envelope_rows(df: DataFrame, column: str, endpoint: str, keep: Sequence[str]) -> DataFrame:
    """Rows of ``{"success": true, "<endpoint>": [...], "count": n}``; failures drop out."""
    kind = ENVELOPE_KEYS[endpoint]
    shape = f"success BOOLEAN, `{kind}` ARRAY<STRUCT<{_colons(PAYLOADS[endpoint])}>>"
    parsed = df.select(*keep, F.from_json(column, shape).alias("e"))
    return parsed.where("e.success").select(*keep, F.inline(F.col(f"e.{kind}")))


def envelope_errors(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Failed or unreadable envelopes with their error text and type."""
    parsed = df.select(*keep, column, F.from_json(column, "success BOOLEAN, error STRING, error_type STRING").alias("e"))
    return parsed.where(~F.coalesce("e.success", F.lit(False))).select(
        *keep,
        F.coalesce("e.error", F.lit("unreadable response")).alias("error"),
        F.coalesce("e.error_type", F.lit("UNKNOWN_ERROR")).alias("error_type"),
    )


def _colons(fields: str) -> str:
    """``a INT, b ARRAY<..>`` with a colon after each top-level name, for use inside STRUCT<>."""
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(fields))
