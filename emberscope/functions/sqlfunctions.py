"""Table and scalar SQL functions over landed payload views, for SQL users and tools.

``register(spark, frames)`` takes payload-shaped frames (``schemas.PAYLOADS`` plus
``cluster_id``) and creates temporary views and functions in the session.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberscope.operators import drill
from emberscope.plans.compat import ROW_OPERATORS
from emberscope.schemas import NODE_LIST

VIEW = "emberscope_{}"

# Result columns of the job, stage, SQL and executor functions.
JOB_COLUMNS = (
    "jobId STRING, name STRING, description STRING, submissionTime STRING, completionTime STRING, stageIds ARRAY<STRING>, "
    "status STRING, numTasks DOUBLE, numCompletedTasks DOUBLE, numSkippedTasks DOUBLE, numFailedTasks DOUBLE, "
    "numCompletedStages DOUBLE, numSkippedStages DOUBLE, numFailedStages DOUBLE"
)
STAGE_COLUMNS = (
    "stageId STRING, attemptId STRING, name STRING, description STRING, submissionTime STRING, completionTime STRING, status STRING, "
    "numTasks DOUBLE, numCompletedTasks DOUBLE, numSkippedTasks DOUBLE, numFailedTasks DOUBLE, numCompletedStages DOUBLE, "
    "numSkippedStages DOUBLE, numFailedStages DOUBLE, memoryBytesSpilled BIGINT, diskBytesSpilled BIGINT, inputBytes BIGINT, "
    "inputRecords BIGINT, outputBytes BIGINT, outputRecords BIGINT, shuffleReadBytes BIGINT, shuffleReadRecords BIGINT, "
    "shuffleWriteBytes BIGINT, shuffleWriteRecords BIGINT"
)
SQL_COLUMNS = (
    "id BIGINT, status STRING, description STRING, planDescription STRING, submissionTime STRING, duration BIGINT, "
    f"successJobIds ARRAY<STRING>, failedJobIds STRING, nodes {NODE_LIST}"
)
EXECUTOR_COLUMNS = (
    "id STRING, memoryUsed DOUBLE, diskUsed DOUBLE, totalCores DOUBLE, addTime STRING, removeTime STRING, maxTasks DOUBLE, "
    "completedTasks DOUBLE, totalTasks DOUBLE, totalDuration DOUBLE, totalGCTime DOUBLE, totalInputBytes BIGINT, "
    "totalShuffleRead BIGINT, totalShuffleWrite BIGINT, maxMemory BIGINT"
)
_RUN = "timestampdiff(SECOND, to_timestamp(submissionTime), to_timestamp(completionTime))"
_UP = "timestampdiff(SECOND, to_timestamp(addTime), to_timestamp(removeTime))"


def _names(columns: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).fieldNames()


def _view(spark: SparkSession, name: str, frame: DataFrame, columns: str) -> str:
    """Temporary view with exactly the declared columns; absent ones are NULL."""
    from pyspark.sql.types import StructType

    present = set(frame.columns)
    typed = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(columns).fields
    ]
    view = VIEW.format(name)
    frame.select(F.col("cluster_id").cast("string").alias("cluster_id"), *typed).createOrReplaceTempView(view)
    return view


def register(spark: SparkSession, frames: Mapping[str, DataFrame]) -> list[str]:
    """Create the functions whose frames are given; returns their names.

    Frames: ``applications`` (cluster_id, application_id, start_time), ``jobs``,
    ``stages``, ``sql``, ``executors`` and ``task_summaries`` (cluster_id, stage_id,
    stage_attempt_id, raw_json).
    """
    made = []

    def function(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
        made.append(name)

    def listing(name, view, columns, extra, parameters="", condition="true", order=""):
        added, expression = extra if extra else ("", "")
        picked = ", ".join(_names(columns)) + (f", {expression} AS {added.split()[0]}" if extra else "")
        returns = f"TABLE ({columns}{', ' + added if extra else ''})"
        function(
            name, "clusterid STRING" + parameters, returns,
            f"SELECT {picked} FROM {view} WHERE cluster_id = clusterid AND {condition} {order}",
        )

    if "applications" in frames:
        view = VIEW.format("applications")
        frames["applications"].select(
            F.col("cluster_id").cast("string").alias("cluster_id"), F.col("application_id").cast("string").alias("application_id"), "start_time"
        ).createOrReplaceTempView(view)
        function(
            "getappid", "clusterid STRING", "STRING",
            f"(SELECT min_by(application_id, struct(start_time, application_id)) FROM (SELECT * FROM {view} WHERE cluster_id = clusterid))",
        )
    if "jobs" in frames:
        view = _view(spark, "jobs", frames["jobs"], JOB_COLUMNS)
        run = ("runtimesec BIGINT", _RUN)
        listing("getslowestjobs", view, JOB_COLUMNS, run, order="ORDER BY runtimesec DESC")
        listing("jobmetrics", view, JOB_COLUMNS, run, ", jobidsarr ARRAY<STRING>", "array_contains(jobidsarr, jobId)")
    if "stages" in frames:
        view = _view(spark, "stages", frames["stages"], STAGE_COLUMNS)
        run = ("runtimesec BIGINT", _RUN)
        listing("getsloweststages", view, STAGE_COLUMNS, run, order="ORDER BY runtimesec DESC")
        listing("stagemetrics", view, STAGE_COLUMNS, run, ", stageidsarr ARRAY<STRING>", "array_contains(stageidsarr, stageId)")
        listing("getstage", view, STAGE_COLUMNS, run, ", wantedstage INT", "stageId = CAST(wantedstage AS STRING)")
    if "executors" in frames:
        view = _view(spark, "executors", frames["executors"], EXECUTOR_COLUMNS)
        listing("getexecutor", view, EXECUTOR_COLUMNS, ("uptime BIGINT", _UP), ", executorid STRING", "id = executorid")
    if "sql" in frames:
        view = _view(spark, "sql", frames["sql"], SQL_COLUMNS)
        listing("getslowestsql", view, SQL_COLUMNS, None, order="ORDER BY duration DESC")
        snippets = drill.sql_snippets(
            spark.table(view).withColumnRenamed("id", "sql_id"), ["cluster_id"], limit=float("inf")
        ).select("cluster_id", "nodestring", "successJobIds", "stringlength", "rank")
        snippet_view = VIEW.format("sql_snippets")
        snippets.createOrReplaceTempView(snippet_view)
        function(
            "sqlmetrics", "clusterid STRING, sizelimit DOUBLE DEFAULT 20000, ranking DOUBLE DEFAULT 0",
            "TABLE (nodestring STRING, successJobIds ARRAY<STRING>, stringlength BIGINT, rank DOUBLE)",
            f"SELECT nodestring, successJobIds, stringlength, rank FROM {snippet_view} WHERE cluster_id = clusterid "
            "AND stringlength < sizelimit AND (ranking = 0 OR rank = ranking) ORDER BY stringlength DESC",
        )
        listed = ", ".join(f"'{name}'" for name in ROW_OPERATORS)
        nodes = f"(SELECT id, inline(nodes) FROM {view} WHERE cluster_id = clusterid)"
        function(
            "compatmetrics", "clusterid STRING", "DOUBLE",
            f"(SELECT try_divide(count_if(nodeName NOT IN ({listed})), count(*)) FROM {nodes})",
        )
        pattern = "|".join(ROW_OPERATORS)
        function(
            "compatanalysis", "clusterid STRING", "TABLE (sql_id BIGINT, compatible_nodes BIGINT, total_nodes BIGINT, compatible_ratio DOUBLE)",
            f"SELECT id, count_if(NOT nodeName RLIKE '{pattern}'), count(*), try_divide(count_if(NOT nodeName RLIKE '{pattern}'), count(*)) "
            f"FROM {nodes} GROUP BY id",
        )
    if "task_summaries" in frames:
        view = VIEW.format("task_summaries")
        summaries = frames["task_summaries"]
        owner = F.col("application_id").cast("string") if "application_id" in summaries.columns else F.lit(None)
        summaries.withColumns(
            {"cluster_id": F.col("cluster_id").cast("string"), "application_id": F.coalesce(owner, F.lit(""))}
        ).createOrReplaceTempView(view)
        function(
            "taskmetrics", "clusterid STRING, wantedstage INT, wantedapplication STRING DEFAULT NULL", "STRING",
            # a stage number that several applications have needs one of them named, else there is no answer
            f"(SELECT CASE WHEN count(DISTINCT application_id) = 1 THEN min(raw_json) END FROM (SELECT raw_json, application_id FROM {view} "
            "WHERE cluster_id = clusterid AND stage_id = wantedstage AND stage_attempt_id = 0 "
            "AND (wantedapplication IS NULL OR application_id = wantedapplication)))",
        )
    return made
