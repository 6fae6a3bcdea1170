"""emberscope: Spark workload telemetry, analysed with Spark.

Raw event logs and landed history snapshots come in as DataFrames; job, stage,
task, SQL and executor tables, quantile summaries, tuning recommendations and
efficiency scores come out as DataFrames.  Every operator is keyed by the
application (and cluster), so one run covers any number of applications.
"""

__version__ = "0.1.0"
