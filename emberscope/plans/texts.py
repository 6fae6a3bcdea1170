"""Wording of recommendations, issues and reports."""

REVIEW_JOBS = "Review failed job logs for root cause. Common issues include OOM errors, data skew, or external service failures."
REVIEW_STAGES = "Check executor logs for OOM, shuffle fetch failures, or task failures. Consider increasing executor memory or reducing partition sizes."
REVIEW_RETRIES = "Investigate transient failures. Consider enabling speculation for straggler tasks."
SPECULATION = "spark.speculation=true"
REVIEW_TASKS = "Check for data corruption, OOM errors, or network issues. Consider increasing task retries."
TASK_RETRIES = "spark.task.maxFailures=8"
AVOID_SPILL = "Increase executor memory or reduce partition sizes to avoid spilling to disk."
SPILL_CONFIG = "spark.executor.memory (increase by 50-100%) or spark.sql.shuffle.partitions (increase to reduce per-partition data)"
REDUCE_SHUFFLE = "Consider reducing shuffle by using broadcast joins for small tables, or enabling adaptive query execution."
ADAPTIVE_COALESCE = "spark.sql.adaptive.enabled=true; spark.sql.adaptive.coalescePartitions.enabled=true"
MONITOR_SHUFFLE = "Monitor shuffle performance. Consider AQE for automatic optimization."
ADAPTIVE = "spark.sql.adaptive.enabled=true"
SALT_JOIN = "Consider salting keys, using broadcast join, or enabling AQE skew join optimization."
SKEW_JOIN = "spark.sql.adaptive.skewJoin.enabled=true"
REVIEW_SQL = "Review query plans and error messages. Check for data issues or resource constraints."
REVIEW_PLANS = "Review execution plans for optimization opportunities. Consider partitioning, caching, or query restructuring."
FEWER_PARTITIONS = "Consider reducing partition count for stages with very high task counts."
FEWER_PARTITIONS_CONFIG = "spark.sql.shuffle.partitions (reduce if > 2000)"
DYNAMIC_PARTITIONS = "Enable AQE to dynamically adjust partitions based on data size."
EVEN_KEYS = (
    "Data is unevenly distributed across partitions. Consider repartitioning by a more evenly distributed key, "
    "enabling AQE skew join handling, or salting skewed keys."
)
SKEW_JOIN_256M = "spark.sql.adaptive.skewJoin.enabled=true; spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes=256m"
TAIL_TASKS = (
    "Tail tasks are processing disproportionately large partitions. Consider increasing partition count, "
    "enabling speculation for stragglers, or investigating data skew in join/group-by keys."
)
TAIL_CONFIG = "spark.speculation=true; spark.sql.shuffle.partitions (increase to reduce per-partition data)"
MORE_PARTITIONS = (
    "Increase the number of partitions to reduce per-task data volume. "
    "For file scans, consider setting spark.sql.files.maxPartitionBytes. "
    "For shuffles, increase spark.sql.shuffle.partitions."
)
MORE_PARTITIONS_CONFIG = "spark.sql.files.maxPartitionBytes=128m; spark.sql.shuffle.partitions (increase 2-4x)"
SMALLER_INPUT = (
    "Consider reducing max partition bytes or increasing partition count to keep "
    "task-level data below 256-512 MB for optimal memory utilization."
)
SMALLER_INPUT_CONFIG = "spark.sql.files.maxPartitionBytes=128m"
SMALLER_SHUFFLE = "Increase spark.sql.shuffle.partitions, enable AQE coalescing, or investigate skewed join/group-by keys."
SMALLER_SHUFFLE_CONFIG = "spark.sql.shuffle.partitions (increase 2-4x); spark.sql.adaptive.enabled=true"
SLOW_TASKS = (
    "Tasks are processing data too slowly. Potential causes: expensive UDFs or transformations, "
    "Python UDFs (consider Pandas UDFs), excessive object creation causing GC pressure, or I/O throttling. "
    "Profile the workload to identify CPU-bound operations."
)
SLOW_TASKS_CONFIG = "Consider a native vectorized engine, vectorized Pandas UDFs, or reducing transformation complexity"

NOTHING_TO_TUNE = "No tuning recommendations. Your Spark job appears well-optimized!"
REPORT_TITLE = "# Spark Tuning Recommendations\n"
SEVERITY_LABELS = {
    "high": "🔴 HIGH PRIORITY",
    "medium": "🟡 MEDIUM PRIORITY",
    "low": "🟢 LOW PRIORITY",
    "info": "ℹ️ INFORMATIONAL",
}

ISSUE_ADVICE = {
    "DATA_SKEW": "Consider salting keys, using adaptive query execution, or repartitioning data to reduce skew.",
    "HIGH_GC_TIME": "Increase executor memory, tune GC settings, or reduce data size per task.",
    "MEMORY_SPILL": "Increase spark.memory.fraction or executor memory, or reduce partition sizes.",
    "TOO_MANY_SMALL_TASKS": "Consider coalescing partitions or increasing spark.sql.shuffle.partitions appropriately.",
    "CLUSTER_WIDE_GC": "Consider G1GC, increase executor memory, or tune spark.memory.fraction and spark.memory.storageFraction.",
}
