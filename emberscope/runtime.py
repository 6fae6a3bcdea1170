"""Session settings and the few places that need an action before the plan is known."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for; a cluster normally has its own values
#: for the sizing ones, so only correctness and AQE settings are listed here.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(app_name: str = "emberscope", cpus: int | str = "*", **extra) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which all executors share.

    A cluster has to name one.  Only a local session that names none, as in tests, gets a folder of its own, once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="emberscope-checkpoint-"))
    return context.getCheckpointDir()


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/emberscope-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends there, lost executors cost nothing, and readers take only the columns they use.  The folder belongs to
    the session and goes with it (:func:`release`).
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if spark.sparkContext.applicationId not in _AT_EXIT:
        _AT_EXIT.add(spark.sparkContext.applicationId)
        atexit.register(_release_at_exit, spark)
    return spark.read.schema(df.schema).parquet(path)


_AT_EXIT: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this session; frames read from there are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        release(spark)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder, so a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
