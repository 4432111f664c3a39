"""Session factory and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "tastegrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; without that a cluster has no such folder and
    a ``ValueError`` says so. Only a local master (single-machine tests) gets a fresh temporary
    folder, recorded in the session so that later calls reuse it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.conf.get("tastegrid.shared.dir", None)
    if named is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        named = tempfile.mkdtemp(prefix="tastegrid-")
        spark.conf.set("tastegrid.shared.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for one written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of a query when the query is over, not when the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write a table that several steps read, and read it back.

    Later steps then start from narrow columnar files: the work behind ``df`` runs once,
    survives the loss of executors, and its size is known to the planner. Its shuffle files go
    as soon as it is written. Each value of the columns ``folders`` has its own folder, so that
    a step that wants one value reads no other.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more (an empty table takes their place)."""
    for table in tables:
        files = table.inputFiles()
        if files:
            path = files[0].rsplit("/", 1)[0]
            table.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
