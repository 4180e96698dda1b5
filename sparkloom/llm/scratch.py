"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a new temporary folder only where it is unset (local runs and tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this session's own."""
    return f"{root(spark)}/sparkloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{name}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind ``df`` have no further reader, so Spark deletes them as the write ends.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of written tables that have no further reader."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, nor with another underscore at its end."""
    taken = {c.lower().rstrip("_") for c in df.columns}
    while name.lower() in taken:
        name = "x" + name
    return name


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as whole documents may be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def purge(spark: SparkSession) -> None:
    """Delete every intermediate table of this session; call it once results are written."""
    _delete(spark, f"{root(spark)}/sparkloom-{spark.sparkContext.applicationId}")
