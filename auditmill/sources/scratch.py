"""Folders for written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the shuffle files of a query go at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that is unset and driver and tasks are one process, a temporary folder of the
    session takes its place; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("auditmill.scratch.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("auditmill.scratch.dir", base)
    return f"{base.rstrip('/')}/auditmill-{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *by: str, mode: str = "error") -> None:
    """Write df, in a folder for each value of ``by``. The job's shuffle files go when it ends, not when the driver comes to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).partitionBy(*by).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back. Written tables that df names in ``_reads`` are deleted then."""
    path = scratch_path(df.sparkSession, label)
    write(df, path)
    release(*df.__dict__.pop("_reads", ()))
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote, once everything read from them is itself written."""
    for t in tables:
        path = t.__dict__.pop("_written_to", None)
        if path:
            remove(t.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
