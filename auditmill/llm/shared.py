"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a key is spread over before its final aggregate or join.
SALTS = 32

#: White space of the word and line rules: space and the controls 9 to 13.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and driver and tasks are one process (tests), a temporary folder
    takes its place; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("auditmill.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("auditmill.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/auditmill-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once everything read from them is itself written."""
    for t in tables:
        path = t.__dict__.pop("_written_to", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def salt_of(*cols: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def group_salted(
    rows: DataFrame, keys: list[str], salt: str, first: dict[str, Column], then: dict[str, Column], keep: Column | None = None
) -> DataFrame:
    """Aggregates of each key, one row for each (key, salt) present.

    Rows are aggregated by (key, salt), those partial rows by key, and the totals go back to the
    partial rows. A later join on (key, salt) then deals a hot key over its salts, and no task
    holds more than one part of it. ``then`` may use the names that ``first`` makes.
    """
    part = rows.groupBy(*keys, salt).agg(*[c.alias(n) for n, c in first.items()])
    total = part.groupBy(*keys).agg(*[c.alias(n) for n, c in then.items()])
    if keep is not None:
        total = total.where(keep)
    return part.select(*keys, salt).join(total, keys)


def lookup_salted(rows: DataFrame, key: str, salt: str, answers: DataFrame) -> DataFrame:
    """rows with the columns of answers (one row for each key), nulls where there is none.

    The answers go to each (key, salt) that rows has, so a hot key is dealt over its salts.
    """
    return rows.join(rows.select(key, salt).distinct().join(answers, key), [key, salt], "left")


def ascii_lower(c: Column) -> Column:
    """Only A to Z change, unlike lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """rows with a global 0-based ``rank``, by range partitions and their row counts.

    The rows are written once, sorted by range; only one number per partition is gathered.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    within = sorted_rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    stored = materialize(within, label)
    sizes = {r["_pid"]: r["n"] for r in stored.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for pid in sorted(sizes):
        starts.append((pid, at))
        at += sizes[pid]
    offsets = spark.createDataFrame(starts, "_pid int, _start long")  # one row per partition
    return stored.join(F.broadcast(offsets), "_pid").withColumn("rank", F.col("_rn") - 1 + F.col("_start")).drop("_pid", "_rn", "_start")
