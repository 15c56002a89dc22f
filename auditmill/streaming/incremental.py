"""Auditing new visit files once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditmill.operators.audit import guid_key
from auditmill.sources.scratch import release, stored
from auditmill.streaming.keylog import PARTS, KeyLog, part_of


def visit_keys(batch: DataFrame) -> DataFrame:
    """batch (guid, _file, ...) with ``_key``, one row for each key.

    A visit's key is its guid without regard to case. A visit without one (null or blank) has the
    key of its file, its content and its place among visits of that content, so no such visit is
    taken for another one, and the same file gives the same keys. Of visits with one guid the
    first by file and content stays.
    """
    content = F.sha2(F.to_json(F.struct(*[c for c in batch.columns if c != "_file"])), 256)
    seen = batch.withColumn("_content", content).withColumn("_nth", F.row_number().over(Window.partitionBy("_file", "_content").orderBy(F.lit(1))))
    named = F.concat(F.lit("guid:"), guid_key(F.col("guid")))
    key = F.coalesce(named, F.concat_ws(":", F.lit("file"), "_file", "_content", "_nth"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_file", "_content", "_nth"))
    return seen.withColumn("_key", key).withColumn("_first", first).where("_first = 1").drop("_content", "_nth", "_first")


def audit_new(spark: SparkSession, source: str, schema: str, results: str, checkpoint: str, audit: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> None:
    """Audit the visits (guid, ...) of files in source that came since the last call, and add them to results.

    Each batch drops repeated visits (see visit_keys()) and those audited before. What it writes is
    the part ``lot`` of results, named by stream and batch, and replaces that part, so a batch that
    is run again adds nothing. Audited keys are kept beside results in a KeyLog; a batch reads the
    parts of its own keys and never the results, and first merges what earlier batches have left.
    No state of the stream grows with time and no watermark is needed.
    """
    keys = results.rstrip("/") + "-keys"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        lot = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        log = KeyLog(session, keys)
        log.compact(lot)
        fresh = stored(visit_keys(batch).withColumn("_part", part_of("_key")), "fresh")
        parts = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # PARTS at most
        assert len(parts) <= PARTS
        known = stored(fresh.join(log.known(parts, lot).withColumnRenamed("key", "_key"), "_key", "left_anti"), "known")
        done = audit(known.drop("_key", "_part", "_file")).withColumn("lot", F.lit(lot))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lot").parquet(results)
        log.add(known.select(F.col("_key").alias("key"), F.col("_part").alias("part")), lot)
        release(fresh, known)

    stream = spark.readStream.schema(schema).format(fmt).load(source).select("*", F.col("_metadata.file_path").alias("_file"))
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()
