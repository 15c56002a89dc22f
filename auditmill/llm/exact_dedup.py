"""Exact duplicates by a tree of merged digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: Least number of leaf runs and the number of runs that one round merges; a power of WAYS.
RUNS, WAYS = 64, 4
#: What makes texts equal: SHA-256, byte length and a second, independent hash.
SAME = ("sha", "bytes", "check")
ENTRY = "run int, sha binary, bytes int, check long, keep_id long, group_size long"
#: Stands for a null id, which every other id goes before.
NO_ID = -(1 << 63)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by run and digest, with neighbours of one run and digest merged: the largest id stays, rows add up.

    The last entry of a batch waits for the next one, so memory is that of a batch.
    """
    names, waiting = [f.split()[0] for f in ENTRY.split(", ")], None
    for batch in batches:
        if not len(batch):
            continue
        # Counts come as never null, what waits may be null to Arrow: batches that meet need one schema.
        batch = pa.RecordBatch.from_arrays([batch.column(c) for c in names], names)
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        new = np.ones(len(batch), bool)
        if len(batch) > 1:
            differs = [pc.not_equal(c.slice(1), c.slice(0, len(batch) - 1)) for c in map(batch.column, ("run", *SAME))]
            new[1:] = np.any([d.to_numpy(zero_copy_only=False) for d in differs], axis=0)
        first = np.flatnonzero(new)
        keep = np.maximum.reduceat(pc.fill_null(batch.column("keep_id"), NO_ID).to_numpy(zero_copy_only=False), first)
        size = np.add.reduceat(batch.column("group_size").to_numpy(zero_copy_only=False), first)
        heads = batch.take(pa.array(first))
        out = pa.RecordBatch.from_arrays([*map(heads.column, names[:4]), pa.array(keep, pa.int64(), mask=keep == NO_ID), pa.array(size, pa.int64())], names)
        yield out.slice(0, len(out) - 1)
        waiting = out.slice(len(out) - 1)
    if waiting is not None:
        yield waiting


def _round(entries: DataFrame, label: str) -> DataFrame:
    """One round: runs meet in slices of the digest, each slice is sorted, and its neighbours merge in one streaming pass."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "run", F.substring("sha", 1, 2)).sortWithinPartitions("run", *SAME)
    return materialize(dealt.mapInArrow(_merged, ENTRY), label)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, ways: int = WAYS) -> DataFrame:
    """Groups of identical texts: id, keep_id, group_size, kept, text_sha256 for every row.

    Each row belongs to one leaf run, a sorted list with one entry for each digest: the id that
    stays and the number of rows. In each round ``ways`` neighbouring runs exchange their entries
    and merge into one sorted run; of equal digests the largest id stays. A run is sliced by the
    first bytes of the digest, so a round has many tasks even when few runs are left. After the
    last round every digest has one entry; the answers then go down the same tree, so no task
    ever gets all rows of one text, however often it occurs. ``runs`` (the number of leaves) is a
    power of ``ways``; by default at least RUNS and the number of shuffle partitions.

    An entry is known by SHA-256, byte length and a second, independent 64-bit hash; texts merge
    only if all three agree at every level.

    A null text counts as empty, and empty texts form a group like others. Ids are whole numbers.
    Rows with a null id count in the group and stay only if the group has no other; rows that
    repeat the id that stays are all kept. Columns other than the two named are not read.
    """
    if runs is None:
        runs = 1
        while runs < max(RUNS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))):
            runs *= ways
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows with a null id are dealt over the runs by the task that reads them.
    place = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(runs)).cast("int")
    digests = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check")
        ).withColumn("run", place),
        "digests",
    )
    # Leaves: equal digests of one run are counted where they are read before they are sorted.
    leaves = digests.groupBy("run", *SAME).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    levels = [_round(leaves, "runs")]
    width = runs
    while width > 1:
        width = -(-width // ways)
        levels.append(_round(levels[-1].withColumn("run", F.floor(F.col("run") / ways).cast("int")), "runs"))
    answer, written = levels[-1], list(levels)
    for below in reversed(levels[:-1]):
        own = below.select(*SAME, "run", F.floor(F.col("run") / ways).cast("int").alias("up"))
        answer = own.join(answer.withColumnRenamed("run", "up"), [*SAME, "up"]).drop("up")
    answer = materialize(answer, "answers")
    release(*written)
    joined = digests.join(answer, [*SAME, "run"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
