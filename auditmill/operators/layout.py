"""Page layout: as-of sections, first content page, batches of rows, uncovered intervals, assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions.text import stripped
from auditmill.sources.scratch import stored

#: What was in earlier slices of a key: see _slices().
_SLICE, _BEFORE = "_slice", "_before"


def _slices(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows by ranges of (keys, order) with ``_slice``, the number of the range. Written once.

    A key of many rows lies in several slices, one after the other, so no task has to hold or to
    sort all rows of a key. What runs over a key is made within (slice, key), with what the
    key's earlier slices hand on (see _handed_on()).
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, *order).withColumn(_SLICE, F.spark_partition_id()), "slices")


def _handed_on(held: DataFrame, keys: list[str], own: Column, over: Callable[[Column], Column]) -> DataFrame:
    """Sliced rows with ``_before``: over the ``own`` values of the key's earlier slices, null in its first one.

    Slices are ranges, so all keys but the first of a slice begin in it: fewer rows than there are
    slices have something handed on, and those are broadcast.
    """
    each = held.groupBy(_SLICE, *keys).agg(own.alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    handed = each.withColumn(_BEFORE, over(F.col("_own")).over(earlier)).where(F.col(_BEFORE).isNotNull())
    handed = handed.select(F.col(_SLICE).alias("_s"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], _BEFORE)
    same = F.col(_SLICE) == F.col("_s")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return held.join(F.broadcast(handed), same, "left").drop("_s", *[f"_k{n}" for n in range(len(keys))])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 0 within a key, in order: the place in the slice and the rows of the slices before."""
    held = _handed_on(_slices(rows, keys, order), keys, F.count("*"), F.sum)
    within = F.row_number().over(Window.partitionBy(_SLICE, *keys).orderBy(*order)) - 1
    return held.withColumn(name, (F.coalesce(_BEFORE, F.lit(0)) + within).cast("int")).drop(_SLICE, _BEFORE)


def ordered_entries(entries: DataFrame, key: str = "file_id") -> DataFrame:
    """entries (key, page from 1, ord, title) with 0-based start and place in order of start, stable."""
    zero = entries.withColumn("start", F.col("page") - 1)
    return numbered(zero, [key], ["start", "ord"], "place").withColumn("place", F.col("place") + 1)


def section_asof(pages: DataFrame, entries: DataFrame, key: str = "file_id") -> DataFrame:
    """pages (key, page) with the title of the last entry (key, start, ord, title) that starts at or before it.

    Null before the first entry; of entries with one start the last in file order counts. One
    sort of both sides by (key, page) in slices, no join; a slice hands its last section on.
    """
    left = entries.select(key, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_side"), F.col("ord").cast("long").alias("_ord"), F.col("title").alias("section"), F.lit(None).alias("_page"))
    right = pages.select(key, F.col("page").cast("long").alias("_at"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_ord"), F.lit(None).cast("string").alias("section"), F.struct("*").alias("_page"))
    both = left.withColumn("_page", F.lit(None).cast(right.schema["_page"].dataType)).unionByName(right)
    place = F.when(F.col("section").isNotNull(), F.struct("_at", "_side", "_ord"))
    held = _handed_on(_slices(both, [key], ["_at", "_side", "_ord"]), [key], F.max_by("section", place), lambda c: F.last(c, ignorenulls=True))
    until = Window.partitionBy(_SLICE, key).orderBy("_at", "_side", "_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return held.withColumn("section", F.coalesce(F.last("section", ignorenulls=True).over(until), F.col(_BEFORE))).where("_side = 1").select("_page.*", "section")


def from_first_entry(pages: DataFrame, entries: DataFrame, key: str = "file_id") -> DataFrame:
    """pages from the first entry's start on; all pages of files without entries."""
    first = entries.groupBy(key).agg(F.min("start").alias("_first"))
    return pages.join(first, key, "left").where(F.col("page") >= F.coalesce("_first", F.lit(0))).drop("_first")


def row_batches(rows: DataFrame, key: str, order: list[str], size: int = 8) -> DataFrame:
    """rows with 0-based batch and place in it: consecutive batches of at most size rows of a key."""
    return numbered(rows, [key], order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("place", (F.col("_n") % size).cast("int")).drop("_n")


def chunk_ordinals(chunks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """chunks with chunk_index, numbered from 0 over the whole document."""
    return numbered(chunks, [key], order, "chunk_index")


def interval_complement(spans: DataFrame, keys: list[str], low: Column, high: Column, groups: DataFrame) -> DataFrame:
    """The parts of [low, high] that no span (keys, top, bottom) of a group covers: keys, start, end.

    groups lists all groups (keys): one without spans gives the whole range. Overlapping spans
    merge by a running maximum of the ends before them, which a slice hands on.
    """
    tails = groups.select(*keys, high.alias("top"), high.alias("bottom"))
    both = spans.select(*keys, "top", "bottom").unionByName(tails)
    held = _handed_on(_slices(both, keys, ["top", "bottom"]), keys, F.max("bottom"), F.max)
    before = Window.partitionBy(_SLICE, *keys).orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1)
    gaps = held.withColumn("start", F.greatest(low, F.coalesce(F.max("bottom").over(before), low), F.coalesce(_BEFORE, low)))
    return gaps.where(F.col("top") > F.col("start")).select(*keys, "start", F.col("top").alias("end"))


def assemble(fragments: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key and text: its fragments (text), stripped, without blank ones, a line each, in order."""
    clean = fragments.withColumn("_t", stripped(F.col("text"))).where("_t <> ''")
    grouped = clean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col("_t").alias("t")))).alias("l"))
    return grouped.select(key, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
