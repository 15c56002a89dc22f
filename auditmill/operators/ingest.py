"""From pages to chunks with questions and vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import json_text, text
from auditmill.operators import layout, scoring
from auditmill.sources.files import blocks_and_tables, pages_to_blocks, write_docs
from auditmill.sources.scratch import exists, stored


def not_ingested(manifest: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def with_files(manifest: DataFrame, files: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the manifest whose file exists, and the missing ones."""
    known = files.select(key).distinct()
    return manifest.join(known, key, "left_semi"), manifest.join(known, key, "left_anti")


def summary(chunks: DataFrame) -> DataFrame:
    """inserted and failed chunks (file_id, error) of each file and in total (the row without a file)."""
    return chunks.rollup("file_id").agg(F.count_if(F.col("error").isNull()).alias("inserted"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def chunks_of_tables(html: str | None, rows: int) -> Iterator[tuple[int, int, str | None, str]]:
    """(table_index, chunk_index, section, chunk) of a page's tables and list items; see table_chunks()."""
    blocks, tables = blocks_and_tables(html)
    heads = [t for kind, _, t in blocks if kind == "heading"]
    for number, headings, records in tables:
        section = heads[min(headings, len(heads)) - 1] if headings and heads else None
        for n in range(0, len(records), rows):
            yield number, n // rows, section, "[" + ", ".join(json.dumps(r, ensure_ascii=False) for r in records[n : n + rows]) + "]"
    items = [t for kind, tag, t in blocks if kind == "row" and tag == "li"]
    for n in range(0, len(items), rows):
        yield -1, n // rows, None, json.dumps([{"text": t} for t in items[n : n + rows]], ensure_ascii=False, separators=(",", ":"))


def table_chunks(pages: DataFrame, rows: int = 8) -> DataFrame:
    """page_id, table_index, chunk_index, section and chunk (a JSON array of row objects) of the tables of pages.

    Records keep their table's column names and go into batches of ``rows`` for each table; the
    section is the last heading before the table. List items are one more table of their page,
    number -1, with the only column ``text``. A page is one value, so its rows are numbered where it is read: nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *c) for i, html in zip(batch["page_id"], batch["html"], strict=True) for c in chunks_of_tables(html, rows)]
            yield pd.DataFrame(found, columns=["page_id", "table_index", "chunk_index", "section", "chunk"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, table_index int, chunk_index int, section string, chunk string")


def ingest_pages(pages: DataFrame, dimension: int = 64, size: int = 2000, overlap: int = 200, rows: int = 8, anchor: str | None = None) -> DataFrame:
    """Chunks of pages (page_id, html): file_id, content_type, table_index, chunk_index, section, chunk, questions, vectors, error.

    Text blocks of a page outside of its tables are joined and split into numbered sections and
    pieces, which are numbered over the whole page. Tables give the table_chunks(). A chunk is
    named by file, content type, table (-1 for texts and list items) and chunk_index. One without
    questions has an error and no vectors; the others are not held up by it. With an anchor, what
    comes before its second occurrence in a page's text is cut first.
    """
    # A file of pages may be one row group, which is one task's: pages are dealt over tasks before they are parsed.
    pages = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(pages_to_blocks(pages), "blocks")
    texts = layout.assemble(blocks.where("kind IN ('text', 'heading')"), "page_id", ["pos"])
    if anchor:
        texts = texts.withColumn("text", text.strip_front_matter(F.col("text"), anchor))
    sections = texts.select("page_id", F.posexplode(text.split_sections(F.col("text"))).alias("section_pos", "s"))
    pieces = sections.select("page_id", "section_pos", F.col("s.title").alias("section"), F.posexplode(text.chunk_recursive(size, overlap)(F.col("s.text"))).alias("sub_pos", "chunk"))
    pieces = layout.chunk_ordinals(pieces, "page_id", ["section_pos", "sub_pos"]).select("page_id", F.lit("text").alias("content_type"), F.lit(-1).alias("table_index"), "chunk_index", "section", "chunk")
    tables = table_chunks(pages, rows).withColumn("content_type", F.lit("table"))
    chunks = pieces.unionByName(tables).withColumn("q", scoring.chunk_questions(F.col("chunk")))
    key = ["page_id", "content_type", "table_index", "chunk_index"]
    vectors = scoring.embed_three(chunks.where("q.fact IS NOT NULL"), key, dimension)
    error = F.when(F.col("q.fact").isNull(), "no question")
    return chunks.join(vectors, key, "left").select(F.col("page_id").cast("string").alias("file_id"), *key[1:], "section", "chunk", "q", "fact", "procedure", "constraint", error.alias("error"))


def done_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id) of the files whose last ingest in folder had no failed chunk; a file with failures is not done."""
    if not exists(spark, f"{folder}/summary"):
        return spark.createDataFrame([], "id string")
    last = spark.read.parquet(f"{folder}/summary").groupBy("file_id").agg(F.max_by("failed", "run").alias("failed"))
    return last.where("failed = 0").select(F.col("file_id").alias("id"))


def ingest(manifest: DataFrame, pages: DataFrame, folder: str, run: str, anchor: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """One ingest: the summary of this run (file_id or null for the total, inserted, failed) and the manifest's rows without a file.

    manifest: id and columns of strings; pages: page_id, html, by the same ids. Files that are done
    are skipped, the others' chunks are made (see ingest_pages()) with the manifest's row as
    metadata. Under folder: ``docs``, in which a file is replaced as a whole; ``errors``, the
    chunks that failed, by run; ``summary``, by run, from which done_files() knows what is done.
    The summary is written last, and a run that is repeated replaces its own rows.
    """
    spark = manifest.sparkSession
    new = not_ingested(manifest, done_files(spark, folder))
    found, missing = with_files(new, pages.select(F.col("page_id").cast("string").alias("id")))
    own = pages.join(found.select(F.col("id").cast("long").alias("page_id")), "page_id", "left_semi")
    made = ingest_pages(own, anchor=anchor, **options)
    base = F.create_map(*[x for c in manifest.columns for x in (F.lit(c), F.col(f"m.{c}").cast("string"))])
    place = {"section": F.col("section"), "content_type": F.col("content_type"), "table_index": F.when(F.col("table_index") >= 0, F.col("table_index").cast("string")), "chunk_index": F.col("chunk_index").cast("string")}
    over = F.map_filter(F.create_map(*[x for k, v in place.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    chunks = made.join(found.select(F.col("id").alias("file_id"), F.struct(*manifest.columns).alias("m")), "file_id")
    chunks = stored(chunks.withColumn("metadata", F.to_json(json_text.merge_metadata(base, over))).drop("m"), "chunks")
    by_run = lambda df, name: df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/{name}")
    write_docs(chunks.where("error IS NULL").drop("error"), f"{folder}/docs")
    by_run(chunks.where("error IS NOT NULL").select("file_id", "content_type", "table_index", "chunk_index", "chunk", "error"), "errors")
    # A file without a chunk is ingested too.
    empty = found.select(F.col("id").alias("file_id")).join(chunks.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(0).cast("long").alias("inserted"), F.lit(0).cast("long").alias("failed"))
    counted = summary(chunks)
    by_run(counted.where("file_id IS NOT NULL").unionByName(empty), "summary")
    return counted.unionByName(empty), missing
