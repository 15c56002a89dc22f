"""Retrieval for many queries at once: exact nearest neighbours, BM25, rank fusion, hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from auditmill.operators.bm25 import bm25_scores, bm25_stats, cells, lists, token_lists  # noqa: F401  offered here too
from auditmill.sources.scratch import stored

#: Candidates for each result, and the fusion constant.
CANDIDATE_FACTOR, RRF_K = 6, 50

#: Which vector column answers which type of query.
VECTOR_COLUMNS = {"fact": "fact_vec", "procedure": "procedure_vec", "constraint": "constraint_vec"}

#: Queries that one pass over the corpus answers, and the queries and rows that are multiplied at once.
QUERIES_A_PASS, QUERY_BLOCK, ROW_BLOCK = 16_384, 4_096, 2_048
#: Rows of a file that meet a block of its queries in one task.
FILE_ROWS = 1 << 16
#: A corpus of more bytes than this is searched in one of SAMPLE parts first, to bound what its tasks return.
LARGE, SAMPLE = 64 << 30, 64
#: Digits that distances and scores are rounded to before they are ranked.
DIGITS = 9

FOUND = "query_id long, doc_id long, distance double"


def vector_column(query_type: str) -> str:
    """The vector column of a query type; ValueError for others."""
    if query_type not in VECTOR_COLUMNS:
        raise ValueError(f"query_type must be one of {list(VECTOR_COLUMNS)}, got {query_type!r}")
    return VECTOR_COLUMNS[query_type]


def without_phrases(docs: DataFrame, phrases: list[str], column: str = "chunk") -> DataFrame:
    """Rows whose text has none of the phrases (case counts)."""
    for phrase in phrases:
        docs = docs.where(~F.col(column).contains(phrase))
    return docs


def section_like(metadata: Column, keyword: Column) -> Column:
    """Whether the lower-cased section holds the keyword; null without a section."""
    return F.contains(F.lower(F.get_json_object(metadata, "$.section")), keyword)


class _Block:
    """Queries that are multiplied together: ids, unit vectors, the file of each, and the largest distance of use."""

    def __init__(self, rows: list[Row], same_file: bool, bounds: dict[int, float]) -> None:
        self.ids = [r["query_id"] for r in rows]
        self.matrix = np.array([r["embedding"] for r in rows], float)
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.by_file: dict[str, list[int]] | None = {} if same_file else None
        for n, r in enumerate(rows if same_file else []):
            self.by_file.setdefault(r["file_id"], []).append(n)
        self.bounds = np.array([bounds.get(i, np.inf) for i in self.ids])


def _top(k: int, blocks: list[_Block]):
    """A task: of each query the k nearest rows of a partition that are within the query's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[list[tuple[float, int]]]] = [[[] for _ in b.ids] for b in blocks]
        worst = [b.bounds.copy() for b in blocks]
        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                size = np.linalg.norm(vectors, axis=1)
                some = np.flatnonzero(size > 0)
                vectors = vectors[some] / size[some, None]
                names = part.column("doc_id").to_numpy(zero_copy_only=False)[some]
                held: dict[str, list[int]] = {}
                if blocks[0].by_file is not None:
                    files = part.column("file_id").to_pylist()
                    for n, i in enumerate(some):
                        held.setdefault(files[i], []).append(n)
                for b, block in enumerate(blocks):
                    if block.by_file is None:
                        groups = [(np.arange(len(block.ids)), np.arange(len(names)))]
                    else:
                        groups = [(np.array(block.by_file[f]), np.array(rows)) for f, rows in held.items() if f in block.by_file]
                    for asked, rows in groups:
                        far = np.round(1.0 - block.matrix[asked] @ vectors[rows].T, DIGITS) + 0.0  # no negative zero
                        for q in np.flatnonzero((far <= worst[b][asked, None]).any(axis=1)):
                            own, n = np.flatnonzero(far[q] <= worst[b][asked[q]]), asked[q]
                            if len(own) > k:
                                own = own[far[q, own] <= np.partition(far[q, own], k - 1)[k - 1]]
                            best[b][n] = sorted(best[b][n] + list(zip(far[q, own].tolist(), names[rows[own]].tolist(), strict=True)))[:k]
                            if len(best[b][n]) == k:
                                worst[b][n] = min(worst[b][n], best[b][n][-1][0])
        for block, own_best in zip(blocks, best, strict=True):
            for query, found in zip(block.ids, own_best, strict=True):
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([query] * len(found), pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array([d for d, _ in found], pa.float64())],
                        ["query_id", "doc_id", "distance"],
                    )

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found (query_id, doc_id, distance) with vector_rank, the first k of each query."""
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= k)


def _in_files(wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """FOUND for queries (query_id, embedding, file_id) among their file's rows (doc_id, vector, file_id).

    A file is cut into parts of FILE_ROWS rows and its queries into blocks of QUERY_BLOCK. Each
    part meets each block in a task of its own, which multiplies them and returns k rows a query
    at most; so a file that holds a third of all rows is many tasks, and none sees more than one cell.
    """
    blocks = wanted.groupBy("file_id").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    parts = rows.groupBy("file_id").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"))
    sizes = blocks.join(parts, "file_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = wanted.join(sizes, "file_id").select("file_id", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), each("parts").alias("part"), "query_id", "embedding")
    held = rows.join(sizes, "file_id").select("file_id", each("blocks").alias("block"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "vector")

    def unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = lists(column)
        matrix = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(ends) - 1, -1) if len(ends) > 1 else np.empty((0, 0))
        size = np.linalg.norm(matrix, axis=1)
        some = np.flatnonzero(size > 0)
        return matrix[some] / size[some, None], some

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if len(left) and len(right):
            (asked, some), (vectors, known) = unit(left.column("embedding")), unit(right.column("vector"))
            names, queries = right.column("doc_id").to_numpy()[known], left.column("query_id").to_numpy()[some]
            order = np.argsort(names, kind="stable")
            names, vectors = names[order], vectors[order]
            for at in range(0, len(queries) if len(names) else 0, 64):
                far = np.round(1.0 - asked[at : at + 64] @ vectors.T, DIGITS) + 0.0  # no negative zero
                for q, row in enumerate(far):
                    own = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                    own = own[np.argsort(row[own], kind="stable")][:k]
                    for column, values in zip(out, (np.full(len(own), queries[at + q]), names[own], row[own]), strict=True):
                        column.append(values)
        return pa.table(dict(zip(("query_id", "doc_id", "distance"), map(np.concatenate, out), strict=True)))

    keys = ["file_id", "block", "part"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, FOUND)


def nearest(queries: DataFrame, docs: DataFrame, k: int, vector: str = "fact_vec", same_file: bool = False) -> DataFrame:
    """(query_id, doc_id, distance, vector_rank): the k docs nearest to each query by cosine distance.

    queries has query_id (long), embedding and, with same_file, file_id: only that file's docs
    count. docs has doc_id (long) and the vector column. Equal distances rank by doc_id. Docs whose
    vector is null or all zero are no candidates, and queries with such an embedding find nothing.

    One pass over docs answers QUERIES_A_PASS queries, which are all that is broadcast at a time;
    with more queries each pass is written before the next one begins. A task multiplies its rows
    with blocks of queries and returns k rows for each query at most. For a corpus over LARGE
    bytes one of SAMPLE parts of it is searched first: no task then returns a row farther than the
    k-th of that part, so about k * SAMPLE rows a query are shuffled, however many tasks there are.
    More than QUERIES_A_PASS queries within files go to their files instead (see _in_files()).
    """
    keys = ["file_id"] if same_file else []
    rows = docs.where(F.col(vector).isNotNull()).select("doc_id", F.col(vector).alias("vector"), *keys)
    wanted = queries.where(F.exists("embedding", lambda x: x != 0)).select("query_id", "embedding", *keys)
    passes = -(-wanted.count() // QUERIES_A_PASS)
    if same_file and passes > 1:
        return ranked(_in_files(wanted, rows, k), k)
    large = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > LARGE
    parts = []
    for n in range(passes):
        own = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()
        search = lambda of, bounds: of.mapInArrow(_top(k, [_Block(own[i : i + QUERY_BLOCK], same_file, bounds) for i in range(0, len(own), QUERY_BLOCK)]), FOUND)  # noqa: B023, E731
        bounds = {}
        if own and large:
            sample = search(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0), {})
            bounds = {r["query_id"]: r["distance"] for r in ranked(sample, k).where(F.col("vector_rank") == k).select("query_id", "distance").collect()}
        if own:
            found = search(rows, bounds)
            parts.append(stored(found, "nearest") if passes > 1 else found)
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    return ranked(found, k)


def bm25_rank(scored: DataFrame) -> DataFrame:
    """scored (query_id, doc_id, vector_rank, bm25) with bm25_rank; equal scores keep the vector order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "vector_rank")
    return scored.withColumn("bm25_rank", F.row_number().over(order))


def rrf_fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf_score) of any number of ranked lists, unioned as (query_id, doc_id, rank)."""
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score"))


def candidates(queries: DataFrame, docs: DataFrame, k: int, query_type: str = "fact", same_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """The k nearest docs of each query, written once, and the tokens of the distinct docs among them."""
    near = stored(nearest(queries, docs, k, vector_column(query_type), same_file), "candidates")
    return near, token_lists(docs.select("doc_id", "chunk").join(near.select("doc_id").distinct(), "doc_id", "left_semi"))


def hybrid_ranks(queries: DataFrame, docs: DataFrame, top_k: int = 10, query_type: str = "fact", same_file: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, rrf_score) of the top_k docs of each query by fused vector and BM25 rank.

    queries: query_id, query_text, embedding (and file_id). docs: doc_id, chunk, the vector columns
    (and file_id). Equal scores keep the vector order. Queries of one file are scored together, so
    that a document goes to few cells (see bm25).
    """
    k = top_k * CANDIDATE_FACTOR
    near, tokens = candidates(queries, docs, k, query_type, same_file)
    ranked = bm25_rank(bm25_scores(queries, near.select("query_id", "doc_id", "vector_rank"), tokens, cells(queries, k, same_file)))
    # Two lists: a document's fused score needs both of its ranks only, which stand in one row.
    fused = ranked.withColumn("rrf_score", sum((F.lit(1.0) / (F.lit(RRF_K) + F.col(c)) for c in ("vector_rank", "bm25_rank")), F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", DIGITS)), "vector_rank")
    best = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "rank", "doc_id", F.round("rrf_score", 6).alias("rrf_score"))
    best._reads = (near, tokens)
    return best


def hybrid_search(queries: DataFrame, docs: DataFrame, top_k: int = 10, query_type: str = "fact", same_file: bool = False) -> DataFrame:
    """hybrid_ranks() with the docs' file_id, chunk and metadata. Texts are read for the results only."""
    best = stored(hybrid_ranks(queries, docs, top_k, query_type, same_file), "ranks")
    return docs.select("doc_id", "file_id", "chunk", "metadata").join(best, "doc_id").select("query_id", "rank", "doc_id", "rrf_score", "file_id", "chunk", "metadata")
