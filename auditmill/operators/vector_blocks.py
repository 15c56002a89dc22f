"""Exact nearest neighbours over a written index of vectors: blocks around centres, skipped by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from auditmill.operators.bm25 import lists
from auditmill.operators.retrieval import DIGITS, FOUND, QUERIES_A_PASS, ranked
from auditmill.sources.scratch import stored

#: Rows that centres are fitted on at most, centres at most, rounds of fitting, rows in a block, and
#: the parts that a centre's rows are dealt over.
SAMPLE_ROWS, CENTRES, ROUNDS, BLOCK_ROWS, PARTS = 20_000, 1024, 8, 2048, 8
#: Centres whose blocks give a query its first bound.
HOME = 2
#: What the roundings of distances may amount to.
SLACK = 1e-7

INDEX = "centre int, block string, point array<double>, lo double, hi double, ids array<long>, vectors binary"


def unit_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column at unit length, without those that are all zero, and the places of the others."""
    flat, ends = lists(column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column]))
    matrix = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(ends) - 1, -1) if len(flat) else np.empty((0, 1))
    size = np.linalg.norm(matrix, axis=1)
    some = np.flatnonzero(size > 0)
    return matrix[some] / size[some, None], some


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres at unit length: rounds of spherical k-means, begun at rows spread over the sample."""
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, count).astype(int))]
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def build(docs: DataFrame, path: str, vector: str = "fact_vec") -> None:
    """Write the index of every doc (doc_id long, vector) to path, by centre.

    Centres are fitted on SAMPLE_ROWS rows at most, the first by a hash of their ids, and are about the square root
    of the rows, CENTRES at most. A row goes to its nearest centre. The rows of a centre are dealt over
    PARTS tasks, sorted by their distance from it and cut into blocks of BLOCK_ROWS, so a block is
    a shell: it knows its centre and the least and largest distance from it. Docs whose vector is null
    or all zero are in no block.
    """
    rows = docs.where(F.col(vector).isNotNull()).select("doc_id", F.col(vector).alias("vector"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select("vector").toArrow().column("vector")
    known, _ = unit_rows(sample)
    centres = fit_centres(known, int(min(CENTRES, max(1, rows.count() ** 0.5)))) if len(known) else np.empty((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, some = unit_rows(batch.column("vector"))
            if len(some):
                far = _apart(vectors, centres)
                own = far.argmin(axis=1)
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own]), packed], ["doc_id", "centre", "away", "unit"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            centre, first, _, last = *held[0][:2], held[-1][0], held[-1][1]
            ids, vectors = [x[2] for x in held], b"".join(x[3] for x in held)
            values = [centre, f"{centre}-{ids[0]}", centres[centre].tolist(), first, last, ids, vectors]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("centre", "block", "point", "lo", "hi", "ids", "vectors"), values, strict=True))], schema=schema)

        schema = pa.schema([("centre", pa.int32()), ("block", pa.string()), ("point", pa.list_(pa.float64())), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("centre", "away", "doc_id", "unit")], strict=True):
                if held and (row[0] != held[0][0] or len(held) == BLOCK_ROWS):
                    yield block()
                held.append(row)
        if held:
            yield block()

    assigned = rows.mapInArrow(assign, "doc_id long, centre int, away double, unit binary")
    dealt = assigned.repartition("centre", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).sortWithinPartitions("centre", "away", "doc_id")
    dealt.mapInArrow(pack, INDEX).write.partitionBy("centre").parquet(path)


class _Asked:
    """Queries of one pass: ids, unit vectors, and for each the largest distance of use."""

    def __init__(self, rows: list[Row], bounds: dict[int, float]) -> None:
        self.ids = [r["query_id"] for r in rows]
        self.matrix, _ = unit_rows(pa.array([list(map(float, r["embedding"])) for r in rows], pa.list_(pa.float64())))
        self.bounds = np.array([bounds.get(i, np.inf) for i in self.ids])

    def needs(self, point: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """Queries that a block may hold a row for: a row is at least as far as the shell around the block's centre is."""
        far = _apart(self.matrix, point[None])[:, 0]
        least = np.maximum(0.0, np.maximum(far - hi, lo - far))
        return np.flatnonzero(least * least / 2 <= self.bounds + SLACK)


def _scan(asked: _Asked, k: int, homes: np.ndarray | None):
    """A task: of each query the k nearest rows of the blocks that it needs, or of those of its home centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        now = _Asked.__new__(_Asked)
        now.matrix, now.bounds = asked.matrix, asked.bounds.copy()
        for batch in batches:
            for row in batch.to_pylist():
                wanted = now.needs(np.array(row["point"]), row["lo"], row["hi"])
                if homes is not None:
                    wanted = wanted[(homes[wanted] == row["centre"]).any(axis=1)]
                if not len(wanted):
                    continue
                ids = np.array(row["ids"])
                vectors = np.frombuffer(row["vectors"], float).reshape(len(ids), -1)
                for at in range(0, len(wanted), 512):
                    part = wanted[at : at + 512]
                    far = np.round(1.0 - now.matrix[part] @ vectors.T, DIGITS) + 0.0  # no negative zero
                    for q, row_far in zip(part, far, strict=True):
                        own = np.flatnonzero(row_far <= now.bounds[q])
                        if len(own) > k:
                            own = own[row_far[own] <= np.partition(row_far[own], k - 1)[k - 1]]
                        if len(own):
                            best[q] = sorted(best.get(q, []) + list(zip(row_far[own].tolist(), ids[own].tolist(), strict=True)))[:k]
                            if len(best[q]) == k:
                                now.bounds[q] = min(now.bounds[q], best[q][-1][0])
        rows = [(asked.ids[q], i, d) for q, found in best.items() for d, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["query_id", "doc_id", "distance"])

    return run


def needed_blocks(index: DataFrame, asked: _Asked) -> DataFrame:
    """(centre, block) of the blocks that some query needs; reads no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in batch.to_pylist() if len(asked.needs(np.array(r["point"]), r["lo"], r["hi"]))]
            yield pa.RecordBatch.from_arrays([pa.array([r["centre"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.string())], ["centre", "block"])

    return index.select("centre", "block", "point", "lo", "hi").mapInArrow(run, "centre int, block string")


def nearest_in_blocks(spark: SparkSession, queries: DataFrame, path: str, k: int) -> DataFrame:
    """(query_id, doc_id, distance, vector_rank), as retrieval.nearest(), of the docs of an index that build() wrote.

    Each pass over at most QUERIES_A_PASS queries first searches their HOME nearest centres, which
    bounds the k-th distance of each. By these bounds the blocks' shells alone tell which blocks
    any query can need: the folders of other centres are not read, and of those that are read a task
    leaves out the blocks and queries that cannot meet. The bounds tighten as a task goes on.
    """
    index = spark.read.schema(INDEX).parquet(path)
    wanted = queries.where(F.exists("embedding", lambda x: x != 0)).select("query_id", "embedding")
    passes, parts = -(-wanted.count() // QUERIES_A_PASS), []
    points = index.select("centre", "point").groupBy("centre").agg(F.first("point").alias("point")).orderBy("centre").collect()  # CENTRES at most
    for n in range(passes if points else 0):
        own = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()
        if not own:
            continue
        asked = _Asked(own, {})
        names = np.array([r["centre"] for r in points])
        homes = names[np.argsort(_apart(asked.matrix, np.array([r["point"] for r in points])), axis=1)[:, :HOME]]
        near = index.where(F.col("centre").isin(np.unique(homes).tolist()))
        first = ranked(near.mapInArrow(_scan(asked, k, homes), FOUND), k).where(F.col("vector_rank") == k)
        asked = _Asked(own, {r["query_id"]: r["distance"] for r in first.select("query_id", "distance").collect()})
        centres = [r["centre"] for r in needed_blocks(index, asked).select("centre").distinct().collect()]  # CENTRES at most
        found = index.where(F.col("centre").isin(centres)).mapInArrow(_scan(asked, k, None), FOUND)
        parts.append(stored(ranked(found, k), "nearest"))
    out = parts[0] if parts else ranked(spark.createDataFrame([], FOUND), k)
    for part in parts[1:]:
        out = out.unionByName(part)
    out._reads = tuple(parts)
    return out
