"""BM25 over each query's own candidates: documents by terms as incidence blocks, multiplied where they meet their queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions.text import tokenize
from auditmill.sources.scratch import stored

#: BM25's constants, digits that scores are rounded to, and candidates (query, document) in a cell.
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9
CELL = 8192


def token_lists(texts: DataFrame) -> DataFrame:
    """(doc_id, tokens) of texts (doc_id, chunk). Written once."""
    return stored(texts.select("doc_id", tokenize(F.col("chunk")).alias("tokens")), "tokens")


def places_of(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges from begin up to end, and which range each is of."""
    size = end - begin
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column one after the other, and where each list begins and the last one ends."""
    whole = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets = whole.offsets.to_numpy()
    return whole.flatten(), offsets - offsets[0]


class Incidence:
    """A cell's documents by terms: for each document its distinct terms and how often each occurs, row after row."""

    def __init__(self, docs: pa.Table) -> None:
        docs = docs.sort_by("doc_id")
        self.ids = docs.column("doc_id").to_numpy()
        flat, ends = lists(docs.column("tokens"))
        coded = flat.dictionary_encode()
        self.terms = coded.dictionary
        self.length = np.diff(ends)
        width = max(1, len(self.terms))
        key, self.f = np.unique(np.repeat(np.arange(len(self.ids)), self.length) * width + coded.indices.to_numpy(), return_counts=True)
        doc, self.term = key // width, key % width
        self.start = np.searchsorted(doc, np.arange(len(self.ids) + 1))

    def rows_of(self, ids: np.ndarray) -> np.ndarray:
        """Rows of those of the ids that the cell has."""
        at = np.searchsorted(self.ids, ids)
        return at[(at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == ids)] if len(self.ids) else at[:0]

    def stats(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a set of documents: places of their entries, the row of each, document frequencies of all terms, and for the terms held their idf.

        The product of the set's 0/1 column with the incidence block gives the frequencies. An idf
        below zero becomes EPSILON times the mean idf of the set's distinct terms.
        """
        at, owner = places_of(self.start[rows], self.start[rows + 1])
        n = np.bincount(self.term[at], minlength=len(self.terms))
        held = np.flatnonzero(n)
        raw = np.log(len(rows) - n[held] + 0.5) - np.log(n[held] + 0.5)
        return at, owner, n, held, np.where(raw < 0, EPSILON * raw.mean() if len(raw) else 0.0, raw)


def cells(queries: DataFrame, k: int, same_file: bool = False) -> DataFrame:
    """(query_id, cell): queries of one file, or of none, in cells of about CELL candidates."""
    group = F.coalesce(F.col("file_id").cast("string"), F.lit("")) if same_file else F.lit("")
    named = queries.select("query_id", group.alias("_g"))
    parts = named.groupBy("_g").agg(F.ceil(F.count("*") * k / CELL).cast("int").alias("_p"))
    part = F.pmod(F.xxhash64("query_id"), F.col("_p"))
    return named.join(parts, "_g").select("query_id", F.concat_ws("/", part.cast("string"), "_g").alias("cell"))


def _celled(queries: DataFrame, candidates: DataFrame, tokens: DataFrame, celled: DataFrame | None, answer: Callable, schema: str) -> DataFrame:
    """answer(asked, incidence) of each cell: asked has query_id, words, docs (the query's candidates) and ranks."""
    rank = F.col("vector_rank") if "vector_rank" in candidates.columns else F.lit(None).cast("int")
    listed = candidates.select("query_id", F.struct(rank.alias("r"), "doc_id").alias("d")).groupBy("query_id").agg(F.array_sort(F.collect_list("d")).alias("d"))
    words = queries.select("query_id", tokenize(F.col("query_text")).alias("words"))
    if celled is None:
        most = candidates.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
        celled = cells(listed, most)
    asked = listed.join(words, "query_id", "left").join(celled, "query_id")
    asked = asked.select("cell", "query_id", F.coalesce("words", F.array().cast("array<string>")).alias("words"), F.transform("d", lambda x: x["doc_id"]).alias("docs"), F.transform("d", lambda x: F.coalesce(x["r"], F.lit(0))).alias("ranks"))
    met = candidates.select("query_id", "doc_id").join(celled, "query_id").select(F.concat("cell", F.lit("")).alias("cell"), "doc_id").distinct()
    sent = met.join(tokens, "doc_id").select("cell", "doc_id", "tokens")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return answer(left, Incidence(right))

    return asked.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(run, schema)


def _scores(asked: pa.Table, block: Incidence) -> pa.Table:
    words, word_ends = lists(asked.column("words"))
    docs, doc_ends = lists(asked.column("docs"))
    ranks = lists(asked.column("ranks"))[0].to_numpy()
    known = pc.fill_null(pc.index_in(words, value_set=block.terms), -1).to_numpy() if len(block.terms) else np.full(len(words), -1)
    docs = docs.to_numpy()
    out = []
    for q, query in enumerate(asked.column("query_id").to_pylist()):
        own, places = docs[doc_ends[q] : doc_ends[q + 1]], ranks[doc_ends[q] : doc_ends[q + 1]]
        there = np.isin(own, block.ids)
        own, places = own[there], places[there]
        rows = block.rows_of(own)
        at, owner, _, held, idf = block.stats(rows)
        weight = np.zeros(len(block.terms))
        weight[held] = idf
        terms = known[word_ends[q] : word_ends[q + 1]]
        weight *= np.bincount(terms[terms >= 0], minlength=len(block.terms))
        some = np.flatnonzero(weight[block.term[at]])
        at, owner = at[some], owner[some]
        length = block.length[rows]
        scale = K1 * (1 - B + B * length / max(length.mean(), 1e-300)) if len(rows) else length
        f = block.f[at]
        out.append((query, own, places, np.bincount(owner, weight[block.term[at]] * f * (K1 + 1) / (f + scale[owner]), len(rows))))
    size = [len(x[1]) for x in out]
    return pa.table({
        "query_id": pa.array(np.repeat(np.array([x[0] for x in out], np.int64), size)), "doc_id": pa.array(np.concatenate([x[1] for x in out]) if out else [], pa.int64()),
        "vector_rank": pa.array(np.concatenate([x[2] for x in out]) if out else [], pa.int32()), "bm25": pa.array(np.concatenate([x[3] for x in out]) if out else [], pa.float64()),
    })


def _statistics(asked: pa.Table, block: Incidence) -> pa.Table:
    docs, ends = lists(asked.column("docs"))
    docs, parts = docs.to_numpy(), []
    for q, query in enumerate(asked.column("query_id").to_pylist()):
        rows = block.rows_of(docs[ends[q] : ends[q + 1]])
        _, _, n, held, idf = block.stats(rows)
        if len(held):
            same = lambda v, kind: pa.array(np.full(len(held), v), kind)  # noqa: B023, E731
            parts.append(pa.table({"query_id": same(query, pa.int64()), "term": block.terms.take(pa.array(held)), "idf": idf, "n": pa.array(n[held], pa.int64()), "docs": same(len(rows), pa.int64()), "avg_len": same(block.length[rows].mean(), pa.float64())}))
    empty = pa.schema([("query_id", pa.int64()), ("term", pa.string()), ("idf", pa.float64()), ("n", pa.int64()), ("docs", pa.int64()), ("avg_len", pa.float64())])
    return pa.concat_tables(parts) if parts else empty.empty_table()


def _tokens_of(candidates: DataFrame, tokens: DataFrame | None) -> DataFrame:
    return token_lists(candidates.select("doc_id", "chunk").dropDuplicates(["doc_id"])) if tokens is None else tokens


def bm25_stats(candidates: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(query_id, term, idf, n, docs, avg_len) of candidate sets (query_id, doc_id), one set for each query.

    tokens are the token_lists() of the candidates' texts; without them candidates has chunk.
    """
    none = candidates.select("query_id", F.lit("").alias("query_text")).distinct()
    return _celled(none, candidates, _tokens_of(candidates, tokens), None, _statistics, "query_id long, term string, idf double, n long, docs long, avg_len double")


def bm25_scores(queries: DataFrame, candidates: DataFrame, tokens: DataFrame | None = None, celled: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, vector_rank, bm25) of every candidate, rounded; one without a query term scores 0.

    queries has query_id and query_text; repeated words of a query count as often. celled says
    which queries meet in one task (see cells()). A cell gets each document's tokens once, and a
    query there takes the rows of its candidates: (query, document, term) is never a row of Spark's.
    """
    found = _celled(queries, candidates, _tokens_of(candidates, tokens), celled, _scores, "query_id long, doc_id long, vector_rank int, bm25 double")
    rank: list[str | Column] = ["vector_rank"] if "vector_rank" in candidates.columns else []
    return found.select("query_id", "doc_id", *rank, F.round("bm25", DIGITS).alias("bm25"))
