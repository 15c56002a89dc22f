"""Registered queries: vectors, filters, BM25, fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import text, vectors
from auditmill.operators import retrieval, vector_blocks
from auditmill.plans import views
from auditmill.plans.views import SQL_DOCS, SQL_QUERIES, with_views
from auditmill.sources.scratch import scratch_path

PHRASES = ["idiot", "License"]
#: Languages stand for sections, and so do these parts of their names for section keywords.
KEYWORD = "e"

#: Tokens of DuckDB, the same as functions.text.TOKEN.
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')"


def near_sql(k: int, vector: str = "fact_vec", where: str = "true") -> str:
    return f"""near AS (
  SELECT * FROM (
    SELECT query_id, doc_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS vector_rank
    FROM (SELECT query_id, doc_id, round(list_cosine_distance({vector}, embedding), 9) AS distance FROM docs d JOIN queries q ON {where} WHERE {vector} IS NOT NULL)
  ) WHERE vector_rank <= {k})"""


BM25_SQL = rf"""found AS (SELECT query_id, doc_id, vector_rank, {TOKENS.format("chunk")} AS toks FROM near JOIN docs USING (doc_id)
), lens AS (SELECT query_id, doc_id, vector_rank, len(toks) AS len FROM found
), sets AS (SELECT query_id, count(*) AS docs, avg(len) AS avg_len FROM lens GROUP BY query_id
), counts AS (SELECT query_id, doc_id, term, count(*) AS f FROM (SELECT query_id, doc_id, unnest(toks) AS term FROM found) GROUP BY ALL
), raws AS (SELECT query_id, term, n, docs, avg_len, ln(docs - n + 0.5) - ln(n + 0.5) AS raw
  FROM (SELECT query_id, term, count(*) AS n FROM counts GROUP BY ALL) JOIN sets USING (query_id)
), terms AS (SELECT query_id, term, n, docs, avg_len, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query_id) ELSE raw END AS idf FROM raws
), asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("query_text")}) AS term FROM queries) GROUP BY ALL
), sums AS (SELECT query_id, doc_id, sum(times * idf * (f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / avg_len)))) AS s
  FROM counts JOIN asked USING (query_id, term) JOIN terms USING (query_id, term) JOIN lens USING (query_id, doc_id) GROUP BY ALL
), scored AS (SELECT query_id, doc_id, vector_rank, round(coalesce(s, 0), 9) AS bm25 FROM lens LEFT JOIN sums USING (query_id, doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, vector_rank)::INTEGER AS bm25_rank FROM scored
), fused AS (SELECT query_id, doc_id, vector_rank, 1.0::DOUBLE / (50 + vector_rank) + 1.0::DOUBLE / (50 + bm25_rank) AS rrf FROM ranked
), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, vector_rank)::INTEGER AS rank FROM fused)"""

RESULT = "SELECT query_id, rank, doc_id, round(rrf, 6) AS rrf_score, file_id, chunk, metadata FROM best JOIN docs USING (doc_id) WHERE rank <= {k}"


def _sql(k: int, tail: str, vector: str = "fact_vec", where: str = "true") -> str:
    return with_views(f"{BM25_SQL} {tail}", SQL_DOCS, SQL_QUERIES, near_sql(k, vector, where))


def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = views.docs(spark, sf), views.search_queries(spark, sf)
    pairs = docs.join(queries, "file_id")
    return pairs.select("query_id", "doc_id", F.round(vectors.cosine_distance(F.col("fact_vec"), F.col("embedding")), 9).alias("distance"))


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    scaled = views.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * (F.col("vec_id") % 7 + 1).cast("float")).alias("v"))
    unit = scaled.select("vec_id", vectors.l2_normalize(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(vectors.norm(F.col("u")), 9).alias("length"), F.round(F.col("u")[0], 6).alias("first"))


def filter_has_vector(spark: SparkSession, sf: str) -> DataFrame:
    all_docs = views.table(spark, sf, "documents").join(views.table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return all_docs.where(F.col("embedding").isNotNull()).select("doc_id", F.col("source").alias("file_id"))


def filter_excluded_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.without_phrases(views.table(spark, sf, "documents").select("doc_id", F.col("text").alias("chunk")), PHRASES).select("doc_id")


def filter_section_like(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.docs(spark, sf)
    return docs.where(retrieval.section_like(F.col("metadata"), F.lit(KEYWORD))).select("doc_id", "metadata")


def filter_file(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").where(F.col("source") == "src3").select("doc_id", F.col("source").alias("file_id"))


def select_query_vector(spark: SparkSession, sf: str) -> DataFrame:
    docs, queries = views.docs(spark, sf), views.search_queries(spark, sf)
    parts = [retrieval.nearest(queries, docs, 5, retrieval.vector_column(kind)).withColumn("query_type", F.lit(kind)) for kind in retrieval.VECTOR_COLUMNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("query_type", "query_id", "doc_id", "vector_rank")


def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.nearest(views.search_queries(spark, sf), views.docs(spark, sf), 60)


def knn_join_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """As knn_join, over a written index that tells which blocks no query needs."""
    path = scratch_path(spark, "vectors")
    vector_blocks.build(views.docs(spark, sf), path)
    return vector_blocks.nearest_in_blocks(spark, views.search_queries(spark, sf), path, 60)


def vector_rank(spark: SparkSession, sf: str) -> DataFrame:
    return knn_join(spark, sf).select("query_id", "doc_id", "vector_rank")


def candidate_expand(spark: SparkSession, sf: str) -> DataFrame:
    near = retrieval.nearest(views.search_queries(spark, sf), views.docs(spark, sf), 4 * retrieval.CANDIDATE_FACTOR)
    return near.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max("distance").alias("farthest"))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs, query = views.docs(spark, sf), views.search_queries(spark, sf).where("query_id = 7")
    found = docs.join(F.broadcast(query.select("query_id", "embedding").limit(1)), F.lit(True))
    far = F.round(vectors.cosine_distance(F.col("fact_vec"), F.col("embedding")), 9)
    return found.select("doc_id", far.alias("distance")).orderBy("distance", "doc_id").limit(20)


def knn_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    docs = retrieval.without_phrases(views.docs(spark, sf), PHRASES).where(retrieval.section_like(F.col("metadata"), F.lit(KEYWORD)))
    return retrieval.nearest(views.search_queries(spark, sf), docs, 4, same_file=True)


def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    near, tokens = retrieval.candidates(views.search_queries(spark, sf), views.docs(spark, sf), 60)
    return retrieval.bm25_stats(near, tokens).select("query_id", "term", "n", "docs", F.round("avg_len", 6).alias("avg_len"), F.round("idf", 6).alias("idf"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, vector_rank and bm25 of each query's 60 candidates."""
    queries = views.search_queries(spark, sf)
    near, tokens = retrieval.candidates(queries, views.docs(spark, sf), 60)
    return retrieval.bm25_scores(queries, near, tokens)


def bm25_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def bm25_rank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25_rank(_scored(spark, sf)).select("query_id", "doc_id", "vector_rank", "bm25_rank")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    lists = retrieval.bm25_rank(_scored(spark, sf)).select("query_id", "doc_id", F.explode(F.array("vector_rank", "bm25_rank")).alias("rank"))
    return retrieval.rrf_fuse(lists).select("query_id", "doc_id", F.round("rrf_score", 9).alias("rrf_score"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(views.search_queries(spark, sf), views.docs(spark, sf), 10)


def rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_search(spark, sf).select("query_id", "rank", "doc_id", "rrf_score")


def hybrid_assemble(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_search(spark, sf).select("query_id", "doc_id", "file_id", "metadata", "rrf_score", F.md5("chunk").alias("chunk_md5"))


def hybrid_search_file(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.hybrid_search(views.search_queries(spark, sf), views.docs(spark, sf), 4, same_file=True)


def hybrid_search_section(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.docs(spark, sf).where(retrieval.section_like(F.col("metadata"), F.lit(KEYWORD)))
    return retrieval.hybrid_search(views.search_queries(spark, sf), docs, 4, same_file=True)


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    tokens = views.table(spark, sf, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def lookup_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The found rows of each query's ids, in the order asked; repeated ids repeat, missing ones drop.

    Each block of 100 ids asks for two ids per label, so lists stay short, grow in number with the
    input and ask over all ids.
    """
    labels = views.table(spark, sf, "labels").select(F.floor(F.col("doc_id") / 100).alias("ask"), "doc_id")
    wanted = F.explode(F.array(F.struct(F.lit(0).alias("k"), (F.col("doc_id") + F.col("doc_id") * 37 % 101).alias("id")), F.struct(F.lit(1).alias("k"), (F.col("doc_id") * 2).alias("id"))))
    each = labels.select("ask", "doc_id", wanted.alias("w"))
    asked = each.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("doc_id", "w.k", "w.id"))).alias("ids"))
    rows = asked.select("ask", F.posexplode(F.transform("ids", lambda x: x["id"])).alias("pos", "doc_id"))
    return rows.join(views.table(spark, sf, "documents").select("doc_id", F.col("source").alias("file_id")), "doc_id").select("ask", "pos", "doc_id", "file_id")


lookup_in_order_blocks = lookup_in_order


LOOKUP_SQL = """
WITH w AS (SELECT doc_id // 100 AS ask, doc_id AS by_id, 0 AS k, doc_id + doc_id * 37 % 101 AS id FROM labels UNION ALL SELECT doc_id // 100, doc_id, 1, doc_id * 2 FROM labels),
r AS (SELECT ask, (row_number() OVER (PARTITION BY ask ORDER BY by_id, k, id) - 1)::INTEGER AS pos, id AS doc_id FROM w)
SELECT ask, pos, doc_id, source AS file_id FROM r JOIN documents USING (doc_id)"""

_NEAR60 = with_views("SELECT query_id, doc_id, distance, vector_rank FROM near", SQL_DOCS, SQL_QUERIES, near_sql(60))

QUERIES = {
    "hybrid_search": (hybrid_search, _sql(60, RESULT.format(k=10))),
    "cosine_distance": (cosine_distance, with_views("SELECT query_id, doc_id, round(list_cosine_distance(fact_vec, embedding), 9) AS distance FROM docs JOIN queries USING (file_id)", SQL_DOCS, SQL_QUERIES)),
    "l2_normalize": (
        l2_normalize,
        """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT * (vec_id % 7 + 1)::FLOAT)::DOUBLE[] AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM s)
        SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: (x / size) * (x / size)))), 9) AS length, round(v[1] / size, 6) AS first FROM n""",
    ),
    "filter_has_vector": (filter_has_vector, "SELECT doc_id, source AS file_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE embedding IS NOT NULL"),
    "filter_excluded_phrases": (filter_excluded_phrases, "SELECT doc_id FROM documents WHERE text NOT LIKE '%idiot%' AND text NOT LIKE '%License%'"),
    "filter_section_like": (filter_section_like, with_views("SELECT doc_id, metadata FROM docs WHERE lower(metadata->>'section') LIKE '%e%'", SQL_DOCS)),
    "filter_file": (filter_file, "SELECT doc_id, source AS file_id FROM documents WHERE source = 'src3'"),
    "select_query_vector": (
        select_query_vector,
        with_views(
            "all_near AS (SELECT 'fact' AS query_type, * FROM near UNION ALL SELECT 'procedure', * FROM near_p UNION ALL SELECT 'constraint', * FROM near_c) SELECT query_type, query_id, doc_id, vector_rank FROM all_near",
            SQL_DOCS, SQL_QUERIES, near_sql(5), near_sql(5, "procedure_vec").replace("near AS", "near_p AS", 1), near_sql(5, "constraint_vec").replace("near AS", "near_c AS", 1),
        ),
    ),
    "knn_join": (knn_join, _NEAR60),
    "knn_join_blocks": (knn_join_blocks, _NEAR60),
    "vector_rank": (vector_rank, with_views("SELECT query_id, doc_id, vector_rank FROM near", SQL_DOCS, SQL_QUERIES, near_sql(60))),
    "candidate_expand": (candidate_expand, with_views("SELECT query_id, count(*) AS candidates, max(distance) AS farthest FROM near GROUP BY query_id", SQL_DOCS, SQL_QUERIES, near_sql(24))),
    "knn_topk": (knn_topk, with_views("SELECT doc_id, round(list_cosine_distance(fact_vec, embedding), 9) AS distance FROM docs, queries WHERE query_id = 7 ORDER BY distance, doc_id LIMIT 20", SQL_DOCS, SQL_QUERIES)),
    "knn_topk_filtered": (
        knn_topk_filtered,
        with_views(
            "SELECT query_id, doc_id, distance, vector_rank FROM near", SQL_DOCS, SQL_QUERIES,
            near_sql(4, where="d.file_id = q.file_id AND chunk NOT LIKE '%idiot%' AND chunk NOT LIKE '%License%' AND section LIKE '%e%'"),
        ),
    ),
    "bm25_stats": (bm25_stats, _sql(60, "SELECT query_id, term, n, docs, round(avg_len, 6) AS avg_len, round(idf, 6) AS idf FROM terms")),
    "bm25_score": (bm25_score, _sql(60, "SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM scored")),
    "bm25_rank": (bm25_rank, _sql(60, "SELECT query_id, doc_id, vector_rank, bm25_rank FROM ranked")),
    "rrf_fuse": (rrf_fuse, _sql(60, "SELECT query_id, doc_id, round(rrf, 9) AS rrf_score FROM fused")),
    "rrf_topk": (rrf_topk, _sql(60, "SELECT query_id, rank, doc_id, round(rrf, 6) AS rrf_score FROM best WHERE rank <= 10")),
    "hybrid_assemble": (hybrid_assemble, _sql(60, "SELECT query_id, doc_id, file_id, metadata, round(rrf, 6) AS rrf_score, md5(chunk) AS chunk_md5 FROM best JOIN docs USING (doc_id) WHERE rank <= 10")),
    "hybrid_search_file": (hybrid_search_file, _sql(24, RESULT.format(k=4), where="d.file_id = q.file_id")),
    "hybrid_search_section": (hybrid_search_section, _sql(24, RESULT.format(k=4), where="d.file_id = q.file_id AND section LIKE '%e%'")),
    "tokenize": (tokenize, rf"SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)"),
    "lookup_in_order": (lookup_in_order, LOOKUP_SQL),
    "lookup_in_order_blocks": (lookup_in_order_blocks, LOOKUP_SQL),
}
