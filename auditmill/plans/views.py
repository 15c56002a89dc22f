"""Input views that the registered queries share: the same rows as DataFrames and as SQL.

Visits come from orders and their lines, the manifest from parts, guideline chunks from documents
with embeddings, search queries from benchmark items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of the lines of a visit: no two different lines tie.
LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)

CODE = "concat(upper(substr(p_type, 1, 1)), lpad(replace(p_brand, 'Brand#', ''), 2, '0'), '.', CAST(p_size % 10 AS STRING))"
#: A part's code as its guideline lists it: two in three stand under a class that no diagnosis has.
LISTED_CODE = f"CASE WHEN p_partkey % 3 = 0 THEN {CODE} ELSE concat('Q', {CODE}) END"
SERVICE = (
    "CASE WHEN o_orderpriority LIKE '1-%' THEN 'Первичный приём' WHEN o_orderpriority LIKE '2-%' THEN 'Повторный приём' "
    "WHEN o_orderpriority LIKE '3-%' THEN 'Профилактический осмотр' ELSE 'Консультация' END"
)
GUID = "concat_ws('-', substr({0}, 1, 8), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 12))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def visit_heads(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: visit, guid, date, service, patient fields."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("o_orderkey").alias("visit"),
        F.expr(GUID.format("md5(CAST(o_orderkey AS STRING))")).alias("guid"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.expr(SERVICE).alias("service"),
        F.col("c_name").alias("patient_name"),
        F.col("c_mktsegment").alias("segment"),
    )


def visit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per diagnosis of a visit: visit, pos, code, name, first_time, param, value."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    # Numbered by the key's new name: what is grouped by visit afterwards is not shuffled again.
    lines = lines.withColumnRenamed("l_orderkey", "visit")
    return lines.select(
        "visit",
        F.row_number().over(Window.partitionBy("visit").orderBy(*LINE_ORDER)).alias("pos"),
        F.expr(CODE).alias("code"),
        F.col("p_name").alias("name"),
        (F.col("l_returnflag") == "N").alias("first_time"),
        F.col("p_brand").alias("param"),
        F.col("p_type").alias("value"),
    )


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Nested visits: visit, guid, date, patient, services, diagnoses, inspection."""
    lines = visit_lines(spark, sf).groupBy("visit").agg(F.array_sort(F.collect_list(F.struct("pos", "code", "name", "first_time", "param", "value"))).alias("l"))
    diagnoses = F.transform("l", lambda x: F.struct(x["code"].alias("code"), x["name"].alias("name"), F.lit(None).cast("string").alias("detail"), x["first_time"].alias("first_time")))
    inspection = F.transform("l", lambda x: F.struct(x["param"].alias("param"), x["value"].alias("value")))
    joined = visit_heads(spark, sf).join(lines, "visit", "left")
    return joined.select(
        "visit",
        "guid",
        "date",
        F.create_map(F.lit("Имя"), F.col("patient_name"), F.lit("Группа"), F.col("segment")).alias("patient"),
        F.array(F.struct(F.col("service").alias("name"))).alias("services"),
        F.coalesce(diagnoses, F.array().cast("array<struct<code:string,name:string,detail:string,first_time:boolean>>")).alias("diagnoses"),
        F.coalesce(inspection, F.array().cast("array<struct<param:string,value:string>>")).alias("inspection"),
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Guidelines: id, name, codes (one cell), pos (file order)."""
    grouped = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("name"), F.array_join(F.array_sort(F.collect_set(F.expr(LISTED_CODE))), ", ").alias("codes"))
    named = grouped.select(F.concat_ws("_", "p_brand", "p_type").alias("id"), "name", "codes")
    # One row per pair of brand and type: the file order is that of the ids.
    return named.withColumn("pos", F.row_number().over(Window.orderBy("id")))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with vectors: doc_id, file_id, chunk, metadata (JSON) and three vector columns."""
    joined = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return joined.select(
        "doc_id",
        F.col("source").alias("file_id"),
        F.col("text").alias("chunk"),
        F.to_json(F.struct(F.col("lang").alias("section"))).alias("metadata"),
        F.col("embedding").alias("fact_vec"),
        F.reverse("embedding").alias("procedure_vec"),
        F.transform("embedding", lambda x: -x).alias("constraint_vec"),
    )


def guideline_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with vectors of the manifest's guidelines: the docs, dealt over them by id."""
    listed = manifest(spark, sf)
    place = F.col("doc_id") % listed.count() + 1
    return docs(spark, sf).drop("file_id").join(listed.select(F.col("id").alias("file_id"), "pos"), F.col("pos") == place).drop("pos")


def pair_vectors(spark: SparkSession, sf: str, cases: DataFrame) -> DataFrame:
    """cases (d: code, name) with ``embedding``, a test vector chosen by a hash of the two."""
    vectors = table(spark, sf, "embeddings")
    place = F.conv(F.substring(F.md5(F.concat("d.code", "d.name")), 1, 8), 16, 10).cast("long") % vectors.count()
    return cases.join(vectors.select("vec_id", "embedding"), F.col("vec_id") == place).drop("vec_id")


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, query_text, embedding, file_id."""
    joined = table(spark, sf, "benchmark").join(table(spark, sf, "embeddings"), F.col("item_id") == F.col("vec_id"))
    return joined.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), "embedding", F.concat(F.lit("src"), F.col("item_id") % 20).alias("file_id")
    )


SQL_HEADS = f"""visit_heads AS (
  SELECT o_orderkey AS visit, {GUID.format("md5(CAST(o_orderkey AS STRING))")} AS guid, strftime(o_orderdate, '%Y-%m-%d') AS date,
         {SERVICE} AS service, c_name AS patient_name, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL_LINES = f"""visit_lines AS (
  SELECT l_orderkey AS visit, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)})::INTEGER AS pos,
         {CODE} AS code, p_name AS name, l_returnflag = 'N' AS first_time, p_brand AS param, p_type AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

SQL_MANIFEST = f"""manifest AS (
  SELECT concat_ws('_', p_brand, p_type) AS id, min(p_name) AS name, string_agg(DISTINCT {LISTED_CODE}, ', ' ORDER BY {LISTED_CODE}) AS codes,
         row_number() OVER (ORDER BY concat_ws('_', p_brand, p_type))::INTEGER AS pos
  FROM part GROUP BY p_brand, p_type)"""

SQL_DOCS = """docs AS (
  SELECT doc_id, source AS file_id, text AS chunk, '{"section":"' || lang || '"}' AS metadata, lang AS section,
         embedding::DOUBLE[] AS fact_vec, list_reverse(embedding)::DOUBLE[] AS procedure_vec, list_transform(embedding, lambda x: -x)::DOUBLE[] AS constraint_vec
  FROM documents JOIN embeddings ON doc_id = vec_id)"""

SQL_QUERIES = """queries AS (
  SELECT item_id AS query_id, text AS query_text, embedding::DOUBLE[] AS embedding, 'src' || (item_id % 20) AS file_id
  FROM benchmark JOIN embeddings ON item_id = vec_id)"""


def with_views(sql: str, *views: str) -> str:
    """sql after the given views; sql may begin with more of them (a comma and a name)."""
    body = sql.strip()
    return "WITH " + ", ".join(views) + ("\n" if body.upper().startswith(("SELECT", "(")) else ", ") + body
