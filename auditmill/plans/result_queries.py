"""Registered queries: model answers, stored results and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import json_text, render, text
from auditmill.operators import audit, retrieval
from auditmill.plans import search_queries, views
from auditmill.plans.views import SQL_DOCS, with_views
from auditmill.sources import files
from auditmill.sources.scratch import scratch_path

FLAGS = "filter(array(CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN doc_id % 9 = 0 THEN 'LOW_QUALITY' END), x -> x IS NOT NULL)"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Results: id, flags (repeats kept), findings."""
    rows = views.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.expr(FLAGS).alias("flags"))
    return rows.withColumn("findings", F.transform("flags", lambda f: F.struct(f.alias("flag"), F.concat(F.lit("see "), F.lower(f)).alias("issue"))))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """A checker's raw answer per turn: plain, fenced, an object instead of a list, or cut short."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("turn") % 4, F.length("text").alias("chars")).toDF("conv_id", "turn", "role", "kind", "chars")
    sources = F.array(F.struct(F.col("role").alias("doc_title"), F.when(F.col("chars") % 2 == 0, F.concat(F.lit("s"), "chars")).alias("section"), F.lit(None).cast("string").alias("cite")))
    items = F.array(F.struct(F.concat(F.lit("issue "), "chars").alias("issue"), sources.alias("sources")), F.struct(F.lit("").alias("issue"), sources.alias("sources")))
    whole = F.to_json(items)
    raw = (
        F.when(F.col("kind") == 0, whole)
        .when(F.col("kind") == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(F.col("kind") == 2, F.to_json(items[0]))
        .otherwise(F.concat(F.lit('[{"issue": "cut'), F.col("chars")))
    )
    return turns.select("conv_id", "turn", "chars", "role", "kind", raw.alias("answer"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).withColumn("issues", json_text.parse_issues(F.col("answer")))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """One result per conversation with the issues of three checkers (turns in threes)."""
    by = lambda k: F.flatten(F.transform(F.filter("l", lambda x: x["turn"] % 3 == k), lambda x: x["issues"]))
    folded = issues(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "issues"))).alias("l"))
    return folded.select(
        "conv_id",
        F.struct(
            F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("G"), "conv_id")).alias("guideline_id"),
            F.concat(F.lit("C"), F.col("conv_id") % 7).alias("icd_code"),
            *[by(k).alias(c) for k, c in enumerate(audit.CHECKERS)],
        ).alias("result"),
    )


def issue_text(items: Column) -> Column:
    """Issues as one text, for comparison."""
    source = lambda s: F.concat_ws("/", s["doc_title"], s["section"], s["cite"])
    return F.array_join(F.transform(items, lambda i: F.concat(i["issue"], F.lit("<"), F.array_join(F.transform(i["sources"], source), ","), F.lit(">"))), "|")


def parse_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events: good, broken and lists."""
    broken = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 10 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    parsed = views.table(spark, sf, "events").select("event_id", json_text.parse_metadata(broken).alias("m"))
    return parsed.select("event_id", F.size("m").alias("keys"), F.col("m")["k"].alias("k"))


def parse_issues(spark: SparkSession, sf: str) -> DataFrame:
    return issues(spark, sf).select("conv_id", "turn", F.size("issues").alias("n"), issue_text(F.col("issues")).alias("text"))


def parse_findings(spark: SparkSession, sf: str) -> DataFrame:
    packed = flagged(spark, sf).select("id", F.when(F.col("id") % 11 == 0, "not json").otherwise(F.to_json(F.struct("findings"))).alias("j"))
    return packed.select("id", F.array_join(F.transform(json_text.parse_findings(F.col("j")), lambda f: F.concat(f["flag"], F.lit(":"), f["issue"])), ";").alias("findings"))


def parse_queries(spark: SparkSession, sf: str) -> DataFrame:
    items = views.table(spark, sf, "benchmark")
    made = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("fact")))).otherwise(F.to_json(F.struct(F.col("text").alias("fact"), F.lit("p").alias("procedure"), F.lit("c").alias("constraint"))))
    return items.select("item_id", json_text.parse_questions(made).alias("q")).select("item_id", F.md5("q.fact").alias("fact_md5"), "q.procedure", "q.error")


def report_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Report cells of which some name a guid, in mixed case."""
    heads = views.visit_heads(spark, sf)
    named = F.concat(F.lit("Приём: x\n  GUID: "), F.when(F.col("visit") % 2 == 0, F.upper("guid")).otherwise(F.col("guid")), F.lit("\n  DATE: "), "date")
    return heads.select("visit", F.when(F.col("visit") % 3 == 0, F.concat(F.lit("no id "), "date")).otherwise(named).alias("cell"))


def extract_guid(spark: SparkSession, sf: str) -> DataFrame:
    return report_cells(spark, sf).select("visit", text.extract_guid(F.col("cell")).alias("guid"))


def done_guids_from_report(spark: SparkSession, sf: str) -> DataFrame:
    cells = report_cells(spark, sf)
    return cells.unionByName(cells.where("visit % 5 = 0")).select(text.extract_guid(F.col("cell")).alias("guid")).where("guid IS NOT NULL").distinct()


def safe_period_key(spark: SparkSession, sf: str) -> DataFrame:
    dates = views.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("d"))
    return dates.select("o_orderkey", text.safe_period_key(F.concat(F.lit(" "), "d", F.lit(" — "), "d", F.lit("!"))).alias("key"))


def flag_contains(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).where(F.array_contains("flags", "TOXIC")).select("id").orderBy("id")


def flags_of_findings(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).select("id", F.array_join(F.transform("findings", lambda f: f["flag"]), ",").alias("flags"))


def write_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results written in two runs and read back."""
    path = scratch_path(spark, "results")
    rows = flagged(spark, sf).select("id", F.to_json(F.struct("id")).alias("input"), "flags", F.to_json("findings").alias("issues"))
    files.write_results(rows.where("id % 2 = 0").withColumn("run_date", F.lit("2024-01-01")), path)
    files.write_results(rows.where("id % 2 = 1").withColumn("run_date", F.lit("2024-01-02")), path)
    read = spark.read.parquet(path)
    return read.select("id", "input", F.array_join("flags", ",").alias("flags"), "issues", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"))


def concat_checker_issues(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("conv_id", issue_text(audit.all_issues(F.col("result"))).alias("text"))


def issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("conv_id", *[F.size(f"result.{c}").alias(c) for c in audit.CHECKERS])


def stored(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct("result.icd_code", audit.all_issues(F.col("result")).alias("issues"))
    return results(spark, sf).select("conv_id", F.array(one).alias("d"))


def serialize_issues(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).select("conv_id", F.md5(json_text.serialize_results(F.col("d"))).alias("json_md5"))


def deserialize_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth text lacks its lists."""
    packed = stored(spark, sf).select("conv_id", F.when(F.col("conv_id") % 4 == 0, '[{"issues":[{"issue":"x"}]}]').otherwise(json_text.serialize_results(F.col("d"))).alias("j"))
    back = packed.select("conv_id", json_text.deserialize_results(F.col("j")).alias("d"))
    return back.select("conv_id", F.col("d")[0]["icd_code"].alias("icd_code"), issue_text(F.col("d")[0]["issues"]).alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Text and table chunks with their metadata maps."""
    docs = views.docs(spark, sf).join(views.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    row = '{"Unnamed: 0": "%s, x", "lang": "'
    cell = lambda v: F.concat(F.lit(row % v), "lang", F.lit('"}'))
    table = F.concat(F.lit("["), cell("v"), F.lit(", "), cell("w"), F.lit("]"))
    kind = F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text")
    meta = F.create_map(
        F.lit("Наименование"), F.col("file_id"), F.lit("МКБ-10"), F.when(F.col("doc_id") % 2 == 0, F.lit("A01")), F.lit("section"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")),
        F.lit("chunk_index"), F.col("doc_id").cast("string"), F.lit("content_type"), kind,
    )
    return docs.select("doc_id", "file_id", F.when(kind == "table", table).otherwise(F.col("chunk")).alias("chunk"), meta.alias("metadata"))


def format_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("doc_id", F.md5(render.format_chunk(F.col("chunk"), F.col("metadata"))).alias("text_md5"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    """Results of each query's search, in order."""
    near = retrieval.nearest(views.search_queries(spark, sf), views.docs(spark, sf), 5)
    rows = near.join(views.docs(spark, sf).select("doc_id", "chunk", "metadata"), "doc_id")
    section = F.get_json_object("metadata", "$.section")
    item = F.struct(F.col("vector_rank").alias("rank"), "doc_id", (1.0 - F.col("distance")).alias("rrf_score"), F.lit("").alias("title"), section.alias("section"), "chunk")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("r"))


def format_search_results(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform("r", lambda x: render.format_chunk(x["chunk"], F.create_map(F.lit("section"), x["section"])))
    return _found(spark, sf).select("query_id", F.md5(render.format_search_results(parts)).alias("text_md5"))


def format_context_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).select("query_id", F.md5(render.format_context_pack(F.col("r"))).alias("text_md5"))


def retrieval_log(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf).join(views.search_queries(spark, sf).select("query_id", "query_text"), "query_id")
    return found.select("query_id", F.md5(render.retrieval_log(F.lit("fact"), F.lit(5), F.col("query_text"), F.col("r"))).alias("text_md5"))


def format_formal(spark: SparkSession, sf: str) -> DataFrame:
    return flagged(spark, sf).select("id", render.format_formal(F.col("findings")).alias("text"))


def format_diagnosis_audit(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select("conv_id", F.md5(render.format_diagnosis_audit(F.col("result"))).alias("text_md5"))


def format_issue(spark: SparkSession, sf: str) -> DataFrame:
    each = issues(spark, sf).select("conv_id", "turn", F.explode("issues").alias("i"))
    return each.select("conv_id", "turn", render.format_issue(F.col("i")).alias("text"))


def format_result(spark: SparkSession, sf: str) -> DataFrame:
    findings = flagged(spark, sf).select(F.col("id").alias("conv_id"), "findings")
    joined = stored(spark, sf).join(findings, "conv_id")
    return joined.select("conv_id", F.md5(render.format_result(F.col("conv_id"), F.col("findings"), F.col("d"))).alias("text_md5"))


SQL_FLAGGED = """flagged AS (
  SELECT doc_id AS id, list_filter([CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN doc_id % 9 = 0 THEN 'LOW_QUALITY' END], lambda x: x IS NOT NULL) AS flags
  FROM labels)"""
#: What the answers of result_queries.answers() mean: kinds 0 and 1 have one issue, the others none.
SQL_ISSUES = """issues AS (
  SELECT conv_id, turn, length(text) AS chars, role, 'issue ' || length(text) AS issue, CASE WHEN length(text) % 2 = 0 THEN 's' || length(text) END AS section,
         turn % 4 IN (0, 1) AS has FROM conversations
), packed AS (SELECT *, CASE WHEN has THEN issue || '<' || concat_ws('/', role, section) || '>' ELSE '' END AS t,
         '    • ' || issue || chr(10) || '      source: ' || role || coalesce(' / ' || section, '') AS shown,
         '{"issue":"' || issue || '","sources":[{"doc_title":"' || role || '"' || coalesce(',"section":"' || section || '"', '') || '}]}' AS j FROM issues
), folded AS (SELECT conv_id, coalesce(string_agg(t, '|' ORDER BY turn % 3, turn) FILTER (has), '') AS t, coalesce(string_agg(j, ',' ORDER BY turn % 3, turn) FILTER (has), '') AS j,
         string_agg(shown, chr(10) ORDER BY turn % 3, turn) FILTER (has) AS shown,
         count(*) FILTER (has AND turn % 3 = 0)::INTEGER AS anamnesis, count(*) FILTER (has AND turn % 3 = 1)::INTEGER AS inspection, count(*) FILTER (has AND turn % 3 = 2)::INTEGER AS treatment,
         string_agg(shown, chr(10) ORDER BY turn) FILTER (has AND turn % 3 = 0) AS s0, string_agg(shown, chr(10) ORDER BY turn) FILTER (has AND turn % 3 = 1) AS s1, string_agg(shown, chr(10) ORDER BY turn) FILTER (has AND turn % 3 = 2) AS s2
  FROM packed GROUP BY conv_id)"""
_FORMAL = "CASE WHEN len(flags) = 0 THEN '  Formal structure: OK' ELSE '  Formal structure:' || chr(10) || array_to_string(list_transform(flags, lambda f: '    [' || f || '] see ' || lower(f)), chr(10)) END"
_SECTION = "'  {0}:' || CASE WHEN {1} IS NULL THEN ' OK' ELSE chr(10) || {1} END"
_CELLS = f"""cells AS (SELECT o_orderkey AS visit, {views.GUID.format("md5(CAST(o_orderkey AS STRING))")} AS guid FROM orders JOIN customer ON o_custkey = c_custkey)"""
_NEAR5 = search_queries.near_sql(5)
_PACK = "SELECT query_id, md5(string_agg({0}, {1} ORDER BY vector_rank)) AS text_md5 FROM near JOIN docs USING (doc_id) GROUP BY query_id"


def _near(item: str, separator: str) -> str:
    return with_views(_PACK.format(item, separator), SQL_DOCS, views.SQL_QUERIES, _NEAR5)


QUERIES = {
    "parse_metadata": (
        parse_metadata,
        """SELECT event_id, CASE WHEN event_id % 10 < 2 THEN 0 ELSE len(json_keys(props)) END::INTEGER AS keys, CASE WHEN event_id % 10 >= 2 THEN props->>'k' END AS k FROM events""",
    ),
    "parse_issues": (parse_issues, with_views("SELECT conv_id, turn, has::INTEGER AS n, t AS text FROM packed", SQL_ISSUES)),
    "parse_findings": (
        parse_findings,
        with_views("SELECT id, CASE WHEN id % 11 = 0 THEN '' ELSE array_to_string(list_transform(flags, lambda f: f || ':see ' || lower(f)), ';') END AS findings FROM flagged", SQL_FLAGGED),
    ),
    "parse_queries": (
        parse_queries,
        "SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN md5(text) END AS fact_md5, CASE WHEN item_id % 3 <> 0 THEN 'p' END AS procedure, CASE WHEN item_id % 3 = 0 THEN 'missing or invalid question' END AS error FROM benchmark",
    ),
    "extract_guid": (extract_guid, with_views("SELECT visit, CASE WHEN visit % 3 <> 0 THEN guid END AS guid FROM cells", _CELLS)),
    "done_guids_from_report": (done_guids_from_report, with_views("SELECT DISTINCT guid FROM cells WHERE visit % 3 <> 0", _CELLS)),
    "safe_period_key": (safe_period_key, "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') || '---' || strftime(o_orderdate, '%d-%m-%Y') AS key FROM orders"),
    "flag_contains": (flag_contains, "SELECT doc_id AS id FROM labels WHERE toxic = 1 ORDER BY id"),
    "flags_of_findings": (flags_of_findings, with_views("SELECT id, array_to_string(flags, ',') AS flags FROM flagged", SQL_FLAGGED)),
    "write_results": (
        write_results,
        with_views(
            """SELECT id, '{"id":' || id || '}' AS input, array_to_string(flags, ',') AS flags,
            '[' || array_to_string(list_transform(flags, lambda f: '{"flag":"' || f || '","issue":"see ' || lower(f) || '"}'), ',') || ']' AS issues,
            CASE WHEN id % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS run_date FROM flagged""",
            SQL_FLAGGED,
        ),
    ),
    "concat_checker_issues": (concat_checker_issues, with_views("SELECT conv_id, t AS text FROM folded", SQL_ISSUES)),
    "issue_counts": (issue_counts, with_views("SELECT conv_id, anamnesis, inspection, treatment FROM folded", SQL_ISSUES)),
    "serialize_issues": (serialize_issues, with_views("""SELECT conv_id, md5('[{"icd_code":"C' || (conv_id % 7) || '","issues":[' || j || ']}]') AS json_md5 FROM folded""", SQL_ISSUES)),
    "deserialize_issues": (
        deserialize_issues,
        with_views("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'C' || (conv_id % 7) END AS icd_code, CASE WHEN conv_id % 4 = 0 THEN 'x<>' ELSE t END AS text FROM folded", SQL_ISSUES),
    ),
    "format_chunk": (
        format_chunk,
        with_views(
            """SELECT doc_id, md5('[' || file_id || CASE WHEN doc_id % 2 = 0 THEN ' | МКБ-10: A01' ELSE '' END || chr(10) || CASE WHEN doc_id % 5 <> 0 THEN section || ' | ' ELSE '' END || 'фрагмент ' || doc_id || ']' || chr(10)
              || CASE WHEN doc_id % 3 = 0 THEN '{"  0": "v, x", "lang": "' || section || '"}' || chr(10) || '{"  0": "w, x", "lang": "' || section || '"}' ELSE chunk END) AS text_md5 FROM docs""",
            SQL_DOCS,
        ),
    ),
    "format_search_results": (format_search_results, _near("'--- Источник ' || vector_rank || ' ---' || chr(10) || '[' || section || ']' || chr(10) || chunk", "chr(10) || chr(10)")),
    "format_context_pack": (format_context_pack, _near("'[' || vector_rank || '] ' || section || chr(10) || chunk", "chr(10) || chr(10) || '---' || chr(10) || chr(10)")),
    "retrieval_log": (
        retrieval_log,
        with_views(
            """SELECT query_id, md5('[retrieval] hybrid_search' || chr(10) || 'query_type: fact' || chr(10) || 'top_k: 5' || chr(10) || 'query: ' || any_value(query_text) || chr(10) || 'count: ' || count(*) || chr(10) ||
            string_agg(chr(10) || '--- chunk ' || vector_rank || ' ---' || chr(10) || 'id: ' || doc_id || chr(10) || 'rrf_score: ' || printf('%.6f', 1.0 - distance) || chr(10) || 'title: —' || chr(10) || 'section: ' || section || chr(10) || chunk, chr(10) ORDER BY vector_rank)) AS text_md5
            FROM near JOIN docs USING (doc_id) JOIN queries USING (query_id) GROUP BY query_id""",
            SQL_DOCS, views.SQL_QUERIES, _NEAR5,
        ),
    ),
    "format_formal": (format_formal, with_views(f"SELECT id, {_FORMAL} AS text FROM flagged", SQL_FLAGGED)),
    "format_diagnosis_audit": (
        format_diagnosis_audit,
        with_views(
            f"""SELECT conv_id, md5(CASE WHEN conv_id % 5 = 0 THEN '{render.NO_GUIDELINE} (C' || (conv_id % 7) || ')' ELSE
            'Результат аудита диагноза(icd_code=C' || (conv_id % 7) || ', номер клин.рек.=G' || conv_id || ')' || chr(10) || {_SECTION.format('Анамнез', 's0')} || chr(10) || {_SECTION.format('Осмотр', 's1')} || chr(10) || {_SECTION.format('Лечение', 's2')} END) AS text_md5 FROM folded""",
            SQL_ISSUES,
        ),
    ),
    "format_issue": (format_issue, with_views("SELECT conv_id, turn, shown AS text FROM packed WHERE has", SQL_ISSUES)),
    "format_result": (
        format_result,
        with_views(
            f"""SELECT conv_id, md5('Result(id=' || conv_id || ')' || chr(10) || {_FORMAL} || chr(10) || '  Diagnosis results:' || chr(10) || '  [C' || (conv_id % 7) || ']' || CASE WHEN shown IS NULL THEN ' OK' ELSE chr(10) || shown END) AS text_md5
            FROM folded JOIN flagged ON id = conv_id""",
            SQL_ISSUES, SQL_FLAGGED,
        ),
    ),
}
