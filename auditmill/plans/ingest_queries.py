"""Registered queries: sources, layout, chunks, scoring and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditmill.functions import json_text, text
from auditmill.operators import ingest, layout, rules, scoring
from auditmill.plans import views, visit_queries
from auditmill.plans.search_queries import TOKENS
from auditmill.plans.views import LINE_ORDER, SQL_HEADS, SQL_LINES, SQL_MANIFEST, with_views
from auditmill.sources import files
from auditmill.sources.scratch import scratch_path
from auditmill.streaming.incremental import audit_new

ANCHOR = "Список сокращений"
DAY = 86_400


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed windows of all documents: file_id, doc_id, n, chunk."""
    docs = views.table(spark, sf, "documents")
    return docs.select(F.col("source").alias("file_id"), "doc_id", F.posexplode(text.chunk_fixed(F.col("text"))).alias("n", "chunk"))


#: The records of table_pages().
SQL_RECORDS = """records AS (
  SELECT visit, pos, date, '{"group": "' || segment || '", "code": "' || code || '", "Unnamed: 2": "' || name || '", "code.1": "' || CASE WHEN first_time THEN 'new' ELSE '' END || '"}' AS record
  FROM visit_lines JOIN visit_heads USING (visit))"""


def sources(spark: SparkSession, sf: str, below: int | None = None) -> DataFrame:
    """All sources, or those with numbers under ``below``, as (id)."""
    docs = views.table(spark, sf, "documents")
    docs = docs if below is None else docs.where(F.substring("source", 4, 5).cast("int") < below)
    return docs.select(F.col("source").alias("id")).distinct()


def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    listed = views.manifest(spark, sf)
    listed.select(F.col("id").alias("ID"), F.col("name").alias("Наименование"), F.col("codes").alias("МКБ-10")).write.csv(path, header=True)
    read = files.read_manifest(spark, path)
    return read.select(F.col("ID").alias("id"), F.col("`МКБ-10`").alias("codes"), F.col("metadata")["Наименование"].alias("name"))


def scan_docs_no_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return views.docs(spark, sf).select("doc_id", "file_id", "metadata", F.length("chunk").alias("chars"))


def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One document by its id, from documents that are landed for lookups by it."""
    path = scratch_path(spark, "lookup")
    files.land_for_lookups(views.table(spark, sf, "documents"), path, "doc_id")
    return spark.read.parquet(path).where("doc_id = 77").select("doc_id", "source", "text")


def pages_to_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return files.pages_to_blocks(views.table(spark, sf, "pages"))


def write_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Two writes: all chunks, then those of one file without its last windows; the file is replaced as a whole."""
    path = scratch_path(spark, "docs")
    chunks = doc_chunks(spark, sf)
    files.write_docs(chunks, path)
    files.write_docs(chunks.where("file_id = 'src1' AND n = 0"), path)
    return files.read_docs(spark, path).groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


def replace_file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks are written, those of one file are deleted, and the rest is read back."""
    path = scratch_path(spark, "docs")
    files.write_docs(doc_chunks(spark, sf), path)
    deleted = files.delete_file(spark, path, "src3")
    return files.read_docs(spark, path).agg(F.lit(deleted).cast("long").alias("deleted"), F.count("*").alias("left"))


def anti_ingested(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.not_ingested(sources(spark, sf), sources(spark, sf, 5))


def semi_file_exists(spark: SparkSession, sf: str) -> DataFrame:
    found, missing = ingest.with_files(sources(spark, sf), sources(spark, sf, 15))
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def distinct_file_ids(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select(F.col("source").alias("file_id")).distinct()


def entries(spark: SparkSession, sf: str) -> DataFrame:
    events = views.table(spark, sf, "events").where("event_type = 'signup'")
    return events.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 500 + 1).alias("page"), F.col("event_id").alias("ord"), F.concat(F.lit("T"), "event_id").alias("title"))


def book_pages(spark: SparkSession, sf: str) -> DataFrame:
    events = views.table(spark, sf, "events").where("event_type <> 'signup'")
    return events.select(F.col("user_id").alias("file_id"), (F.col("event_id") % 500).alias("page"), "event_id")


def ordered_entries(spark: SparkSession, sf: str) -> DataFrame:
    return layout.ordered_entries(entries(spark, sf)).select("file_id", "place", "start", "title")


def section_asof(spark: SparkSession, sf: str) -> DataFrame:
    starts = layout.ordered_entries(entries(spark, sf))
    return layout.section_asof(book_pages(spark, sf), starts).select("event_id", "section")


def first_content_page(spark: SparkSession, sf: str) -> DataFrame:
    starts = layout.ordered_entries(entries(spark, sf))
    return layout.from_first_entry(book_pages(spark, sf), starts).select("event_id", "file_id", "page")


def interval_complement(spark: SparkSession, sf: str) -> DataFrame:
    events = views.table(spark, sf, "events")
    top = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    spans = events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), top.alias("top"), F.least(top + F.floor(F.col("value") * 60), F.lit(DAY)).cast("int").alias("bottom"))
    groups = spans.select("user_id", "day").distinct()
    return layout.interval_complement(spans, ["user_id", "day"], F.lit(0), F.lit(DAY), groups)


def assemble_document(spark: SparkSession, sf: str) -> DataFrame:
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit(" \t"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"))
    return layout.assemble(turns, "conv_id", ["turn"]).select("conv_id", F.md5("text").alias("text_md5"))


def chunk_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return layout.chunk_ordinals(doc_chunks(spark, sf), "file_id", ["doc_id", "n"]).select("file_id", "doc_id", "n", "chunk_index")


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return layout.row_batches(views.table(spark, sf, "lineitem"), "l_suppkey", ["l_orderkey", *LINE_ORDER])


def row_batches(spark: SparkSession, sf: str) -> DataFrame:
    return table_rows(spark, sf).groupBy("l_suppkey", "batch").agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("keys"), F.max("place").alias("last"))


def render_chunk_json(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("place", "l_orderkey", "l_partkey", "l_returnflag")
    grouped = table_rows(spark, sf).groupBy("l_suppkey", "batch").agg(F.array_sort(F.collect_list(item)).alias("r"))
    rows = F.transform("r", lambda x: F.struct(x["l_orderkey"].alias("l_orderkey"), x["l_partkey"].alias("l_partkey"), x["l_returnflag"].alias("l_returnflag")))
    return grouped.select("l_suppkey", "batch", F.md5(F.to_json(rows)).alias("json_md5"))


def fill_blank(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of which some are null; a table without rows has no cells here."""
    cells = views.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"))
    return cells.na.fill("")


def union_chunks(spark: SparkSession, sf: str) -> DataFrame:
    texts = chunk_ordinal(spark, sf).select("file_id", "chunk_index", F.lit("text").alias("content_type"), "doc_id")
    tables = row_batches(spark, sf).select(F.concat(F.lit("sup"), "l_suppkey").alias("file_id"), F.col("batch").alias("chunk_index"), F.lit("table").alias("content_type"))
    return texts.unionByName(tables, allowMissingColumns=True)


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """A text per order: a preamble, a contents-like line, and a section for each line."""
    part = F.concat(F.lit("1."), F.col("pos"), F.lit(" "), "name", F.lit("\nbody "), "code", F.lit("\n"))
    sections = views.visit_lines(spark, sf).groupBy("visit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    joined = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("visit")).join(sections, "visit", "left")
    return joined.select("visit", F.concat(F.lit("Preamble of "), "visit", F.lit("\n0.1 Contents ..... 7\nlost\n"), F.coalesce("t", F.lit(""))).alias("text"))


def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    parts = numbered(spark, sf).select("visit", F.posexplode(text.split_sections(F.col("text"))).alias("pos", "s"))
    return parts.select("visit", "pos", "s.title", F.md5("s.text").alias("text_md5"))


def strip_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with an even key have the anchor twice, others once."""
    again = F.when(F.col("visit") % 2 == 0, F.lit(ANCHOR + "\n")).otherwise("")
    framed = numbered(spark, sf).select("visit", F.concat(F.lit("Title\n" + ANCHOR + "\nfront "), again, "text").alias("text"))
    return framed.select("visit", F.md5(text.strip_front_matter(F.col("text"), ANCHOR)).alias("text_md5"))


def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    pieces = docs.select("doc_id", F.posexplode(text.chunk_recursive()(F.col("text"))).alias("n", "chunk"))
    return pieces.select("doc_id", "n", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return doc_chunks(spark, sf).select("doc_id", "n", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def content_preview(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", text.content_preview(F.col("text")).alias("preview"))


def merge_metadata(spark: SparkSession, sf: str) -> DataFrame:
    chunks = doc_chunks(spark, sf)
    base = F.create_map(F.lit("section"), F.lit("base"), F.lit("file"), F.col("file_id"))
    over = F.create_map(F.lit("section"), F.concat(F.lit("s"), F.col("n")), F.lit("chunk_index"), F.col("n").cast("string"))
    entries_ = F.array_sort(F.map_entries(json_text.merge_metadata(base, over)))
    return chunks.select("doc_id", "n", F.array_join(F.transform(entries_, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.summary(doc_chunks(spark, sf).withColumn("error", F.when(F.col("doc_id") % 7 == 0, "failed")))


def make_length_scorer() -> scoring.Scorer:
    """Answers with the text's length; refuses texts with an insult and cuts long answers short."""

    def score(texts: list[str]) -> list[tuple[str | None, str]]:
        if any("idiot" in t for t in texts):
            raise ValueError("refused")
        return [(str(len(t)), "stop" if len(t) < 5000 else "length") for t in texts]

    return score


def score_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents")
    return scoring.score_batches(docs, make_length_scorer, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "answer", "status", "error")


def make_visit_scorer() -> scoring.Scorer:
    labels = (("Перв", "primary"), ("Повт", "repeat"), ("Проф", "prophylactic"))

    def score(texts: list[str]) -> list[tuple[str | None, str]]:
        return [(next((label for start, label in labels if t.startswith(start)), "unsure"), "stop") for t in texts]

    return score


def classify_visit_scored(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_batches(views.visit_heads(spark, sf), make_visit_scorer, "visit", "service")
    return scored.select(F.col("visit").cast("long").alias("visit"), F.when(F.col("answer").isin("primary", "repeat", "prophylactic"), F.col("answer")).alias("visit_type"))


def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", scoring.embed_text(F.col("text"), 64).alias("v"))
    millionths = F.array_join(F.transform("v", lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return docs.select("doc_id", F.size("v").alias("dimension"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.md5(millionths).alias("vector_md5"))


def chunk_questions(spark: SparkSession, sf: str) -> DataFrame:
    chunks = doc_chunks(spark, sf)
    return chunks.select("doc_id", "n", scoring.chunk_questions(F.col("chunk")).alias("q")).select("doc_id", "n", "q.*")


def embed_three(spark: SparkSession, sf: str) -> DataFrame:
    """Three vectors of every chunk."""
    chunks = doc_chunks(spark, sf).select("doc_id", "n", scoring.chunk_questions(F.col("chunk")).alias("q"))
    made = scoring.embed_three(chunks, ["doc_id", "n"], 64)
    return made.select("doc_id", "n", *[F.size(k).alias(k) for k in ("fact", "procedure", "constraint")])


embed_three_chunks = embed_three


def ingest_corpus(spark: SparkSession, sf: str) -> DataFrame:
    chunks = ingest.ingest_pages(views.table(spark, sf, "pages"))
    return chunks.select("file_id", "content_type", "table_index", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.size("fact").alias("dimension"), "error")


def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each visit with lines: a heading, a table of its lines under another one, text after it; the patient's cell spans all rows, one column has no name, and two have the same."""
    heads, lines = views.visit_heads(spark, sf), views.visit_lines(spark, sf)
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    first = F.when(F.col("pos") == 1, F.concat(F.lit('<td rowspan="'), F.count("*").over(Window.partitionBy("visit")).cast("string"), F.lit('"><p>'), "segment", F.lit("</p></td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), first, cell(F.col("code")), cell(F.concat(F.lit("<b>"), "name", F.lit("</b>"))), F.when(F.col("first_time"), cell(F.lit("new"))).otherwise(""), F.lit("</tr>"))
    rows = lines.join(heads.select("visit", "segment"), "visit").select("visit", "pos", row.alias("t"))
    body = rows.groupBy("visit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n").alias("rows"))
    top = F.concat(F.lit("<h1>Visit</h1><p>"), "service", F.lit("</p><h2>Lines of "), "date", F.lit("</h2><table><tr><th>group</th><th>code</th><th></th><th>code</th></tr>"))
    return heads.join(body, "visit").select(F.col("visit").alias("page_id"), F.concat(top, "rows", F.lit("</table><h2>End</h2><p>after</p>")).alias("html"))


def pages_to_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each page's table, by column names."""
    return files.pages_to_tables(table_pages(spark, sf)).select("page_id", "table", "headings", "row", F.md5("record").alias("record_md5"))


def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a table's records under their section."""
    chunks = ingest.table_chunks(table_pages(spark, sf))
    return chunks.select("page_id", "table_index", "chunk_index", "section", F.md5("chunk").alias("chunk_md5"))


def ingest_job(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of one ingest: the first has a part of the pages, the second all but some; what is stored then, and what is missing."""
    pages, folder = views.table(spark, sf, "pages").select("page_id", "url", "html"), scratch_path(spark, "ingest")
    manifest = pages.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("name"))
    ingest.ingest(manifest.where("CAST(id AS BIGINT) % 4 = 0"), pages, folder, "run-1", anchor=ANCHOR)
    _, missing = ingest.ingest(manifest, pages.where("page_id % 5 <> 1"), folder, "run-2", anchor=ANCHOR)
    docs = files.read_docs(spark, f"{folder}/docs")
    kept = docs.groupBy("file_id").agg(F.count("*").alias("chunks")).select("file_id", F.lit("stored").alias("state"), "chunks")
    return kept.unionByName(missing.select(F.col("id").alias("file_id"), F.lit("missing").alias("state"), F.lit(0).cast("long").alias("chunks")))


def incremental_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Visits arrive as files in two lots that share some; the second run audits only new ones, a third none.

    The second lot spells guids in upper case. Visits without a guid (empty or null) cannot be
    known again: those of both lots are audited with each.
    """
    guid = F.when(F.col("visit") % 10 == 3, "").when(F.col("visit") % 10 != 4, F.col("guid"))
    visits = views.visits(spark, sf).select("visit", guid.alias("guid"), "services")
    folder, results, checkpoint = (scratch_path(spark, x) for x in ("visits", "audited", "offsets"))

    def audited(batch: DataFrame) -> DataFrame:
        return batch.select("visit", "guid", rules.visit_type(F.col("services")).alias("visit_type"))

    schema = "visit long, guid string, services array<struct<name:string>>"
    visits.where("visit % 3 <> 0").write.mode("append").parquet(folder)
    audit_new(spark, folder, schema, results, checkpoint, audited)
    visits.where("visit % 3 <> 1").withColumn("guid", F.upper("guid")).write.mode("append").parquet(folder)
    for _ in range(2):
        audit_new(spark, folder, schema, results, checkpoint, audited)
    return spark.read.parquet(results).select("visit", "guid", "visit_type")


SQL_CHUNKS = """chunks AS (
  SELECT source AS file_id, doc_id, (unnest(generate_series(1, greatest(length(text) - 200, 1), 1800)) - 1) // 1800 AS n, text FROM documents WHERE length(text) > 0)"""
SQL_CHUNK = "substr(text, n * 1800 + 1, 2000)"
SQL_ROWS = f"""trows AS (
  SELECT *, ((row_number() OVER w - 1) // 8)::INTEGER AS batch, ((row_number() OVER w - 1) % 8)::INTEGER AS place FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, {", ".join(LINE_ORDER)}))"""
SQL_ENTRIES = """entries AS (SELECT user_id AS file_id, event_id % 500 AS start, event_id AS ord, 'T' || event_id AS title FROM events WHERE event_type = 'signup'
), book AS (SELECT user_id AS file_id, event_id % 500 AS page, event_id FROM events WHERE event_type <> 'signup')"""
SQL_NUMBERED = """secs AS (SELECT visit, string_agg('1.' || pos || ' ' || name || chr(10) || 'body ' || code || chr(10), '' ORDER BY pos) AS t FROM visit_lines GROUP BY visit
), numbered AS (SELECT o_orderkey AS visit, 'Preamble of ' || o_orderkey || chr(10) || '0.1 Contents ..... 7' || chr(10) || 'lost' || chr(10) || coalesce(t, '') AS text FROM orders LEFT JOIN secs ON visit = o_orderkey)"""
_NUMBER = "CAST(substr(source, 4, 5) AS INTEGER)"

QUERIES = {
    "scan_manifest": (scan_manifest, with_views("SELECT id, codes, name FROM manifest", SQL_MANIFEST)),
    "scan_docs_no_vectors": (scan_docs_no_vectors, """SELECT doc_id, source AS file_id, '{"section":"' || lang || '"}' AS metadata, length(text)::INTEGER AS chars FROM documents JOIN embeddings ON doc_id = vec_id"""),
    "point_lookup": (point_lookup, "SELECT doc_id, source, text FROM documents WHERE doc_id = 77"),
    "pages_to_blocks": (pages_to_blocks, None),
    "write_docs": (write_docs, with_views(f"SELECT file_id, count(*) AS chunks, sum(length({SQL_CHUNK}))::BIGINT AS chars FROM chunks WHERE file_id <> 'src1' OR n = 0 GROUP BY file_id", SQL_CHUNKS)),
    "replace_file_chunks": (replace_file_chunks, with_views("SELECT count(*) FILTER (file_id = 'src3') AS deleted, count(*) FILTER (file_id <> 'src3') AS left FROM chunks", SQL_CHUNKS)),
    "anti_ingested": (anti_ingested, f"SELECT DISTINCT source AS id FROM documents WHERE NOT coalesce({_NUMBER} < 5, false)"),
    "semi_file_exists": (semi_file_exists, f"SELECT DISTINCT source AS id, coalesce({_NUMBER} < 15, false) AS found FROM documents"),
    "distinct_file_ids": (distinct_file_ids, "SELECT DISTINCT source AS file_id FROM documents"),
    "ordered_entries": (ordered_entries, with_views("SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start, ord)::INTEGER AS place, start, title FROM entries", SQL_ENTRIES)),
    "section_asof": (
        section_asof,
        with_views("SELECT event_id, arg_max(title, start * 1000000000 + ord) AS section FROM book b LEFT JOIN entries e ON e.file_id = b.file_id AND e.start <= b.page GROUP BY event_id", SQL_ENTRIES),
    ),
    "first_content_page": (
        first_content_page,
        with_views("SELECT event_id, file_id, page FROM book LEFT JOIN (SELECT file_id, min(start) AS f FROM entries GROUP BY file_id) USING (file_id) WHERE page >= coalesce(f, 0)", SQL_ENTRIES),
    ),
    "interval_complement": (
        interval_complement,
        f"""WITH spans AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)))::INTEGER AS top, value FROM events
        ), clipped AS (SELECT user_id, day, top, least(top + floor(value * 60), {DAY})::INTEGER AS bottom FROM spans
        ), tailed AS (SELECT * FROM clipped UNION ALL SELECT DISTINCT user_id, day, {DAY}, {DAY} FROM clipped
        ), gaps AS (SELECT *, greatest(0, coalesce(max(bottom) OVER (PARTITION BY user_id, day ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start FROM tailed)
        SELECT user_id, day, start, top AS "end" FROM gaps WHERE top > start""",
    ),
    "assemble_document": (
        assemble_document,
        r"SELECT conv_id, md5(string_agg(t, chr(10) ORDER BY turn)) AS text_md5 FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations) WHERE t <> '' GROUP BY conv_id",
    ),
    "chunk_ordinal": (chunk_ordinal, with_views("SELECT file_id, doc_id, n::INTEGER AS n, (row_number() OVER (PARTITION BY file_id ORDER BY doc_id, n) - 1)::INTEGER AS chunk_index FROM chunks", SQL_CHUNKS)),
    "row_batches": (row_batches, with_views("SELECT l_suppkey, batch, count(*) AS rows, sum(l_orderkey)::BIGINT AS keys, max(place) AS last FROM trows GROUP BY ALL", SQL_ROWS)),
    "render_chunk_json": (
        render_chunk_json,
        with_views("""SELECT l_suppkey, batch, md5('[' || string_agg('{"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY place) || ']') AS json_md5 FROM trows GROUP BY ALL""", SQL_ROWS),
    ),
    "fill_blank": (fill_blank, "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_name ELSE '' END AS name, CASE WHEN p_size % 3 <> 0 THEN p_brand ELSE '' END AS brand FROM part"),
    "union_chunks": (
        union_chunks,
        with_views(
            "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY doc_id, n) - 1 AS chunk_index, 'text' AS content_type, doc_id FROM chunks UNION ALL SELECT DISTINCT 'sup' || l_suppkey, batch, 'table', NULL FROM trows",
            SQL_CHUNKS, SQL_ROWS,
        ),
    ),
    "split_sections": (
        split_sections,
        with_views(
            r"SELECT visit, pos - 1 AS pos, '1.' || pos || ' ' || name AS title, md5('1.' || pos || ' ' || name || chr(10) || 'body ' || code) AS text_md5 FROM visit_lines UNION ALL SELECT visit, 0, NULL, md5(text) FROM numbered WHERE visit NOT IN (SELECT visit FROM visit_lines)",
            SQL_LINES, SQL_NUMBERED,
        ),
    ),
    "strip_front_matter": (
        strip_front_matter,
        with_views(
            rf"SELECT visit, md5(CASE WHEN visit % 2 = 0 THEN '{ANCHOR}' || chr(10) || regexp_replace(text, '\s+$', '') ELSE 'Title' || chr(10) || '{ANCHOR}' || chr(10) || 'front ' || text END) AS text_md5 FROM numbered",
            SQL_LINES, SQL_NUMBERED,
        ),
    ),
    "chunk_recursive": (chunk_recursive, None),
    "chunk_fixed": (chunk_fixed, with_views(f"SELECT doc_id, n::INTEGER AS n, length({SQL_CHUNK})::INTEGER AS chars, md5({SQL_CHUNK}) AS chunk_md5 FROM chunks", SQL_CHUNKS)),
    "content_preview": (content_preview, "SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS preview FROM documents"),
    "merge_metadata": (merge_metadata, with_views("SELECT doc_id, n::INTEGER AS n, 'chunk_index=' || n || ';file=' || file_id || ';section=s' || n AS metadata FROM chunks", SQL_CHUNKS)),
    "ingest_summary": (ingest_summary, with_views("SELECT file_id, count(*) FILTER (doc_id % 7 <> 0) AS inserted, count(*) FILTER (doc_id % 7 = 0) AS failed FROM chunks GROUP BY ROLLUP (file_id)", SQL_CHUNKS)),
    "score_batches": (
        score_batches,
        """SELECT doc_id, CASE WHEN text NOT LIKE '%idiot%' THEN length(text)::VARCHAR END AS answer,
        CASE WHEN text IS NULL THEN 'empty' WHEN text LIKE '%idiot%' THEN 'error' WHEN length(text) < 5000 THEN 'ok' ELSE 'cut' END AS status,
        CASE WHEN text LIKE '%idiot%' THEN 'ValueError: refused' WHEN length(text) >= 5000 THEN 'length' END AS error FROM documents""",
    ),
    "classify_visit_scored": (classify_visit_scored, with_views(f"SELECT visit, nullif({visit_queries.KIND_SQL}, 'other') AS visit_type FROM visit_heads", SQL_HEADS)),
    "embed_text": (
        embed_text,
        rf"""WITH buckets AS (SELECT doc_id, ('0x' || md5(t)[:8])::BIGINT % 64 AS b, count(*) AS c FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS t FROM documents) GROUP BY ALL
        ), held AS (SELECT doc_id, map_from_entries(list((b, c))) AS m, sqrt(sum(c * c)) AS size FROM buckets GROUP BY doc_id)
        SELECT doc_id, 64 AS dimension, CASE WHEN size IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS length,
               md5(array_to_string(list_transform(range(64), lambda i: round(coalesce(m[i] / size, 0) * 1000000)::BIGINT), ',')) AS vector_md5
        FROM documents LEFT JOIN held USING (doc_id)""",
    ),
    "chunk_questions": (
        chunk_questions,
        with_views(
            rf"""sentences AS (SELECT doc_id, n, list_filter(string_split(regexp_replace({SQL_CHUNK}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM chunks)
            SELECT doc_id, n::INTEGER AS n, s[1] AS fact, coalesce(s[2], s[-1]) AS procedure, coalesce(s[3], s[-1]) AS "constraint" FROM sentences""",
            SQL_CHUNKS,
        ),
    ),
    "embed_three": (embed_three, with_views('SELECT doc_id, n::INTEGER AS n, 64 AS fact, 64 AS procedure, 64 AS "constraint" FROM chunks', SQL_CHUNKS)),
    "embed_three_chunks": (embed_three_chunks, with_views('SELECT doc_id, n::INTEGER AS n, 64 AS fact, 64 AS procedure, 64 AS "constraint" FROM chunks', SQL_CHUNKS)),
    "pages_to_tables": (pages_to_tables, with_views("SELECT visit AS page_id, 0 AS \"table\", 2 AS headings, (pos - 1)::INTEGER AS row, md5(record) AS record_md5 FROM records", SQL_HEADS, SQL_LINES, SQL_RECORDS)),
    "table_chunks": (
        table_chunks,
        with_views(
            """SELECT visit AS page_id, 0 AS table_index, ((pos - 1) // 8)::INTEGER AS chunk_index, 'Lines of ' || date AS section, md5('[' || string_agg(record, ', ' ORDER BY pos) || ']') AS chunk_md5
            FROM records GROUP BY ALL""",
            SQL_HEADS, SQL_LINES, SQL_RECORDS,
        ),
    ),
    "ingest_corpus": (ingest_corpus, None),
    "ingest_job": (ingest_job, None),
    "incremental_audit": (
        incremental_audit,
        with_views(
            f"""typed AS (SELECT visit, CASE WHEN visit % 10 = 3 THEN '' WHEN visit % 10 <> 4 THEN guid END AS guid, {visit_queries.KIND_SQL} AS visit_type FROM visit_heads)
            SELECT visit, guid, visit_type FROM typed WHERE visit % 3 <> 0
            UNION ALL SELECT visit, upper(guid), visit_type FROM typed WHERE visit % 3 = 0 OR (visit % 3 = 2 AND coalesce(guid, '') = '')""",
            SQL_HEADS,
        ),
    ),
}
