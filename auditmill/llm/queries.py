"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, lexical, line_dedup, minhash_dedup, mixing, ngram_join, pii, repair, token_counts, toxicity, warc
from .shared import let, materialize, release, table


#: A demonstration key; a real one is a secret that the caller passes.
PII_KEY = "demonstration-key"

#: The tokenizer's vocabulary: pieces and scores of this public model, used as a unigram model.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.split_items(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find_contaminated(table(spark, sf_dir, "documents"), items)
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.transform("matches", lambda m: m["by"]).alias("matched_by"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.read_vocabulary(VOCABULARY))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    fixed = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    turns = stored.unionByName(fixed).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_chats(turns)
    read = out.select("conv_id", "formatted", F.struct(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).alias("r"))
    digest = let(
        F.col("r"),
        lambda r: F.struct(
            F.size(r["t"]).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(r["t"], lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.aggregate(r["l"], F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("loss_chars"),
            F.sha2(F.array_join(r["l"], ""), 256).alias("loss_sha256"),
        ),
    )
    read = read.select("conv_id", digest.alias("d"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "d.*", "formatted_chars")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents"))
    found = materialize(lexical.search(index, table(spark, sf_dir, "benchmark")), "found")
    release(index)
    return found


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(table(spark, sf_dir, "documents"), percent=80)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "conversations")
    rows = repair.damage(stored)
    planned = materialize(repair.plans(rows), "plans")
    named = [F.col(c).alias(f"_{c}") for c in ("conv_id",)]
    found = planned.join(repair.digests(repair.repaired_turns(rows, planned)).select(*named, "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    found = found.select(F.col("conv_id").alias("_conv_id"), F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").alias("p"))
    every = stored.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    numbers = [F.coalesce(f"p.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("p.audit", F.lit("")).alias("audit"), F.coalesce("p.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_pseudonyms": op1_pii_pseudonyms,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mixing": op5_mixing,
        "op6_toxicity": op6_toxicity,
        "op7_line_dedup": op7_line_dedup,
        "op8_token_counts": op8_token_counts,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_warc": op10_warc,
        "op11_lexical_search": op11_lexical_search,
        "op12_ngram_join": op12_ngram_join,
        "op13_conversation_repair": op13_conversation_repair,
    }


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.other = edges.x
), comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM comps LEFT JOIN sizes USING (doc_id)
"""

OP3_SQL = r"""
WITH item_texts AS (
  SELECT item_id, text, regexp_extract(text, '(?s)^(.*[.!?])\s+(\S.*)$', 1) AS asked, regexp_extract(text, '(?s)^(.*[.!?])\s+(\S.*)$', 2) AS answer FROM benchmark
), sides AS (
  SELECT item_id, 'whole' AS side, text AS t FROM item_texts
  UNION ALL SELECT item_id, 'question', CASE WHEN answer = '' THEN text ELSE asked END FROM item_texts
  UNION ALL SELECT item_id, 'answer', answer FROM item_texts
), side_words AS (
  SELECT item_id, side, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM sides
), item_grams AS (
  SELECT DISTINCT item_id, side, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram
  FROM side_words WHERE len(w) >= CASE WHEN side = 'whole' THEN 1 ELSE 13 END
), sizes AS (SELECT item_id, side, count(*) AS n FROM item_grams GROUP BY ALL
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), doc_grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS gram,
         unnest(range(1, len(w) - 3)) AS pos
  FROM doc_words
), hits AS (
  -- A match lies in one passage of 128 words; no item here is longer than half of that.
  SELECT doc_id, item_id, side, gram, (pos - 1) // 64 + k AS passage FROM doc_grams JOIN item_grams USING (gram), (VALUES (0), (-1)) AS v(k)
), held AS (
  SELECT DISTINCT doc_id, item_id, side FROM (
    SELECT doc_id, item_id, side, passage, count(DISTINCT gram) AS c FROM hits GROUP BY ALL
  ) JOIN sizes USING (item_id, side) WHERE 5 * c >= 4 * n
), matched AS (
  SELECT doc_id, item_id, CASE WHEN bool_or(side = 'question') AND bool_or(side = 'answer') THEN 'both' WHEN bool_or(side = 'question') THEN 'question'
                               WHEN bool_or(side = 'answer') THEN 'answer' ELSE 'whole' END AS by
  FROM held GROUP BY ALL
)
SELECT doc_id, count(m.item_id) > 0 AS contaminated, coalesce(list(m.item_id ORDER BY m.item_id) FILTER (m.item_id IS NOT NULL), []) AS item_ids,
       coalesce(list(m.by ORDER BY m.item_id) FILTER (m.item_id IS NOT NULL), []) AS matched_by
FROM documents LEFT JOIN matched m USING (doc_id) GROUP BY doc_id
"""

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS n FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered
), found AS (SELECT level FROM levels WHERE cap > weight * level ORDER BY n LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM found)) AS target FROM ordered
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || md5('mix-1|' || doc_id)[:12])::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT doc_id, pos, line, s.key IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(role) + length(text) + length(text) - length(replace(text, chr(92), ''))
         + len(regexp_extract_all(text, '</?s>|<</?SYS>>|<\|[0-9A-Za-z_.-]+\|>|\[/?INST\]')) + 24 AS chars
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: DuckDB has no base 32: the SHA-1's hex digits are read as bits, and the bits five at a time.
OP10_SQL = r"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages
), bits AS (
  SELECT *, list_aggregate(list_transform(string_split(sha1(body), ''),
           lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), 'string_agg', '') AS b
  FROM hashed
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ('0b' || b[i * 5 + 1 : i * 5 + 5])::INTEGER]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM bits
"""


OP11_SQL = r"""
WITH terms AS (
  SELECT rowid_, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), sizes AS (SELECT rowid_, doc_id, len(t)::BIGINT AS n FROM terms WHERE len(t) > 0
), stats AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM sizes
), asked AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))) GROUP BY ALL
), wanted AS (SELECT DISTINCT term FROM asked
), postings AS (SELECT rowid_, term, count(*)::BIGINT AS tf FROM (SELECT rowid_, unnest(t) AS term FROM terms) JOIN wanted USING (term) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats
), scored AS (
  SELECT q, item_id, doc_id, rowid_, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (rowid_), stats GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP12_SQL = OP2_SQL.replace("85 *", "80 *").replace(", doc_id = component_id AS kept", "")


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11_SQL, "op12_ngram_join": OP12_SQL, "op2_minhash_near_dedup": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op7_line_dedup": OP7_SQL, "op9_chat_formatting": OP9_SQL, "op10_warc": OP10_SQL}
