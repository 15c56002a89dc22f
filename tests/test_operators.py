from __future__ import annotations

import math

import numpy as np
import pytest
from auditmill.operators import audit, codes, ingest, layout, retrieval, rules, scoring
from auditmill.plans import ingest_queries, search_queries
from auditmill.sources import files
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"f{i % 3}", f"text {i % 7} word{i % 5} and, more", '{"section":"Жалобы"}' if i % 2 else "{}", rng.normal(size=8).tolist() if i % 10 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, file_id string, chunk string, metadata string, fact_vec array<float>")
    queries = spark.createDataFrame([(q, f"word{q} text", rng.normal(size=8).tolist(), f"f{q}") for q in range(3)], "query_id long, query_text string, embedding array<float>, file_id string")
    return docs.repartition(5), queries, rows


def test_nearest_is_exact_and_skips_missing_vectors(corpus):
    docs, queries, rows = corpus
    got = retrieval.nearest(queries, docs, 7, same_file=True).collect()
    for q in queries.collect():
        v = np.array(q.embedding)
        far = sorted((round(1 - float(np.array(r[4], np.float32).astype(float) @ v / np.linalg.norm(np.array(r[4], np.float32).astype(float)) / np.linalg.norm(v)), 9), r[0]) for r in rows if r[4] and r[1] == q.file_id)[:7]
        mine = sorted((r.vector_rank, r.doc_id) for r in got if r.query_id == q.query_id)
        assert [d for _, d in mine] == [i for _, i in far] and [n for n, _ in mine] == list(range(1, 8))


def test_hybrid_search_shape(corpus):
    docs, queries, _ = corpus
    got = retrieval.hybrid_search(queries, docs, 4)
    assert got.columns == ["query_id", "rank", "doc_id", "rrf_score", "file_id", "chunk", "metadata"]
    rows = got.collect()
    assert len(rows) == 12 and all(r.rrf_score > 0 for r in rows)
    assert retrieval.hybrid_search(queries, docs.limit(0), 4).count() == 0
    assert retrieval.hybrid_search(queries.limit(0), docs, 4).count() == 0


def test_vector_columns():
    assert retrieval.vector_column("procedure") == "procedure_vec"
    with pytest.raises(ValueError, match="query_type"):
        retrieval.vector_column("other")


def test_bm25_agrees_with_the_formula(spark):
    texts = ["a b b", "a c", "a a a d", ""]
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "query_id long, doc_id long, chunk string")
    query = spark.createDataFrame([(1, "b a b zzz")], "query_id long, query_text string")
    got = {r.doc_id: r.bm25 for r in retrieval.bm25_scores(query, docs).collect()}
    split = [t.split() for t in texts]
    n, mean = len(texts), sum(map(len, split)) / len(texts)
    idf = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t in "abcd" for k in [sum(t in d for d in split)]}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    for i, d in enumerate(split):
        want = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in "b a b zzz".split())
        assert got[i] == pytest.approx(want, abs=1e-8)


def test_rank_fusion_is_symmetric(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 1), (1, 1, 2), (1, 3, 3)], "query_id long, doc_id long, rank int")
    got = {r.doc_id: r.rrf_score for r in retrieval.rrf_fuse(lists).collect()}
    assert got[1] == got[2] == pytest.approx(1 / 51 + 1 / 52) and got[3] == pytest.approx(1 / 53)


def test_guideline_tiers(spark):
    manifest = spark.createDataFrame(
        [("g1", "acute cough", "J06.0, j06.9", 1), ("g2", "cough chronic", "J06.9", 2), ("g3", "other", "J20.0", 3), (" ", "blank", "Z99", 4), ("g5", "alpha", "K10", 5), ("g6", "beta", "K10", 6)],
        "id string, name string, codes string, pos int",
    )
    rows = [("a", "J06.0", "x"), ("b", " j06.9 ", "Cough"), ("c", "J20.9", "any"), ("d", "Z00.1", "x"), ("e", "", "x"), ("f", "Z99", "x"), ("g", "K10", "betta"), ("h", "X1.2", "x"), ("i", None, "x"), ("k", "J06.9", None)]
    got = {r.dx: (r.guideline_id, r.tier) for r in codes.resolve(spark.createDataFrame(rows, "dx string, code string, name string"), manifest, "dx").collect()}
    assert got == {
        "a": ("g1", "exact_one"), "b": ("g1", "exact_overlap"), "c": ("g3", "prefix_scored"), "d": (None, "skip"), "e": (None, "skip"), "f": (None, "none"),
        "g": ("g6", "exact_scored"), "h": (None, "none"), "i": (None, "skip"), "k": ("g1", "exact_scored"),
    }


def test_choices(spark):
    frame = spark.createDataFrame([(' "g1"\n', ["g1"]), ("none", ["g1"]), ("g2", ["g1"])], "c string, ids array<string>")
    assert [r.x for r in frame.select(codes.valid_choice(F.col("c"), F.col("ids")).alias("x")).collect()] == ["g1", None, None]


VISIT = '{"Прием":{"GUID":"%s","DATE":"2024-01-01"},"Пациент":{"Возраст":10},"Диагнозы":[{"КодМКБ":"A01"},{"КодМКБ":"B02"}]}'


def test_payloads(spark):
    one = VISIT % "AAA"
    frame = spark.createDataFrame([(1, '{"appointments": [%s, %s]}' % (one, VISIT % "BBB")), (2, f"[{one}]"), (3, "broken"), (4, "{}"), (5, None)], "id int, payload string")
    got = files.split_appointments(frame, "id").collect()
    assert [(r.id, r.ordinal, r["Прием"].GUID) for r in got] == [(1, 0, "AAA"), (1, 1, "BBB"), (2, 0, "AAA")]
    assert got[0]["Пациент"] == {"Возраст": "10"} and [d["КодМКБ"] for d in got[0]["Диагнозы"]] == ["A01", "B02"]


def test_pending_visits_ignore_case_and_keep_order(spark):
    visits = spark.createDataFrame([(0, "aa-1"), (1, "BB-2"), (2, "cc-3"), (3, None), (4, "")], "n int, guid string")
    done = spark.createDataFrame([("bb-2",), (None,), ("",)], "guid string")
    assert [r.n for r in audit.pending(visits, done).orderBy("n").collect()] == [0, 2, 3, 4]
    assert audit.queue_summary(visits, done).first()[:] == (5, 1, 4, 2)


def test_visit_ids(spark):
    frame = spark.createDataFrame([("g", "d"), ("", "d"), (None, ""), (None, None)], "g string, d string")
    assert [r.x for r in frame.select(audit.visit_id(F.col("g"), F.col("d"), F.lit(4)).alias("x")).collect()] == ["g", "d", "#5", "#5"]


def nested(spark, rows):
    return spark.createDataFrame(
        rows,
        "visit long, guid string, date string, patient map<string,string>, services array<struct<name:string>>, "
        "diagnoses array<struct<code:string,name:string,detail:string,first_time:boolean>>, inspection array<struct<param:string,value:string>>",
    )


def test_one_report_row_per_visit_with_all_diagnoses(spark):
    visits = nested(
        spark,
        [
            (1, "G1", "2024-01-01", {"Возраст": "10"}, [("Первичный приём",)], [("A01", "cough", None, True), ("B02.1", "rash", None, None), (None, "none", None, None)], [("Жалобы", "-")]),
            (2, None, None, {}, [], [], []),
            (3, "DONE", "2024-01-02", {}, None, [], []),
        ],
    )
    manifest = spark.createDataFrame([("g1", "acute cough", "A01", 1), ("g2", "itch", "B02", 2)], "id string, name string, codes string, pos int")
    audited = audit.audit_visits(visits, manifest, spark.createDataFrame([("done",)], "guid string"))
    got = {r.visit: r for r in audited.collect()}
    assert set(got) == {1, 2} and got[1].visit_type == "primary" and got[2].visit_type == "other" and got[2].visit_id == "#2"
    assert [(x.icd_code, x.guideline_id) for x in got[1].results] == [("A01", "g1"), ("B02.1", "g2"), ("#3", None)]
    assert [len(x.anamnesis) for x in got[1].results] == [0, 1, 0] and got[2].results == []
    assert {f.flag for f in got[1].findings} == {"PLACEHOLDER"} and {"MISSING_META", "MISSING_DIAGNOSIS"} <= {f.flag for f in got[2].findings}
    report = {r.visit: r for r in audit.report_rows(audited, visits).collect()}
    assert "icd_code=A01" in report[1].diagnosis and "icd_code=B02.1" in report[1].diagnosis and report[2].diagnosis == "—"
    assert report[1].formal_structure == "  Formal structure:\n    [PLACEHOLDER] Жалобы"


def test_rules(spark):
    assert spark.createDataFrame([("(F) If it rains: then wet",)], "x string").first().x == spark.range(1).select(rules.rule_line(F.lit("F"), F.lit("If it rains. "), F.lit("then wet")).alias("x")).first().x
    text = "Take 5 mg 3 times a day for 7 days"
    frame = spark.createDataFrame([(text,), ("Take 5 mg",), ("3 раза в день 10 мл 5 дней",)], "t string")
    assert [r.x for r in frame.select(rules.incomplete_prescription(F.col("t")).alias("x")).collect()] == [False, True, False]


def test_layout(spark):
    entries = spark.createDataFrame([("f", 3, 1, "A"), ("f", 3, 2, "B"), ("f", 6, 0, "C")], "file_id string, page int, ord int, title string")
    starts = layout.ordered_entries(entries)
    assert [(r.place, r.start, r.title) for r in starts.orderBy("place").collect()] == [(1, 2, "A"), (2, 2, "B"), (3, 5, "C")]
    pages = spark.createDataFrame([("f", p) for p in range(7)] + [("g", 0)], "file_id string, page int")
    got = {(r.file_id, r.page): r.section for r in layout.section_asof(pages, starts).collect()}
    assert [got["f", p] for p in range(7)] == [None, None, "B", "B", "B", "C", "C"] and got["g", 0] is None
    assert {(r.file_id, r.page) for r in layout.from_first_entry(pages, starts).collect()} == {("f", p) for p in range(2, 7)} | {("g", 0)}


def test_interval_complement(spark):
    spans = spark.createDataFrame([("a", 2, 4), ("a", 3, 6), ("a", 3, 5), ("a", 8, 10), ("b", 0, 10)], "g string, top int, bottom int")
    groups = spark.createDataFrame([("a",), ("b",), ("c",)], "g string")
    got = sorted(tuple(r) for r in layout.interval_complement(spans, ["g"], F.lit(0), F.lit(10), groups).collect())
    assert got == [("a", 0, 2), ("a", 6, 8), ("c", 0, 10)]


def test_batches_and_assembly(spark):
    rows = spark.createDataFrame([("k", i) for i in range(19)], "k string, i int")
    got = layout.row_batches(rows, "k", ["i"]).orderBy("i").collect()
    assert [(r.batch, r.place) for r in got] == [(i // 8, i % 8) for i in range(19)]
    parts = spark.createDataFrame([(1, 2, " b "), (1, 1, "a\n"), (1, 3, " \t"), (2, 1, " ")], "d int, p int, text string")
    assert [tuple(r) for r in layout.assemble(parts, "d", ["p"]).collect()] == [(1, "a\nb")]


def test_scoring_reports_errors_by_row(spark):
    def make():
        def score(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [(t.upper(), "length" if t == "long" else "stop") for t in texts]

        return score

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "long"), (5, "b")], "id int, text string").coalesce(1)
    got = {int(r.id): (r.answer, r.status, r.error) for r in scoring.score_batches(rows, make, "id", batch=3).collect()}
    assert got == {1: ("A", "ok", None), 2: (None, "error", "RuntimeError: no"), 3: (None, "empty", None), 4: ("LONG", "cut", "length"), 5: ("B", "ok", None)}


def test_blocks_of_a_page():
    html = "<html><head><title>T</title><style>x</style></head><body><h1>Head</h1><p>One &amp; <b>two</b></p><script>no()</script><!-- c --><ul><li>a<li>b</ul><table><tr><td>1<td>2</tr></table>tail"
    assert files.blocks_of(html) == [("heading", "h1", "Head"), ("text", "p", "One & two"), ("row", "li", "a"), ("row", "li", "b"), ("row", "tr", "1 2"), ("text", "body", "tail")]
    assert files.blocks_of(None) == []


def test_ingest_pages(spark):
    pages = spark.createDataFrame([(1, "<h1>1.1 Title</h1><p>Some text. More text! And?</p>" + "".join(f"<li>row {i}</li>" for i in range(10))), (2, None)], "page_id long, html string")
    got = ingest.ingest_pages(pages, dimension=16).orderBy("content_type", "chunk_index").collect()
    assert [(r.file_id, r.content_type, r.chunk_index) for r in got] == [("1", "table", 0), ("1", "table", 1), ("1", "text", 0)]
    assert got[2].section == "1.1 Title" and got[2].q.fact.startswith("1.1 Title") and abs(sum(x * x for x in got[2].fact) - 1) < 1e-9


def test_rule_findings_name_conflicts(spark):
    visits = spark.sql(
        """SELECT 1L AS visit, 'g' AS guid, '2024-01-01' AS date, map('name', 'A') AS patient, array(named_struct('name', 'x')) AS services, 'other' AS visit_type,
        array(named_struct('param', 'pulse', 'value', '60'), named_struct('param', 'mood', 'value', 'good'), named_struct('param', 'pulse', 'value', '75'), named_struct('param', 'mood', 'value', 'good'), named_struct('param', 'mood', 'value', NULL)) AS inspection,
        array(named_struct('code', 'A00', 'name', 'n')) AS diagnoses"""
    )
    assert [tuple(f) for f in audit.rule_findings(visits).first().findings] == [("CONFLICT", "pulse")]


def test_every_chunk_of_a_long_document_is_embedded(spark, tmp_path):
    spark.createDataFrame([(1, "s", "One. Two. " * 500), (2, "s", "Short."), (3, "s", "")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ingest_queries.embed_three_chunks(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n, r.fact) for r in got.collect()) == [(1, 0, 64), (1, 1, 64), (1, 2, 64), (2, 0, 64)]


def test_lookup_reaches_all_ids_in_short_lists(spark, tmp_path):
    spark.range(5_000).selectExpr("id AS doc_id", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(5_000).selectExpr("id AS doc_id").write.parquet(str(tmp_path / "labels.parquet"))
    got = search_queries.lookup_in_order_blocks(spark, str(tmp_path)).collect()
    assert max(r.doc_id for r in got) > 4_900 and len({r.ask for r in got}) == 50 and max(r.pos for r in got) < 200
    block = [r.doc_id for r in sorted((r for r in got if r.ask == 7), key=lambda r: r.pos)]
    assert block == [x for i in range(700, 800) for x in (i + i * 37 % 101, i * 2)]


def test_nearest_without_null_or_zero_vectors_and_in_large_corpora(corpus, monkeypatch):
    docs, queries, _ = corpus
    spark = docs.sparkSession
    whole = sorted(tuple(r) for r in retrieval.nearest(queries, docs, 7).collect())
    zero = spark.createDataFrame([(900, "f0", "", "{}", [0.0] * 8), (901, "f0", "", "{}", None)], docs.schema)
    odd = spark.createDataFrame([(7, "x", None, "f0"), (8, "x", [0.0] * 8, "f0")], queries.schema)
    assert sorted(tuple(r) for r in retrieval.nearest(queries.union(odd), docs.union(zero), 7).collect()) == whole
    monkeypatch.setattr(retrieval, "LARGE", 0)
    monkeypatch.setattr(retrieval, "SAMPLE", 3)
    assert sorted(tuple(r) for r in retrieval.nearest(queries, docs, 7).collect()) == whole
    monkeypatch.setattr(retrieval, "QUERIES_A_PASS", 2)
    assert sorted(tuple(r) for r in retrieval.nearest(queries, docs, 7).collect()) == whole
    own = sorted(tuple(r) for r in retrieval.nearest(queries, docs, 7, same_file=True).collect())
    monkeypatch.setattr(retrieval, "QUERIES_A_PASS", 100)
    assert sorted(tuple(r) for r in retrieval.nearest(queries, docs, 7, same_file=True).collect()) == own


def test_rules_of_every_type(spark, tmp_path):
    visits = nested(
        spark,
        [
            (1, "g", "2024-01-01", {"Имя": "A"}, [("Профилактический осмотр",)], [("A01", "cough", None, True)], []),
            (2, "g", "2024-01-01", {"Имя": "A"}, [("Повторный приём",), ("Первичный приём",)], [("R05", "cough", None, True), ("J20", "b", None, None), ("K1", "c", None, None)], [("Лечение", "5 mg"), ("Жалобы", " ")]),
            (3, "g", None, {"Жалобы": "cough"}, [("Первичный приём",)], [], [("Динамика", "-"), ("Контроль", "через неделю")]),
            (4, "g", "2024-01-01", {}, None, None, None),
        ],
    ).withColumn("visit_type", rules.visit_type(F.col("services")))
    path = str(tmp_path / "rules")
    rules.save_rules(rules.default_rules(spark, rules.DEFAULT_RULES + rules.MORE_RULES), path)
    table = rules.load_rules(spark, path)
    assert table.count() == len(rules.DEFAULT_RULES + rules.MORE_RULES)
    got = {r.visit: [tuple(f) for f in r.findings] for r in rules.check_visits(visits, table).collect()}
    assert got[1] == []  # complaints may be missing at a prophylactic visit
    assert got[2] == [("SYMPTOM_CODE", "symptom code beside a main diagnosis"), ("NO_FOLLOW_UP", "follow_up"), ("NO_DYNAMICS", "dynamics, clinical_context"), ("SERVICE_MISMATCH", "repeat, primary"), ("INCOMPLETE_PRESCRIPTION", "Лечение")]
    assert got[3] == [("MISSING_META", "date"), ("MISSING_CORE", "diagnosis"), ("MISSING_DIAGNOSIS", "diagnosis"), ("PLACEHOLDER", "Динамика")]
    assert {f for f, _ in got[4]} >= {"MISSING_META", "MISSING_DIAGNOSIS"}
    assert [r.flag_code for r in rules.model_rules(table).collect()] == ["NOT_SUPPORTED"]
    assert rules.check_visits(visits, table.limit(0)).where("size(findings) > 0").count() == 0


def test_three_checkers_search_their_sections(spark):
    visits = nested(spark, [(1, "G1", "2024-01-01", {"Имя": "A"}, [("Первичный приём",)], [("A01", "cough", None, True), ("Z9", "none", None, None)], [("Жалобы", "cough")]), (2, "G2", "2024-01-01", {}, [], None, [])])
    manifest = spark.createDataFrame([("g1", "acute", "A01", 1)], "id string, name string, codes string, pos int")
    docs = spark.createDataFrame(
        [(1, "g1", "Cough for a week", '{"section":"Жалобы"}', [1.0, 0.0]), (2, "g1", "Look at the throat", '{"section":"Исследования"}', [0.0, 1.0]), (3, "g2", "cough", '{"section":"Лечение"}', [1.0, 0.0])],
        "doc_id long, file_id string, chunk string, metadata string, fact_vec array<double>",
    )
    embed = lambda cases: cases.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))
    done = spark.createDataFrame([], "guid string")

    def broken():
        def score(texts):
            if any("inspection" in t.split("\n")[0] for t in texts):
                raise RuntimeError("down")
            return [('[{"issue":"%d","sources":[]}]' % ("Имя" in t), "stop") for t in texts]

        return score

    got = {r.visit: r for r in audit.audit_visits(visits, manifest, done, docs=docs, embed=embed).collect()}
    first, second = got[1].results
    assert ([i.issue for i in first.anamnesis], [i.issue for i in first.inspection], [i.issue for i in first.treatment]) == ([], ["not mentioned: cough"], ["no text of the section"])
    assert (second.guideline_id, second.anamnesis, second.inspection, second.treatment) == (None, [], [], [])
    assert got[1].errors == [] and got[2].errors == ["no diagnoses", "no service"]
    for per_visit in (False, True):
        own = {r.visit: r for r in audit.audit_visits(visits, manifest, done, docs=docs, embed=embed, make_checker=broken, per_visit=per_visit).collect()}
        assert own[1].errors == ["inspection: RuntimeError: down"] and [i.issue for i in own[1].results[0].treatment] == [str(int(per_visit))]


def test_sections_by_lines(spark):
    texts = ["pre\n1.1 One\nbody\n1.2 .... 7\nlost\n2.10 Two. x\n\nmore\n", "no sections", "1.1 ...... 3\nx", "1.1\nTitle\ntext", "", None, "a 1.1 b\n 1.2 c"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from auditmill.functions import text

    got = {r.i: r.s and [tuple(x) for x in r.s] for r in frame.select("i", text.split_sections(F.col("t")).alias("s")).collect()}
    assert got[0] == [("1.1 One", "1.1 One\nbody"), ("2.10 Two. x", "2.10 Two. x\n\nmore")]
    assert got[1] == [(None, "no sections")] and got[2] == [(None, texts[2])] and got[3] == [("1.1\nTitle", texts[3])] and got[4] == [(None, "")] and got[6] == [(None, texts[6])]


def test_incremental_audit_knows_visits_again(spark, tmp_path):
    from auditmill.streaming.incremental import audit_new

    schema = "guid string, n int"
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(paths[0])
    run = lambda: audit_new(spark, paths[0], schema, paths[1], paths[2], lambda b: b)
    put([("ABCD", 1), ("abcd", 1), ("", 2), ("", 2), (" ", 3), (None, 2), (None, 4)])
    run()
    assert spark.read.parquet(paths[1]).count() == 6
    put([("AbCd", 9), ("new", 5), (None, 4)])
    for _ in range(2):
        run()
    got = sorted((r.guid or "", r.n) for r in spark.read.parquet(paths[1]).collect())
    assert got == [("", 2), ("", 2), ("", 2), ("", 4), ("", 4), (" ", 3), ("ABCD", 1), ("new", 5)] or got == [("", 2), ("", 2), ("", 2), ("", 4), ("", 4), (" ", 3), ("abcd", 1), ("new", 5)]
    # A batch that is run again (its offsets are known, its commit is not) adds nothing.
    import glob
    import os

    last = max(glob.glob(paths[2] + "/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    if os.path.exists(crc := os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        os.remove(crc)
    run()
    assert sorted((r.guid or "", r.n) for r in spark.read.parquet(paths[1]).collect()) == got


def test_embedders_of_any_provider(spark):
    def make():
        def embed(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[float(len(t)), 0.0] if t != "short" else [1.0] for t in texts]

        return embed

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "short")], "id long, text string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in scoring.embed_batches(rows, make, "id", 2).collect()}
    assert got[1] == ([1.0, 0.0], None) and got[2] == (None, "RuntimeError: no") and got[3] == (None, None) and got[4][0] is None and "2 numbers" in got[4][1]


@pytest.mark.parametrize("buckets", [1, 2, 4096])
def test_files_are_replaced_and_deleted_as_a_whole(spark, tmp_path, monkeypatch, buckets):
    monkeypatch.setattr(files, "BUCKETS", buckets)
    path = str(tmp_path / "docs")
    rows = lambda found: sorted(((r.file_id or "", r.chunk) for r in found.select("file_id", "chunk").collect()))
    files.write_docs(spark.createDataFrame([("a b", "x"), ("a b", "y"), ("c", "z"), (None, "n"), ("d", None)], "file_id string, chunk string").where("chunk IS NOT NULL"), path)
    assert len(list((tmp_path / "docs").glob("bucket=*"))) <= min(buckets, 3)
    files.write_docs(spark.createDataFrame([("a b", "new", 1), (None, "m", 2)], "file_id string, chunk string, page int"), path)
    assert rows(files.read_docs(spark, path)) == [("", "m"), ("a b", "new"), ("c", "z")]
    assert rows(files.read_docs(spark, path, "c")) == [("c", "z")] and "bucket" not in files.read_docs(spark, path).columns
    files.write_docs(spark.createDataFrame([], "file_id string, chunk string"), path)
    assert files.delete_file(spark, path, "a b") == 1 and files.delete_file(spark, path, "no") == 0
    assert rows(files.read_docs(spark, path)) == [("", "m"), ("c", "z")]
    assert files.delete_file(spark, path, "c") == 1 and rows(files.read_docs(spark, path)) == [("", "m")]


def test_a_file_is_looked_up_and_deleted_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_docs(spark.range(3000).select((F.col("id") % 40).cast("string").alias("file_id"), F.col("id").cast("string").alias("chunk")), path)
    scans = lambda found: found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scans(files.read_docs(spark, path, "7"))
    folder = f"{path}/bucket={files._bucket_of(spark, '7')}"
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "docs").glob("bucket=*/*.parquet") if not str(p).startswith(folder + "/")}
    assert files.delete_file(spark, path, "7") == 75
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "docs").glob("bucket=*/*.parquet") if not str(p).startswith(folder + "/")}
    assert before == after and files.read_docs(spark, path).count() == 2925


def test_ingest_from_manifest_to_summary(spark, tmp_path):
    folder = str(tmp_path / "ingest")
    page = "<p>cut</p><p>ANCHOR</p><p>front</p><p>ANCHOR</p><h1>1.1 Title</h1><p>Some text. More.</p>" + "".join(f"<li>row {i}</li>" for i in range(9))
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>Plain.</p>")], "page_id long, html string")
    manifest = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three"), ("9", "gone")], "id string, name string")
    total, missing = ingest.ingest(manifest.where("id <> '3'"), pages, folder, "r1", anchor="ANCHOR", dimension=8)
    assert sorted((r.file_id or "", r.inserted, r.failed) for r in total.collect()) == [("", 3, 0), ("1", 3, 0), ("2", 0, 0)] and [r.id for r in missing.collect()] == ["9"]
    docs = spark.read.parquet(f"{folder}/docs").where("content_type = 'text'").collect()
    assert [d.chunk for d in docs] == ["1.1 Title\nSome text. More."] and '"name":"one"' in docs[0].metadata and '"section":"1.1 Title"' in docs[0].metadata
    assert sorted(r.id for r in ingest.done_files(spark, folder).collect()) == ["1", "2"]
    for run in ("r2", "r2"):
        total, _ = ingest.ingest(manifest, pages, folder, run, dimension=8)
    assert {str(r.file_id) for r in spark.read.parquet(f"{folder}/docs").select("file_id").distinct().collect()} == {"1", "3"}
    assert sorted(r.id for r in ingest.done_files(spark, folder).collect()) == ["1", "2", "3"]


def test_a_hot_key_lies_in_many_slices(spark, monkeypatch):
    """One key has most of the rows: it is dealt over the slices, and numbers, sections and gaps are those of one sort."""
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(3000), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "file_id string, page int, ord long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        held = layout._slices(frame, ["file_id"], ["page", "ord"])
        sizes = [r["count"] for r in held.where("file_id = 'hot'").groupBy("_slice").count().collect()]
        assert len(sizes) >= 8 and max(sizes) <= 4000 / 16 * 3
        got = {r.ord: r.n for r in layout.numbered(frame, ["file_id"], ["page", "ord"], "n").collect()}
        for key in ("hot", "a", "b", None):
            own = sorted((p, o) for k, p, o in rows if k == key)
            assert [got[o] for _, o in own] == list(range(len(own)))
        entries = frame.where("ord % 50 = 0").select("file_id", F.col("page").alias("start"), "ord", F.concat(F.lit("T"), "ord").alias("title"))
        found = {r.ord: r.section for r in layout.section_asof(frame, entries).collect()}
        for key, page, n in rows:
            before = [(p, o) for k, p, o in rows if k == key and o % 50 == 0 and p <= page]
            assert found[n] == (f"T{max(before)[1]}" if before else None)
        spans = frame.where("file_id IS NOT NULL").select("file_id", (F.col("page") * 3).alias("top"), (F.col("page") * 3 + F.col("ord") % 5).alias("bottom"))
        gaps = sorted(tuple(r) for r in layout.interval_complement(spans, ["file_id"], F.lit(0), F.lit(9100), spans.select("file_id").distinct()).collect())
        want = []
        for key in ("a", "b", "hot"):
            at = 0
            for top, bottom in [*sorted((p * 3, p * 3 + o % 5) for k, p, o in rows if k == key), (9100, 9100)]:
                want += [(key, at, top)] if top > at else []
                at = max(at, bottom)
        assert gaps == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tables_of_a_page():
    html = """<h1>A</h1><p>x</p><table><tr><th>k</th><th colspan=2>v</th><th></th></tr><tr><td rowspan="2">1<td>a<td><p>b</p><ul><li>c</li></ul></td></tr><tr><td>d</td></tr></table>
      <h2>B</h2><table><tr><td>only</td></tr></table><table></table><div><table><thead><tr><th>o</th></tr></thead><tbody><tr><td>out<table><tr><td>in</td></tr><tr><td>7</td></tr></table></td><td>more</td></tr></tbody></table></div>"""
    assert files.tables_of(html) == [
        (0, 1, [{"k": "1", "v": "a", "v.1": "b c", "Unnamed: 3": ""}, {"k": "1", "v": "d", "v.1": "", "Unnamed: 3": ""}]),
        (1, 2, []), (2, 2, []), (3, 2, [{"o": "out", "Unnamed: 1": "more"}]), (4, 2, [{"in": "7"}]),
    ]
    assert files.tables_of(None) == [] and files.tables_of('<table><tr><td rowspan="x">a</table><td>') == [(0, 0, [])]
    assert [b for b in files.blocks_of(html) if b[0] in ("text", "heading")] == [("heading", "h1", "A"), ("text", "p", "x"), ("heading", "h2", "B")]


def test_tables_are_chunks_with_their_columns_and_section(spark):
    row = "".join(f"<tr><td>{i}</td><td><p>name {i}.</p></td></tr>" for i in range(10))
    page = f"<h1>1.1 Title</h1><p>Before.</p><h2>Doses</h2><table><tr><th>n</th><th>name</th></tr>{row}</table><h2>End</h2><p>After.</p><ul><li>item</li></ul>"
    chunks = ingest.ingest_pages(spark.createDataFrame([(1, page), (2, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>")], "page_id long, html string"), dimension=8).collect()
    got = {(r.file_id, r.content_type, r.table_index, r.chunk_index): (r.section, r.chunk) for r in chunks}
    assert len(got) == len(chunks)
    record = lambda i: '{"n": "%d", "name": "name %d."}' % (i, i)
    assert got == {
        ("1", "text", -1, 0): ("1.1 Title", "1.1 Title\nBefore.\nDoses\nEnd\nAfter."), ("1", "table", -1, 0): (None, '[{"text":"item"}]'), ("2", "table", 0, 0): (None, '[{"a": "b"}]'),
        ("1", "table", 0, 0): ("Doses", "[" + ", ".join(map(record, range(8))) + "]"), ("1", "table", 0, 1): ("Doses", "[" + ", ".join(map(record, (8, 9))) + "]"),
    }


def test_offline_checker_keeps_a_checkers_last_texts(monkeypatch):
    """Prompts of one context are judged without lowering its texts again; another context's are not mixed up with them."""
    judge, lowered = checks.offline_checker(), []

    class Text(str):
        def __getitem__(self, at):
            return Text(super().__getitem__(at))

        def lower(self):
            lowered.append(self)
            return super().lower()

    record = lambda name: f"Имя: P\nГруппа: G\n\nНаименование МКБ: {name}\n"
    prompts = [Text(checks._prompt(k, record(name), section, "all")) for section in ("Hot RING", "cold", render.NOTHING_FOUND) for name in ("ring", "bolt") for k in checks.SECTIONS]
    want = {"Hot RING": {"ring": [], "bolt": ["not mentioned: bolt (G)"]}, "cold": {n: [f"not mentioned: {n} (G)"] for n in ("ring", "bolt")}}
    said = [[i["issue"] for i in json.loads(a)] for a, _ in judge(prompts)]
    assert said == [want.get(s, {}).get(n, ["no text of the section"]) for s in ("Hot RING", "cold", render.NOTHING_FOUND) for n in ("ring", "bolt") for _ in checks.SECTIONS]
    assert sum(s in ("Hot RING", "cold") for s in lowered) == 6 and not any("all" in s for s in lowered)
    # The digest of a message is made once for all kinds.
    told = hashlib.sha256(b"m").hexdigest()
    assert answers.prompt_id("k", "d", told) == hashlib.sha256(f"1:k1:d64:{told}".encode()).hexdigest()


def test_a_second_audit_scores_nothing(spark, tmp_path):
    """Two visits of one diagnosis are judged each by its own record; answers are kept by content, failures are not."""
    visits = nested(
        spark,
        [(n, f"G{n}", "2024-01-01", {"Имя": f"P{n}"}, [("Первичный приём",)], [("A01", "cough", None, True)] * (1 + n % 2), [("Жалобы", "cough")]) for n in range(6)]
        + [(9, "G9", "2024-01-01", {"Имя": "P1"}, [("Первичный приём",)], [("A01", "cough", None, True)] * 2, [("Жалобы", "cough")])],
    )
    manifest = spark.createDataFrame([("g1", "acute", "A01", 1)], "id string, name string, codes string, pos int")
    docs = spark.createDataFrame([(1, "g1", "Cough", '{"section":"Жалобы"}', [1.0, 0.0])], "doc_id long, file_id string, chunk string, metadata string, fact_vec array<double>")
    embed = lambda cases: cases.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))
    listed = rules.default_rules(spark, rules.DEFAULT_RULES + rules.MORE_RULES)
    log, store = str(tmp_path / "asked"), str(tmp_path / "answers")

    def counting(kind, answer, broken=""):
        def make():
            def score(texts):
                with open(log, "a") as f:
                    f.writelines(f"{kind}\n" for t in texts)
                if broken and any(broken in t for t in texts):
                    raise RuntimeError("down")
                return [(answer(t), "stop") for t in texts]

            return score

        return make

    def run(broken=""):
        open(log, "w").close()
        checker = counting("check", lambda t: '[{"issue":"%s"}]' % next(x for x in t.split("\n") if x.startswith("Имя")), broken)
        judge = counting("rules", lambda t: '```json\n[{"flag":"OTHER","issue":"o"},{"flag":"NOT_SUPPORTED","issue":"%s"}]\n```' % ("P1" in t))
        audited = audit.audit_visits(visits, manifest, spark.createDataFrame([], "guid string"), listed=listed, docs=docs, embed=embed, make_checker=checker, make_rule_checker=judge, answers=store)
        found = {r.visit: r for r in audited.collect()}
        with open(log) as f:
            asked = f.read().split()
        return found, asked.count("check"), asked.count("rules")

    found, _, rules_made = run("P5")
    assert found[5].errors and all(e.endswith("RuntimeError: down") for e in found[5].errors) and not found[4].errors
    assert rules_made == 6  # one visit is another's copy but for its number
    found, again, rules_again = run()
    assert again == 3 and rules_again == 0 and not found[5].errors
    found, again, rules_again = run()
    assert (again, rules_again) == (0, 0)
    for n, r in found.items():
        assert [[i.issue for i in x.anamnesis] for x in r.results] == [[f"Имя: P{1 if n == 9 else n}"]] * len(r.results)
        said = [tuple(f) for f in r.findings if f.flag in ("OTHER", "NOT_SUPPORTED")]
        assert said == [("NOT_SUPPORTED", str(n in (1, 9))), ("OTHER", "o")]


def test_choice_from_lists_with_run_offs(spark):
    rows = [("a", "X1", "long", f"g{i:02}", f"name {i}", i) for i in range(45)] + [("b", "X2", None, "h1", "other\tname", 1), ("c", "X3", "none", "h1", "x", 1), ("d", "X4", "odd", "h1", "x", 1)]
    frame = spark.createDataFrame(rows, "dx string, code string, name string, id string, guideline string, pos int")
    asked = []

    def make():
        def score(texts):
            out = []
            for t in texts:
                head, offered = t.split("\n## Guidelines\n")
                ids = [line.split("\t")[0] for line in offered.split("\n")]
                assert len(ids) <= 4
                out.append((' "' + max(ids) + '"\n' if "none" != head.split("\n")[-1] and "odd" not in head else "zzz" if "odd" in head else "none", "stop"))
            return out

        return score

    got = {r.dx: (r.id, r.guideline) for r in codes.listwise(make, 4)(frame, "dx").collect()}
    assert got == {"a": ("g44", "name 44"), "b": ("h1", "other\tname")} and not asked
    manifest = frame.where("dx <> 'a'").select("id", F.col("guideline").alias("name"), F.col("code").alias("codes"), "pos").unionByName(frame.where("dx <> 'a'").select(F.concat("id", F.lit("b")).alias("id"), F.lit("y").alias("name"), F.col("code").alias("codes"), "pos"))
    wanted = spark.createDataFrame([("b", "X2", None), ("c", "X3", "none"), ("d", "X4", "odd"), ("e", "X4.1", "odd")], "dx string, code string, name string")
    tiers = {r.dx: (r.guideline_id, r.tier) for r in codes.resolve(wanted, manifest, "dx", scorer=codes.listwise(make, 4)).collect()}
    assert tiers == {"b": ("h1b", "exact_scored"), "c": (None, "exact_scored"), "d": (None, "exact_scored"), "e": (None, "prefix_scored")}


def test_periods_read_their_months_only(spark, tmp_path):
    path = str(tmp_path / "landed")
    days = spark.sql("SELECT id, date_add(DATE '1996-01-01', CAST(id % 366 AS INT)) AS d FROM range(3000)")
    files.land_by_month(days, "d", path)
    got = files.read_period(spark, path, "d", "25.02.1996", "03.03.1996")
    assert sorted(r.id for r in got.collect()) == sorted(i for i in range(3000) if 55 <= i % 366 <= 62)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    got.collect()
    assert 0 < scan.metrics().apply("numOutputRows").value() <= sum(31 <= i % 366 < 91 for i in range(3000))  # the two months' rows at most
    # A month that is landed again is replaced, the others stay.
    files.land_by_month(days.where("month(d) = 2 AND id < 100"), "d", path)
    assert spark.read.parquet(path).where("month = '1996-02'").count() == sum(31 <= i < 60 for i in range(100)) and spark.read.parquet(path).count() > 2500


def test_lookups_skip_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "lookup")
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("guid"), F.lit("x" * 50).alias("text"))
    files.land_for_lookups(rows, path, "doc_id", "guid", group_bytes=100_000)
    groups = 0
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
    assert groups > 8
    guid = rows.where("doc_id = 777").first().guid
    for where, at_most in ((f"guid = '{guid}'", 3), ("doc_id = 777", 1)):
        found = spark.read.parquet(path).where(where)
        assert [r.doc_id for r in found.collect()] == [777]
        plan = found._jdf.queryExecution().executedPlan()
        scan = next(p for p in [plan.collectLeaves().apply(0)])
        assert "PushedFilters: [IsNotNull" in plan.toString() and scan.metrics().apply("numOutputRows").value() < 50_000 / groups * (at_most + 2)


def test_key_log_stays_small_and_survives_a_broken_merge(spark, tmp_path, monkeypatch):
    import os

    from auditmill.streaming import keylog

    monkeypatch.setattr(keylog, "FAN", 3)
    monkeypatch.setattr(keylog, "PARTS", 4)
    log = keylog.KeyLog(spark, str(tmp_path / "keys"))
    batch = lambda n: spark.createDataFrame([(f"k{n}-{i}",) for i in range(5)] + [("again",)], "key string").withColumn("part", keylog.part_of("key")).coalesce(1)
    dropped = keylog.KeyLog.drop
    for n in range(30):
        if n == 9:  # the merge is written, then the batch breaks off before all its sources are gone
            monkeypatch.setattr(keylog.KeyLog, "drop", lambda self, run: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                log.compact("b9")
            assert {r.key for r in log.known([0, 1, 2, 3], "b9").collect()} == {"again", *(f"k{b}-{i}" for b in range(9) for i in range(5))}
            monkeypatch.setattr(keylog.KeyLog, "drop", dropped)
        for _ in range(2 if n % 7 == 0 else 1):  # some batches are run again: their own keys are not known to them
            log.compact(f"b{n}")
            assert log.known([0, 1, 2, 3], f"b{n}").where(f"key LIKE 'k{n}-%'").isEmpty()
            log.add(batch(n), f"b{n}")
        assert all(sum(level == x for level, _ in log.runs()) <= 3 for x in range(4))
    assert {r.key for r in log.known([0, 1, 2, 3], "none").collect()} == {"again", *(f"k{b}-{i}" for b in range(30) for i in range(5))}
    assert max(level for level, _ in log.runs()) == 3
    files_left = sum(f.endswith(".parquet") for _, _, names in os.walk(tmp_path / "keys") for f in names)
    assert files_left <= 3 + 3 * 3 * 4
    one = log.known([2], "none")
    assert {r.part for r in one.withColumn("part", keylog.part_of("key")).select("part").distinct().collect()} == {2}


def test_free_json_renders_without_a_schema(spark):
    import json

    from auditmill.functions import render

    def lines(value, indent=0):
        pad = "  " * indent
        scalar = lambda x: "—" if x is None else ("да" if x else "нет") if isinstance(x, bool) else str(x)
        if not isinstance(value, dict | list):
            return [pad + scalar(value)]
        if not value:
            return [pad + "—"]
        out = []
        for label, x in [(f"{k}:", v) for k, v in value.items()] if isinstance(value, dict) else [(f"{n}.", v) for n, v in enumerate(value, 1)]:
            out += [pad + label, *lines(x, indent + 1)] if isinstance(x, dict | list) else [f"{pad}{label} {scalar(x)}"]
        return out

    values = [
        {"z": 1, "a": {"y": [1, [2, {"q": None}], []], "b": {}}, "t": True, "f": False, "n": None, "s": "true", "e": "", "o": "{not json", "l": "[1]"},
        [], {}, [[["deep"]]], 5, "text", None, True, [None, False, "x\ny"], {"k.1": {"k 2": [{"é": 1.5}, {"é": -2}]}}, {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}},
    ]
    rows = [(n, json.dumps(v, ensure_ascii=False)) for n, v in enumerate(values)]
    got = {r.i: r.text for r in render.format_json(spark.createDataFrame(rows, "i int, j string"), "i", "j").collect()}
    for n, v in enumerate(values):
        assert got[n] == (json.dumps(v) if isinstance(v, str) else "\n".join(lines(v)))


def test_blocks_that_no_query_needs_are_skipped(spark, tmp_path, monkeypatch):
    from auditmill.operators import vector_blocks

    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(30, 16))
    rows = [(i, (points[i % 30] + rng.normal(size=16) * 0.05).tolist()) for i in range(3000)] + [(9000, [0.0] * 16), (9001, None)]
    rows += [(9100 + i, rows[7][1]) for i in range(30)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, fact_vec array<double>").repartition(5)
    asked = [(q, (points[q % 30] + rng.normal(size=16) * 0.05).tolist()) for q in range(6)] + [(50, [0.0] * 16), (51, None), (52, rows[7][1])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    path = str(tmp_path / "vectors")
    vector_blocks.build(docs, path)
    index = spark.read.schema(vector_blocks.INDEX).parquet(path)
    assert index.selectExpr("sum(size(ids))").first()[0] == 3030
    for k in (5, 40):
        want = sorted(tuple(r) for r in retrieval.nearest(queries, docs, k).collect())
        assert sorted(tuple(r) for r in vector_blocks.nearest_in_blocks(spark, queries, path, k).collect()) == want
    bounds = {r.query_id: r.distance for r in retrieval.nearest(queries, docs, 5).where("vector_rank = 5").collect()}
    known = vector_blocks._Asked([r for r in queries.collect() if r.query_id in bounds], bounds)
    assert 0 < vector_blocks.needed_blocks(index, known).count() < index.count() / 2
    monkeypatch.setattr(vector_blocks, "QUERIES_A_PASS", 3)
    assert sorted(tuple(r) for r in vector_blocks.nearest_in_blocks(spark, queries, path, 40).collect()) == want
    nothing = str(tmp_path / "none")
    vector_blocks.build(docs.limit(0), nothing)
    assert vector_blocks.nearest_in_blocks(spark, queries, nothing, 3).collect() == []
