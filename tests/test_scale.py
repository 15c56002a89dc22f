"""Copies of the tables with other keys: what depends on content only is not made again for them."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

import pyarrow as pa
import pytest
from auditmill.functions import render, text
from auditmill.operators import answers, audit, checks, ingest, rules
from auditmill.plans import views, visit_queries
from auditmill.sources import files, scratch
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def copied(spark, tmp_path, name: str, key: str, times: int) -> str:
    """A folder with the tables of SF, of which one stands there several times with shifted keys."""
    for table in os.listdir(SF):
        if table != f"{name}.parquet":
            os.symlink(f"{SF}/{table}", tmp_path / table)
    rows = views.table(spark, SF, name)
    shift = -(-(rows.agg(F.max(key) + 1).first()[0]) // 420) * 420  # keeps the remainders that the views look at
    rows.crossJoin(spark.range(times).withColumnRenamed("id", "_n")).withColumn(key, F.col(key) + F.col("_n") * shift).drop("_n").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_equal_diagnoses_are_searched_once_and_texts_stand_once(spark, tmp_path, monkeypatch):
    seen, made = [], checks.contexts

    def contexts(cases, *rest):
        found = made(cases, *rest)
        seen.append((cases.count(), found.where("text IS NOT NULL").count(), found.where("text IS NOT NULL").select("doc_id").distinct().count()))
        return found

    monkeypatch.setattr(checks, "contexts", contexts)
    once = sorted(map(tuple, visit_queries.check_diagnosis(spark, SF).collect()))
    twice = sorted(map(tuple, visit_queries.check_diagnosis(spark, copied(spark, tmp_path, "part", "p_partkey", 2)).collect()))
    assert seen[0][0] == seen[1][0] and all(n == distinct for _, n, distinct in seen)
    assert len(twice) == 2 * len(once) and [r[1:] for r in twice[: len(once)]] == [r[1:] for r in once]


def test_table_chunks_read_a_page_once_and_shuffle_nothing(spark):
    page = "<h1>A</h1><h2> </h2><ul><li>x\"</li><li>й</li></ul><h2>B</h2><table><tr><th>k</th></tr>" + "".join(f"<tr><td>{n}</td></tr>" for n in range(10)) + "</table>"
    made = ingest.table_chunks(spark.createDataFrame([(1, page), (2, "<table><tr><th>k</th></tr><tr><td>v</td></tr></table>"), (3, None)], "page_id long, html string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInPandas") == 1
    got = sorted(tuple("~" if v is None else v for v in r) for r in made.collect())
    batch = lambda first, last: "[" + ", ".join(f'{{"k": "{n}"}}' for n in range(first, last)) + "]"
    assert got == [(1, -1, 0, "~", '[{"text":"x\\""},{"text":"й"}]'), (1, 0, 0, "B", batch(0, 8)), (1, 0, 1, "B", batch(8, 10)), (2, 0, 0, "~", '[{"k": "v"}]')]


def test_findings_are_made_once_for_a_visit(spark):
    """What is blank and what predicates find stands below the join with the rules, and nothing filters by ``findings``."""
    for query in (visit_queries.check_rules, visit_queries.check_rules_table, visit_queries.check_rules_scored):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("map_from_arrays") == 1
        assert plan.index("LeftOuter") < plan.index("map_from_arrays")


def test_exceptions_and_targets_are_sorted_out_once_for_a_type(spark):
    kinds = (["all"], ["general"], "any")
    rows = [(0, "a", "h", "required_field", kinds, ["date", "dynamics", "results"], None, "", "R", ""), (1, "b", "h", "conditional_required", kinds, ["dynamics", "results"], None, "", "C", ""),
            (2, "c", "h", "allowed_missing", kinds, ["results"], None, "", "A", ""), (3, "d", "h", "structure_defect", kinds, None, None, "", "DUPLICATE_SEMANTIC_BLOCK", ""),
            (4, "e", "h", "conditional_required", kinds, ["dynamics", "state"], None, "", "D", "")]
    visits = views.visits(spark, SF).withColumn("visit_type", rules.visit_type(F.col("services")))
    found = rules.check_visits(visits, spark.createDataFrame(rows, "pos int, " + rules.RULE)).orderBy("visit").collect()
    assert all([tuple(f) for f in r.findings if f.flag in "RCAD"] == [("R", "dynamics"), ("D", "dynamics, state")] for r in found)
    assert sum(f.flag == "DUPLICATE_SEMANTIC_BLOCK" for r in found for f in r.findings) == sum(r.flag == "CONFLICT" for r in visit_queries.check_rules_conflicts(spark, SF).collect()) > 0


def test_prompts_are_shuffled_once_and_equal_ones_scored_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def score(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            if "t3" in texts:
                raise RuntimeError("down")
            return [(t.upper(), "length" if t == "t4" else "stop") for t in texts]

        return score

    def run(store, n):
        open(log, "w").close()
        prompts = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("id")).withColumn("text", F.concat(F.lit("t"), "id"))
        made = answers.score_each(prompts, make, ["k"], store)
        got = {r.k: tuple(r)[1:] for r in made.collect()}
        assert len(got) == n and all(got[k] == (("T" + str(k % 7), "cut" if k % 7 == 4 else "ok", "length" if k % 7 == 4 else None) if k % 7 != 3 else (None, "error", "RuntimeError: down")) for k in got)
        with open(log) as f:
            return made, set(f.read().split())

    made, asked = run(None, 30_000)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and asked == {f"t{n}" for n in range(7)}
    store = str(tmp_path / "answers")
    assert run(store, 5)[1] == {f"t{n}" for n in range(5)}
    assert run(store, 50)[1] == {"t3", "t5", "t6"}


def test_plain_pages_are_read_as_the_parser_reads_them(monkeypatch):
    class Record(files._Parser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.seen = []

        def handle_starttag(self, tag, attrs):
            self.seen.append((tag, attrs))

        def handle_endtag(self, tag):
            self.seen.append(("/", tag))

        def handle_data(self, data):
            self.seen.append(("=", data))

    plain = '<H1>A</H1>\n<p Class="x">b > c</p><table><tr><td rowspan="2"\n colspan="3">й</td></tr></table>'
    odd = ["<td a=\"1\">x", "<p a>x", "<!-- <p> -->x", "a &amp; b", "<script><p></script>", "<title><p></title>", "<br/>x", "<p a=\"1\"b=\"2\">x", "<", "</p", "<p>\0"]
    for page in [plain, *odd]:
        whole, mine = Record(), Record()
        whole.feed(page)
        whole.close()
        files._read(mine, page)
        assert mine.seen == whole.seen, page
    monkeypatch.setattr(files._Parser, "feed", lambda *_: pytest.fail("a plain page is fed to the parser"))
    assert files.tables_of(plain + "<table><tr><th>k</th></tr><tr><td>v</td></tr></table>")[1] == (1, 1, [{"k": "v"}])


def test_many_columns_of_one_name():
    names = list(files.tables_of("<table><tr>" + '<th colspan="1000">k</th>' * 3 + "<th>k.1</th></tr><tr><td>v</td></tr></table>")[0][2][0])
    assert names == ["k", *[f"k.{n}" for n in range(1, 3000)], "k.1.1"]


def test_plain_json_is_rendered_in_one_pass_as_level_by_level(spark, monkeypatch):
    texts = [
        '{"a":1,"b":[true,null,{"c":"x\\ny"}],"d":{},"e":[]}', "[]", "{}", "[[[]]]", "true", "null", '"s"', "5", None, "", " ", "{", "[1,]", '{"a":1,"a":2}', '{"a":1.50,"b":1e3}', "[NaN]", "[-0]", "[1] x",
        '[12345678901234567890]', '["\\u00e9"]', " [ 1 , -2 ] ", '{"":"","é":"\\/"}', "{'a':1}", '["a\tb"]', "[01]", "[" * 60 + "]" * 60, '{"k":{"k":false}}', '["{", "[1]", "null", "true"]', "\ufeff[1]",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    both = [{r.i: r.text for r in f(rows, "i", "j").collect()} for f in (render.format_json, render._json_levels)]
    assert both[0] == both[1] and len(both[0]) == len(texts)
    monkeypatch.setattr(render, "_json_levels", lambda *_: pytest.fail("plain texts are opened level by level"))
    made = render.format_json(rows.where("i < 4"), "i", "j")
    assert made.count() == 4 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_shuffled_again_to_be_grouped_by_visit(spark):
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    lines = views.visit_lines(spark, SF)
    assert exchanges(lines.groupBy("visit").agg(F.collect_list("code"))) == exchanges(lines)


def test_stripped_takes_white_space_of_every_kind_without_a_pattern(spark):
    kinds = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    rows = spark.createDataFrame([(c + " a" + c + "b\n" + c,) for c in kinds] + [(c,) for c in kinds] + [(None,)], "t string")
    assert rows.where(~text.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in rows.select(text.stripped(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def left():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(n).getName() for n in range(held.size()) if held.apply(n).getName().startswith("shuffle")}

    rows, before = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), left()
    made = scratch.stored(rows.join(rows.withColumnRenamed("count", "n"), "k"), "counts")
    assert not left() - before
    assert made.count() == 7 and rows.count() == 7


def test_rows_that_meet_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(answers, "ROWS", 10)
    rows = spark.createDataFrame([(k, n) for k, many in (("a", 95), ("b", 3), (None, 2)) for n in range(many)], "k string, n long")
    held = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, t long")
    show = lambda rows, texts: pa.table({"n": rows.column("n"), "t": pa.array([texts.column("t").to_pylist()[0]] * len(rows)), "all": pa.array([len(rows)] * len(rows))})
    width = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = answers.with_texts(rows, held, "k", F.col("n"), show, "n long, t long, all long")
        assert made._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1  # of what is held
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", width)
    assert sorted((r.n, r.t) for r in got) == sorted([(n, 1) for n in range(95)] + [(n, 2) for n in range(3)])
    assert max(r["all"] for r in got if r.t == 1) < 40


def test_a_pass_reads_its_own_lines(spark):
    """The condition of a pass stands at the files of orders and lines, below every shuffle."""
    own = views.visits(spark, SF).where(F.pmod(F.xxhash64("visit"), F.lit(3)) == 1)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert [sum(f"xxhash64({key}" in line for line in plan.split("\n")) for key in ("o_orderkey", "l_orderkey")] == [1, 1]


def test_an_audit_in_passes_is_that_of_one_pass(spark, tmp_path, monkeypatch):
    """Equal prompts are scored once whatever pass their visits are made in, and only results stay."""
    record = lambda n: ({"Имя": f"P{n % 7}"}, [("Первичный приём",)], [("A01", "cough", None, True), ("Z9", None, None, None)][: n % 3], [("Жалобы", f"c{n % 7}")])
    visits = spark.createDataFrame(
        [(n if n % 9 else None, f"G{n}", "2024-01-01", *record(n)) for n in range(40)] + [(99, None, None, None, None, None, None)],
        "visit long, guid string, date string, patient map<string,string>, services array<struct<name:string>>, "
        "diagnoses array<struct<code:string,name:string,detail:string,first_time:boolean>>, inspection array<struct<param:string,value:string>>",
    )
    manifest = spark.createDataFrame([("g1", "acute", "A01", 1)], "id string, name string, codes string, pos int")
    docs = spark.createDataFrame([(1, "g1", "Cough", '{"section":"Жалобы"}', [1.0, 0.0])], "doc_id long, file_id string, chunk string, metadata string, fact_vec array<double>")
    log = str(tmp_path / "asked")

    def make():
        def score(texts):
            with open(log, "a") as f:
                f.writelines(hashlib.md5(t.encode()).hexdigest() + "\n" for t in texts)
            return [('[{"flag":"OTHER","issue":"%d"}]' % len(t), "stop") for t in texts]

        return score

    def run(**options):
        open(log, "w").close()
        folder = tempfile.mkdtemp(dir=tmp_path)
        for module in (scratch, audit):
            monkeypatch.setattr(module, "scratch_path", lambda spark, label: f"file://{folder}/{label}-{uuid.uuid4().hex}")
        listed = rules.default_rules(spark, rules.DEFAULT_RULES + rules.MORE_RULES)
        made = audit.audit_visits(
            visits, manifest, spark.createDataFrame([("g5",)], "guid string"), listed=listed, docs=docs, embed=lambda cases: cases.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5))),
            make_checker=make, make_rule_checker=make, with_input=True, **options,
        )
        rows, kinds = sorted(map(str, made.collect())), [x.split("-")[0] for x in os.listdir(folder)]
        assert not [x for d, _, names in os.walk(folder) for x in names if "/due-" in d and "_slice" in d] and not {"checked", "contexts", "resolved", "pairs"} & set(kinds)
        with open(log) as f:
            return rows, kinds.count("audited"), sorted(f.read().split())

    rows, parts, asked = run()
    assert len(rows) == 40 and parts == 1 and 20 < len(asked) == len(set(asked))
    assert run(passes=2) == (rows, 2, asked)
