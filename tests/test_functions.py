from __future__ import annotations

import re
import time

import pytest
from auditmill.functions import json_text, render, text, vectors
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first().r


def c():
    return F.col("c")


def test_strip_removes_all_white_space(spark):
    assert one(spark, text.stripped(c()), " \t a b\n ") == "a b"


def test_tokens(spark):
    assert one(spark, text.tokenize(c()), "Острый-бронхит, 38.5°!") == ["острый", "-", "бронхит", ",", "38", ".", "5", "°", "!"]
    assert one(spark, text.tokenize(c()), None) == []


def test_sections(spark):
    sections = lambda t: [(r.title, r.text) for r in one(spark, text.split_sections(c()), t)]
    assert sections("no numbers here") == [(None, "no numbers here")]
    assert sections("pre\n1.1 Первый\nтело\n1.2 Second v. 2\nbody\n") == [("1.1 Первый", "1.1 Первый\nтело"), ("1.2 Second v. 2", "1.2 Second v. 2\nbody")]
    # Text under a contents-like line is lost, and so is the line.
    assert sections("1.1 A\nx\n1.2 Contents ..... 7\nlost\n1.3 B\ny") == [("1.1 A", "1.1 A\nx"), ("1.3 B", "1.3 B\ny")]
    # A number without a letter in its line is no section.
    assert sections("1.1 22\nx") == [(None, "1.1 22\nx")]


def test_sections_of_a_long_text(spark):
    """A text is cut once: work that grew with the square of the lines took minutes here."""
    lines, start = "".join(f"1.{n} Title {n}\nbody\n" for n in range(10_000)), time.time()
    frame = spark.createDataFrame([(lines,)], "c string").select(F.explode(text.split_sections(c())).alias("s")).select("s.*")
    found = frame.agg(F.count("*"), F.min("title"), F.count_if(F.col("text") == F.concat("title", F.lit("\nbody")))).first()
    assert tuple(found) == (10_000, "1.0 Title 0", 10_000) and time.time() - start < 20


def test_front_matter(spark):
    cut = lambda t: one(spark, text.strip_front_matter(c(), "Abbr"), t)
    assert cut("x Abbr y Abbr z ") == "Abbr z"
    assert cut("x Abbr y ") == "x Abbr y " and cut("none") == "none" and cut("AbbrAbbr") == "Abbr"


def test_fixed_chunks(spark):
    assert one(spark, text.chunk_fixed(c(), 5, 2), "abcdefghij") == ["abcde", "defgh", "ghij"]
    assert one(spark, text.chunk_fixed(c(), 5, 2), "ab") == ["ab"] and one(spark, text.chunk_fixed(c(), 5, 2), "") == []


@pytest.mark.parametrize("size,overlap", [(20, 5), (50, 10), (7, 0)])
def test_recursive_chunks_cover_the_text(size, overlap):
    source = "First part.\n\nSecond part is longer than others\nwith lines and averyveryverylongwordwithoutspaces here.\n\n\nEnd"
    pieces = text.split_text(source, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    for piece in pieces:
        found = source.find(piece, max(0, at - overlap - 2))
        assert found >= 0 and not source[at:found].strip()
        assert at - found <= overlap
        at = found + len(piece)
    assert not source[at:].strip() and text.split_text("", 10, 2) == []


def test_codes_and_keys(spark):
    assert one(spark, text.normalize_codes(c()), " j06.0,\tJ06.9 ") == ["J06.0", "J06.9"]
    assert one(spark, text.code_prefix(c()), "J20.9") == "J20" and one(spark, text.code_prefix(c()), "J20") == "J20"
    assert one(spark, text.safe_period_key(c()), " 01.02.2024 ") == "01-02-2024"
    assert one(spark, text.extract_guid(c()), "x GUID:\n AB12CD34-1111-2222-3333-ABCDEFABCDEF y") == "ab12cd34-1111-2222-3333-abcdefabcdef"
    assert one(spark, text.extract_guid(c()), "GUID: nothing") is None
    assert one(spark, text.content_preview(c()), "a\nb" + "x" * 200) == "a b" + "x" * 117


def test_metadata(spark):
    for value, want in (('{"a": 1, "b": "x"}', {"a": "1", "b": "x"}), ("[1]", {}), ("{broken", {}), (None, {}), ("3", {})):
        assert one(spark, json_text.parse_metadata(c()), value) == want
    base, over = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))
    assert one(spark, json_text.merge_metadata(base, over), "x") == {"a": "1", "b": "2"}


def test_issues(spark):
    parse = lambda t: [(i.issue, [tuple(s) for s in i.sources]) for i in one(spark, json_text.parse_issues(c()), t)]
    good = '[{"issue": "x", "sources": [{"doc_title": "t", "section": "s"}, 7, {"cite": "c"}]}, {"issue": ""}, {"sources": []}, 5, {"issue": "y"}]'
    want = [("x", [("t", "s", None), ("", None, "c")]), ("y", [])]
    assert parse(good) == want and parse(f"```json\n{good}\n```") == want and parse(f" ```\n{good}``` tail") == want
    for bad in ('{"issue": "x"}', '[{"issue": "x"', "", "text", None):
        assert parse(bad) == []


def test_plain_issues_as_the_parser_reads_them(spark):
    """An answer of one plain issue is read by one expression; whatever else is in it goes to the parser."""
    said = ['[{"issue": "Я (x)", "sources": []}]', '[{"issue": "", "sources": []}]', '[{"issue": "a\\"b", "sources": []}]', '[{"issue": "a", "sources": []}, {"issue": "b", "sources": []}]', '[{"issue":"a","sources":[]}]x']
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(said)], "n int, c string").select("n", json_text.parse_issues(c()).alias("i"))
    assert {r.n: [tuple(x) for x in r.i] for r in frame.collect()} == {0: [("Я (x)", [])], 1: [], 2: [('a"b', [])], 3: [("a", []), ("b", [])], 4: [("a", [])]}
    assert re.fullmatch(json_text.PLAIN_ISSUE.replace("\\z", ""), said[0]) and not any(re.fullmatch(json_text.PLAIN_ISSUE.replace("\\z", ""), t) for t in said[1:])


def test_findings_and_questions(spark):
    assert [tuple(f) for f in one(spark, json_text.parse_findings(c()), '{"findings": [{"flag": "F", "issue": "i"}]}')] == [("F", "i")]
    assert one(spark, json_text.parse_findings(c()), "oops") == []
    assert one(spark, json_text.parse_questions(c()), '{"fact": "a", "procedure": "b", "constraint": "c"}')[:] == ("a", "b", "c", None)
    assert one(spark, json_text.parse_questions(c()), '{"fact": "a"}').error == "missing or invalid question"


def test_results_round_trip(spark):
    stored = '[{"icd_code":"A","issues":[{"issue":"x","sources":[{"doc_title":"t"}]}]}]'
    assert one(spark, json_text.serialize_results(json_text.deserialize_results(c())), stored) == stored
    assert one(spark, json_text.deserialize_results(c()), '[{"issues":null}]')[0][:] == ("", [])
    assert [tuple(f) for f in one(spark, json_text.flags_as_findings(F.array(F.lit("A"))), "x")] == [("A", "")]


def test_vectors(spark):
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r.d for r in pair.select(F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 9).alias("d")).collect()]
    assert got == [1.0, 0.0, None]
    assert [r.u for r in pair.select(vectors.l2_normalize(F.col("b")).alias("u")).collect()][0] == [0.0, 1.0]
    assert [r.u for r in pair.select(vectors.l2_normalize(F.col("a")).alias("u")).collect()][2] == [0.0, 0.0]


def test_rendered_values(spark):
    kind = T.StructType.fromDDL("a string, b boolean, c array<int>, d struct<e: string>, f array<struct<g: int>>")
    frame = spark.createDataFrame([((None, True, [1, 2], ("x",), []),)], T.StructType([T.StructField("v", kind)]))
    assert frame.select(render.format_value(F.col("v"), kind).alias("t")).first().t == "a: —\nb: да\nc:\n  1. 1\n  2. 2\nd:\n  e: x\nf:\n  —"


def test_rendered_chunk(spark):
    frame = spark.createDataFrame([('[{"Unnamed: 0": "x, y: \\"q\\"", "b": 1.5}]', {"content_type": "table", "Наименование": "N", "chunk_index": "3"}), ("body", {}), ("[Unnamed: 1 oops", {"content_type": "table", "section": ""})], "c string, m map<string,string>")
    got = [r.t for r in frame.select(render.format_chunk(F.col("c"), F.col("m")).alias("t")).collect()]
    assert got == ['[N\nфрагмент 3]\n{"  0": "x, y: \\"q\\"", "b": 1.5}', "body", "[  1 oops"]


def test_nothing_found(spark):
    assert one(spark, render.format_search_results(F.array().cast("array<string>")), "x") == render.NOTHING_FOUND
    assert one(spark, render.format_context_pack(F.array().cast("array<struct<section:string,chunk:string>>")), "x") == render.NOTHING_IN_BASE
