"""Texts for people and models, made from nested columns."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.functions.text import not_blank, stripped
from auditmill.sources.scratch import stored

# Fixed texts of the report format.
DASH = "—"
YES, NO = "да", "нет"
NOTHING_FOUND = "Ничего не найдено."
NOTHING_IN_BASE = "По данному запросу ничего не найдено в базе знаний."
NO_GUIDELINE = "Для такого МКБ кода нет прямых клинических рекоммендаций"
SECTIONS = (("Анамнез", "anamnesis"), ("Осмотр", "inspection"), ("Лечение", "treatment"))


#: What comes before a comma or colon outside of strings, and that sign: JSON rows get a space after it.
JSON_PART = r'((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:]++)++)([,:])'


def joined(parts: Column, separator: str = "\n") -> Column:
    return F.array_join(parts, separator)


def format_inspection(pairs: Column) -> Column:
    """``param: value`` lines of the pairs of which neither is blank."""
    clean = F.transform(pairs, lambda p: F.struct(stripped(F.coalesce(p["param"], F.lit(""))).alias("k"), stripped(F.coalesce(p["value"], F.lit(""))).alias("v")))
    return joined(F.transform(F.filter(clean, lambda p: (p["k"] != "") & (p["v"] != "")), lambda p: F.concat(p["k"], F.lit(": "), p["v"])))


def format_diagnosis(d: Column) -> Column:
    detail = not_blank(d["detail"])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Код МКБ: "), F.coalesce(d["code"], F.lit(DASH))),
        F.concat(F.lit("Наименование МКБ: "), F.coalesce(d["name"], F.lit(DASH))),
        F.concat(F.lit("Детализация: "), detail),
        F.concat(F.lit("Выявлен впервые: "), F.when(d["first_time"], YES).when(~d["first_time"], NO)),
    )


def format_patient(patient: Column) -> Column:
    """``key: value`` lines of the entries that are not null."""
    held = F.filter(F.map_entries(patient), lambda e: e["value"].isNotNull())
    return joined(F.transform(held, lambda e: F.concat(e["key"], F.lit(": "), e["value"])))


def around_diagnosis(patient: Column, inspection: Column) -> tuple[Column, Column]:
    """What stands before and after the diagnosis in compose_context()."""
    return F.concat(F.lit("## Пациент\n"), format_patient(patient), F.lit("\n\n## Диагноз\n")), F.concat(F.lit("\n\n## Клинический контекст (данные осмотра)\n"), format_inspection(inspection))


def compose_context(patient: Column, diagnosis: Column, inspection: Column) -> Column:
    before, after = around_diagnosis(patient, inspection)
    return F.concat(before, format_diagnosis(diagnosis), after)


def format_chunk(chunk: Column, metadata: Column) -> Column:
    """A chunk under its header. metadata is a map.

    Line one: name, code, age category; line two: section, fragment number. Of a table chunk,
    column names that begin with Unnamed become spaces, and each row of the JSON array is a line;
    if it does not parse, its text stays.
    """
    meta = lambda k: not_blank(metadata[k])
    who = F.concat_ws(" | ", meta("Наименование"), F.concat(F.lit("МКБ-10: "), meta("МКБ-10")), meta("Возрастная категория"))
    where = F.concat_ws(" | ", meta("section"), F.concat(F.lit("фрагмент "), metadata["chunk_index"]))
    header = F.concat_ws("\n", not_blank(who), not_blank(where))
    clean = F.regexp_replace(chunk, r"(?U)Unnamed\S*", " ")
    rows = F.transform(F.from_json(F.when(F.ltrim(clean).startswith("["), clean), "array<string>"), lambda r: F.regexp_replace(r, JSON_PART, "$1$2 "))
    body = F.when(F.coalesce(metadata["content_type"], F.lit("text")) == "table", F.coalesce(joined(rows), clean)).otherwise(chunk)
    return F.when(header != "", F.concat(F.lit("["), header, F.lit("]\n"), body)).otherwise(body)


def numbered(parts: Column, head: str, tail: str, separator: str) -> Column:
    """parts joined, each after head, its number from 1 and tail."""
    return joined(F.transform(parts, lambda p, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail), p)), separator)


def format_search_results(chunks: Column) -> Column:
    """Formatted chunks as numbered sources, or the text for none."""
    return F.when(F.size(chunks) > 0, numbered(chunks, "--- Источник ", " ---\n", "\n\n")).otherwise(NOTHING_FOUND)


def format_context_pack(results: Column) -> Column:
    """results (section, chunk) as ``[i] section`` blocks, or the text for none."""
    part = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.coalesce(F.concat(F.lit(" "), not_blank(r["section"])), F.lit("")), F.lit("\n"), F.coalesce(r["chunk"], F.lit("")))
    return F.when(F.size(results) > 0, joined(F.transform(results, part), "\n\n---\n\n")).otherwise(NOTHING_IN_BASE)


def retrieval_log(query_type: Column, top_k: Column, query: Column, results: Column) -> Column:
    """The trace of a search: results has doc_id, rrf_score, title, section, chunk."""
    dash = lambda c: F.coalesce(not_blank(c), F.lit(DASH))

    def block(r: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n", F.lit(""), F.format_string("--- chunk %d ---", i + 1), F.concat(F.lit("id: "), r["doc_id"].cast("string")), F.format_string("rrf_score: %.6f", r["rrf_score"]),
            F.concat(F.lit("title: "), dash(r["title"])), F.concat(F.lit("section: "), dash(r["section"])), F.coalesce(r["chunk"], F.lit("")),
        )

    head = F.concat_ws(
        "\n", F.lit("[retrieval] hybrid_search"), F.concat(F.lit("query_type: "), query_type), F.concat(F.lit("top_k: "), top_k.cast("string")),
        F.concat(F.lit("query: "), query), F.concat(F.lit("count: "), F.size(results).cast("string")),
    )
    return joined(F.concat(F.array(head), F.transform(results, block)))


def format_scalar(c: Column, kind: T.DataType) -> Column:
    text = F.when(c, YES).otherwise(NO) if isinstance(kind, T.BooleanType) else c.cast("string")
    return F.when(c.isNull(), DASH).otherwise(text)


def format_value(c: Column, kind: T.DataType, indent: int = 0) -> Column:
    """Key and value lines of a nested column, by its type: lists are numbered, depth indents by two."""
    pad = " " * indent

    def item(label: Column, value: Column, inner: T.DataType) -> Column:
        if isinstance(inner, T.StructType | T.ArrayType | T.MapType):
            return F.concat(F.lit(pad), label, F.lit("\n"), format_value(value, inner, indent + 2))
        return F.concat(F.lit(pad), label, F.lit(" "), format_scalar(value, inner))

    if isinstance(kind, T.StructType):
        lines = F.concat_ws("\n", *[item(F.lit(f"{f.name}:"), c[f.name], f.dataType) for f in kind.fields])
        return F.when(c.isNull(), F.lit(pad + DASH)).otherwise(lines)
    if isinstance(kind, T.MapType):
        lines = joined(F.transform(F.map_entries(c), lambda e: item(F.concat(e["key"], F.lit(":")), e["value"], kind.valueType)))
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(pad + DASH)).otherwise(lines)
    if isinstance(kind, T.ArrayType):
        lines = joined(F.transform(c, lambda x, i: item(F.concat((i + 1).cast("string"), F.lit(".")), x, kind.elementType)))
        return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(pad + DASH)).otherwise(lines)
    return F.concat(F.lit(pad), format_scalar(c, kind))


def _json_kind(value: Column) -> Column:
    """What a VARIANT is: object, array, bool, null or scalar."""
    schema = F.schema_of_variant(value)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "BOOLEAN", "bool").when(schema == "VOID", "null").otherwise("scalar")


def _json_children(text: Column, kind: Column) -> Column:
    """The members of a JSON object or the items of an array, in the text's order: array<struct<label, text, kind>>.

    Texts keep the order of keys, which a VARIANT sorts; the VARIANT tells the kinds, which texts do not.
    """
    value = F.try_parse_json(text)
    entries, kinds = F.map_entries(F.from_json(text, "map<string,string>")), value.cast("map<string,variant>")
    items, item_kinds = F.from_json(text, "array<string>"), value.cast("array<variant>")
    child = lambda label, t, v: F.struct(label.alias("label"), t.alias("text"), _json_kind(v).alias("kind"))
    members = F.transform(entries, lambda e: child(F.concat(e["key"], F.lit(":")), e["value"], F.element_at(kinds, e["key"])))
    numbered_items = F.transform(items, lambda x, i: child(F.concat((i + 1).cast("string"), F.lit(".")), x, F.get(item_kinds, i)))
    return F.when(kind == "object", members).when(kind == "array", numbered_items)


#: Longest text, deepest value and longest integer that plain_json() renders.
PLAIN_CHARS, PLAIN_DEPTH, PLAIN_DIGITS = 1 << 15, 50, 18


class _Object(list):
    """The members of a JSON object, in the text's order."""


def _members(pairs: list[tuple]) -> _Object:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key is repeated")
    return _Object(pairs)


def _integer(text: str) -> str:
    if len(text) > PLAIN_DIGITS or text == "-0":
        raise ValueError("an integer that may be written otherwise")
    return text


def _refuse(text: str) -> None:
    raise ValueError(text)


_PLAIN_JSON = json.JSONDecoder(object_pairs_hook=_members, parse_int=_integer, parse_float=_refuse, parse_constant=_refuse)


def plain_json(text: str | None) -> str | None:
    """The lines of format_json() for a short text of objects, arrays, strings, short integers, true, false and null; None for every other."""

    def scalar(value: object) -> str:
        return DASH if value is None else (YES if value else NO) if isinstance(value, bool) else value

    def add(value: list, depth: int) -> None:
        if depth > PLAIN_DEPTH:
            raise ValueError("too deep")
        pad = "  " * depth
        if not value:
            lines.append(pad + DASH)
        for label, x in [(f"{k}:", x) for k, x in value] if isinstance(value, _Object) else [(f"{n}.", x) for n, x in enumerate(value, 1)]:
            if isinstance(x, list):
                lines.append(pad + label)
                add(x, depth + 1)
            else:
                lines.append(f"{pad}{label} {scalar(x)}")

    if text is None or len(text) > PLAIN_CHARS or "\\u" in text:
        return None
    lines: list[str] = []
    try:
        value = _PLAIN_JSON.decode(text)
        if not isinstance(value, list):
            return scalar(value) if value is None or isinstance(value, bool) else None
        add(value, 0)
    except (ValueError, RecursionError):
        return None
    return "\n".join(lines)


def format_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text): free JSON as key and value lines, like format_value() but without a declared schema.

    Lists are numbered, depth indents by two, empty objects and arrays and nulls are a dash. A text that is no
    JSON (or repeats a key), or one JSON string, is shown as it stands. Null texts are a dash. A
    text that plain_json() renders is one row from end to end; the others, if there are any, are opened
    level by level (see _json_levels()).
    """

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(plain_json, na_action=None)

    # A text that is rendered is not kept.
    made = rows.select(key, F.col(column).alias("_j"), plain(F.col(column)).alias("_t"))
    made = stored(made.select(key, F.when(F.col("_t").isNull(), F.col("_j")).alias("_j"), "_t"), "rendered")
    done, left = made.where("_t IS NOT NULL").select(key, F.col("_t").alias("text")), made.where("_t IS NULL")
    if left.isEmpty():
        done._reads = (made,)
        return done
    opened = _json_levels(left, key, "_j")
    out = done.unionByName(opened)
    out._reads = (made, *opened._reads)
    return out


def _json_levels(rows: DataFrame, key: str, column: str) -> DataFrame:
    """format_json() of texts of any length, depth and numbers.

    Records are opened level by level: a level is written, its lines have their path, and only objects and
    arrays go on, so each level costs one pass and nothing recurs in a task.
    """
    value = F.try_parse_json(column)
    level = rows.select(key, F.array().cast("array<int>").alias("path"), F.col(column).alias("text"), F.coalesce(_json_kind(value), F.lit("scalar")).alias("kind"))
    shown = lambda: F.when(F.col("text").isNull() | (F.col("kind") == "null"), DASH).when(F.col("kind") == "bool", F.when(F.col("text") == "true", YES).otherwise(NO)).otherwise(F.col("text"))
    lines = [level.where("kind NOT IN ('object', 'array')").select(key, "path", shown().alias("line"))]
    depth, written = 0, []
    while True:
        opened = level.where("kind IN ('object', 'array')").withColumn("children", _json_children(F.col("text"), F.col("kind")))
        pad = "  " * depth
        below = opened.select(key, "path", F.posexplode_outer("children").alias("at", "c"))
        below = below.select(key, F.concat("path", F.array(F.coalesce("at", F.lit(0)))).alias("path"), "c.label", "c.text", F.coalesce("c.kind", F.lit("none")).alias("kind"))
        below = stored(below, "lines")
        written.append(below)
        text = F.when(F.col("kind") == "none", DASH).when(F.col("kind").isin("object", "array"), F.col("label")).otherwise(F.concat_ws(" ", "label", shown()))
        lines.append(below.select(key, "path", F.concat(F.lit(pad), text).alias("line")))
        level, depth = below.select(key, "path", "text", "kind"), depth + 1
        if level.where("kind IN ('object', 'array')").isEmpty():
            break
    every = functools.reduce(DataFrame.unionByName, lines)
    folded = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("l"))
    out = folded.select(key, joined(F.transform("l", lambda x: x["line"])).alias("text"))
    out._reads = tuple(written)
    return out


def format_formal(findings: Column) -> Column:
    lines = F.transform(findings, lambda f: F.concat(F.lit("    ["), f["flag"], F.lit("] "), f["issue"]))
    return F.when(F.size(findings) <= 0, "  Formal structure: OK").otherwise(joined(F.concat(F.array(F.lit("  Formal structure:")), lines)))


def format_issue(issue: Column) -> Column:
    def source(s: Column) -> Column:
        more = lambda mark, c: F.coalesce(F.concat(F.lit(mark), not_blank(c)), F.lit(""))
        return F.concat(F.lit("      source: "), s["doc_title"], more(" / ", s["section"]), more(" — ", s["cite"]))

    return joined(F.concat(F.array(F.concat(F.lit("    • "), issue["issue"])), F.transform(issue["sources"], source)))


def format_issue_section(label: str, issues: Column) -> Column:
    lines = F.concat(F.array(F.lit(f"  {label}:")), F.transform(issues, format_issue))
    return F.when(F.size(issues) <= 0, f"  {label}: OK").otherwise(joined(lines))


def format_diagnosis_audit(d: Column) -> Column:
    """d: guideline_id, icd_code and an array of issues for each of SECTIONS."""
    code = not_blank(d["icd_code"])
    none = F.concat(F.lit(NO_GUIDELINE), F.coalesce(F.concat(F.lit(" ("), code, F.lit(")")), F.lit("")))
    head = F.concat(F.lit("Результат аудита диагноза(icd_code="), F.coalesce(code, F.lit(DASH)), F.lit(", номер клин.рек.="), d["guideline_id"], F.lit(")"))
    return F.when(d["guideline_id"].isNull(), none).otherwise(F.concat_ws("\n", head, *[format_issue_section(label, d[name]) for label, name in SECTIONS]))


def format_diagnosis_cell(audits: Column) -> Column:
    """All diagnoses of a visit in one cell, numbered; a dash for none."""
    return F.when(F.size(audits) > 0, numbered(F.transform(audits, format_diagnosis_audit), "", ".\n", "\n\n")).otherwise(DASH)


def format_result(result_id: Column, findings: Column, diagnoses: Column) -> Column:
    """A whole stored result; diagnoses: icd_code, issues."""

    def one(d: Column) -> Column:
        head = F.concat(F.lit("  ["), d["icd_code"], F.lit("]"))
        lines = joined(F.concat(F.array(head), F.transform(d["issues"], format_issue)))
        return F.when(F.size(d["issues"]) <= 0, F.concat(head, F.lit(" OK"))).otherwise(lines)

    some = joined(F.concat(F.array(F.lit("  Diagnosis results:")), F.transform(diagnoses, one)))
    tail = F.when(F.size(diagnoses) > 0, some).otherwise("  Diagnosis results: none")
    return F.concat_ws("\n", F.concat(F.lit("Result(id="), F.coalesce(result_id.cast("string"), F.lit("None")), F.lit(")")), format_formal(findings), tail)
