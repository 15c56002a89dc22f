"""JSON text to columns and back: metadata, model answers, stored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditmill.functions.text import stripped

SOURCE = "struct<doc_title:string,section:string,cite:string>"
ISSUES = f"array<struct<issue:string,sources:array<{SOURCE}>>>"
FINDINGS = "array<struct<flag:string,issue:string>>"
QUESTIONS = "struct<fact:string,procedure:string,constraint:string>"


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def parse_metadata(c: Column) -> Column:
    """A JSON object as a map; an empty one for bad JSON and for other values."""
    return F.coalesce(F.from_json(F.when(F.ltrim(c).startswith("{"), c), "map<string,string>"), F.create_map().cast("map<string,string>"))


#: The whole of an answer with one issue, without sources and escapes.
PLAIN_ISSUE = r'^\[\{"issue": ?"([^"\\\x00-\x1f]+)", ?"sources": ?\[\]\}\]\z'


def unfenced(c: Column) -> Column:
    """The text inside a code fence (its language name gone), or the stripped text."""
    clean = stripped(c)
    inside = F.regexp_replace(F.get(F.split(clean, "```"), F.lit(1)), "^json", "")
    return F.when(clean.startswith("```"), stripped(inside)).otherwise(clean)


def parse_issues(c: Column) -> Column:
    """Issues of a checker's answer: a JSON array of objects, maybe fenced.

    Bad JSON and other values give none. Items without an issue and sources that are no objects
    are left out; a source without a title has an empty one.
    """
    text = unfenced(c)
    items = F.filter(F.from_json(F.when(text.startswith("["), text), "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    # Objects are read one by one: an item of another kind must not spoil the array.
    parsed = F.transform(items, lambda x: F.from_json(x, "struct<issue:string,sources:array<string>>"))
    named = F.filter(parsed, lambda x: F.coalesce(x["issue"], F.lit("")) != "")
    source = lambda s: F.from_json(s, SOURCE)
    titled = lambda s: F.struct(F.coalesce(s["doc_title"], F.lit("")).alias("doc_title"), s["section"].alias("section"), s["cite"].alias("cite"))
    objects = lambda x: F.filter(F.coalesce(x["sources"], empty("array<string>")), lambda s: F.ltrim(s).startswith("{"))
    made = F.transform(named, lambda x: F.struct(x["issue"].alias("issue"), F.transform(objects(x), lambda s: titled(source(s))).alias("sources")))
    # The common answers are not worth a parser.
    plain = F.transform(F.filter(F.array(F.regexp_extract(c, PLAIN_ISSUE, 1)), lambda i: i != ""), lambda i: F.struct(i.alias("issue"), empty(f"array<{SOURCE}>").alias("sources")))
    return F.when(c == "[]", empty(ISSUES)).otherwise(F.get(F.transform(F.array(plain), lambda p: F.when(F.size(p) > 0, p).otherwise(F.coalesce(made, empty(ISSUES)))), F.lit(0)))


def parse_findings(c: Column) -> Column:
    """The findings of an object {"findings": [{flag, issue}]} or of an array of such, maybe fenced; none for anything else."""
    text = unfenced(c)
    listed = F.from_json(F.when(text.startswith("["), text), FINDINGS)
    return F.coalesce(listed, F.from_json(F.when(text.startswith("{"), text), f"struct<findings:{FINDINGS}>")["findings"], empty(FINDINGS))


def parse_questions(c: Column) -> Column:
    """struct(fact, procedure, constraint, error): all three questions, or nulls and what is wrong."""
    q = F.from_json(c, QUESTIONS)
    whole = q["fact"].isNotNull() & q["procedure"].isNotNull() & q["constraint"].isNotNull()
    part = lambda n: F.when(whole, q[n]).alias(n)
    return F.struct(part("fact"), part("procedure"), part("constraint"), F.when(~F.coalesce(whole, F.lit(False)), "missing or invalid question").alias("error"))


def merge_metadata(base: Column, over: Column) -> Column:
    """Both maps; on a common key the second one's value."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def serialize_results(diagnoses: Column) -> Column:
    """array<struct<icd_code, issues>> as JSON; null sections and cites are left out."""
    return F.to_json(diagnoses)


def deserialize_results(c: Column) -> Column:
    """The array back from JSON; missing lists are empty, missing codes are ''."""
    raw = F.from_json(c, f"array<struct<icd_code:string,issues:{ISSUES}>>")
    issue = lambda i: F.struct(i["issue"].alias("issue"), F.coalesce(i["sources"], empty(f"array<{SOURCE}>")).alias("sources"))
    one = lambda d: F.struct(F.coalesce(d["icd_code"], F.lit("")).alias("icd_code"), F.coalesce(F.transform(d["issues"], issue), empty(ISSUES)).alias("issues"))
    return F.coalesce(F.transform(raw, one), empty(f"array<struct<icd_code:string,issues:{ISSUES}>>"))


def flags_as_findings(flags: Column) -> Column:
    """Stored flags as findings without texts."""
    return F.coalesce(F.transform(flags, lambda f: F.struct(f.alias("flag"), F.lit("").alias("issue"))), empty(FINDINGS))


