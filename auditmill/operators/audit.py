"""Auditing visits: which are due, what is found, one result for each."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions import json_text, render
from auditmill.functions.text import not_blank, stripped
from auditmill.operators import checks, codes, rules, scoring
from auditmill.sources.scratch import release, remove, scratch_path, stored, write

CHECKERS = tuple(checks.SECTIONS)


def visit_id(guid: Column, date: Column, ordinal: Column) -> Column:
    """The guid, else the date, else # and the ordinal from 1."""
    return F.coalesce(not_blank(guid), not_blank(date), F.concat(F.lit("#"), (ordinal + 1).cast("string")))


def guid_key(guid: Column) -> Column:
    """What guids are compared by: lower case, null where blank."""
    return F.lower(not_blank(stripped(guid)))


def pending(visits: DataFrame, done: DataFrame) -> DataFrame:
    """visits (guid) that done (guid) does not name; case does not count, and visits without a guid stay."""
    key = guid_key(F.col("guid"))
    named = done.select(guid_key(F.col("guid")).alias("_done")).where(F.col("_done").isNotNull()).distinct()
    return visits.withColumn("_key", key).join(named, F.col("_key") == F.col("_done"), "left_anti").drop("_key")


def queue_summary(visits: DataFrame, done: DataFrame) -> DataFrame:
    """total, skipped, audited, and unmatched: visits without a guid, which cannot be skipped."""
    total = visits.agg(F.count("*").alias("total"), F.count_if(not_blank(F.col("guid")).isNull()).alias("unmatched"))
    left = pending(visits, done).agg(F.count("*").alias("audited"))
    return total.join(left).select("total", (F.col("total") - F.col("audited")).alias("skipped"), "audited", "unmatched")


def rule_findings(visits: DataFrame, structure: bool = True, listed: DataFrame | None = None, said: Column | None = None) -> DataFrame:
    """visits (nested, with visit_type) with ``findings`` of a rule table (see rules.check_visits()).

    Without a table: the default rules but NO_FOLLOW_UP, and CONFLICT last if structure.
    """
    if listed is not None:
        return rules.check_visits(visits, listed, said=said)
    base = rules.default_rules(visits.sparkSession).where("flag_code <> 'NO_FOLLOW_UP'")
    base = base.withColumn("pos", F.when(F.col("flag_code") == "CONFLICT", 99).otherwise(F.col("pos")))
    return rules.check_visits(visits, base if structure else base.where("flag_code <> 'CONFLICT'"), said=said)


def fold_visits(visits: DataFrame, diagnoses: DataFrame, key: str = "visit") -> DataFrame:
    """visits with ``results``: its rows of diagnoses (key, pos, result), in order of pos; an empty list without any."""
    kind = diagnoses.schema["result"].dataType.simpleString()
    folded = diagnoses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "result"))).alias("_r"))
    joined = visits.join(folded, key, "left")
    return joined.withColumn("results", F.coalesce(F.transform("_r", lambda x: x["result"]), F.array().cast(f"array<{kind}>"))).drop("_r")


def all_issues(result: Column) -> Column:
    """The issues of the three checkers, in their order."""
    return F.concat(*[F.coalesce(result[c], json_text.empty(json_text.ISSUES)) for c in CHECKERS])


def check_offline(code: Column, name: Column, guideline: Column) -> Column:
    """The offline anamnesis checker's answers, a JSON text each: one issue if the name and guideline share no word."""
    issue = F.to_json(F.array(F.struct(F.concat(F.lit("no common word: "), name).alias("issue"), F.array(F.struct(guideline.alias("doc_title"), code.alias("section"))).alias("sources"))))
    return F.when(codes.token_overlap(name, guideline) == 0, issue).otherwise("[]")


def report_input() -> Column:
    """What a report shows of a visit."""
    return F.struct("guid", "date", "patient", "services", "diagnoses").alias("input")


def land_due(visits: DataFrame, done: DataFrame, passes: int = 1) -> tuple[DataFrame, str]:
    """The visits that are due, written once, with type, id and ``_gaps``, and the folder they are in.

    They are made and written in passes, so only a pass of their lines is shuffled at a time. ``_slice`` is the folder
    of a visit, by what is told of it: visits with equal prompts are in one.
    """
    path, made = scratch_path(visits.sparkSession, "due"), None
    gaps = F.array(F.when(F.col("diagnoses").isNull(), F.lit("no diagnoses")), F.when(F.coalesce(F.size("services"), F.lit(0)) <= 0, F.lit("no service")))
    place = F.pmod(F.xxhash64(*render.around_diagnosis(F.col("patient"), F.col("inspection"))), F.lit(passes)) if passes > 1 else F.lit(0)
    for n in range(passes):
        own = visits if passes == 1 else visits.where(F.pmod(F.xxhash64("visit"), F.lit(passes)) == n)
        due = pending(own, done).withColumn("visit_type", rules.visit_type(F.col("services"))).withColumn("visit_id", visit_id(F.col("guid"), F.col("date"), F.col("visit") - 1))
        made = due.withColumn("_gaps", F.filter(gaps, lambda x: x.isNotNull())).withColumn("_slice", place.cast("int"))
        write(made, path, "_slice", mode="append")
    return visits.sparkSession.read.schema(made.schema).parquet(path), path


def _diagnoses(due: DataFrame) -> DataFrame:
    """A row for each diagnosis: visit, pos, d, pair (code and name as a text), and what is told of the visit before and after the diagnosis."""
    pair = F.concat_ws("\n", F.coalesce(F.concat(F.lit("="), "d.code"), F.lit("")), F.coalesce(F.concat(F.lit("="), "d.name"), F.lit("")))
    # What is told of a visit beside the diagnosis is made before its diagnoses are rows.
    before, after = render.around_diagnosis(F.col("patient"), F.col("inspection"))
    each = due.select("visit", "diagnoses", before.alias("before"), after.alias("after"))
    return each.select("visit", "before", "after", F.posexplode("diagnoses").alias("pos", "d")).withColumn("pair", pair)


def audit_visits(
    visits: DataFrame,
    manifest: DataFrame,
    done: DataFrame,
    structure: bool = True,
    listed: DataFrame | None = None,
    docs: DataFrame | None = None,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    make_checker: Callable[[], scoring.Scorer] = checks.offline_checker,
    sections: dict[str, str] = checks.SECTIONS,
    per_visit: bool = True,
    make_rule_checker: Callable[[], scoring.Scorer] | None = None,
    answers: str | None = None,
    with_input: bool = False,
    passes: int = 1,
) -> DataFrame:
    """The audit: visits that are due, rule findings, a guideline and three checks per diagnosis, one row per visit.

    visits: as in plans.views.visits. listed: the rule table (the default rules without one).
    docs: the guidelines' chunks, with the manifest's ids as file_id; embed adds ``embedding`` to
    rows with query_text. Each checker of a diagnosis judges the visit's own record (patient,
    diagnosis, inspection) by what a section search and a general search of its guideline find
    (see checks). Guidelines and searches depend on code and name only and are made once for
    each pair of them; without per_visit so are the answers, to code and name alone. Without docs
    only the names of diagnosis and guideline are compared, as the anamnesis check.

    make_rule_checker judges the rules in words (see rules.model_findings()), which find nothing
    without it. answers is a folder that keeps what was answered: a run scores the prompts that it lacks only.

    passes: the visits are made, and then judged, in so many parts (see land_due()); the shuffle files of one are gone
    before the next, and the visits of a part are deleted when its results are written.

    Result: visit, visit_id, visit_type, findings, results (struct of guideline_id, icd_code and the
    issues of each checker, per diagnosis), errors: what a visit lacks that the audit takes as empty
    (diagnoses, services), and checks and rules whose scorer failed; with_input also ``input``, what report_rows() shows of a visit.
    """
    # Written once: rules, pairs and results all read the visits that are due.
    due, path = land_due(visits, done, passes)
    pairs = stored(_diagnoses(due).select("pair", "d.code", "d.name").dropDuplicates(["pair"]).withColumn("dx", F.monotonically_increasing_id()), "pairs")
    names = manifest.select(F.col("id").alias("guideline_id"), F.col("name").alias("guideline"))
    resolved = codes.resolve(pairs, manifest, "dx")
    known = stored(pairs.join(resolved, "dx").join(names, "guideline_id", "left"), "resolved")
    release(pairs, *resolved._reads)
    nothing = json_text.empty(json_text.ISSUES)
    none = F.array().cast("array<string>")
    issues = [F.coalesce(F.col(f"checks.{c}"), nothing).alias(c) for c in CHECKERS]
    errors = F.coalesce("checks.errors", none).alias("errors")
    kept_in = None if answers is None else f"{answers}/checks"
    contexts = judged = None
    if docs is not None:
        cases = known.where("guideline_id IS NOT NULL").select("dx", "pair", F.coalesce("name", "code").alias("query_text"), F.col("guideline_id").alias("file_id"), F.struct("code", "name").alias("d"))
        contexts = checks.contexts(embed(cases), docs, sections)
        if not per_visit:
            detail = F.struct("d.code", "d.name", F.lit(None).cast("string").alias("detail"), F.lit(None).cast("boolean").alias("first_time"))
            told = cases.select(F.col("pair").alias("case"), "dx", "file_id", F.concat(F.lit("## Диагноз\n"), render.format_diagnosis(detail)).alias("message"))
            judged = stored(checks.check(told, contexts, make_checker, kept_in), "checked")

    def checked_of(each: DataFrame) -> DataFrame:
        """visit, pos, d (with code), guideline_id, the issues of each checker, and errors, for each diagnosis."""
        rows = each.select("visit", "pos", "d", "pair")
        if docs is None:
            answer = F.when(F.col("guideline_id").isNotNull(), check_offline(F.col("code"), F.col("name"), F.col("guideline")))
            compared = {"anamnesis": json_text.parse_issues(F.coalesce(answer, F.lit("[]"))), "inspection": nothing, "treatment": nothing}
            return rows.join(known.select("pair", "guideline_id", *[c.alias(n) for n, c in compared.items()], none.alias("errors")), "pair")
        if judged is not None:
            answered = judged.withColumnRenamed("case", "pair")
            return rows.join(known.select("pair", "guideline_id"), "pair").join(answered, "pair", "left").select("visit", "pos", "d", "guideline_id", *issues, errors)
        own = each.join(known.select("pair", "dx", "guideline_id"), "pair")
        message = F.concat("before", render.format_diagnosis(F.col("d")), "after")
        told = own.where("guideline_id IS NOT NULL").select("visit", "pos", "d.code", "guideline_id", F.col("guideline_id").alias("file_id"), "dx", message.alias("message"))
        said = stored(checks.check(told, contexts, make_checker, kept_in, ("visit", "pos", "code", "guideline_id")), "checked")
        rest = own.where("guideline_id IS NULL").select("visit", "pos", "d.code", "guideline_id", F.lit(None).cast(said.schema["checks"].dataType).alias("checks"))
        checked = said.unionByName(rest).select("visit", "pos", F.struct("code").alias("d"), "guideline_id", *issues, errors)
        checked._reads = (said,)
        return checked

    def audited(due: DataFrame) -> DataFrame:
        failed, said, judged_by, read = F.array().cast("array<string>"), None, due, ()
        if make_rule_checker is not None and listed is not None:
            by_model = rules.model_findings(due, listed, make_rule_checker, None if answers is None else f"{answers}/rules")
            judged_by, said, read = due.join(by_model, "visit", "left"), F.col("said"), by_model._reads
            failed = F.filter(F.array(F.concat(F.lit("rules: "), F.col("error"))), lambda x: x.isNotNull())
        judged_by = rule_findings(judged_by.withColumn("_gaps", F.concat("_gaps", failed)), structure, listed, said)
        found = judged_by.select("visit", "visit_id", "visit_type", "findings", "_gaps", *([report_input()] if with_input else []))
        checked = checked_of(_diagnoses(due))
        result = F.struct("guideline_id", F.coalesce("d.code", F.concat(F.lit("#"), (F.col("pos") + 1).cast("string"))).alias("icd_code"), *CHECKERS)
        folded = fold_visits(found, checked.select("visit", "pos", F.struct(result.alias("r"), "errors").alias("result")))
        failures = F.concat("_gaps", F.flatten(F.transform("results", lambda x: x["errors"])))
        results = F.transform("results", lambda x: x["r"]).alias("results")
        out = folded.select("visit", "visit_id", "visit_type", "findings", results, failures.alias("errors"), *(["input"] if with_input else []))
        out._reads = (*read, *checked.__dict__.get("_reads", ()))
        return stored(out, "audited")

    parts = []
    for n in range(passes):
        parts.append(audited(due.where(F.col("_slice") == n).drop("_slice")))
        remove(due.sparkSession, f"{path}/_slice={n}")
    release(known, *[t for t in (contexts, judged) if t is not None])
    return functools.reduce(DataFrame.unionByName, parts)


def report_rows(audited: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """One row per visit with three texts: input, formal_structure, diagnosis. visits is needed where audited has no ``input``."""
    if visits is not None:
        audited = audited.drop("input").join(visits.select("visit", report_input()), "visit")
    kind = audited.schema["input"].dataType
    return audited.select(
        "visit",
        render.format_value(F.col("input"), kind).alias("input"),
        render.format_formal(F.col("findings")).alias("formal_structure"),
        render.format_diagnosis_cell(F.col("results")).alias("diagnosis"),
    )
