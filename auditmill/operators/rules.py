"""Rules for visits: selection, rendering, and checks that need no model."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import json_text
from auditmill.functions.text import stripped
from auditmill.operators import answers, scoring

RULE = (
    "rule_id string, source string, rule_type string, applies_to struct<visit_types:array<string>,specialties:array<string>,age_group:string>, "
    "targets array<string>, condition string, expectation string, flag_code string, severity string"
)

#: Parts of a service's name and the visit types they show, in order.
VISIT_TYPES = (("первичн", "primary"), ("повторн", "repeat"), ("профилактическ", "prophylactic"))

#: Values that only fill a field.
PLACEHOLDER = r"(?iU)^\s*(?:-+|\.+|\?+|n/?a|none|null|test|тест|нет данных|xxx+)\s*$"


#: A small set of rules in the rule schema; callers bring their own file to load_rules().
DEFAULT_RULES = (
    ("meta", "required_field", ["all"], ["date", "patient", "service"], None, "Date, patient and service are stated.", "MISSING_META", "critical"),
    ("primary_core", "required_field", ["primary"], ["inspection", "diagnosis"], None, "A first visit states findings and a diagnosis.", "MISSING_CORE", "critical"),
    ("repeat_core", "required_field", ["repeat"], ["diagnosis"], None, "A repeat visit states a diagnosis.", "MISSING_REPEAT_CORE", "critical"),
    ("diagnosis", "required_field", ["all"], ["diagnosis"], None, "At least one diagnosis is stated.", "MISSING_DIAGNOSIS", "critical"),
    ("placeholder", "structure_defect", ["all"], ["any"], None, "No field holds a placeholder.", "PLACEHOLDER", "major"),
    ("conflict", "structure_defect", ["all"], ["any"], None, "No field is filled twice with different values.", "CONFLICT", "minor"),
    ("symptom", "consistency", ["primary", "repeat"], ["diagnosis"], "If a main diagnosis is established.", "symptom codes are a defect.", "SYMPTOM_CODE", "major"),
    ("follow_up", "followup_check", ["primary", "repeat"], ["diagnosis"], "If three or more conditions are found.", "a further visit is planned.", "NO_FOLLOW_UP", "major"),
)

#: More rules, of the other types; with those above every type has one.
MORE_RULES = (
    ("complaints", "required_field", ["primary", "prophylactic"], ["complaints"], None, "Complaints are stated.", "MISSING_COMPLAINTS", "major"),
    ("dynamics", "conditional_required", ["repeat"], ["dynamics", "clinical_context"], None, "A repeat visit states a course or a context.", "NO_DYNAMICS", "major"),
    ("service", "consistency", ["all"], ["service", "visit_type"], None, "All services are of one visit type.", "SERVICE_MISMATCH", "major"),
    ("prescription", "content_analysis", ["all"], ["treatment_plan"], None, "Prescriptions have dose, frequency and duration.", "INCOMPLETE_PRESCRIPTION", "major"),
    ("no_complaints", "prophylactic_exception", ["prophylactic"], ["complaints"], None, "No complaints are needed.", "ALLOW_NO_COMPLAINTS", "minor"),
    ("no_treatment", "allowed_missing", ["prophylactic"], ["treatment_plan"], None, "No treatment is needed.", "ALLOW_NO_TREATMENT", "minor"),
    ("supported", "diagnosis_check", ["primary", "repeat"], ["diagnosis", "complaints"], None, "The diagnosis follows from the record.", "NOT_SUPPORTED", "major"),
)

#: What the name of a patient's or inspection's field holds that fills a target.
TARGET_WORDS = {
    "complaints": ("жалоб",), "anamnesis": ("анамнез",), "objective_exam": ("объектив", "осмотр"), "recommendations": ("рекоменд",), "treatment_plan": ("лечен", "назначен"),
    "investigation_plan": ("обследован", "исследован"), "results": ("результат",), "dynamics": ("динамик",), "clinical_context": ("контекст", "течени"), "state": ("состояни",),
    "follow_up": ("повторн", "контрол", "наблюден"), "companion_info": ("сопровожд", "представител"), "diagnosis_justification": ("обоснован",), "specialty": ("специальн",),
    "patient_age": ("возраст",), "patient_sex": ("пол",),
}
#: Flags of rule files that mean what a predicate finds (fixed values), and all flags that predicates judge.
SAME_FLAGS = {"PLACEHOLDER_VALUE_DETECTED": "PLACEHOLDER", "DUPLICATE_SEMANTIC_BLOCK": "CONFLICT", "SERVICE_VISIT_MISMATCH": "SERVICE_MISMATCH"}
JUDGED = ("PLACEHOLDER", "CONFLICT", "SYMPTOM_CODE", "SERVICE_MISMATCH", "INCOMPLETE_PRESCRIPTION", "NO_FOLLOW_UP", *SAME_FLAGS)
#: The prompt for rules in words, and what stands before the record.
RECORD = "\n\n## Record\n"
TASK = "Judge the record of a visit by each of these rules.\n\n{rules}\n\nAnswer with a JSON array of the rules that it breaks, as {\"flag\": ..., \"issue\": ...}; [] if it breaks none." + RECORD
#: Types of rules that let targets be missing.
EXCEPTIONS = ("prophylactic_exception", "allowed_missing")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON array, with pos in file order."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{RULE_STRUCT}>>").alias("rules"))
    return raw.select(F.posexplode("rules").alias("pos", "r")).select("pos", "r.*")


RULE_STRUCT = ", ".join(part.replace(" ", ":", 1) for part in RULE.replace("struct<visit_types:array<string>,specialties:array<string>,age_group:string>", "@").split(", ")).replace(
    "@", "struct<visit_types:array<string>,specialties:array<string>,age_group:string>"
)


def default_rules(spark: SparkSession, listed: tuple = DEFAULT_RULES) -> DataFrame:
    rows = [
        (pos, i, "house", kind, (types, ["general"], "any"), targets, condition, expectation, flag, severity)
        for pos, (i, kind, types, targets, condition, expectation, flag, severity) in enumerate(listed)
    ]
    return spark.createDataFrame(rows, "pos int, " + RULE)


def save_rules(rules: DataFrame, path: str) -> None:
    """Write rules as the JSON array that load_rules() reads."""
    one = rules.agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*[c for c in rules.columns if c != "pos"]).alias("r")))).alias("l"))
    one.select(F.to_json(F.transform("l", lambda x: x["r"])).alias("value")).coalesce(1).write.text(path)


def visit_type(services: Column) -> Column:
    """The type that the first service's name shows; other without one."""
    name = F.lower(F.get(services, F.lit(0))["name"])
    out = F.when(F.lit(False), "")
    for part, kind in VISIT_TYPES:
        out = out.when(F.contains(name, F.lit(part)), kind)
    return out.otherwise("other")


def _typed(rules: DataFrame, *columns: str) -> DataFrame:
    """A row for each rule and visit type that it applies to."""
    kinds = [k for _, k in VISIT_TYPES] + ["other"]
    typed = rules.select(*columns, F.explode(F.array_distinct("applies_to.visit_types")).alias("visit_type"))
    return typed.withColumn("visit_type", F.explode(F.when(F.col("visit_type") == "all", F.array(*map(F.lit, kinds))).otherwise(F.array("visit_type")))).distinct()


def rules_for(visits: DataFrame, rules: DataFrame) -> DataFrame:
    """visits (visit, visit_type) with each rule for that type or for all, by equi-joins.

    The rules are one small table; each type's rules are joined on the type, so a visit never
    meets a rule of another type.
    """
    return visits.join(_typed(rules, "pos", "rule_id", "flag_code", "condition", "expectation"), "visit_type")


def rule_line(flag: Column, condition: Column, expectation: Column) -> Column:
    """``(FLAG) condition without its last character: expectation``."""
    bare = F.rtrim(condition)
    head = F.when(F.coalesce(condition, F.lit("")) != "", F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(": "))).otherwise("")
    return F.concat(F.lit("("), F.coalesce(flag, F.lit("")), F.lit(") "), head, F.coalesce(expectation, F.lit("")))


def render_rules(selected: DataFrame, key: str = "visit") -> DataFrame:
    """key and rules: one line for each selected rule, in file order."""
    line = rule_line(F.col("flag_code"), F.col("condition"), F.col("expectation"))
    grouped = selected.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return grouped.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("rules"))


def render_template(template: str, name: str, value: Column) -> Column:
    """The template with every {name} replaced."""
    return F.replace(F.lit(template), F.lit("{" + name + "}"), value)


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of blank fields: null, white space, or an empty array or map given as its size 0."""
    blank = lambda c: c.isNull() | (F.regexp_replace(c.cast("string"), r"(?U)\s+", "").isin("", "0"))
    return F.filter(F.array(*[F.when(blank(c), F.lit(name)) for name, c in fields.items()]), lambda x: x.isNotNull())


def finding(flag: Column | str, issue: Column) -> Column:
    return F.struct((F.lit(flag) if isinstance(flag, str) else flag).alias("flag"), issue.alias("issue"))


def placeholder_findings(pairs: Column) -> Column:
    """A finding for each (param, value) whose value only fills the field."""
    held = F.filter(pairs, lambda p: p["value"].rlike(PLACEHOLDER))
    return F.transform(held, lambda p: finding("PLACEHOLDER", p["param"]))


def conflicts(visits: DataFrame, key: str = "visit") -> DataFrame:
    """key and param of fields that a visit fills with different values."""
    pairs = visits.select(key, F.explode("inspection").alias("p")).select(key, "p.param", "p.value")
    return pairs.groupBy(key, "param").agg(F.count_distinct("value").alias("values")).where("values > 1")


def conflict_findings(inspection: Column) -> Column:
    """A finding for each field of a visit (array of param, value) that is filled with different values, in order of first use."""
    params = F.array_distinct(F.transform(inspection, lambda p: p["param"]))
    values = lambda name: F.array_distinct(F.transform(F.filter(inspection, lambda p: (p["param"] == name) & p["value"].isNotNull()), lambda p: p["value"]))
    return F.transform(F.filter(params, lambda name: F.size(values(name)) > 1), lambda name: finding("CONFLICT", name))


def symptom_beside_main(diagnoses: Column, symptom: str = "R") -> Column:
    """Whether a symptom code stands beside a diagnosis of another class."""
    is_symptom = lambda d: F.upper(d["code"]).startswith(symptom)
    return F.exists(diagnoses, is_symptom) & F.exists(diagnoses, lambda d: ~is_symptom(d))


def incomplete_prescription(text: Column) -> Column:
    """Whether a prescription lacks a dose, a frequency or a duration."""
    dose = text.rlike(r"(?iU)\d+\s*(?:mg|ml|мг|мл|г|g)\b")
    often = text.rlike(r"(?iU)\d+\s*(?:times|раза?|x)\b|daily|ежедневно")
    lasting = text.rlike(r"(?iU)\d+\s*(?:days?|weeks?|дн\w*|недел\w*)\b")
    return ~(dose & often & lasting)


def held_names() -> Column:
    """The lower-cased names of the fields of the inspection and the patient that hold something, a line each."""
    some = lambda v: stripped(v) != ""
    named = F.transform(F.filter("inspection", lambda p: some(p["value"])), lambda p: p["param"])
    more = F.transform(F.filter(F.map_entries("patient"), lambda e: some(e["value"])), lambda e: e["key"])
    return F.lower(F.concat_ws("\n", named, more))


def _filled(names: Column, words: tuple[str, ...]) -> Column:
    """Whether one of held_names() has one of the words."""
    return functools.reduce(lambda x, y: x | y, [F.contains(names, F.lit(w)) for w in words])


def missing_targets(names: Column) -> Column:
    """The targets that a nested visit (date, patient, services, diagnoses, inspection) leaves blank. names: its held_names()."""
    service, diagnosis = F.get("services", F.lit(0))["name"], F.coalesce(F.size("diagnoses"), F.lit(0)) > 0
    stated = lambda c: ~stripped(c).isin("", "0")  # noqa: E731  as missing_fields()
    date, size = stated(F.col("date")), lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    held = {"date": date, "visit_date": date, "patient": size("patient"), "service": stated(service), "service_name": stated(service), "inspection": size("inspection")}
    held |= {"diagnosis": diagnosis, "diagnosis_code": diagnosis, "diagnosis_text": diagnosis} | {name: _filled(names, words) for name, words in TARGET_WORDS.items()}
    return F.array_remove(F.array(*[F.when(found, "").otherwise(name) for name, found in held.items()]), "")


def predicates(names: Column | None = None) -> dict[str, Column]:
    """The issues of a nested visit (with visit_type) by the flags of rules that need no model; SAME_FLAGS has more names of them. names: its held_names()."""
    none = F.array().cast("array<string>")
    one = lambda when, issue: F.when(when, F.array(issue)).otherwise(none)
    issues = lambda findings: F.coalesce(F.transform(findings, lambda f: f["issue"]), none)
    kinds = F.array_distinct(F.filter(F.transform("services", lambda s: visit_type(F.array(s))), lambda k: k != "other"))
    treated = F.filter("inspection", lambda p: F.exists(F.array(*map(F.lit, TARGET_WORDS["treatment_plan"])), lambda w: F.contains(F.lower(p["param"]), w)))
    return {
        "PLACEHOLDER": issues(placeholder_findings(F.col("inspection"))),
        "CONFLICT": issues(conflict_findings(F.col("inspection"))),
        "SYMPTOM_CODE": one(symptom_beside_main(F.col("diagnoses")), F.lit("symptom code beside a main diagnosis")),
        "SERVICE_MISMATCH": one(F.size(kinds) > 1, F.array_join(kinds, ", ")),
        "INCOMPLETE_PRESCRIPTION": F.coalesce(F.transform(F.filter(treated, lambda p: incomplete_prescription(p["value"])), lambda p: p["param"]), none),
        "NO_FOLLOW_UP": one((F.size("diagnoses") >= 3) & ~_filled(held_names() if names is None else names, TARGET_WORDS["follow_up"]), F.lit("follow_up")),
    }


def _rules_by_type(rules: DataFrame, same: dict[str, str]) -> DataFrame:
    """visit_type, ``_rules`` (kind, targets, flag, judge) in order and ``_known``, all flags: what of the rules depends on no visit.

    The targets that a type's exceptions let be blank are left out here, and ``judge`` is the predicate's flag.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "rule_type", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), "flag_code")))
    by_type = _typed(rules, "pos", "rule_type", "targets", "flag_code").groupBy("visit_type").agg(listed.alias("l"))
    by_type = by_type.withColumn("allowed", F.flatten(F.transform(F.filter("l", lambda r: r["rule_type"].isin(*EXCEPTIONS)), lambda r: r["targets"])))
    allowed = lambda t: F.coalesce(F.array_contains("allowed", t), F.lit(False))
    kind = lambda r: F.when(r["rule_type"] == "required_field", 0).when(r["rule_type"] == "conditional_required", 1).otherwise(2)
    judge = lambda r: functools.reduce(lambda c, x: c.when(r["flag_code"] == x, same[x]), same, F.when(F.lit(False), "")).otherwise(r["flag_code"])
    left = F.filter("l", lambda r: ~F.coalesce(r["rule_type"].isin(*EXCEPTIONS), F.lit(False)) & ~((kind(r) == 1) & F.exists(r["targets"], allowed)))
    targets = lambda r: F.when(kind(r) == 0, F.filter(r["targets"], lambda t: ~allowed(t))).otherwise(r["targets"])
    each = F.transform(left, lambda r: F.struct(kind(r).alias("kind"), targets(r).alias("targets"), r["flag_code"].alias("flag"), judge(r).alias("judge")))
    return by_type.select("visit_type", each.alias("_rules"), F.transform("l", lambda r: r["flag_code"]).alias("_known"))


def check_visits(visits: DataFrame, rules: DataFrame, flags: dict[str, Column] | None = None, said: Column | None = None) -> DataFrame:
    """visits (nested, with visit_type) with ``findings`` of the rules that apply to them, in the order of the rules.

    By rule_type: required_field finds each blank target; conditional_required finds that all its
    targets are blank; the exceptions let their targets be blank; rules of other types find what
    the predicate of their flag does (see predicates(); callers may give their own), and without
    one what a scorer ``said`` of that flag (an array of flag and issue; see model_findings()). What
    was said of other flags comes last. Each visit meets one row: the rules of its type, one of four.
    What is blank and what predicates find is made once for a visit, below that join, so nothing of it is made again for a rule.
    """
    none, made = F.array().cast("array<struct<flag:string,issue:string>>"), predicates(F.col("_names")) if flags is None else flags
    facts = F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values()))
    judged = visits.withColumn("_names", held_names()).withColumns({"_missing": missing_targets(F.col("_names")), "_facts": facts, "_said": none if said is None else F.coalesce(said, none)})
    joined = judged.join(F.broadcast(_rules_by_type(rules, SAME_FLAGS if flags is None else {})), "visit_type", "left")  # one row for each visit type

    def one(r: Column) -> Column:
        each = lambda items: F.transform(items, lambda i: finding(r["flag"], i))
        blank = F.size(F.array_except(r["targets"], F.col("_missing"))) == 0
        spoken = none if said is None else F.filter("_said", lambda f: f["flag"] == r["flag"])
        return (
            F.when(r["kind"] == 0, each(F.filter(r["targets"], lambda t: F.array_contains("_missing", t))))
            .when(r["kind"] == 1, F.when(blank, F.array(finding(r["flag"], F.array_join(r["targets"], ", ")))).otherwise(none))
            .otherwise(F.coalesce(each(F.try_element_at("_facts", r["judge"])), spoken, none))
        )

    found = F.flatten(F.transform("_rules", one))
    if said is not None:
        found = F.concat(found, F.filter("_said", lambda f: ~F.array_contains("_known", f["flag"])))
    return joined.withColumn("findings", F.coalesce(found, none)).drop("_rules", "_known", "_names", "_missing", "_facts", "_said")


def model_rules(rules: DataFrame, flags: tuple[str, ...] = JUDGED) -> DataFrame:
    """The rules that check_visits() cannot judge by itself: they go to a scorer as text."""
    return rules.where(~F.col("rule_type").isin("required_field", "conditional_required", *EXCEPTIONS) & ~F.col("flag_code").isin(*flags))


def model_findings(visits: DataFrame, rules: DataFrame, make_scorer: Callable[[], scoring.Scorer], store: str | None = None) -> DataFrame:
    """(visit, said, error) of nested visits (with visit_type): what a scorer finds by the model_rules() of their type.

    A prompt is TASK with the rules of a visit type (see render_rules()) and the visit's record as
    JSON. Equal prompts are scored once, and kept answers not again (see answers). An answer is
    an array of flag and issue, or an object with such ``findings``, maybe fenced; anything else finds nothing.
    Visits of a type without such rules are not asked about.
    """
    typed = _typed(model_rules(rules), "pos", "flag_code", "condition", "expectation")
    heads = render_rules(typed, "visit_type").select("visit_type", render_template(TASK, "rules", F.col("rules")).alias("_head"))
    record = F.to_json(F.struct("date", "patient", "services", "diagnoses", "inspection"))
    asked = visits.join(F.broadcast(heads), "visit_type")  # one row for each visit type
    asked = asked.select("visit", F.concat("_head", record).alias("text")).select("visit", "text", answers.content_id(F.col("text")).alias("id"))
    found = answers.score_each(asked, make_scorer, ["visit"], store)
    out = found.select("visit", json_text.parse_findings(F.col("answer")).alias("said"), "error")
    out._reads = (found,)
    return out


def offline_rule_checker() -> scoring.Scorer:
    """A scorer without a model: NOT_SUPPORTED, if it is asked for, where a record has diagnoses and none of them is new."""

    def judge(prompt: str) -> dict:
        said, record = prompt.split(RECORD, 1)
        new = [bool(d.get("first_time")) for d in json.loads(record).get("diagnoses") or []]
        return {"findings": [{"flag": "NOT_SUPPORTED", "issue": "no diagnosis is new"}] if "(NOT_SUPPORTED)" in said and new and not any(new) else []}

    return lambda texts: [(json.dumps(judge(t)), "stop") for t in texts]
