from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import http.client
import io
import math
import random
import re
import types
import zlib

import numpy as np
import pytest
from auditmill.llm import chat, decontaminate, exact_dedup, line_dedup, minhash_dedup, mixing, pii, token_counts, toxicity, warc
from auditmill.llm.shared import shared_path
from pyspark.sql import functions as F

from tests.llm import helpers as h


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(h.rows(), h.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], h.SCHEMA)


def simple(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# 2: near-duplicates


def test_near_duplicates_agree_with_brute_force(docs):
    got = {(r.doc_id, r.n_shingles): r for r in minhash_dedup.near_duplicates(docs, percent=85).collect()}
    known = [(r[0], r[1]) for r in h.rows() if r[0] is not None]
    want = h.near_components(known, 85)
    for i, t in known:
        r = got[i, len(h.shingles(t))]
        assert r.component_id == want[i] and r.kept == (want[i] == i)
    assert all(r.component_id is None and r.kept for (i, _), r in got.items() if i is None)


def test_near_duplicates_of_chains_and_many_edits(spark):
    random.seed(3)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        for _ in range(40):
            words = list(base)
            for _ in range(random.choice((1, 2, 3, 3, 4))):
                words[random.randrange(100)] = f"e{random.randrange(10**6)}"
            texts.append(" ".join(words))
        chain = list(base)
        for k in range(12):  # each text is near its neighbours only
            chain = chain[3:] + [f"g{g}c{k}x{j}" for j in range(3)]
            texts.append(" ".join(chain))
    random.shuffle(texts)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(simple(spark, texts), percent=85).collect()}
    assert got == h.near_components(list(enumerate(texts)), 85)


def family(count, words, changes):
    """Copies of one text that is not among them, each with a few other words."""
    base = [f"b{i}" for i in range(words)]
    for _ in range(count):
        new = list(base)
        for k in random.sample(range(words), changes):
            new[k] = f"e{random.randrange(10**9)}"
        yield " ".join(new)


@pytest.mark.parametrize(("changes", "some"), [(4, True), (6, False)])
def test_families_near_the_threshold(spark, monkeypatch, changes, some):
    """Families of which few or no pairs are linked: components are exact, and tests grow with the texts, not with their pairs."""
    tested, linked, probed = [], minhash_dedup._linked, minhash_dedup._probed

    def count_hubs(pairs, *rest):
        tested.append(pairs.count())
        return linked(pairs, *rest)

    def count_probes(asking, probes, *rest):
        tested.append(asking.select("hub", "comp").join(probes.select("hub", F.col("comp").alias("other")), "hub").where("comp <> other").count())
        return probed(asking, probes, *rest)

    monkeypatch.setattr(minhash_dedup, "_linked", count_hubs)
    monkeypatch.setattr(minhash_dedup, "_probed", count_probes)
    random.seed(21)
    texts = list(family(500, 400, changes))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(simple(spark, texts), percent=85).collect()}
    assert got == h.near_components(list(enumerate(texts)), 85)
    assert (len(set(got.values())) < 250) == some
    assert sum(tested) < 60 * len(texts)


def test_drop_near_duplicates_keeps_columns_and_empty_texts(docs, none):
    kept = minhash_dedup.drop_near_duplicates(docs, percent=85)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 4, 5, 6, 7, 8, 9, 11, None} <= ids and not {2, 3, 10, 12} & ids
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_circulant_signature_estimates_similarity():
    words = minhash_dedup._Words()
    a, b = (minhash_dedup.shingles(t, words) for t in (h.edited(1), h.edited(2)))
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = minhash_dedup.signature(a, 512) == minhash_dedup.signature(b, 512)
    assert abs(same.mean() - exact) < 0.08


# 4: exact duplicates


def test_exact_dedup(docs, none):
    groups: dict[str, list] = {}
    for r in h.rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(h.rows())
    by_sha = {h.sha(t): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (largest, len(ids), r.doc_id == largest)
    assert exact_dedup.exact_dedup(none).count() == 0
    other = exact_dedup.exact_dedup(docs.repartition(5), runs=9, ways=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, other), key=str)


def test_exact_dedup_of_tasks_with_several_batches(spark):
    """A task's entries come in more than one batch in every round, also in the first one, whose counts are never null."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text"))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = spark.conf.get(conf)
    spark.conf.set(conf, "20")
    try:
        got = exact_dedup.exact_dedup(docs, runs=4, ways=2).collect()
    finally:
        spark.conf.set(conf, most)
    last = {n: max(range(n, 2000, 700)) for n in range(700)}
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(n, last[n % 700], len(range(n % 700, 2000, 700)), n == last[n % 700]) for n in range(2000)]


# 5: mixing


def test_mix_shares_and_draws(spark):
    random.seed(1)
    rows = [(i, " ".join(["w"] * random.randint(1, 60)), random.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    own: dict = {}
    for r in got:
        own.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 2
    total = sum(r.size for r in got)
    weights = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    sizes = {s: rs[0].source_size for s, rs in own.items()}
    target, open_ = {}, set(sizes)
    while True:
        level = (1.5 * total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= {s: weights[s] * level for s in open_}
    for s, rs in own.items():
        assert rs[0].target == pytest.approx(target[s])
        assert rs[0].target == pytest.approx(target[s])
        # A draw for each document: the noise is that of separate draws; with spread draws it is about one document.
        part = target[s] / sizes[s] % 1
        noise = (part * (1 - part) * sum(r.size**2 for r in rs)) ** 0.5
        assert sum(r.copies * r.size for r in rs) == pytest.approx(target[s], abs=4 * noise + 1)
        for r in rs:
            u = int(hashlib.md5(f"mix-1|{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
            assert r.copies == int(target[s] / sizes[s]) + (u < part)
    spread: dict = {}
    for r in mixing.mix(docs, draw="spread").collect():
        spread[r.source] = spread.get(r.source, 0) + r.copies * r.size
    assert all(spread[s] == pytest.approx(target[s], abs=130) for s in target)
    for draw in ("hash", "spread"):
        assert sorted(map(tuple, mixing.mix(docs, draw=draw).collect()), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7), draw=draw).collect()), key=str)
    with pytest.raises(ValueError, match="draw"):
        mixing.mix(docs, draw="other")


def test_mix_hard_cases(docs, none):
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(h.rows()) and all(r.copies == 0 or r.source_size > 0 for r in plan)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*[c for c in docs.columns if c != "copy_no"], "copy_no"]
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# 7: lines


def test_line_dedup_agrees_with_brute_force(docs, none):
    known = {r[0]: r[1] for r in h.rows() if r[0] is not None}
    want = h.line_dedup(list(known.items()))
    done = line_dedup.line_dedup(docs)
    got = done.select("doc.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert len(got) == len(h.rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id]
        else:
            assert r.n_dropped == 0
    assert done.select("doc.*").columns == docs.columns
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_threshold(spark):
    docs = simple(spark, ["shared line one\nshared line two", "shared line one", "shared line one\nshared line two"])
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(docs, min_docs=3).select("doc.doc_id", "kept_text").collect()}
    assert got == {0: "shared line one\nshared line two", 1: "", 2: "shared line two"}


def test_line_dedup_stays_native(docs):
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 3: decontamination


def test_decontamination_agrees_with_brute_force(spark, none):
    random.seed(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.randint(12, 70))) + ". " + " ".join(random.choices(vocabulary, k=6)) + ".") for i in range(60)]
    items += [(100, None), (101, ""), (102, "two words"), (103, items[0][1])]
    texts = []
    for n in range(120):
        words = random.choices(vocabulary, k=random.randint(0, 400))
        if n % 4 == 0:
            item = random.choice(items[:60])[1].split()
            cut = random.choice((1.0, 0.9, 0.85, 0.7))
            at = random.randint(0, len(words))
            words[at:at] = item[: int(len(item) * cut)]
        texts.append(" ".join(words).upper() if n % 3 == 0 else " ".join(words))
    texts += [None, "", "x two words y", "two", "two words"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contaminated(simple(spark, texts), decontaminate.split_items(bench)).collect()
    grams = {i: h.shingles(t) for i, t in items if t}
    halves = {i: re.match(r"(?s)^(.*[.!?])\s+(\S.*)$", t) for i, t in items if t}
    sides = {i: {"question": m[1], "answer": m[2]} if m else {"question": dict(items)[i]} for i, m in halves.items()}
    for r in found:
        words = (texts[r.doc_id] or "").encode().lower().split()
        want = []
        for i, g in grams.items():
            k = len(next(iter(g)))
            half = 76
            passages = [words[a : a + 2 * half] for a in range(0, max(1, len(words) - half), half)]
            held = lambda g, k: max((len(g & {tuple(p[j : j + k]) for j in range(len(p) - k + 1)}) / len(g) for p in passages), default=0)  # noqa: B023, E731
            flags = []
            for side, text in sides[i].items():
                flags += [side] * (len(text.split()) >= 13 and held(h.shingles(text), 5) >= 0.8)
            if flags or held(g, k) >= 0.8:
                want.append((i, "both" if len(flags) == 2 else flags[0] if flags else "whole"))
        assert [(m.item_id, m.by) for m in r.matches] == sorted(want)
    assert decontaminate.find_contaminated(none, decontaminate.split_items(bench)).count() == 0
    empty = decontaminate.split_items(spark.createDataFrame([], "item_id long, text string"))
    assert decontaminate.drop_contaminated(simple(spark, texts), empty).count() == len(texts)


def test_decontamination_shards_and_columns(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(h.BASE.split()[20:60])), (2, "nothing like it at all here")], "item_id long, text string")
    split = decontaminate.split_items(items)
    whole = [(r.doc_id, [m.item_id for m in r.matches]) for r in decontaminate.find_contaminated(docs, split).collect()]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 10)
    assert len(list(decontaminate.shards(split))) >= 2
    assert whole == [(r.doc_id, [m.item_id for m in r.matches]) for r in decontaminate.find_contaminated(docs, split).collect()]
    kept = decontaminate.drop_contaminated(docs, split)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, m in whole if not m} and (1, [1]) in whole and (2, [1]) in whole


def test_decontamination_by_one_side(spark):
    said = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    items = spark.createDataFrame([(1, said("q", 30), said("a", 30)), (2, said("r", 30), "yes indeed"), (3, said("s", 4), said("t", 4))], "item_id long, question string, answer string")
    texts = [f"x {said('q', 30)} y", f"x {said('a', 30)} y", f"{said('q', 30)} {said('a', 30)}", "well yes indeed so", f"{said('r', 26)}", f"{said('s', 4)} {said('t', 4)}", said("t", 4), said("q", 20)]
    found = decontaminate.find_contaminated(simple(spark, texts), items).collect()
    assert {r.doc_id: [(m.item_id, m.by) for m in r.matches] for r in found} == {
        0: [(1, "question")], 1: [(1, "answer")], 2: [(1, "both")], 3: [], 4: [(2, "question")], 5: [(3, "whole")], 6: [], 7: [],
    }
    first = found[0].matches[0] if found[0].doc_id == 0 else next(r for r in found if r.doc_id == 0).matches[0]
    assert first.question_overlap == 1.0 and first.answer_overlap == 0.0 and first.overlap < 0.8


@pytest.mark.parametrize("cells", [1, 100, 1 << 22])
def test_pivots_find_what_full_scores_find(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    random.seed(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, random.choices(words, k=random.randint(3, 40)), random.choice((0, 2, 15))) for i in range(150)]
    items = [(i, w, min(q, len(w))) for i, w, q in items]
    df = {w: sum(w in set(x) for _, x, _ in items) for w in words}
    shard = decontaminate.Shard(items, {w: n for w, n in df.items() if n}, len(items), sum(len(w) for _, w, _ in items) / len(items))
    scores = {}
    for t in range(len(shard.vocabulary)):
        for p in range(shard.post_start[t], shard.post_start[t + 1]):
            scores[t, shard.post_entry[p]] = shard.post_impact[p]
    passages = np.array([[random.randrange(-1, len(shard.vocabulary)) for _ in range(30)] for _ in range(200)])
    got = {(r, e): s for r, e, s in shard.candidates(passages)}
    want = {(r, e): s for r, p in enumerate(passages) for e in range(len(shard.entry_item)) for s in [sum(scores.get((t, e), 0) for t in set(p.tolist()) if t >= 0)] if s >= decontaminate.CANDIDATE}
    assert set(got) == set(want) and want and all(abs(got[k] - want[k]) < 1e-9 for k in got)


# 1: pseudonyms


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def pseudonyms(spark, texts, key="k"):
    return {r.doc_id: r for r in pii.pseudonymise(simple(spark, texts), key).collect()}


def test_pseudonyms_keep_form_validity_and_links(spark):
    texts = [
        "4539148803436467", "4539 1488 0343 6467!", "1234567812345678", "+1 (743) 555-3824", "call +1 (743) 555-3824 now", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432",
        "123-45-6789", "666-12-1234", "1980-02-29", "31.12.2001", "12/31/1999", "2023-02-30", "10.20.30.40", "999.1.1.1", "Jo.9@mail5.example.com", "jo.9@MAIL5.example.com x", None, "", "7 cats",
    ]
    got = pseudonyms(spark, texts)
    digits = lambda s: re.sub(r"\D", "", s)
    assert luhn(digits(got[0].text)) and digits(got[0].text) == digits(got[1].text) != "4539148803436467"
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}!", got[1].text)
    assert got[4].text == f"call {got[3].text} now" and re.fullmatch(r"\+1 \(743\) [2-9]\d\d-\d{4}", got[3].text) and got[3].text != texts[3]
    assert iban(got[5].text) and got[5].text[:2] == "DE" and len(got[5].text) == len(texts[5]) and iban(got[6].text) and got[6].text[4:8] == "WEST"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[7].text) and got[7].text != texts[7]
    for k, form in ((9, r"\d{4}-\d\d-\d\d"), (10, r"\d\d\.\d\d\.\d{4}"), (11, r"\d\d/\d\d/\d{4}")):
        assert re.fullmatch(form, got[k].text) and got[k].n_date == 1
    assert all(0 <= int(x) <= 255 for x in got[13].text.split("."))
    assert got[15].text.split("@")[0] == got[16].text.split("@")[0] and got[15].text.endswith("@mail5.example.com")
    for k in (2, 8, 12, 14, 17, 18, 19):  # not valid, or nothing to find
        assert got[k].text == texts[k] and not any(got[k][f"n_{x}"] for x in pii.KINDS)
    assert pseudonyms(spark, ["4539148803436467"], "other")[0].text != got[0].text


def test_pseudonyms_of_finds_side_by_side(spark):
    card, grouped, bank = "4539148803436467", "4539 1488 0343 6467", "AT61 1904 3002 3457 3201"
    alone = pseudonyms(spark, [card, grouped, bank, "+33 1 23 45 67 89", "+49 30 1234567", "123-45-6789", "1980-02-29", "+1 743-555-3824"])
    new = {r: alone[k].text for k, r in enumerate([card, grouped, bank, "+33 1 23 45 67 89", "+49 30 1234567", "123-45-6789", "1980-02-29", "+1 743-555-3824"])}
    assert all(old != text for old, text in new.items()) and iban(new[bank])
    assert re.fullmatch(r"\+33 \d \d\d \d\d \d\d \d\d", new["+33 1 23 45 67 89"]) and re.fullmatch(r"\+49 \d\d \d{7}", new["+49 30 1234567"])
    forms = [
        f"card {card} 12/27", f"row 7 {card}", f"{bank} EUR", f"{grouped} 123", f"7 1234 {grouped} 55", f"{card} 123-45-6789", f"{card} 1980-02-29 {bank} EUR 4 {grouped}",
        f"AB12 {grouped}", f"+49 30 1234567 {grouped}", f"+49 30 1234567 1980-02-29", "+33 1 23 45 67 89 12", f"{card}/{card}", f"{bank} {bank} {card}", f"12th {card}, in 1999. {card} The",
    ]
    got = pseudonyms(spark, forms + ["+1 743 555 3824", "1 " * 20_000 + card])
    for k, form in enumerate(forms):
        want = form
        for old in sorted(new, key=len, reverse=True):
            want = want.replace(old, "\0".join(new[old]))
        assert got[k].text == want.replace("\0", ""), form
    assert got[6].n_card == 2 and got[6].n_iban == 1 and got[6].n_date == 1
    assert re.sub(r"\D", "", got[len(forms)].text) == re.sub(r"\D", "", new["+1 743-555-3824"])
    assert got[len(forms) + 1].text == "1 " * 20_000 + new[card]


def test_pseudonyms_agree_with_a_plain_version(spark):
    """The network and every form once more, digit by digit."""

    def permuted(value, a, b, tweak):
        left, right = divmod(value, b)
        for i in range(1, pii.ROUNDS + 1):
            x = right if i % 2 else left
            keyed = int(hashlib.sha256(f"k|{tweak}|{a}|{b}|{i}|{x}".encode()).hexdigest()[:15], 16)
            left, right = ((left + keyed) % a, right) if i % 2 else (left, (right + keyed) % b)
        return left * b + right

    def digits(text, tweak):
        n = len(text)
        return str(permuted(int(text), 10 ** (n // 2), 10 ** (n - n // 2), tweak)).zfill(n) if n else ""

    def card(text):
        moved = text[0] + digits(text[1:-1], "card")
        return next(moved + str(c) for c in range(10) if luhn(moved + str(c)))

    def day(text, form):
        origin = datetime.date(1900, 1, 1)
        old = (datetime.datetime.strptime(text, form).date() - origin).days
        return (origin + datetime.timedelta(permuted(old, *pii.DAYS, "date"))).strftime(form)

    def ip(text):
        v = permuted(int.from_bytes(bytes(map(int, text.split("."))), "big"), 65536, 65536, "ip")
        return ".".join(map(str, v.to_bytes(4, "big")))

    def phone(text):
        seven = int(text[-7:])
        new = permuted(seven - 2_000_000, 8_000, 1_000, "phone") + 2_000_000 if seven >= 2_000_000 else permuted(seven, 2_000, 1_000, "phone0")
        return text[:-7] + str(new).zfill(7)

    def ssn(text):
        areas = [x for x in range(1, 900) if x != 666]
        a, g, n = (int(x) for x in text.split("-"))
        v = permuted((areas.index(a) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, "ssn")
        return f"{areas[v // 9999 // 99]:03}-{v // 9999 % 99 + 1:02}-{v % 9999 + 1:04}"

    def bank(text):
        own = "".join(c for c in text[4:] if c.isdigit())
        new = iter(digits(own[:16], "iban1") + digits(own[16:], "iban2"))
        rest = "".join(next(new) if c.isdigit() else c for c in text[4:])
        return next(f"{text[:2]}{k:02}{rest}" for k in range(2, 99) if iban(f"{text[:2]}{k:02}{rest}"))

    random.seed(8)
    some = lambda n: "".join(random.choices("0123456789", k=n))
    cases = []
    for n in (13, 15, 16, 19):
        cases += [(t, card(t)) for t in [next(m + str(c) for c in range(10) if luhn(m + str(c))) for m in ["4" + some(n - 2) for _ in range(5)]]]
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        cases += [(t, day(t, form)) for t in [datetime.date(1900 + random.randrange(200), random.randint(1, 12), random.randint(1, 28)).strftime(form) for _ in range(5)]]
    cases += [("31/12/2001", day("31/12/2001", "%d/%m/%Y")), ("13/01/1999", day("13/01/1999", "%d/%m/%Y"))]
    cases += [(t, ip(t)) for t in [".".join(str(random.randrange(256)) for _ in range(4)) for _ in range(5)]]
    cases += [(f"+33{t}", f"+33{phone(t)}") for t in ["1" + some(8) for _ in range(5)]]
    cases += [(t, ssn(t)) for t in ["665-01-0001", "667-99-9999", "001-01-0001", "899-50-1234"]]
    cases += [(t, bank(t)) for t in ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]]
    got = pseudonyms(spark, [old for old, _ in cases])
    assert {k: got[k].text for k in got} == {k: new for k, (_, new) in enumerate(cases)}
    first = {r.doc_id: r.text for r in pii.pseudonymise(simple(spark, ["03/04/2001", "12/31/1999", "2001-04-03"]), "k", day_first=True).collect()}
    assert first == {0: day("03/04/2001", "%d/%m/%Y"), 1: day("12/31/1999", "%m/%d/%Y"), 2: day("2001-04-03", "%Y-%m-%d")}


def test_permutation_is_one_to_one(spark):
    frame = spark.range(17 * 43).select("id", pii.permuted(F.col("id"), 17, 43, "k", "t").alias("p"))
    assert sorted(r.p for r in frame.collect()) == list(range(17 * 43))
    days = spark.range(0, 73049).select(pii.permuted(F.col("id"), *pii.DAYS, "k", "date").alias("p"))
    assert days.distinct().count() == 73049 and days.agg(F.min("p"), F.max("p")).first()[:] == (0, 73048)


def test_pseudonyms_hard_cases(docs, none):
    plan = pii.pseudonymise(docs, "k")
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
    assert plan.count() == len(h.rows()) and pii.pseudonymise(none, "k").count() == 0
    assert {r.text for r in plan.where("doc_id = 9").collect()} == {h.LONG}


# 8: token counts


def test_token_counts_agree_with_the_tokenizer(spark, docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("▁a", -1.5), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁ab", -3.5), ("aba", -6.0), ("ba", -4.0), ("bb", -3.0), ("\n", -1.0)] + [(f"<0x{i:02X}>", -9.0) for i in range(256)]
    real = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    real.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    random.seed(2)
    texts = ["".join(random.choice("aabb  c\né▁🎉") for _ in range(random.randint(0, 40))) for _ in range(500)] + ["", " ", None, "ab" * 5000]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(simple(spark, texts), vocabulary).collect()}
    assert got == {i: len(real.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}
    assert token_counts.token_counts(docs, vocabulary).count() == len(h.rows()) and token_counts.token_counts(none, vocabulary).count() == 0


def test_pieces_of_several_marks():
    """As Viterbi over whole texts: runs of spaces, and marks within and at the end of pieces."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    for more in ([("▁▁", -2.0), ("▁▁▁▁", -3.0)], [("▁▁", -2.5), ("b▁", -1.0), ("a▁b", -1.5), ("\n▁▁", -2.0)]):
        vocabulary = [("<unk>", 0.0), ("▁", -2.0), ("▁a", -1.5), ("a", -2.0), ("b", -2.0), ("ab", -3.5), ("▁ab", -3.0), ("\n", -1.0), *more] + [(f"<0x{i:02X}>", -9.0) for i in range(256)]
        real = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
        real.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
        random.seed(9)
        texts = ["".join(random.choice("aab   \n▁") for _ in range(random.randint(1, 40))) for _ in range(800)] + ["a" + " " * 16 + "b", " ", "   ", "b ", "a b"]
        counter = token_counts.Counter(vocabulary)
        assert [counter.total(t) for t in texts] == [len(real.encode(t, add_special_tokens=False).ids) for t in texts]
    whole = token_counts.Counter(token_counts.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model"))
    assert whole.total("x" + " " * 16 + "y") == whole.count("▁x" + "▁" * 16 + "y") < 10


def test_reserved_pieces_are_no_text(spark):
    vocabulary = token_counts.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in vocabulary} and len(vocabulary) > 30_000


# 6: toxicity


def test_toxicity_learns_and_calibrates(spark, none):
    random.seed(4)
    plain = [f"p{i}" for i in range(300)]
    rude = ["grub", "slime", "oaf"]
    rows, labels = [], []
    for i in range(1500):
        words = random.choices(plain, k=random.randint(5, 60))
        toxic = i % 6 == 0
        for _ in range(len(words) // 10 + 1 if toxic else 0):
            words[random.randrange(len(words))] = random.choice(rude).upper() + "!"
        rows.append((i, " ".join(words), "kept"))
        labels.append((i, int(toxic) if i % 50 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame(labels + [(3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    train = toxicity.training_rows(docs, known)
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in train.select("doc_id").collect()} == {1, 2, 3, 4}
    assert 3 not in {r.doc_id for r in train.collect()}
    model = toxicity.fit(train, rounds=5)
    assert set(rude) <= set(model.lexicon)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scores) == 1500 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5}
    hard = spark.createDataFrame(h.rows(), h.SCHEMA)
    assert toxicity.score(hard, model).where("score IS NOT NULL").count() == len(h.rows())
    assert toxicity.drop_toxic(none, model).count() == 0


def plain_features(text, lexicon):
    """The features of a text, word by word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, seen = len(words), []
    for w in words:
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", w).casefold()
        weight = lexicon.get(bare, 0.0)
        plain = re.sub(r"[\W_]", "", bare.translate(toxicity.LOOKALIKE))
        hidden = not weight and (plain in lexicon or re.sub(r"([^\W\d_])\1\1", r"\1", plain) in lexicon)
        letters, upper = sum(c.isalpha() for c in w), sum(c.isupper() for c in w)
        seen.append((
            weight, hidden, bare in toxicity.SECOND_PERSON, letters, upper, letters > 1 and letters == upper, sum(c in "!?" for c in w),
            len(re.findall(r"[^\w\s]", w)), bool(re.search(r"[^\W\d_][\d*@$!|._\-]+[^\W\d_]", bare)), bool(re.search(r"([^\W\d_])\1\1", bare)), w,
        ))
    total = lambda k: sum(x[k] for x in seen)
    hit, you = [i for i, x in enumerate(seen) if x[0] or x[1]], [i for i, x in enumerate(seen) if x[2]]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hit) / len(hit) if hit and you else 0.0
    known = [x for x in seen if x[0]]
    return [
        math.log1p(n), len(known) / n, len(known), len({x[-1] for x in known}), max(x[0] for x in seen), total(0), total(0) / n, total(1) / n, near, total(2) / n,
        total(4) / max(1, total(3)), total(5) / n, total(6) / n, total(7) / n, total(8) / n, total(9) / n,
    ]


def plain_tree(lines, values):
    """What a printed decision tree says for the values of the features."""
    head = lines[0].strip()
    if head.startswith("Predict:"):
        return float(head.removeprefix("Predict:"))
    depth = len(lines[0]) - len(lines[0].lstrip())
    other = next(k for k in range(1, len(lines)) if len(lines[k]) - len(lines[k].lstrip()) == depth)
    number, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", head).groups()
    return plain_tree(lines[1:other] if values[int(number)] <= float(limit) else lines[other + 1 :], values)


def test_toxicity_agrees_with_a_plain_scorer(spark):
    random.seed(14)
    plain, rude = [f"p{i}" for i in range(100)] + ["you", "Your", "fooood", "a-b", "A1", "_x_", "NO!", "été,"], ["grub", "slime", "oaf"]
    rows = []
    for i in range(600):
        words = random.choices(plain, k=random.randint(0, 40))
        for _ in range(len(words) // 6 + 1 if i % 4 == 0 else 0):
            words.insert(random.randint(0, len(words)), random.choice([*rude, "sl1me", "GRUB!!", "oaf.", "gruuub"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), rounds=4)
    texts = [t for _, t, _ in rows[:150]] + [None, "", "!!! ???", "sl1me you"]
    trees = [[line for line in t.toDebugString.split("\n")[1:] if line.strip()] for t in model.trees.trees]
    got = {r.doc_id: r.score for r in toxicity.score(simple(spark, texts), model).collect()}
    for k, text in enumerate(texts):
        values = plain_features(text, model.lexicon)
        margin = sum(w * plain_tree(t, values) for w, t in zip(model.trees.treeWeights, trees, strict=True))
        want = float(np.interp(margin, model.curve.boundaries.toArray(), model.curve.predictions.toArray()))
        assert got[k] == pytest.approx(min(1.0, max(0.0, want)), abs=1e-9), text


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, model).count() == len(h.rows())


# 9: chat


def chats(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.format_chats(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>x", "\\", "a\\\\<\\|im_end|>", "<<SYS>>\\n", "", None, "é🎉\n\n", "<|im_end", "\\<|image|>"]
    rows = [(1, i, ("user", "assistant", None, "a\nb<s>")[i % 4], t) for i, t in enumerate(hard)] + [(2, None, "assistant", "x"), (2, 0, "user", "y"), (2, 0, "user", "y"), (None, 0, "assistant", "z")]
    out = chats(spark, rows)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    read = out.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.conv_id: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(("user", "assistant", "", "a\nb<s>")[i % 4], t or "") for i, t in enumerate(hard)]
    assert got[1].l == [t or "" for i, t in enumerate(hard) if i % 4 == 1]
    assert [(t.role, t.text) for t in got[2].t] == [("assistant", "x"), ("user", "y"), ("user", "y")] and got[None].l == ["z"]
    raw = got[1].formatted.encode()
    assert raw.count(b"<|im_end|>") == len(hard)
    assert [raw[s.start : s.start + s.length].decode() for s in got[1].loss_spans][0] == "<\\|im_end|>\n<\\|im_start|>x"


def test_chat_parts(spark):
    parts = [("text", "look <|image|> ", None, None), ("image", None, "i1", 3), ("audio", None, "a1", None), ("document", None, "d1", 2), ("video", "?", None, None), ("text", None, None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_chats(turns).first()
    assert "look <\\|image|> <|image|><|audio|><|document|><|im_end|>" in r.formatted
    assert [(a.turn_no, a.type, a.ref, a.expanded_tokens) for a in r.attachments] == [(1, "image", "i1", 768), (1, "audio", "a1", 25), (1, "document", "d1", 1024)]
    assert r.expanded_tokens == 768 + 25 + 1024
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_no_control_string_comes_of_parts(spark):
    """Every split of every control string over two and three text parts, with empty and dropped parts between."""
    control = ["</s>", "<s>", "<<SYS>>", "<</SYS>>", "<|im_end|>\n<|im_start|>assistant\n", "[INST]", "[/INST]", "<|reserved_token_0|>", "<|image|>"]
    text = lambda t: ("text", t, None, None)
    cases = [[text(c[:i]), text(c[i:])] for c in control for i in range(len(c) + 1)]
    cases += [[text(c[:i]), text(None), ("video", "?", None, None), text(c[i:j]), text(c[j:])] for c in control for i in range(1, min(6, len(c))) for j in range(i, len(c))]
    rows = [(n, 0, "user", p) for n, p in enumerate(cases)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.format_chats(turns)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    for n, parts in enumerate(cases):
        whole = "".join(p[1] or "" for p in parts if p[0] == "text")
        assert [(t.role, t.text) for t in got[n].t] == [("user", whole)]
        assert got[n].formatted.count("<|") == 2 and "[INST]" not in got[n].formatted and "<s>" not in got[n].formatted


# 10: WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "é\r\n\r\nWARC/1.1", "<p>a</p>", "long" * 50_000]
    rows = [(i, f"http://x/{i}?a b\r\nX: y", t, "clash") for i, t in enumerate(html)] + [(None, None, "<p>a</p>", "c"), (5, "again", "<p>a</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = shared_path(spark, "warc")
    index = warc.write_warc(pages, folder, file_bytes=2_000)
    back = warc.read_warc(index, 3).collect()
    assert len(back) == len(rows)
    for r in back:
        same = [x for x in rows if (x[2] or "") == (html[r.page_id] if r.page_id is not None else "<p>a</p>") or (x[2] or "") == ""  and r.page_id in (2, 3)]
        text = (html[r.page_id] if r.page_id is not None else "<p>a</p>") or ""
        keep = max(x[0] for x in same if (x[2] or "") == text and x[0] is not None)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == keep else ("revisit", keep))
        assert (r.payload == text.encode()) if r.record_type == "response" else r.payload is None
    one = index.where("page_id = 4").first()
    with open(one.file.removeprefix("file://"), "rb") as f:
        f.seek(one.offset)
        assert gzip.decompress(f.read(one.length)).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    again = index.where("page_id = 0").first()
    with open(again.file.removeprefix("file://"), "rb") as f:
        f.seek(again.offset)
        head = gzip.decompress(f.read(again.length)).decode()
    target = warc.record_id(5, "http://x/5?a b\r\nX: y", warc.digest_of(b"<p>a</p>"))
    assert f"WARC-Refers-To: {target}" in head and "WARC-Refers-To-Target-URI: http://x/5?a%20b%0D%0AX:%20y" in head
    member, digest = warc.record(1, "u", b"abc", None, None, False, "2024-01-01T00:00:00Z")
    assert warc.parse(member)["payload_bytes"] == 3
    with pytest.raises(ValueError, match="digest"):
        warc.parse(gzip.compress(gzip.decompress(member).replace(b"abc", b"abd")))
    small = warc.read_warc(warc.write_warc(pages, shared_path(spark, "warc"), min_revisit_bytes=100), 2).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def _plain_records(path):
    """(headers, block) of the records of an archive, by the standard library alone."""
    with gzip.open(path) as f:
        while line := f.readline():
            assert line == b"WARC/1.1\r\n"
            fields = http.client.parse_headers(f)
            block = f.read(int(fields["Content-Length"]))
            assert f.read(4) == b"\r\n\r\n"
            yield fields, block


def test_warc_files_are_read_by_other_readers(spark):
    """Whole files read from their start: a warcinfo record, then HTTP responses; revisits end with the head."""
    texts = ["<p>one</p>\r\n\r\ntail", "", "ж" * 3000, "<p>one</p>\r\n\r\ntail", None, "HTTP/1.1 404 No\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(2)
    index = warc.write_warc(pages, shared_path(spark, "warc"), file_bytes=300)
    files = {r.file for r in index.select("file").distinct().collect()}
    seen = {}
    for file in files:
        first, *rest = _plain_records(file.removeprefix("file://"))
        assert first[0]["WARC-Type"] == "warcinfo" and first[0]["WARC-Filename"] == file.rsplit("/", 1)[1] and b"format: WARC" in first[1]
        for fields, block in rest:
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            raw = io.BytesIO(block)
            answer = http.client.HTTPResponse(types.SimpleNamespace(makefile=lambda _: raw))  # noqa: B023
            answer.begin()
            assert answer.status == 200 and answer.headers.get_content_type() == "text/html"
            n = int(fields["X-Page-Id"])
            text = (texts[n] or "").encode()
            assert int(answer.headers["Content-Length"]) == len(text) and fields["WARC-Target-URI"] == f"http://x/{n}"
            assert raw.read() == (text if fields["WARC-Type"] == "response" else b"")
            seen[n] = fields["WARC-Type"]
    assert seen == {0: "revisit", 1: "revisit", 2: "response", 3: "response", 4: "response", 5: "response"}
    # Ranges smaller than a record and of any gap give the same records.
    whole = sorted((r.page_id, r.payload) for r in warc.read_warc(index, 2).collect())
    assert whole == sorted((r.page_id, r.payload) for r in warc.read_warc(index, 3, gap=0, most=1).collect())
    assert whole == sorted((r.page_id, r.payload) for r in warc.read_warc(index, 1, gap=1 << 30, most=1 << 30).collect())
