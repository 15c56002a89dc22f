"""Lexical search, the n-gram join and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from auditmill.llm import lexical, ngram_join, queries, repair
from pyspark.sql import functions as F

from tests.llm import helpers
from tests.test_queries import SF

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is not None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)}
    return out


def words(rng, n):
    return " ".join(f"t{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(n))


@pytest.mark.parametrize("block,tokens,window", [(4, 3000, 64), (64, 1 << 22, 8192)])
def test_search_equals_brute_force(spark, monkeypatch, block, tokens, window):
    monkeypatch.setattr(lexical, "SHARD_TOKENS", tokens)
    rng = random.Random(5)
    docs = [(k, words(rng, rng.choice((3, 30, 300)))) for k in range(700)] + [(9001, None), (9002, ""), (9003, "-- !"), (None, "t1 t2 t3"), (9004, "É t1 T1"), (9004, "É t1 T1"), (9005, "t7 " * 70_000)]
    items = [(k, words(rng, rng.choice((1, 6, 40)))) for k in range(40)] + [(50, None), (51, "?"), (52, "nowhere"), (53, "é É t1 t1"), (53, "é É t1 t1"), (53, "t2"), (None, "t5")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    index = lexical.build_index(frame)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()} == ranked(docs, [x for x in items if x[1] is not None])


def test_search_in_groups_and_of_nothing(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(k, words(rng, 50)) for k in range(60)]
    items = [(k, words(rng, 30)) for k in range(30)]
    monkeypatch.setattr(lexical, "ITEM_WORDS", 50)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), top=3).collect()} == ranked(docs, items, 3)
    empty = lexical.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert lexical.search(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_search_leaves_blocks_packed(spark):
    """A rare term decides: of a common one only the blocks of its documents are unpacked."""
    docs = [(k, "common " * 2 + ("rare " * 40 if k % 997 == 0 else "filler ") + f"x{k}") for k in range(20_000)]
    builder = lexical._Builder()
    for i, t in docs:
        builder.add(i, lexical.terms_of(t))
    rows = builder.pack(0).to_pylist()
    sizes, stats = np.frombuffer(rows[0]["postings"], np.int32), lexical._Stats(20_000, sum(len(t.split()) for _, t in docs))
    lists = {r["term"]: lexical._List(r, sizes, stats) for r in rows[1:] if r["term"] in (b"common", b"rare")}
    heap = lexical._Heap(5)
    lexical.search_shard([(9000, lists[b"rare"]), (1, lists[b"common"])], np.frombuffer(rows[0]["blocks"], np.int64), heap)
    assert heap.ids.tolist() == [0, 997, 1994, 2991, 3988]
    assert lists[b"common"].open.mean() < 0.5


def families(rng, count):
    texts = []
    for f in range(count):
        base = [f"f{f}w{rng.randrange(300)}" for _ in range(rng.choice((4, 12, 60, 200)))]
        for _ in range(rng.choice((1, 2, 12, 25))):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                own[rng.randrange(len(own))] = f"c{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own += [f"shared{k}" for k in range(rng.choice((20, 40)))]
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("chunk,percent", [(1 << 19, 80), (400, 80), (400, 60), (2000, 95)])
def test_join_equals_brute_force(spark, monkeypatch, chunk, percent):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    docs = list(enumerate(families(random.Random(3), 40)))
    docs += [(9000 + k, t) for k, t in enumerate((None, "", " \t", "a b", "A b", "a b c d e f g"))]
    got = {r["doc_id"]: r for r in ngram_join.ngram_links(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), percent=percent).collect()}
    want = helpers.near_components(docs, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(helpers.shingles(t)) for i, t in docs}


def test_join_hard_rows(spark):
    rows = [r for r in helpers.rows()]
    got = ngram_join.ngram_links(spark.createDataFrame(rows, helpers.SCHEMA))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    out = got.collect()
    assert len(out) == len(rows)
    want = helpers.near_components([(r[0], r[1]) for r in rows if r[0] is not None], 80)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in out)
    assert ngram_join.ngram_links(spark.createDataFrame([], helpers.SCHEMA)).collect() == []
    # Two texts under one id: their links meet in the id's component.
    two = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_links(spark.createDataFrame(two, "doc_id long, text string")).collect()} >= {(1, 1), (2, 1)}


def cheapest(rows):
    """Uniform cost search over (cost, audit): the first goal taken is the answer."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        tail = roles[-2:] if len(roles) < 3 else "x" + roles[-1]
        if (i, tail) in done:
            continue
        done.add((i, tail))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        legal = lambda r: re.fullmatch("s?(ua)*u?", r)
        for r in "ua":
            if legal(roles + r):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                if legal(roles + initial):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + initial))
                for r in "ua":
                    if legal(roles + r):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))


def test_solve_equals_uniform_cost_search():
    rng = random.Random(1)
    cases = [list(x) for n in range(3) for x in itertools.product(itertools.product("suao", range(4)), repeat=n)]
    cases += [[(rng.choice("suuaao"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(3, 12))] for _ in range(1500)]
    for rows in cases:
        codes = "".join(chr(97 + "suao".index(r) * 4 + f) for r, f in rows)
        assert repair.solve(codes) == cheapest(rows), rows
    assert repair.solve("e" + "i" * 5000)[0] == 3 * 2500


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text, k = say(role), say(text), zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def repaired(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, coded = set(), []
        for _, _, role, text in own:
            full = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not full else 2 if (role, text) in seen else 3 if full[-1] not in ".!?" else 0
            seen.add((role, text))
            coded.append((role[:1] if role[:1] in ("s", "u", "a") else "o", fault))
        cost, audit = cheapest(coded)
        out, at = [], 0
        for e in audit:
            first_system = bool(out) and out[0].startswith("s")
            given = "user" if (len(out) - first_system) % 2 == 0 else "assistant"
            if e == "I":
                out.append(f"{given}:")
                continue
            if e != "D":
                out.append(f"{own[at][2] if e == 'K' else given}:{own[at][3]}")
            at += 1
        turns = [r[1] for r in own if r[1] is not None]
        count = lambda n: sum(f == n for _, f in coded)  # noqa: B023, E731
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(coded)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, count(1), count(2), count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def test_repair_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "SLICE", 3)
    rng = random.Random(2)
    texts = ["Yes.", "No!", "Why? ", "no end", "", " \t", "x" * 50_000 + ".", "é.", None, "Yes."]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 14)):
            rows.append((conv, rng.choice((turn, turn, turn, turn + 2, None)), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    schema = "conv_id long, turn long, role string, text string, codes string"
    spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == repaired(rows)


def test_repair_of_the_smallest_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, SF)
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == repaired(rows)


def test_repair_of_nothing(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    planned = repair.plans(repair.damage(rows))
    assert planned.collect() == [] and repair.digests(repair.repaired_turns(repair.damage(rows), planned)).collect() == []
    long_one = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(0).alias("copy"))
    assert repair.plans(long_one).select("cost", F.length("audit")).first() == (0, 3000)
