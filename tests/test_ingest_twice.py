"""Blocks, pieces and whole ingests against second implementations that share no code with the first."""

from __future__ import annotations

import hashlib
import html
import json
import random
import re

import pytest
from auditmill.functions import text
from auditmill.plans import ingest_queries
from auditmill.sources import files

from tests.test_queries import SF

BLOCK = "p div h1 h2 h3 h4 h5 h6 li tr ul ol table article section nav body br".split()


def blocks(page: str) -> list[tuple[str, str, str]]:
    """Blocks by regular expressions: hidden parts go, tags of blocks cut, others vanish."""
    page = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "", page or "")
    page = re.sub(r"(?is)<(script|style|title|noscript|template)\b.*?</\1\s*>", "", page)
    out, tag, held = [], "body", ""

    def cut() -> None:
        nonlocal held
        said = " ".join(html.unescape(held).split())
        if said:
            out.append(("heading" if re.fullmatch("h[0-9]", tag) else "row" if tag in ("li", "tr") else "text", tag, said))
        held = ""

    for piece in re.split(r"(<[^>]*>)", page):
        found = re.fullmatch(r"<(/?)([A-Za-z0-9]+)[^>]*>", piece)
        if not found:
            held += piece
        elif found[2].lower() in ("td", "th"):
            held += " " if not found[1] else ""
        elif found[2].lower() in BLOCK:
            cut()
            tag = "body" if found[1] else tag if found[2].lower() == "br" else found[2].lower()
    cut()
    return out


def spans(source: str, size: int, overlap: int) -> list[str]:
    """Pieces by places: where units end is found from coarse to fine, then windows move from end to end."""
    edges = [0, len(source)]
    for mark in ("\n\n", "\n", " ", ""):
        finer = set(edges)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a <= size:
                continue
            if not mark:
                finer.update(range(a, b, size))
            else:
                at = source.find(mark, a)
                while 0 <= at < b and at + len(mark) <= b:
                    finer.add(at + len(mark))
                    at = source.find(mark, at + 1)
        edges = sorted(finer)
    pieces, start, stop = [], 0, 0
    while stop < len(edges) - 1:
        while stop < len(edges) - 1 and edges[stop + 1] - edges[start] <= size:
            stop += 1
        pieces.append(source[edges[start] : edges[stop]])
        if stop == len(edges) - 1:
            break
        while start < stop and (edges[stop] - edges[start] > overlap or edges[stop + 1] - edges[start] > size):
            start += 1
    return [p.strip() for p in pieces if p.strip()]


def test_pieces_of_texts(spark):
    rng = random.Random(8)
    for _ in range(300):
        source = "".join(rng.choice(["word ", "x", "\n", "\n\n", "longer text ", "averyverylongwordwithoutspaces"]) for _ in range(rng.randrange(0, 60)))
        size = rng.choice((5, 12, 40, 100))
        for overlap in (0, size // 5, size // 2):
            assert text.split_text(source, size, overlap) == (spans(source, size, overlap) if source else []), (source, size, overlap)
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, n, hashlib.md5(p.encode()).hexdigest()) for i, t in whole.items() for n, p in enumerate(spans(t or "", 2000, 200))}
    assert {(r.doc_id, r.n, r.chunk_md5) for r in ingest_queries.chunk_recursive(spark, SF).collect()} == want


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_blocks_of_pages(spark, pages):
    got = {(r.page_id, r.pos): (r.kind, r.tag, r.text) for r in ingest_queries.pages_to_blocks(spark, SF).collect()}
    assert got == {(i, n): b for i, page in pages.items() for n, b in enumerate(blocks(page))}
    assert files.blocks_of("<p>a<br>b</p>c<li>d") == blocks("<p>a<br>b</p>c<li>d") == [("text", "p", "a"), ("text", "p", "b"), ("text", "body", "c"), ("row", "li", "d")]


def test_ingest_of_pages(spark, pages):
    """The given pages have no tables and no numbered sections: a page is one text and one list of rows."""
    want = {}
    for i, page in pages.items():
        found = blocks(page)
        assert not any(re.match(r"\d+\.\d+\s", b[2]) for b in found)
        whole = "\n".join(b[2] for b in found if b[0] != "row")
        want |= {(str(i), "text", -1, n): p for n, p in enumerate(spans(whole, 2000, 200))}
        rows = [b[2] for b in found if b[0] == "row"]
        for n in range(0, len(rows), 8):
            want[(str(i), "table", -1, n // 8)] = json.dumps([{"text": x} for x in rows[n : n + 8]], ensure_ascii=False, separators=(",", ":"))
    got = {(r.file_id, r.content_type, r.table_index, r.chunk_index): (r.chunk_md5, r.dimension, r.error) for r in ingest_queries.ingest_corpus(spark, SF).collect()}
    assert got == {k: (hashlib.md5(c.encode()).hexdigest(), 64, None) for k, c in want.items()}
