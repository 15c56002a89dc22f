"""Small inputs with the hard cases, and brute-force versions."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank int, copy_no int, score double"

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))


def edited(n: int) -> str:
    words = BASE.split()
    for k in range(n):
        words[7 + 13 * k] = f"changed{n}x{k}"
    return " ".join(words)


def rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""
    texts = [
        (1, BASE, "a"), (2, BASE.upper(), "a"), (3, edited(1), "b"), (4, edited(2), "b"), (5, edited(9), None), (6, None, "a"), (7, "", None),
        (8, " \t\n", "b"), (9, LONG, "a"), (10, LONG + " tail", "c"), (11, "one two", "a"), (12, "One two", "b"), (13, "x\ny\n" + BASE[:60] + "\n", "a"),
        (14, BASE[:60].upper() + " \nz", "a"), (15, "a b c d e f", "c"), (15, "a b c d e f", "c"), (None, "a b c d e f", "a"), (None, None, None), (16, "é" * 9 + "\n" + "é" * 10, "b"), (17, "é" * 10, "b"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), True, 1, 7, 0.5) for i, t, s in texts]


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def near_components(docs: list[tuple[int, str | None]], percent: int) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            shared = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip("\x20\t\n\x0b\x0c\r"))
    where: dict[str, set[int]] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= 2 and min(where[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
