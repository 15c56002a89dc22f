"""Text functions: trimming, tokens, sections, chunks, codes and keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters and digits, or one sign; white space separates.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

#: Where a numbered line begins, and a title: the number and the first line of text after it, which has a letter and no two dots in a row (those are of contents).
CUT = r"(?U)\n(?=\d+\.\d+(?:\s|\z))"
HEADER = r"(?U)^\d+\.\d+(?:\s++|\z)(?=[^\n]*[A-Za-zА-Яа-я])(?![^\n]*\.\.)[^\n]*"

#: White space of every kind: what (?U)\s matches.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

GUID = r"(?U)\bGUID:\s*([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})\b"


def stripped(c: Column) -> Column:
    """Without white space at both ends, of every kind."""
    return F.btrim(c, F.lit(SPACES))


def not_blank(c: Column) -> Column:
    """The column, null where it is empty."""
    return F.when(c != "", c)


def tokenize(c: Column) -> Column:
    """Lower-cased tokens; punctuation counts. Null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def split_sections(c: Column) -> Column:
    """array<struct<title, text>> of the numbered sections of a text.

    Every numbered line (see CUT) begins a block, which ends before the next one. A block is a
    section if the first line of text after its number has a letter and no two dots in a row; the
    title is the number and that line. Text before the first block and blocks of other kinds are
    left out. Without any section the whole text is one, with a null title.
    """

    # A block is what stands between two numbered lines: the text is cut once, and what is found is bound to a name.
    blocks = F.transform(F.filter(F.split(F.concat(F.lit("\n"), c), CUT, -1), lambda _, i: i > 0), stripped)
    titled = F.transform(blocks, lambda b: F.struct(stripped(F.regexp_extract(b, HEADER, 0)).alias("title"), b.alias("text")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), c.alias("text")))
    found = F.array(F.filter(titled, lambda s: s["title"] != ""))
    return F.get(F.transform(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole)), F.lit(0))


def strip_front_matter(c: Column, anchor: str) -> Column:
    """From the second occurrence of anchor on, stripped; unchanged with fewer than two."""
    a = F.lit(anchor)
    first = F.position(a, c)
    second = F.when(first > 0, F.position(a, c, first + len(anchor))).otherwise(0)
    return F.when(second > 0, stripped(F.substring(c, second, F.length(c)))).otherwise(c)


def chunk_fixed(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """Windows of size characters, each overlap characters into the one before."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda s: F.substring(c, s, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: Where texts are split, from coarse to fine; the last resort is every character.
SEPARATORS = ("\n\n", "\n", " ")


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most size characters, in order, split at the coarsest separator that fits.

    A piece begins with as many whole units of the piece before as fit into overlap. Only white
    space is lost.
    """
    units = [text]
    for separator in SEPARATORS:
        units = [u for part in units for u in (re.split(f"(?<={separator})", part) if len(part) > size else [part])]
    units = [u[i : i + size] for u in units for i in range(0, len(u), size)]
    pieces, held, length = [], [], 0
    fresh = False
    for unit in units:
        if fresh and length + len(unit) > size:
            pieces.append("".join(held))
            while held and (length > overlap or length + len(unit) > size):
                length -= len(held.pop(0))
        held.append(unit)
        length += len(unit)
        fresh = True
    if held:
        pieces.append("".join(held))
    return [p for p in map(str.strip, pieces) if p]


def chunk_recursive(size: int = 2000, overlap: int = 200):
    """A pandas function from texts to arrays of pieces (see split_text)."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return run


def normalize_codes(c: Column) -> Column:
    """The codes of a comma-separated cell, stripped and in upper case."""
    return F.transform(F.split(c, ","), lambda x: F.upper(stripped(x)))


def code_prefix(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def content_preview(c: Column, size: int = 120) -> Column:
    return F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" "))


def safe_period_key(c: Column) -> Column:
    """Other characters than letters and digits become hyphens; none at the ends."""
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def extract_guid(c: Column) -> Column:
    """The first identifier after "GUID:", in lower case; null without one."""
    return not_blank(F.lower(F.regexp_extract(c, GUID, 1)))
