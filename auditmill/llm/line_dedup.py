"""Removal of lines that many documents share, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, SALTS, ascii_lower, group_salted, let, materialize, salt_of


def line_key(line: Column) -> Column:
    """The normalised line: blanks stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    salts: int = SALTS,
) -> DataFrame:
    """Drop lines whose key is in at least min_docs documents, except in the smallest of them.

    Returns for every row of docs: doc (the whole row as a struct), kept_text, n_lines, n_dropped.

    Lines are exploded once into (id, position, 128-bit hash of the key); keys under min_chars
    code points are never counted. Keys are counted over (key, salt) before they meet by key, and
    the verdicts go back to (key, salt), so a line that a third of all documents share is dealt
    over ``salts`` tasks. Texts are shuffled once, to meet the positions to drop.

    Null or empty text is one empty line. Rows with a null id are not counted and lose nothing.
    Repeated rows with one id count as one document; each row loses its own lines.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), row.alias("_row"), F.posexplode(lines).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select(
            "_id",
            "_row",
            "_pos",
            F.xxhash64("_key").alias("_h1"),
            F.xxhash64(F.concat(F.lit("~"), "_key")).alias("_h2"),
            salt_of(F.col("_id"), salts=salts).alias("_salt"),
        )
    )
    keyed = materialize(keyed, "lines")
    if min_docs == 2:
        first = {"_lo": F.min("_id"), "_hi": F.max("_id")}
        then = {"_first": F.min("_lo"), "_last": F.max("_hi")}
        keep = F.col("_first") < F.col("_last")
        counted = keyed
    else:
        first = {"_lo": F.min("_id"), "_n": F.count("*")}
        then = {"_first": F.min("_lo"), "_docs": F.sum("_n")}
        keep = F.col("_docs") >= min_docs
        counted = keyed.select("_id", "_h1", "_h2", "_salt").distinct()
    verdicts = group_salted(counted, ["_h1", "_h2"], "_salt", first, then, keep)
    drops = (
        keyed.join(verdicts.select("_h1", "_h2", "_salt", "_first"), ["_h1", "_h2", "_salt"])
        .where(F.col("_id") != F.col("_first"))
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    left = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("_id"), row.alias("_row"))
    joined = left.join(drops, ["_id", "_row"], "left").select(
        "doc", F.struct(F.split(F.coalesce(F.col("doc")[text_col], F.lit("")), "\n", -1).alias("l"), F.coalesce("_drop", F.array().cast("array<int>")).alias("d")).alias("_s")
    )
    n = lambda s: F.size(s["l"])
    result = let(
        F.col("_s"),
        lambda s: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n(s) - 1), s["d"]), lambda i: s["l"][i]), "\n").alias("kept_text"),
            n(s).cast("long").alias("n_lines"),
            F.size(s["d"]).cast("long").alias("n_dropped"),
        ),
    )
    return joined.select("doc", result.alias("r")).select("doc", "r.*")
