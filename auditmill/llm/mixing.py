"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALTS, materialize, ranked, salt_of

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source_size and target for each source of sizes (source, size).

    Sources in code point order, null last, get the weights in turn. They share share * all
    sizes by weight; none gets more than cap * its own size, and what exceeds that is shared
    again among the others by weight until none is above. One job for each such round; the
    driver gets three sums from each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = ranked(totals, [F.col("source").asc_nulls_last()], "sources")
    weight = F.create_map(*[F.lit(x) for k, w in enumerate(weights) for x in (k, w)])[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")]
    totals = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("limit"))
    budget = (totals.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        capped = F.col("limit") <= F.col("weight") * F.lit(level)
        got = totals.agg(
            F.sum(F.when(capped, F.col("limit"))).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if got["n"] == full or not got["open"]:
            break
        full, level = got["n"], (budget - (got["fixed"] or 0.0)) / got["open"]
    return totals.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(level)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix-1",
    draw: str = "hash",
) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size, target, copies, row_hash.

    A source's repetition rate is target / source_size. Each document is taken floor(rate) times
    and once more by a draw that succeeds with probability equal to the rate's fraction. The same
    rows and seed give the same mix. How a document is drawn:

    * "hash" (the default): by a uniform number from the hash of seed and id (of the text where
      the id is null). Draws are independent of the other documents, so no sort is needed, and the
      words taken differ from the target by the noise of separate draws.
    * "spread": from one hash-seeded start for each source, stepping through its documents in
      order of size. Each document has the same probability, and the words taken differ from
      the target by about one document; all rows are sorted by range for it.

    Null text has size 0. Null sources are one source. A source of size 0 is not taken. Repeated
    rows are separate documents; with "hash" rows of one id are drawn alike. An empty table gives
    no rows.
    """
    if draw not in ("hash", "spread"):
        raise ValueError(f'draw must be "hash" or "spread", got {draw!r}')
    text = F.col(text_col)
    unit = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), c)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("row_hash"),
            unit(F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))).alias("u")),
        "sizes",
    )
    targets = materialize(source_targets(sized, weights, share, cap), "targets")
    if draw == "spread":
        order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("row_hash")]
        placed = ranked(sized, order, "placed")
        starts = placed.groupBy("source").agg(F.min("rank").alias("start"))
        plan = targets.alias("t").join(starts.alias("s"), F.expr("t.source <=> s.source")).select("t.*", "s.start")
    else:
        placed, plan = sized.withColumn("rank", F.lit(0)), targets.withColumn("start", F.lit(0))
    placed = placed.withColumn("salt", salt_of(F.col("doc_id"), F.col("row_hash")))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = placed.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.salt = p.salt"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.select("d.doc_id", "d.source", "d.size", "d.row_hash", "d.u", "source_size", "target", (F.col("rank") - F.col("start")).alias("k"), rate.alias("rate"))
    part = F.col("rate") - F.floor("rate")
    start = unit(F.coalesce(F.col("source"), F.lit("\x00")))
    drawn = F.floor((F.col("k") + 1) * part + start) - F.floor(F.col("k") * part + start) if draw == "spread" else (F.col("u") < part).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.floor("rate") + drawn).cast("int").alias("copies"), "row_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as mix() takes it, numbered by ``copy_no`` from 1 (in place of such a column).

    Rows that agree in id, text and source are interchangeable: together they appear as often
    as mix() takes them all.
    """
    plan = mix(docs, id_col, text_col, source_col, **options)
    taken = plan.groupBy(F.struct("doc_id", "source", "row_hash").alias("_k")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("row_hash"))
    # Such rows are told apart by all their columns, so that a task that runs again numbers them as before.
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = docs.select(F.struct("*").alias("_doc"), key.alias("_k"), whole.alias("_w")).withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_w"))).drop("_w")
    joined = rows.join(taken.where("_copies > 0"), "_k")
    own = (F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_r") <= F.col("_copies") % F.col("_rows")).cast("int")).cast("int")
    return joined.where(own > 0).select("_doc", F.explode(F.sequence(F.lit(1), own)).alias("copy_no")).select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c != "copy_no"], "copy_no")
