"""Near-duplicates: circulant MinHash, banding, exact Jaccard, components."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALTS, group_salted, lookup_salted, materialize, release, salt_of

#: Words per shingle; bands and rows per band of the signature. A pair of similarity s meets in no
#: band with probability (1 - s**4)**24: 2e-8 at 0.85, 4e-6 at 0.8.
SHINGLE, BANDS, ROWS = 5, 24, 4
#: Members of a star that the first round of probes tests, the most that a later one does, and the
#: share of a star's components (one in SLOW) that a round must join for another one to follow.
PROBES, MOST_PROBES, SLOW = 8, 512, 16
#: Links of a graph from which on its joins are salted, and rows of one key that go to one part of it.
SALTED_LINKS = 1 << 20
PART_ROWS = 2048

_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S29, _S32 = np.uint64(29), np.uint64(32)


class _Words(dict):
    """64-bit hashes of words seen so far; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers, in place."""
    z *= _M1
    z ^= z >> _S29
    z *= _M2
    z ^= z >> _S32
    return z


def shingles(text: str | None, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Words are runs of other characters than space and the controls 9 to 13, A-Z lower-cased.
    With fewer words than ``size`` the whole sequence is one shingle; without words there is none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(size, len(ids))
    out = np.full(len(ids) - k + 1, np.uint64(k))
    for j in range(k):
        out ^= ids[j : len(ids) - k + 1 + j]
        _mix(out)
    return np.unique(out)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash over the universe of 64-bit integers.

    The first permutation is the mixing at the end of shingles(); the second is _mix. Coordinate
    k is the smallest value of the second permutation, shifted circularly by k steps of an odd
    stride, over the set.
    """
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    shift = (np.arange(1, coordinates + 1, dtype=np.uint64) * _G)[:, None]
    for at in range(0, len(found), 4096):
        np.minimum(out, _mix(found[at : at + 4096] + shift).min(axis=1), out=out)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        seeds = np.arange(1, bands + 1, dtype=np.uint64) * _G
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words, size)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                key = seeds[: bands * bool(len(found))].copy()
                if len(found):
                    sig = signature(found, bands * rows).reshape(bands, rows)
                    for j in range(rows):
                        key ^= sig[:, j]
                        _mix(key)
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(keys)], ["doc_id", "n", "digest", "bands"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for at in range(0, len(batch), 256):  # a set can be large
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), words, size) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, found), pa.int64()), _lists(found)], ["doc_id", "n", "grams"]
                )

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in links (a, b); comp is the smallest node reachable.

    Labels spread to neighbours and jump to their label's label until none changes, so the
    number of rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder and replaces the one before. In graphs of more than SALTED_LINKS rows the
    centre of a star and the label of a large component are dealt over salts, at the cost of a
    second join for each.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct().withColumn("salt", salt_of(F.col("a"))), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    lookup = lookup_salted if both.count() > SALTED_LINKS else lambda rows, key, _, answers: rows.join(answers, key, "left")
    while True:
        near = lookup(both, "b", "salt", labels.select(F.col("node").alias("b"), "comp")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        best = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"), salt_of(F.col("node")).alias("salt"))
        over = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = materialize(lookup(best, "comp", "salt", over).select("node", F.least("comp", "top").alias("comp"), "old"), "labels")
        release(labels)
        labels = jumped
        if labels.where("comp <> old").isEmpty():
            release(both)
            return labels


def nearby(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in links (a, b): the smallest node of two steps down from each.

    Nodes of one comp are of one component; a component may still have several comps. That
    is enough to leave out pairs that need no test, at the cost of one job.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumn("salt", salt_of(F.col("node")))
    lower = lookup_salted(low, "low", "salt", low.select(F.col("node").alias("low"), F.col("low").alias("comp")))
    return materialize(lower.select("node", "comp"), "labels")


def _linked(hub_pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, salt) of classes a and hubs b, those with 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"), F.col("n").alias("na"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"), F.col("n").alias("nb"))
    joined = lookup_salted(hub_pairs.join(left, "a"), "b", "salt", right)
    shared = F.size(F.array_intersect("ga", "gb"))
    return joined.where(shared * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _close(percent: int, shared: Column) -> Column:
    """Whether x and y are linked, from their sizes, their differences from one hub, and how many elements those share."""
    apart = F.size("x_d") + F.size("y_d") - 2 * shared
    return apart * (100 + percent) <= F.lit(100 - percent) * (F.col("x_n") + F.col("y_n"))


def _side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.select("hub", *[F.col(c).alias(f"{name}_{c}") for c in columns])


def _first(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The first ``most`` rows (hub, doc_id) of each hub in order, by parts of each hub."""
    for part in (["hub", "salt"], ["hub"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(order, "doc_id"))).where(F.col("_n") <= most).drop("_n")
    return rows.select("hub", "doc_id")


def _probed(asking: DataFrame, probes: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components: rows of asking (hub, doc_id, salt, comp) against the probes of their hub."""
    own = stars.select("hub", "doc_id", "n", "d")
    left = asking.join(own, ["hub", "doc_id"]).select("hub", "salt", F.col("comp").alias("x_comp"), F.col("n").alias("x_n"), F.col("d").alias("x_d"))
    right = _side(probes.join(own, ["hub", "doc_id"]), "y", "comp", "n", "d")
    spread = asking.select("hub", "salt").distinct().join(right, "hub")
    may = F.expr("x_comp <> y_comp") & (F.abs(F.size("x_d") - F.size("y_d")) * (100 + percent) <= F.lit(100 - percent) * (F.col("x_n") + F.col("y_n")))
    found = left.join(spread, ["hub", "salt"]).where(may).where(_close(percent, F.size(F.array_intersect("x_d", "y_d"))))
    return found.select(F.col("x_comp").alias("a"), F.col("y_comp").alias("b")).distinct()


def _rest(state: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components among all members of the stars in state: the exact prefix filter.

    x and y are linked if their differences from the hub share at least
    need = (|Dx| + |Dy| - (100 - percent) * (nx + ny) / (100 + percent)) / 2 elements. If one of the
    two is not linked with the hub, need is at least 1; if both are, there is nothing to find. With
    elements in order of frequency the first one that they share stands at most at place
    |D| - need of both.
    """
    members = materialize(state.select("hub", "doc_id", "comp", "salt").join(stars.select("hub", "doc_id", "n", "d"), ["hub", "doc_id"]), "rest")
    elements = members.select("hub", "doc_id", "comp", "salt", "n", F.size("d").alias("s"), F.explode("d").alias("e"))
    often = group_salted(elements, ["hub", "e"], "salt", {"c": F.count("*")}, {"df": F.sum("c")})
    ordered = elements.join(often, ["hub", "e", "salt"]).groupBy("hub", "doc_id", "comp", "salt", "n", "s").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("g"))
    prefix = F.floor((100 - percent) * F.col("n") / percent) + 1
    ordered = ordered.select("hub", "doc_id", "comp", "salt", "n", "s", F.posexplode(F.slice("g", F.lit(1), prefix.cast("int"))).alias("at", "g"))
    ordered = materialize(ordered.where("g.df > 1").select("hub", "doc_id", "comp", "salt", "n", "s", "at", "g.e", "g.df"), "prefixes")
    mixed = group_salted(ordered, ["hub", "e"], "salt", {"lo": F.min("comp"), "hi": F.max("comp")}, {"low": F.min("lo"), "high": F.max("hi")}, F.col("low") < F.col("high"))
    split = materialize(ordered.join(mixed.select("hub", "e", "salt"), ["hub", "e", "salt"]), "split")
    # The largest component of an element needs no pairs within itself: it only answers the others.
    sizes = split.groupBy("hub", "e", "comp").agg(F.count("*").alias("c"))
    major = sizes.groupBy("hub", "e").agg(F.max(F.struct("c", "comp")).alias("m")).select("hub", "e", F.col("m.comp").alias("major"))
    major = split.select("hub", "e", "salt").distinct().join(major, ["hub", "e"])
    # A frequent element is dealt over parts of its answering side.
    parts = F.least(F.lit(SALTS), 1 + F.floor(F.col("df") / PART_ROWS)).cast("int")
    minor = split.join(major, ["hub", "e", "salt"]).where("comp <> major").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    one = minor.select("hub", "e", "part", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "comp", "n", "s", "at")])
    two = split.select("hub", "e", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), *[F.col(c).alias(f"y_{c}") for c in ("doc_id", "comp", "n", "s", "at")])
    need = f"(x_s + y_s - floor({100 - percent} * (x_n + y_n) / {100 + percent}) + 1) div 2"
    near = one.join(two, ["hub", "e", "part"]).where(f"x_comp <> y_comp AND {need} <= x_s - x_at AND {need} <= y_s - y_at")
    pairs = near.select("hub", F.least("x_doc_id", "y_doc_id").alias("x_doc_id"), F.greatest("x_doc_id", "y_doc_id").alias("y_doc_id")).distinct()
    both = pairs.join(_side(members, "x", "doc_id", "comp", "n", "d"), ["hub", "x_doc_id"]).join(_side(members, "y", "doc_id", "comp", "n", "d"), ["hub", "y_doc_id"])
    links = materialize(both.where(_close(percent, F.size(F.array_intersect("x_d", "y_d")))).select(F.col("x_comp").alias("a"), F.col("y_comp").alias("b")).distinct(), "confirmed")
    release(members, ordered, split)
    return links


def _joined_stars(stars: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of links (a, b) of components among the members of each star (hub, doc_id, salt, comp, n, d, and the hub's n and comp).

    The first round tests PROBES members of each star against all its others. While a round joins
    at least one in SLOW of a star's components, the next one tests four times as many members of
    the star's largest component against those outside it: a family of linked texts is joined by a
    number of tests in proportion to its size, however many links it has. What is left (small
    stars are done by then) goes through _rest().
    """
    # Not every member was tested with its star's hub.
    close = F.size("d") * (100 + percent) <= F.lit(100 - percent) * (F.col("n") + F.col("h_n"))
    hubs = materialize(stars.where(close).where("comp <> h_comp").select(F.col("comp").alias("a"), F.col("h_comp").alias("b")).distinct(), "confirmed")
    found: list[DataFrame] = [hubs]
    state = materialize(stars.select("hub", "doc_id", "salt", F.when(close, F.col("h_comp")).otherwise(F.col("comp")).alias("comp"), F.lit(True).alias("active"), F.lit(None).cast("long").alias("major")), "state")
    most, first = PROBES, True
    while True:
        asking = state.where("active")
        probes = _first(asking if first else asking.where("comp = major"), F.xxhash64(F.lit(most), F.col("doc_id")), most)
        probes = materialize(probes.join(state.select("hub", "doc_id", "comp"), ["hub", "doc_id"]), "probes")
        links = materialize(_probed(asking if first else asking.where("comp <> major"), probes, stars, percent), "confirmed")
        found.append(links)
        some = not links.isEmpty()
        moved = nearby(links) if some else None
        left = state.join(probes.select("hub", "doc_id"), ["hub", "doc_id"], "left_anti") if first else state
        now = left.withColumnRenamed("comp", "old")
        if some:
            now = lookup_salted(now, "old", "salt", moved.select(F.col("node").alias("old"), "comp")).withColumn("comp", F.coalesce("comp", "old"))
        else:
            now = now.withColumn("comp", F.col("old"))
        sizes = now.groupBy("hub", "comp").agg(F.count_distinct("old").alias("olds"), F.count("*").alias("c"))
        verdict = sizes.groupBy("hub").agg(F.sum("olds").alias("before"), F.count("*").alias("after"), F.max(F.struct("c", "comp")).alias("m")).where("after > 1")
        verdict = verdict.select("hub", ((F.col("before") - F.col("after")) * SLOW >= F.col("before")).alias("quick"), F.col("m.comp").alias("largest"))
        spread = now.select("hub", "salt").distinct().join(verdict, "hub")
        newer = now.join(spread, ["hub", "salt"]).select("hub", "doc_id", "salt", "comp", (F.col("active") & F.col("quick")).alias("active"), F.col("largest").alias("major"))
        newer = materialize(newer, "state")
        release(state, probes, *([moved] if some else []))
        state, most, first = newer, min(4 * most, MOST_PROBES), False
        if state.where("active").isEmpty():
            break
    if not state.isEmpty():
        found.append(_rest(state, stars, percent))
    release(state)
    return found


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their shingle sets;
    component_id is the smallest id reachable over links.

    1. One pass makes each set's size, digest and band keys. Equal sets are one class, shown by
       its smallest id; copies go no further.
    2. In each bucket of equal band keys every class is paired with one hub, the class whose
       buckets are largest over all bands (in a group of edited copies, mostly the text that was
       edited). Pairs are confirmed on full sets. A bucket of m classes gives m - 1 pairs.
    3. Buckets whose other members are still of more than one component make stars: a hub and
       those members, each as its difference from the hub, from which links follow exactly. Stars
       are joined in rounds of probes and at last by a prefix filter over the differences (see
       _joined_stars() and _rest()). A family in which no two texts are linked, all just below
       the threshold, is the case that stays costly: its pairs that pass the filter are tested.

    Texts without words (null, empty, blank) are linked with nothing and kept. Rows with a null
    id are not compared: component_id null, kept. Repeated rows of one id count as one document
    if their texts agree; the id's rows share a component in any case. Tables written on the way
    are deleted, but for the two that the result reads.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(
        text.mapInArrow(_sketches(size, bands, rows), "doc_id long, n long, digest binary, bands array<long>").withColumn("salt", salt_of(F.col("doc_id"))),
        "sketches",
    )
    some = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = group_salted(some, ["digest"], "salt", {"lo": F.min("doc_id")}, {"rep": F.min("lo")})
    member = materialize(some.select("doc_id", "digest", "salt").distinct().join(classes, ["digest", "salt"]).select("doc_id", "rep", "salt"), "members")
    reps = some.join(classes, ["digest", "salt"]).where("doc_id = rep").select("doc_id", "bands")
    keyed = reps.select("doc_id", F.explode(F.array_distinct("bands")).alias("key")).distinct().withColumn("salt", salt_of(F.col("doc_id")))
    keyed = materialize(keyed, "keys")

    sizes = group_salted(keyed, ["key"], "salt", {"c": F.count("*")}, {"total": F.sum("c")}, F.col("total") > 1)
    shared = materialize(keyed.join(sizes, ["key", "salt"]), "buckets")
    central = shared.groupBy("doc_id").agg(F.sum("total").alias("weight"))
    ranked = shared.join(central, "doc_id").select("key", "salt", "doc_id", F.struct(F.col("weight"), (-F.col("doc_id")).alias("neg")).alias("place"))
    hubs = group_salted(ranked, ["key"], "salt", {"top": F.max("place")}, {"hub": F.max("top")}).select("key", "salt", (-F.col("hub.neg")).alias("hub"))
    placed = materialize(shared.join(hubs, ["key", "salt"]).where("doc_id <> hub"), "placed")
    pairs = placed.groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.max("total").alias("t"))
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.least(F.lit(SALTS), 1 + F.floor(F.col("t") / PART_ROWS))).cast("int").alias("salt"))

    wanted = shared.select(F.col("doc_id").alias("_id")).distinct()
    sets = text.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi")
    sets = materialize(sets.mapInArrow(_sets(size), "doc_id long, n long, grams array<long>"), "sets")
    links = materialize(_linked(pairs, sets, percent), "confirmed")
    first = components(links)
    release(keyed, shared, links)

    # Pairs with a hub are tested: only buckets with two more members of different components stay open.
    state = placed.where("total > 2").join(first.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    state = crowded = materialize(state.select("key", "salt", "hub", "doc_id", "comp"), "crowded")
    mixed = group_salted(state, ["key"], "salt", {"lo": F.min("comp"), "hi": F.max("comp")}, {"low": F.min("lo"), "high": F.max("hi")}, F.col("low") < F.col("high"))
    state = materialize(state.join(mixed, ["key", "salt"]).select("doc_id", "salt", "comp", F.col("hub").alias("near")).distinct(), "open")
    # Hubs of one component share one hub, so that a class is in one star instead of several.
    ranks = placed.select(F.col("hub").alias("doc_id"), "total").groupBy("doc_id").agg(F.sum("total").alias("weight")).join(first.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
    heads = ranks.groupBy(F.coalesce("comp", "doc_id").alias("c")).agg(F.max_by(F.col("doc_id"), F.struct(F.col("weight"), -F.col("doc_id"))).alias("hub"))
    heads = lookup_salted(ranks.select(F.col("doc_id").alias("near"), F.coalesce("comp", "doc_id").alias("c"), salt_of(F.col("doc_id")).alias("salt")), "c", "salt", heads).select("near", "hub", F.col("c").alias("h_comp"))
    heads = materialize(heads, "heads")
    stars = lookup_salted(state, "near", "salt", heads).select("hub", "doc_id", "salt", "comp", "h_comp").where("doc_id <> hub").distinct()
    stars = lookup_salted(stars.join(sets, "doc_id"), "hub", "salt", sets.select(F.col("doc_id").alias("hub"), F.col("grams").alias("h"), F.col("n").alias("h_n")))
    apart = F.concat(F.array_except("grams", "h"), F.array_except("h", "grams"))
    stars = materialize(stars.select("hub", "doc_id", "salt", "comp", "n", "h_n", "h_comp", apart.alias("d")), "stars")
    release(placed, sets, crowded, state, heads)
    more = _joined_stars(stars, percent) if not stars.isEmpty() else []
    release(stars)

    # The later links are of components: those of first are named anew, no node is spread to again.
    named = lookup_salted(member, "rep", "salt", first.select(F.col("node").alias("rep"), "comp")).select("doc_id", "salt", F.coalesce("comp", "rep").alias("old"))
    later = functools.reduce(DataFrame.unionByName, more) if more else None
    merged = components(later) if later is not None and not later.isEmpty() else None
    if merged is None:
        named = named.withColumnRenamed("old", "comp")
    else:
        named = lookup_salted(named, "old", "salt", merged.select(F.col("node").alias("old"), "comp")).withColumn("comp", F.coalesce("comp", "old"))
    named = materialize(named.groupBy(F.col("doc_id").alias("_id")).agg(F.min("comp").alias("comp")), "named")
    release(member, first, *more, *([merged] if merged is not None else []))
    out = sketch.join(named, F.col("doc_id") == F.col("_id"), "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without those that another document of their component stands for."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
