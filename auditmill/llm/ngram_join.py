"""N-gram Jaccard join: sets in one global order stand in a prefix tree that their partners walk."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import SHINGLE, _lists, _Words, components, shingles
from .shared import group_salted, lookup_salted, materialize, release, salt_of

#: Percent of a set's smallest hashes that the first filter looks at.
LOW = 30
#: N-grams of a block that go to one task, and n-grams of a branch that are compared at once.
CHUNK, PIECE = 1 << 19, 32


def _heads(size: int, percent: int):
    """A task: of each text the size of its set, a digest, a part of that as a tag, and for the first filter its smallest hashes and how many of them must be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n, digests, low, need = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), words, size)
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = -(-len(found) * percent // 100)
                look = max(-(-len(found) * LOW // 100), len(found) - least + 1) if len(found) else 0
                low.append(found[:look])
                need.append(max(1, -(-max(0, LOW + percent - 100) * least // 100)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(low), pa.array(need, pa.int32())], ["doc_id", "n", "digest", "low", "need"]
            )

    return run


def _tag(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=16).digest()[:4], "little", signed=True)


def _grams(size: int):
    """A task: the sets of texts, and a tag that tells the texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for at in range(0, len(batch), 256):  # a set can be large
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), words, size) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([_tag(x) for x in found], pa.int32()), pa.array(map(len, found), pa.int64()), _lists(found)], ["doc_id", "tag", "n", "grams"]
                )

    return run


class Tree:
    """A prefix tree of sets (arrays of ranks in the global order), and the sizes that the sets have with what is not in the arrays.

    Nodes stand level by level; a node has up to PIECE ranks, its sets part below it. ``left`` is
    the most ranks that a set has below a node, ``least`` and ``most`` are the smallest and largest size there.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.order = np.array(order)
        sets = [sets[k] for k in order]
        sizes = sizes[self.order]
        ends = np.array([len(s) for s in sets])
        common = np.zeros(len(sets) + 1, np.int64)  # ranks that a set begins with like the one before
        for k in range(1, len(sets)):
            m = min(ends[k - 1], ends[k])
            differ = np.flatnonzero(sets[k - 1][:m] != sets[k][:m])
            common[k] = differ[0] if len(differ) else m
        self.levels: list[dict] = []
        # A node: sets lo up to hi, which share their first ranks up to a depth.
        spans = [(0, len(sets), 0, -1)]
        while spans:
            level: dict[str, list] = {k: [] for k in ("parent", "ranks", "cut", "depth", "left", "least", "most", "leaf_node", "leaf")}
            deeper = []
            for lo, hi, depth, parent in spans:
                a = lo
                while a < hi:
                    b = a + 1
                    while b < hi and common[b] > depth:
                        b += 1
                    top = min(int(common[a + 1 : b].min()) if b - a > 1 else int(ends[a]), depth + PIECE)
                    node = len(level["parent"])
                    level["parent"].append(parent)
                    level["ranks"].append(sets[a][depth:top])
                    level["depth"].append(top)
                    level["left"].append(ends[a:b].max() - top)
                    level["least"].append(sizes[a:b].min())
                    level["most"].append(sizes[a:b].max())
                    done = [k for k in range(a, b) if ends[k] == top]  # sets that end here stand first
                    level["leaf_node"] += [node] * len(done)
                    level["leaf"] += done
                    if len(done) < b - a:
                        deeper.append((a + len(done), b, top, node))
                    a = b
            cut = np.cumsum([0, *map(len, level["ranks"])])
            ready = {k: np.array(v) for k, v in level.items() if k not in ("ranks", "cut")}
            parents = ready["parent"]
            ready["ranks"], ready["cut"] = np.concatenate(level["ranks"]), cut
            # Children of a node are neighbours: from child[p] up to child[p + 1].
            above = len(self.levels[-1]["parent"]) if self.levels else 1
            ready["child"] = np.searchsorted(np.maximum(parents, 0), np.arange(above + 1))
            leaf_node = ready["leaf_node"]
            ready["leaf_from"] = np.searchsorted(leaf_node, np.arange(len(parents) + 1))
            self.levels.append(ready)
            spans = deeper

    @staticmethod
    def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the ranges, and which range each is of."""
        size = end - begin
        owner = np.repeat(np.arange(len(size)), size)
        return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner], owner

    def partners(self, ranks: np.ndarray, size: int, percent: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the input of the sets that may reach 100 * overlap >= percent * union with a set of so many n-grams, and their overlaps. held: zeros, one for each rank.

        All sets with one beginning share its overlap. A subtree is left when the overlap so far
        and what may follow, in the set or below the node, is less than its smallest set needs, or when no
        size below it is within reach.
        """
        held[ranks] = 1
        out = []
        nodes, overlaps = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in self.levels:
            at, owner = self._spread(level["child"][nodes], level["child"][nodes + 1])
            if not len(at):
                break
            places, own = self._spread(level["cut"][at], level["cut"][at + 1])
            hits = np.bincount(own, held[level["ranks"][places]], len(at)).astype(np.int64)
            found = overlaps[owner] + hits
            least, most = np.maximum(level["least"][at], -(-percent * size // 100)), np.minimum(level["most"][at], 100 * size // percent)
            most_overlap = found + np.minimum(level["left"][at], len(ranks) - found)
            some = (least <= most) & (most_overlap * (100 + percent) >= percent * (size + least))
            nodes, overlaps = at[some], found[some]
            leaves, own = self._spread(level["leaf_from"][nodes], level["leaf_from"][nodes + 1])
            if len(leaves):
                out.append((level["leaf"][leaves], overlaps[own]))
        held[ranks] = 0
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        leaf, overlap = (np.concatenate(x) for x in zip(*out, strict=True))
        return self.order[leaf], overlap


class _Union(dict):
    """Components: each member's smallest member known."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)
        return a != b


def _joined(percent: int):
    """A group function: links (a, b) between the components of a group's sets.

    Rows: doc_id, comp, n, grams and dfs in the global order, asks, answers. Each asking set walks
    the tree of the answering ones. Links are of comps; one that adds nothing is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        comps, sizes = table.column("comp").to_numpy(), table.column("n").to_numpy()
        grams, dfs = (table.column(c).combine_chunks() for c in ("grams", "dfs"))
        ends = grams.offsets.to_numpy() - grams.offsets[0].as_py()
        flat, often = grams.flatten().to_numpy(), dfs.flatten().to_numpy()
        known, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, often[first]))] = np.arange(len(known))
        ranks = rank[inverse]
        sets = [ranks[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        answers = np.flatnonzero(table.column("answers").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        links: list[tuple[int, int]] = []
        if len(answers) and len(asks):
            tree, union, held = Tree([sets[k] for k in answers], sizes[answers]), _Union(), np.zeros(len(known), np.int8)
            for k in asks:
                places, overlap = tree.partners(sets[k], int(sizes[k]), percent, held)
                places = answers[places]
                linked = places[overlap * (100 + percent) >= percent * (sizes[k] + sizes[places])]
                links += [(int(comps[k]), c) for c in np.unique(comps[linked]).tolist() if union.join(int(comps[k]), c)]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


_SENT = ("doc_id", "comp", "n", "grams", "dfs", "asks", "answers")


def _linked(sent: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) among the comps of each group of keys; written."""
    found = sent.select(*keys, *_SENT).groupBy(*keys).applyInArrow(_joined(percent), "a long, b long")
    return materialize(found.where("a <> b").distinct(), "confirmed")


def _renamed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with comp replaced by the component that the links put it in."""
    moved = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("_to"))
    return rows.join(moved, "comp", "left").withColumn("comp", F.coalesce("_to", "comp")).drop("_to")


def _open_ids(reps: DataFrame) -> DataFrame:
    """(_id) of the representatives that may have a partner, by a part of their hashes.

    With an overlap of at least a, the k-th common hash of two sets stands at most at place
    n - a + k of each, so their first n - a + k hashes share k. With LOW percent of the hashes k is at
    least LOW + percent - 100 percent of the smaller set's a, and that is least for the smallest partner.
    Sets that share fewer of these hashes with all others together go.
    """
    low = reps.select("doc_id", "need", F.explode("low").alias("gram"))
    shared = low.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1").select("gram")
    some = low.join(shared, "gram").groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("need").alias("need")).where("hits >= need")
    return materialize(some.select(F.col("doc_id").alias("_id")), "open")


def _open_sets(text: DataFrame, wanted: DataFrame, percent: int, size: int) -> DataFrame:
    """(doc_id, tag, n, grams, dfs) of the wanted texts that share percent of their n-grams with others: those n-grams, the rarest first."""
    sets = text.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(_grams(size), "doc_id long, tag int, n long, grams array<long>")
    each = materialize(sets.select("doc_id", "tag", "n", F.explode("grams").alias("gram")), "grams")
    often = each.groupBy("gram").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    held = each.join(often, "gram").groupBy("doc_id", "tag", "n").agg(F.array_sort(F.collect_set(F.struct("df", "gram"))).alias("l"))  # rows may repeat
    held = held.where(F.size("l") * 100 >= F.col("n") * percent)
    held = materialize(held.select("doc_id", "tag", "n", F.transform("l", lambda x: x["gram"]).alias("grams"), F.transform("l", lambda x: x["df"]).alias("dfs")), "sets")
    release(each)
    return held


def _blocks(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, block) of the sets that share an n-gram of their prefixes with another one, blocks being the components over these.

    Two linked sets share an n-gram of their prefixes: all partners of a set are in its block.
    """
    prefix = F.size("grams") - F.ceil(F.col("n") * percent / 100) + 1
    rare = sets.select("doc_id", F.explode(F.slice("grams", F.lit(1), prefix.cast("int"))).alias("gram")).withColumn("salt", salt_of(F.col("doc_id")))
    met = group_salted(rare, ["gram"], "salt", {"c": F.count("*"), "lo": F.min("doc_id")}, {"total": F.sum("c"), "hub": F.min("lo")}, F.col("total") > 1)
    links = materialize(rare.join(met, ["gram", "salt"]).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct(), "prefixes")
    found = components(links).select(F.col("node").alias("doc_id"), F.col("comp").alias("block"))
    release(links)
    return found


def _large_links(rows: DataFrame, percent: int) -> list[DataFrame]:
    """Further links of blocks with several chunks, from rows (block, parts, chunk, comp and the sets).

    First one set for each component and chunk meets those of the other chunks, which joins a
    family of linked texts. Then the sets outside a block's largest component ask every chunk of
    it: nothing is lost, and what costs most is a large block that hardly has links.
    """
    yes = F.lit(True)
    heads = rows.groupBy("block", "chunk", "comp").agg(F.min(F.struct("doc_id", "tag")).alias("h")).select("block", "comp", "h.doc_id", "h.tag")
    heads = materialize(heads.join(rows.select("block", "comp", "doc_id", "tag", "n", "grams", "dfs"), ["block", "comp", "doc_id", "tag"]), "heads")
    sizes = heads.groupBy("block").agg(F.sum(F.size("grams")).alias("all"))
    heads_of = heads.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("heads")), F.ceil(F.col("all") / CHUNK)))
    met = _linked(heads_of.select("*", yes.alias("asks"), yes.alias("answers")), ["block", "part"], percent)
    rows = _renamed(rows, met)
    counts = rows.groupBy("block", "comp").agg(F.sum(F.size("grams")).alias("c"))
    mixed = counts.groupBy("block").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k"), F.sum("c").alias("all")).where("k > 1")
    mixed = mixed.select("block", F.col("m.comp").alias("major"), F.ceil((F.col("all") - F.col("m.c")) / CHUNK).cast("int").alias("askers"))
    open_rows = materialize(rows.join(mixed, "block"), "rest")
    asking = open_rows.where("comp <> major").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("asks")), F.col("askers")).cast("int"))
    asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "chunk", "part", "doc_id", "comp", "n", "grams", "dfs", yes.alias("asks"), F.lit(False).alias("answers"))
    answering = open_rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).select("block", "chunk", "part", "doc_id", "comp", "n", "grams", "dfs", F.lit(False).alias("asks"), yes.alias("answers"))
    rest = _linked(asking.unionByName(answering), ["block", "chunk", "part"], percent)
    release(heads, open_rows)
    return [met, rest]


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links) for every row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``size``-word
    n-grams (with fewer words, the whole sequence).

    1. Equal sets are one class, shown by its smallest id; copies go no further.
    2. Sets that share too little with all others together go (see _open_ids() and _open_sets()); those that
       stay keep the n-grams that others have, in one global order, the rarest first.
    3. Sets that share an n-gram of their prefixes are in one block, and so are all partners.
    4. A block's sets go to one task, or to several by hash. There they stand in a prefix tree
       and walk it (see Tree). Blocks with several chunks go through _large_links().

    Only links that join components leave a task. Texts without words are linked with nothing. Rows
    with a null id are not compared and have a null component. Rows of one id share a component.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heads = text.mapInArrow(_heads(size, percent), "doc_id long, n long, digest binary, low array<long>, need int")
    heads = materialize(heads.withColumn("salt", salt_of(F.col("doc_id"))), "heads")
    some = heads.where("n > 0 AND doc_id IS NOT NULL")
    classes = group_salted(some, ["digest"], "salt", {"lo": F.min("doc_id")}, {"rep": F.min("lo")})
    member = materialize(some.select("doc_id", "digest", "salt").distinct().join(classes, ["digest", "salt"]).select("doc_id", "rep", "salt"), "members")
    own = member.where("doc_id = rep").select(F.col("doc_id").alias("_id")).distinct()
    reps = heads.where("n > 0").join(own, F.col("doc_id") == F.col("_id"), "left_semi")
    wanted = _open_ids(reps)
    sizes = materialize(heads.select("doc_id", "n"), "sizes")
    release(heads)
    sets = _open_sets(text, wanted, percent, size)
    release(wanted)

    blocks = _blocks(sets, percent)
    rows = sets.join(blocks, "doc_id")
    parts = F.greatest(F.lit(1), F.ceil(F.sum(F.size("grams")) / CHUNK)).cast("int")
    rows = rows.join(rows.groupBy("block").agg(parts.alias("parts")), "block").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = materialize(rows.withColumn("comp", F.col("doc_id")), "blocks")
    yes = F.lit(True)
    links = [_linked(rows.select("*", yes.alias("asks"), yes.alias("answers")), ["block", "chunk"], percent)]
    large = rows.where("parts > 1")
    if not large.isEmpty():
        links += _large_links(_renamed(large, links[0]), percent)
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    comps = components(every)
    release(sets, rows, *links)

    named = lookup_salted(member, "rep", "salt", comps.select(F.col("node").alias("rep"), "comp"))
    named = materialize(named.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.coalesce("comp", "rep")).alias("comp")), "named")
    release(member, comps)
    out = sizes.join(named, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
