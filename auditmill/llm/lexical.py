"""Ranked lexical search: an index of compressed blocks, searched by Block-Max MaxScore shard by shard."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Results for each item, postings in a block, and the tokens or documents at which a shard is full.
TOP, BLOCK, SHARD_TOKENS, SHARD_DOCS = 20, 64, 1 << 22, 1 << 16
#: Words of items that one pass over the index answers, and documents that are scored at once at most.
ITEM_WORDS, WINDOW = 500_000, 8192
#: Parts that the heaps of an item are merged in first.
HEAP_PARTS = 64
#: Stands for a null id in an index; it sorts first, as null does.
NO_ID = -(1 << 63)

#: Bytes that are no part of a term become spaces, A-Z become small; bytes from 128 up belong to terms.
_TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))

INDEX = "shard long, term binary, df int, top_tf int, least_n int, blocks binary, postings binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of ASCII letters and digits and of what is not ASCII, only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class _Builder:
    """Gathers documents of one shard and packs their postings.

    A list is cut into blocks. Of each the directory has six numbers: first and last document,
    largest frequency, least length, where its bytes begin, and the widths of gaps (times 8) and
    frequencies, which are 1, 2 or 4 bytes each.
    """

    def __init__(self) -> None:
        self.numbers, self.ids, self.sizes, self.parts, self.tokens = _Numbers(), [], [], [], 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(terms))
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
        self.tokens += len(terms)

    def pack(self, shard: int) -> pa.RecordBatch:
        count, sizes = len(self.ids), np.array(self.sizes, np.int64)
        key = np.concatenate(self.parts).astype(np.int64) * count + np.repeat(np.arange(count), sizes)
        self.parts = []
        key, tf = np.unique(key, return_counts=True)
        term, doc = key // count, key % count
        df = np.bincount(term, minlength=len(self.numbers))
        begins = np.concatenate([[0], np.cumsum(df)])
        nth = np.arange(len(doc)) - begins[term]
        heads = np.flatnonzero(nth % BLOCK == 0)
        own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(doc))))
        length = np.diff(np.append(heads, len(doc)))
        gaps = np.where(nth % BLOCK == 0, 0, np.diff(doc, prepend=0))
        width = lambda x: np.where(x < 256, 1, np.where(x < 65536, 2, 4))
        top_tf, wide, wide_tf = np.maximum.reduceat(tf, heads), width(np.maximum.reduceat(gaps, heads)), width(np.maximum.reduceat(tf, heads))
        starts = np.concatenate([[0], np.cumsum(length * (wide + wide_tf))])
        data, place = np.zeros(starts[-1], np.uint8), np.arange(len(doc)) - heads[own]
        for values, widths, base in ((gaps, wide, starts[:-1]), (tf, wide_tf, starts[:-1] + length * wide)):
            for w in (1, 2, 4):
                some = np.flatnonzero(widths[own] == w)
                at = base[own[some]] + place[some] * w
                for b in range(w):
                    data[at + b] = (values[some] >> 8 * b) & 255
        firsts = np.searchsorted(heads, begins)  # a term's first block
        term_of_block = term[heads]
        least_n = np.minimum.reduceat(sizes[doc], heads)
        directory = np.stack([doc[heads], doc[heads + length - 1], top_tf, least_n, starts[:-1] - starts[firsts[term_of_block]], wide * 8 + wide_tf], axis=1).astype(np.int32)
        # One row of the shard's own stands before its terms: ids and lengths of its documents.
        own_row = pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int64()), "term": pa.array([b""], pa.binary()), "df": pa.array([count], pa.int32()), "top_tf": pa.array([int(sizes.sum())], pa.int32()), "least_n": pa.array([0], pa.int32()),
            "blocks": pa.array([np.array(self.ids, np.int64).tobytes()], pa.binary()), "postings": pa.array([sizes.astype(np.int32).tobytes()], pa.binary()),
        })
        rows = pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(df), shard), pa.int64()), pa.array(list(self.numbers), pa.binary()), pa.array(df.astype(np.int32)),
                pa.array(np.maximum.reduceat(top_tf, firsts[:-1]).astype(np.int32)), pa.array(np.minimum.reduceat(least_n, firsts[:-1]).astype(np.int32)),
                _binaries(directory.view(np.uint8), firsts * 24), _binaries(data, starts[firsts]),
            ],
            own_row.schema.names,
        )
        return pa.Table.from_batches([own_row, rows]).combine_chunks().to_batches()[0]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of every row and whole text of docs: a written table of INDEX.

    A task closes a shard at SHARD_TOKENS tokens or SHARD_DOCS documents and packs it; nothing is
    shuffled. Texts without terms are in no shard. Row order within a file is that of the
    shards, each with its own row first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, builder = TaskContext.get().partitionId() << 24, _Builder()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                builder.add(doc_id.as_py(), found)
                if builder.tokens >= SHARD_TOKENS or len(builder.ids) >= SHARD_DOCS:
                    yield builder.pack(shard)
                    shard, builder = shard + 1, _Builder()
        if builder.ids:
            yield builder.pack(shard)

    return materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX), "lexical")


class _Stats:
    """Figures of the whole corpus: documents with terms, and all their terms."""

    def __init__(self, docs: int, tokens: int) -> None:
        self.docs, self.tokens = docs, tokens

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))

    def share(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A posting's score but for its term's weight. It grows with tf and shrinks with n."""
        m = 75 + (25 * n.astype(np.int64) * self.docs) // self.tokens
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _List:
    """A term's postings in one shard. Blocks are unpacked when first needed; until then their last document stands in each place."""

    def __init__(self, row: dict, sizes: np.ndarray, stats: _Stats) -> None:
        self.packed, self.sizes, self.stats = row["postings"], sizes, stats
        self.first, self.last, top_tf, least_n, self.start, self.form = np.frombuffer(row["blocks"], np.int32).reshape(-1, 6).T
        self.bounds = stats.share(top_tf, least_n)
        self.top = int(self.bounds.max())
        self.begin = np.append(np.arange(len(self.last)) * BLOCK, row["df"])
        self.docs = np.repeat(self.last, np.diff(self.begin))
        self.shares = np.zeros(row["df"], np.int64)
        self.open = np.zeros(len(self.last), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]]:
            a, z = self.begin[b], self.begin[b + 1]
            wide, wide_tf = divmod(int(self.form[b]), 8)
            at = int(self.start[b])
            gaps = np.frombuffer(self.packed, f"<u{wide}", z - a, at)
            tf = np.frombuffer(self.packed, f"<u{wide_tf}", z - a, at + (z - a) * wide)
            self.docs[a:z] = self.first[b] + np.cumsum(gaps, dtype=np.int64)
            self.shares[a:z] = self.stats.share(tf, self.sizes[self.docs[a:z]])
            self.open[b] = True

    def between(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of all postings from lo up to hi."""
        self.unpack(np.arange(np.searchsorted(self.last, lo), np.searchsorted(self.first, hi)))
        a, z = np.searchsorted(self.docs, (lo, hi))
        return self.docs[a:z], self.shares[a:z]

    def block_bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the block that it would be in, and the block's bound (0 where there is none)."""
        block = np.minimum(np.searchsorted(self.last, docs), len(self.last) - 1)
        held = (docs >= self.first[block]) & (docs <= self.last[block])
        return block, np.where(held, self.bounds[block], 0)

    def shares_of(self, docs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.shares[at], 0)


class _Heap:
    """The best documents of one item so far."""

    def __init__(self, top: int) -> None:
        self.top, self.scores, self.ids, self.least = top, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.top:
            self.least = int(self.scores[-1])


def search_shard(wanted: list[tuple[int, _List]], ids: np.ndarray, heap: _Heap) -> None:
    """Offers a shard's documents that can enter the heap, for (weight, list) of an item's terms.

    Lists stand by their bounds, the least first. While those up to some place cannot reach the
    heap's least score together, a document must be in one of the other, essential lists: only
    these are read through, a window of documents at a time. The others are asked for the
    candidates, the strongest first: a candidate goes when its score, the bound of its block
    there and the bounds of the lists not yet asked stay below, before any block is unpacked.
    """
    wanted = sorted(((w * x.top, w, x) for w, x in wanted if w > 0), key=lambda x: x[0])
    upto = np.cumsum([b for b, _, _ in wanted])
    lo, step = 0, 512
    while lo < len(ids) and wanted:
        hi = min(len(ids), lo + step)
        essential = int(np.searchsorted(upto, heap.least))
        if essential == len(wanted):
            return
        sums = np.zeros(hi - lo, np.int64)
        for _, w, x in wanted[essential:]:
            docs, shares = x.between(lo, hi)
            sums[docs - lo] += w * shares
        docs = np.flatnonzero(sums)
        scores = sums[docs]
        docs = docs + lo
        for k in range(essential - 1, -1, -1):
            _, w, x = wanted[k]
            some = np.flatnonzero(scores + upto[k] >= heap.least)
            docs, scores = docs[some], scores[some]
            block, bound = x.block_bounds(docs)
            some = np.flatnonzero(scores + w * bound + (upto[k - 1] if k else 0) >= heap.least)
            docs, scores, block, bound = docs[some], scores[some], block[some], bound[some]
            x.unpack(np.unique(block[bound > 0]))
            scores = scores + w * x.shares_of(docs)
        some = np.flatnonzero(scores >= heap.least)
        if len(some):
            heap.offer(scores[some], ids[docs[some]])
        lo, step = hi, min(2 * step, WINDOW)


def _search(shared, top: int):
    """A task: the heaps of all items over the shards of a partition, whose rows come shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, stats = shared.value
        heaps = [_Heap(top) for _ in items]
        now, lists, ids, sizes = None, {}, None, None

        def finish() -> None:
            for (_, terms), heap in zip(items, heaps, strict=True):
                search_shard([(w, lists[t]) for t, w in terms if t in lists], ids, heap)

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if now is not None:
                        finish()
                    now, lists = row["shard"], {}
                    ids, sizes = np.frombuffer(row["blocks"], np.int64), np.frombuffer(row["postings"], np.int32)
                else:
                    lists[row["term"]] = _List(row, sizes, stats)
        if now is not None:
            finish()
        for n, heap in enumerate(heaps):
            if len(heap.ids):
                size = len(heap.ids)
                yield pa.RecordBatch.from_arrays([pa.array([n] * size, pa.int32()), pa.array([items[n][0]] * size, pa.int64()), pa.array(heap.ids), pa.array(heap.scores)], ["n", "item_id", "doc_id", "score"])

    return run


def _best(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the top documents of each item with a score above 0, from build_index().

    Items are answered in groups of about ITEM_WORDS words, which are all that is broadcast at a
    time; each group reads its terms' lists only, every shard's in one task, and a task keeps
    one heap for each item over all its shards. Heaps are merged by parts, then whole.

    Equal scores rank by doc_id, a null id first. Items without terms, or with none that a
    document has, have no rows. Repeated items with one text count once; with several texts under
    one id each is an item of its own. Repeated documents are ranked each.
    """
    spark = index.sparkSession
    totals = index.where(F.length("term") == 0).agg(F.sum("df").cast("long").alias("docs"), F.sum("top_tf").cast("long").alias("tokens")).first()
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").dropDuplicates()
    words = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    groups, found = -(-words // (6 * ITEM_WORDS)), []
    for k in range(groups if totals["docs"] else 0):
        rows: list[Row] = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k).collect()
        texts = [(r["item_id"], terms_of(r["text"])) for r in rows]
        names = sorted({t for _, ts in texts for t in ts})
        if not names:
            continue
        known = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in [b"", *names]], "term binary"))
        lists = index.join(known, "term", "left_semi")
        stats = _Stats(totals["docs"], totals["tokens"])
        weights = {bytes(r["term"]): stats.weight(r["df"]) for r in lists.where(F.length("term") > 0).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        counted = [(i, [(t, ts.count(t) * weights[t]) for t in dict.fromkeys(ts) if t in weights]) for i, ts in texts]
        shared = spark.sparkContext.broadcast((counted, stats))
        sorted_lists = lists.repartition("shard").sortWithinPartitions("shard", "term").select("shard", "term", "df", "blocks", "postings")
        heaps = sorted_lists.mapInArrow(_search(shared, top), "n int, item_id long, doc_id long, score long")
        part = _best(heaps.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(HEAP_PARTS))), ["n", "part"], top).drop("rank")
        part = _best(part, ["n"], top).select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        found.append(materialize(part, "ranked") if groups > 1 else part)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, found)
