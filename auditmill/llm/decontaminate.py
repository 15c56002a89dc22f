"""Benchmark decontamination: BM25 over test items with block-max pruning."""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize

#: Okapi BM25 constants.
K1, B = 1.2, 0.75
#: Share of an entry's own score that a passage needs to be a candidate; share of the five-word
#: shingles of an item, or of one side of it, that a passage must hold to be a match.
CANDIDATE, MATCH, SHINGLE = 0.5, 0.8, 5
#: Words that a question or an answer must have to be a match on its own.
SIDE = 13
#: Entries in a block, words of items in one shard of the index, least words in half a passage.
BLOCK, SHARD_WORDS, HALF = 4, 2_000_000, 64
#: Passage positions that are scored at once.
CHUNK = 1 << 18
#: Blocks of passages' terms whose maxima are held at once.
CELLS = 1 << 22

#: The last sentence of an item stands for its answer, what comes before for its question.
ITEM = r"(?s)^(.*[.!?])\s+(\S.*)$"


def split_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, question, answer) of items that are one text: the answer is the last sentence, or empty."""
    answer = F.regexp_extract(text_col, ITEM, 2)
    question = F.when(answer == "", F.col(text_col)).otherwise(F.regexp_extract(text_col, ITEM, 1))
    return benchmark.select(F.col(id_col).alias("item_id"), question.alias("question"), answer.alias("answer"))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


class Shard:
    """An inverted index of one shard of items.

    An entry is a question or an answer of at least SIDE words, or the whole item if neither has
    as many. Impacts are BM25 term scores divided by the entry's score for its own text, so that
    every entry has the same threshold. ``top`` holds a term's largest impact, ``block_*`` its
    largest in each block of entries, ``post_*`` its postings.
    """

    def __init__(self, items: list[tuple[int, list[str], int]], df: dict[str, int], count: int, mean: float) -> None:
        self.ids = [i for i, _, _ in items]
        self.asked = [q for _, _, q in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words, _ in items for w in words}))}
        self.half = max([HALF, *(len(words) for _, words, _ in items)])
        self.words = [tuple(self.vocabulary[w] for w in words) for _, words, _ in items]
        n = np.array([df[w] for w in self.vocabulary], float)
        idf = np.log(1 + (count - n + 0.5) / (n + 0.5))
        self.entry_item: list[int] = []
        postings = []
        for k, words in enumerate(self.words):
            sides = [(a, b) for a, b in ((0, self.asked[k]), (self.asked[k], len(words))) if b - a >= SIDE]
            for a, b in sides or [(0, len(words))]:
                terms, tf = np.unique(np.array(words[a:b], np.int64), return_counts=True)
                impact = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (b - a) / mean))
                postings += zip(terms.tolist(), [len(self.entry_item)] * len(terms), (impact / impact.sum()).tolist(), strict=True)
                self.entry_item.append(k)
        postings.sort()
        size = len(self.vocabulary)
        terms = np.array([e[0] for e in postings], np.int64)
        self.post_entry = [e[1] for e in postings]
        self.post_impact = [e[2] for e in postings]
        self.post_start = np.searchsorted(terms, np.arange(size + 1))
        self.blocks = len(self.entry_item) // BLOCK + 1
        entries, impacts = np.array(self.post_entry, np.int64), np.array(self.post_impact)
        _, first = np.unique(terms * self.blocks + entries // BLOCK, return_index=True)
        self.block_max = np.maximum.reduceat(impacts, first) if len(first) else np.empty(0)
        self.block_no = entries[first] // BLOCK
        self.block_start = np.searchsorted(terms[first], np.arange(size + 1))
        # The entry for words outside the vocabulary is the last one.
        self.top = np.zeros(size + 1)
        np.maximum.at(self.top, terms, impacts)

    def candidates(self, passages: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, entry, score) of passages (word numbers, -1 for none) that reach the threshold.

        The bound of all blocks is tried first, then the bound of each block, for many passages
        at once; pivots() goes through the blocks that are left. Only blocks in which a passage's
        terms have postings are held, about CELLS at a time.
        """
        ids = np.sort(passages, axis=1)
        fresh = np.ones(ids.shape, bool)
        fresh[:, 1:] = ids[:, 1:] != ids[:, :-1]
        fresh &= ids >= 0
        limit = CANDIDATE - 1e-9
        rows = np.flatnonzero((self.top[ids] * fresh).sum(axis=1) >= limit)
        r, c = np.nonzero(fresh[rows])
        terms = ids[rows[r], c]
        starts = np.searchsorted(r, np.arange(len(rows) + 1))
        size = self.block_start[terms + 1] - self.block_start[terms]
        before = np.concatenate([[0], np.cumsum(size)])
        out, at = [], 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(before[starts], before[starts[at]] + CELLS, "right")) - 1)
            own = slice(starts[at], starts[to])
            owner = np.repeat(np.arange(own.start, own.stop), size[own])
            place = np.arange(len(owner)) + before[own.start] - before[owner] + self.block_start[terms[owner]]
            cells, cell = np.unique(r[owner] * self.blocks + self.block_no[place], return_inverse=True)
            passed = cells[np.bincount(cell, self.block_max[place], len(cells)) >= limit]
            found, first = np.unique(passed // self.blocks, return_index=True)
            for k, blocks in zip(found.tolist(), np.split(passed % self.blocks, first[1:]), strict=True) if len(found) else ():
                out += [(int(rows[k]), e, s) for e, s in self.pivots(terms[starts[k] : starts[k + 1]], blocks.tolist(), limit)]
            at = to
        return out

    def pivots(self, terms: np.ndarray, blocks: list[int], limit: float) -> list[tuple[int, float]]:
        """(entry, score) of the entries in the given blocks (sorted numbers) that score at least limit for the terms.

        WAND: each term has a cursor at its next entry. The pivot is the first entry at which the
        largest impacts of the cursors up to it can reach the limit; cursors before it jump to it,
        over all entries and blocks between, and it is scored when they all stand there.
        """
        entries, impacts, found = self.post_entry, self.post_impact, []

        def open_from(block: int) -> int:
            """The first entry of the first given block from this one on, or the end."""
            n = bisect_left(blocks, block)
            return (blocks[n] if n < len(blocks) else self.blocks) * BLOCK

        def jump(cursor: list, target: int) -> bool:
            while True:
                cursor[1] = bisect_left(entries, target, cursor[1], cursor[2])
                if cursor[1] == cursor[2]:
                    return False
                cursor[0] = entries[cursor[1]]
                target = open_from(cursor[0] // BLOCK)
                if target <= cursor[0]:
                    return True

        cursors = [[-1, int(self.post_start[t]), int(self.post_start[t + 1]), float(self.top[t])] for t in terms]
        cursors = [c for c in cursors if jump(c, open_from(0))]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= limit:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                here = [c for c in cursors if c[0] == pivot]
                score = sum(impacts[c[1]] for c in here)
                if score >= limit:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                here, target = [c for c in cursors if c[0] < pivot], pivot
            gone = [id(c) for c in here if not jump(c, target)]
            if gone:
                cursors = [c for c in cursors if id(c) not in gone]
        return found

    def overlaps(self, passage: np.ndarray, item: int) -> tuple[float, float, float]:
        """Shares of shingles that the passage holds: of the whole item, of its question, of its answer.

        What has under five words is one shingle; an empty question or answer has a share of 0.
        """
        words, asked = self.words[item], self.asked[item]
        held: dict[int, set] = {}

        def share(a: int, b: int) -> float:
            k = min(SHINGLE, b - a)
            if not k:
                return 0.0
            if k not in held:
                held[k] = {tuple(x) for x in np.lib.stride_tricks.sliding_window_view(passage, k).tolist()} if len(passage) >= k else set()
            grams = {words[i : i + k] for i in range(a, b - k + 1)}
            return len(grams & held[k]) / len(grams)

        return share(0, len(words)), share(0, asked), share(asked, len(words))

    def verdict(self, item: int, whole: float, asked: float, answer: float) -> str | None:
        """What makes a match: "both", "question", "answer", or "whole" if only all shingles together do; null for none."""
        n = self.asked[item]
        enough = lambda share, size: size >= SIDE and share >= MATCH - 1e-9
        sides = enough(asked, n), enough(answer, len(self.words[item]) - n)
        if any(sides):
            return "both" if all(sides) else "question" if sides[0] else "answer"
        return "whole" if whole >= MATCH - 1e-9 else None

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float, float, str]]]:
        """For each text its matches (item id, score, overlap, question overlap, answer overlap, by), each the best of all passages."""
        out: list[dict] = [{} for _ in texts]
        span, step = 2 * self.half, self.half
        get = self.vocabulary.get
        cache: dict[bytes, int] = {}
        rows, owners = [], []

        def flush() -> None:
            if not rows:
                return
            grid = np.full((len(rows), span), -1, np.int64)
            for k, row in enumerate(rows):
                grid[k, : len(row)] = row
            for k, entry, score in self.candidates(grid):
                item = self.entry_item[entry]
                best = out[owners[k]].get(item, (0.0,) * 4)
                out[owners[k]][item] = tuple(map(max, best, (*self.overlaps(rows[k], item), score)))
            rows.clear()
            owners.clear()

        for n, text in enumerate(texts):
            if not text:
                continue
            words = text.encode("utf-8", "surrogatepass").lower().split()
            for w in set(words).difference(cache):
                cache[w] = get(w.decode("utf-8", "surrogatepass"), -1)
            ids = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
            if len(cache) > 1_000_000:
                cache.clear()
            for at in range(0, max(1, len(ids) - step), step):
                part = ids[at : at + span]
                if (part >= 0).any():
                    rows.append(part)
                    owners.append(n)
                    if len(rows) * span >= CHUNK:
                        flush()
        flush()
        judged = ([(self.ids[i], s, w, q, a, self.verdict(i, w, q, a)) for i, (w, q, a, s) in found.items()] for found in out)
        return [sorted(m for m in found if m[-1]) for found in judged]


def shards(items: DataFrame) -> Iterator[Shard]:
    """The index of items (item_id, question, answer), one shard of about SHARD_WORDS words after the other.

    Document frequencies, lengths and counts are of all items; a shard's items and frequencies
    are gathered only when it is asked for, and its size does not grow with their number.
    """
    words = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("question")).alias("q"), _words(F.col("answer")).alias("a"))
    words = materialize(words.select("item_id", F.concat("q", "a").alias("words"), F.size("q").alias("asked")).where("size(words) > 0"), "items")
    count, total = words.agg(F.count("*"), F.sum(F.size("words"))).first()
    parts = -(-(total or 0) // SHARD_WORDS)
    words = words.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(parts, 1))))
    terms = words.select("shard", F.explode(F.array_distinct("words")).alias("term"))
    df = terms.groupBy("term").count()
    for k in range(parts):
        own = [(r["item_id"], r["words"], r["asked"]) for r in words.where(F.col("shard") == k).orderBy("item_id", "words").collect()]
        known = {r["term"]: r["count"] for r in df.join(terms.where(F.col("shard") == k).select("term").distinct(), "term", "left_semi").collect()}
        if own:
            yield Shard(own, known, count, total / count)


FIELDS = ("item_id", "score", "overlap", "question_overlap", "answer_overlap", "by")
MATCH_TYPE = "struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double,by:string>"
MATCHES = f"array<{MATCH_TYPE}>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in FIELDS[1:5]), ("by", pa.string())]))


def _searched(rows: DataFrame, shared) -> DataFrame:
    """rows (doc_id, text, check) with the matches of one broadcast shard in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(FIELDS, m, strict=True)) for m in ms] for ms in shared.value.search(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("check"), pa.array(found, _MATCHES)], ["doc_id", "check", "matches"])

    return rows.mapInArrow(run, f"doc_id long, check long, matches {MATCHES}")


def _each_shard(docs: DataFrame, items: DataFrame, answer):
    """answer(broadcast shard) of every shard; with several, each is written and its shard let go before the next is gathered."""
    found, waiting = [], None
    for shard in shards(items):
        if waiting is not None:
            found.append(materialize(answer(waiting), "matches"))
            waiting.destroy()
        waiting = docs.sparkSession.sparkContext.broadcast(shard)
    if waiting is not None:
        last = answer(waiting)
        found.append(materialize(last, "matches") if found else last)
        if len(found) > 1:
            waiting.destroy()
    return found


def find_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches (array of MATCH_TYPE, by item_id) for every row of docs.

    Every passage of every text is a query: passages are twice as long as the longest item of
    the shard and start at every half, so each occurrence of an item lies within one. Questions
    and answers that reach the candidate threshold by BM25 are verified on five-word shingles. An
    item matches if a passage holds at least MATCH of its question's shingles, or of its answer's
    (sides of SIDE words and more), or of all its shingles; ``by`` says which.

    Null and empty texts match nothing; neither do items without words. Repeated rows repeat. Ids
    are whole numbers. An index of one shard takes one pass over docs without a shuffle. A larger
    one takes a pass for each shard, one after the other, so that driver and tasks hold one shard
    at a time; only what matches is written and joined back.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("check"))
    found = _each_shard(docs, items, lambda shared: _searched(rows, shared))
    if not found:
        return rows.select("doc_id", F.array().cast(MATCHES).alias("matches"))
    if len(found) == 1:
        return found[0].select("doc_id", F.array_sort("matches").alias("matches"))
    some = functools.reduce(DataFrame.unionByName, [f.where("size(matches) > 0") for f in found]).select("doc_id", "check", F.explode("matches").alias("m"))
    some = some.groupBy(F.struct("doc_id", "check").alias("k")).agg(F.collect_set("m").alias("matches"))
    joined = rows.select("doc_id", F.struct("doc_id", "check").alias("k")).join(some, "k", "left")
    return joined.select("doc_id", F.coalesce(F.array_sort("matches"), F.array().cast(MATCHES)).alias("matches"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, whose text matches no item. One shard takes no shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def kept(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not m for m in shared.value.search(batch.column(at).to_pylist())], pa.bool_()))

        return docs.mapInArrow(run, schema)

    count = items.select(F.sum(F.size(_words(F.col("question"))) + F.size(_words(F.col("answer"))))).first()[0] or 0
    if count <= SHARD_WORDS:
        found = _each_shard(docs, items, kept)
        return found[0] if found else docs
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("check")).where("text IS NOT NULL")
    hit = _each_shard(docs, items, lambda shared: _searched(rows, shared).where("size(matches) > 0").select("check"))
    gone = functools.reduce(DataFrame.unionByName, hit).select(F.col("check").alias("_check")).distinct()
    return docs.join(gone, F.xxhash64(text_col) == F.col("_check"), "left_anti")
