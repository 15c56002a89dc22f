"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal, by branch and bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANKS

#: Costs of the edits. A truncated row that is not deleted adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Initials of the roles, what may stand first in a row's code, and faults in the order in which they count.
ROLES, FAULTS = "suao", ("", "blank", "duplicate", "truncated")
#: States of a legal prefix (start, after system, after user, after assistant): the states that each role
#: leads to, the one role that an edit can give next, and whether a conversation may end there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN, ENDS = ("user", "user", "assistant", "user"), (True, False, False, True)
LEGAL = {"su", "ua", "au"}
#: Turns in a slice: what is sorted and joined at once.
SLICE = 1024


def _decode(codes: str) -> list[tuple[str, int]]:
    """(initial, fault number) of each row."""
    return [(ROLES[(ord(c) - 97) // 4], (ord(c) - 97) % 4) for c in codes]


def _edits(initial: str, fault: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row in a state, letters in ASCII order."""
    yield "D", DELETE, state
    if fault in (1, 2):
        return
    more = TRUNCATED if fault == 3 else 0
    if initial in NEXT[state]:
        yield "K", KEEP + more, NEXT[state][initial]
    yield "R", REROLE + more, NEXT[state][GIVEN[state][0]]


def _bounds(rows: list[tuple[str, int]]) -> list[list[int]]:
    """For each row and state the least cost of all that follows, whatever its audit."""
    far = 4 * INSERT + DELETE * (len(rows) + 1)
    found = [[0 if e else far for e in ENDS] for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        now = found[i]
        if i < len(rows):
            for q in range(4):
                now[q] = min(c + found[i + 1][to] for _, c, to in _edits(*rows[i], q))
        for _ in range(3):  # inserts: at most three in a row lead from one state to any other
            for q in range(4):
                now[q] = min(now[q], INSERT + now[NEXT[q][GIVEN[q][0]]])
    return found


def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation's row codes; of equal costs the ASCII-least audit.

    Depth first over (rows done, state), with an explicit stack whose branches are taken in ASCII
    order. A branch ends if its cost and the bound of its suffix do not beat the incumbent, or
    if its node was reached before at no more cost: the earlier prefix has the lesser audit. (Of
    two audits that reach a node at one cost none begins with the other: what is longer has only
    inserts more, which cost.) The incumbent is optimal when the stack is empty.
    """
    rows = _decode(codes)
    bounds = _bounds(rows)
    best, found = None, ""
    reached: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, int, str]] = [(0, 0, 0, 0, "")]
    path: list[str] = []
    while stack:
        i, q, cost, depth, letter = stack.pop()
        if best is not None and cost + bounds[i][q] >= best:
            continue
        if reached.get((i, q), cost + 1) <= cost:
            continue
        reached[(i, q)] = cost
        if letter:
            del path[depth - 1 :]
            path.append(letter)
        if i == len(rows) and ENDS[q]:
            best, found = cost, "".join(path[:depth])
            continue
        branches = [(i, NEXT[q][GIVEN[q][0]], cost + INSERT, depth + 1, "I")]
        if i < len(rows):
            branches += [(i + 1, to, cost + c, depth + 1, x) for x, c, to in _edits(*rows[i], q)]
        # The best of a node's branches is known from the bounds: others that cannot be optimal do not wait.
        least = min(c + bounds[j][to] for j, to, c, _, _ in branches)
        stack += sorted((b for b in branches if b[2] + bounds[b[0]][b[1]] <= least), key=lambda b: b[4], reverse=True)
    return best or 0, found


def illegal_pairs(codes: str) -> int:
    """Adjacent rows whose role initials may not follow each other."""
    initials = [r for r, _ in _decode(codes)]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) of conversations after the damage that their keys' crc32 choose; null role and text become a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), kind.alias("_k")).where("_k <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


ORDER = ("turn", "role", "text", "copy")


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copy): conv_id, codes, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows count by turn, nulls first; rows of one turn by role, text and copy (a number that only
    tells equal rows apart). Each row becomes one letter for its role's initial and its
    first fault. The letters of a slice of SLICE turns are joined first, then those of the
    slices, so that no task holds more of a long conversation than its letters.
    """
    full = F.rtrim(F.col("text"), F.lit(BLANKS))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn", "copy")) > 1
    fault = F.when(full == "", 1).when(again, 2).when(~F.substring(full, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.withColumn("fault", fault).withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62)).cast("long")))
    pos = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*ORDER))
    code = F.chr((F.lit(97) + F.instr(F.lit(ROLES), _initial(F.col("role"))) * 4 - 4 + F.col("fault")).cast("long"))
    counts = [F.count_if(F.col("fault") == n).alias(f) for n, f in enumerate(FAULTS) if f]
    slices = rows.withColumn("pos", pos).groupBy("conv_id", "slice").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("c")))), lambda x: x["c"]), "").alias("codes"),
        F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("turns"), *counts,
    )
    whole = slices.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "codes"))), lambda x: x["codes"]), "").alias("codes"),
        F.coalesce(F.max("hi") - F.min("lo") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).cast("long").alias(f) for f in FAULTS if f],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            solved = [solve(c) for c in codes]
            new = [pa.array([illegal_pairs(c) for c in codes], pa.int64()), pa.array([c for c, _ in solved], pa.int64()), pa.array([a for _, a in solved], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "illegal", "cost", "audit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return whole.mapInArrow(run, f"{schema}, illegal long, cost long, audit string")


class _Replay:
    """Applies a plan's audit to a conversation's rows as they come."""

    def __init__(self, conv_id: int | None, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.pos, self.lead = conv_id, audit, 0, 0, 0

    def _put(self, role: str | None, text: str, edit: str) -> tuple:
        given = GIVEN[0] if (self.pos - self.lead) % 2 == 0 else GIVEN[2]
        if edit == "K" and self.pos == 0 and role[:1] == "s":
            self.lead = 1
        self.pos += 1
        return self.conv_id, self.pos, role if edit == "K" else given, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put(None, "", "I")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(role, text, edit)


def repaired_turns(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, edit) of the repaired conversations; edit is K, R or I.

    Each conversation's rows follow its plan in one sorted stream of a task, and come out in
    order, so a long conversation passes a task without being held by it.
    """
    kind = rows.schema["turn"].dataType.simpleString()
    heads = planned.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(kind).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"))
    stream = heads.unionByName(rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copy"))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER).select("conv_id", "part", "role", "text")
    id_type = pa.int64() if rows.schema["conv_id"].dataType.simpleString() == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = None
        names = ["conv_id", "pos", "role", "text", "edit"]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names)

        for batch in batches:
            out: list[tuple] = []
            for conv_id, part, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part == 0:
                    out += replay.inserts() if replay else ()
                    replay = _Replay(conv_id, text)
                else:
                    out += replay.row(role, text)
            if out:
                yield packed(out)
        if replay and (out := list(replay.inserts())):
            yield packed(out)

    return stream.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, pos long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired_turns(): its conversations stand whole and in order in its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, ids = None, None, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([found.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            ids = batch.column("conv_id").type
            for conv_id, pos, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")], strict=True):
                if pos == 1:
                    if found:
                        yield packed()
                    now, found = conv_id, hashlib.sha256()
                found.update(f"{'' if pos == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if found:
            yield packed()

    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
