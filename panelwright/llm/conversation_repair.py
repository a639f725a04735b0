"""Repair of conversation structure by parallel Viterbi with rank convergence.

A conversation's rows are edited (keep, give another role, delete, insert)
until its role initials read ``(s?(ua)+)?``.  The automaton of that form has
four states, so what the rest of a conversation costs is a vector of four.

All rows are numbered in conversation order by one range-partitioned sort, so
a conversation of any length lies over many tasks, and are cut into chunks of
bounded size that hold one letter per row.  Each chunk is run backwards from a
speculative cost vector.  A vector matters only up to a constant, and the
vectors that occur differ from such a constant in few ways, so fix-up passes
rerun the chunks whose successor came out with another vector than they had
assumed, until none is left; a rerun stops where its vector differs from the
earlier run's only by a constant.  The chunks' vectors, stitched by their
constants, are the true costs to go; from them the edits are traced forwards,
for each state a chunk can be entered in, and the states are then chained.

Texts meet their edits in a last sort by conversation and are hashed as they
stream by.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import on_workers, store

CHUNK_BITS = 13              # a chunk holds at most 2^13 rows

# --- fixed values -------------------------------------------------------------
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5        # costs; keeping is free
START, SYSTEM, USER, ASSISTANT = range(4)             # states: after nothing, after s, u, a
ACCEPTING = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}    # the one role of user and assistant that can follow
ROLES = {"u": "user", "a": "assistant"}
# a row's letter: its initial (o: another one); capital: truncated; digit: to be deleted
LETTERS = {**{c: (c, "") for c in "suao"}, **{c.upper(): (c, "truncated") for c in "suao"}, **{str(i): (c, "deleted") for i, c in enumerate("suao")}}
BLANKS = " \t\n\x0b\x0c\r"
# ------------------------------------------------------------------------------

State = tuple[int, int, int, int]


def inserted(costs) -> State:
    """Costs to go when rows may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        for s in range(4):
            costs[s] = min(costs[s], INSERT + costs[STEP[s, NEXT[s]]])
    return tuple(costs)


def based(costs: State) -> tuple[State, int]:
    """The vector without its constant, and the constant."""
    least = min(costs)
    return tuple(c - least for c in costs), least


LAST, _ = based(inserted([0 if s in ACCEPTING else 10 ** 6 for s in range(4)]))


def moves(letter: str, s: int):
    """What a row can undergo in state ``s``: (edit, mark, cost, next state)."""
    initial, fault = LETTERS[letter]
    yield "D", "d", DELETE, s
    if fault != "deleted":
        extra = TRUNCATED if fault else 0
        if (s, initial) in STEP:
            yield "K", "k", extra, STEP[s, initial]
        yield "R", NEXT[s], RETYPE + extra, STEP[s, NEXT[s]]


class Backward:
    """Steps of the cost vector, remembered: vectors without their constant
    are few, so a row is one table lookup."""

    def __init__(self):
        self.known: dict = {}
        self.traced: dict = {}

    def step(self, vector: State, letter: str) -> tuple[State, int]:
        found = self.known.get((vector, letter))
        if found is None:
            found = based(inserted([min(cost + vector[t] for _, _, cost, t in moves(letter, s)) for s in range(4)]))
            self.known[vector, letter] = found
        return found

    def run(self, letters: str, vector: State) -> list[State]:
        """Vectors before each row and after the last, without constants."""
        out = [vector]
        for letter in reversed(letters):
            vector, _ = self.step(vector, letter)
            out.append(vector)
        return out[::-1]

    def first(self, letters: str, vector: State, before: State | None = None) -> State | None:
        """The vector before the first row.  ``before`` is the end vector of an
        earlier run: None says that the two runs met, from where on they are
        the same up to a constant, so the earlier result holds."""
        for letter in reversed(letters):
            vector, _ = self.step(vector, letter)
            if before is not None:
                before, _ = self.step(before, letter)
                if vector == before:
                    return None
        return vector

    def trace(self, letters: str, end: State, state: int) -> tuple[str, int, int]:
        """Marks of the cheapest edits, ASCII-least by their initials, from
        ``state`` on; their cost; the state after them.  A row's marks are the
        roles inserted before it (``U``, ``A``) and then ``k`` (kept), ``d``
        (deleted), ``u`` or ``a`` (given that role)."""
        key = (letters, end, state)
        if key in self.traced:
            return self.traced[key]
        vectors = self.run(letters, end)
        marks, total = [], 0
        for i, letter in enumerate(letters):
            here, after = vectors[i], vectors[i + 1]
            _, lost = self.step(after, letter)                   # the constant that ``here`` is without
            while True:
                found = {edit: (mark, cost, t) for edit, mark, cost, t in moves(letter, state) if cost + after[t] - lost == here[state]}
                if "D" in found or INSERT + here[STEP[state, NEXT[state]]] != here[state]:
                    break
                marks.append(NEXT[state].upper())
                total, state = total + INSERT, STEP[state, NEXT[state]]
            mark, cost, state = found[min(found)]
            marks.append(mark)
            total += cost
        if len(letters) < 32 and len(self.traced) < 100_000:
            self.traced[key] = "".join(marks), total, state
        return "".join(marks), total, state


def completion(state: int) -> str:
    """Roles inserted behind the last row."""
    out = ""
    while state not in ACCEPTING:
        out, state = out + NEXT[state].upper(), STEP[state, NEXT[state]]
    return out


# --- rows in conversation order ------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Rows ``conv, turn, role, text`` after the damage that the CRC-32 of
    ``conv:turn`` picks (NULL: one blank): 0 drops the row, 1 empties its
    text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes its role user.
    ``copy`` numbers the repeated row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(blank("conv"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(pick == 1, "").when(pick == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return rows.where(pick != 0).select(
        "conv", "turn", F.when(pick == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.when(pick == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _order() -> list[Column]:
    """Conversation order; rows of one turn by role and digest of the text."""
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def row_faults(rows: DataFrame) -> DataFrame:
    """Damaged rows without their texts, numbered in order: ``id, initial,
    fault`` (blank, duplicate, truncated or NULL) beside their sort key."""
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = rows.select("conv", "turn", "role", "digest", "copy", (said == "").alias("blank"),
                       (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    slim = slim.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    slim = store(slim.withColumn("id", F.monotonically_increasing_id()), "repair-rows")
    firsts = slim.groupBy("conv", "role", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return slim.join(firsts, "id", "left").select("conv", "turn", "role", "digest", "copy", "id",
                                                  F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def chunked(rows: DataFrame) -> DataFrame:
    """One row per conversation and chunk: its rows' letters in order, its
    illegal neighbours (with the last row of the chunk before) and the sort
    key of its first row."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = (F.when(F.col("fault") == "truncated", F.upper(known))
              .when(F.col("fault").isNotNull(), F.translate(known, "suao", "0123")).otherwise(known))
    entry = F.struct("id", letter.alias("letter"), "initial", "turn", "role", "digest", "copy")
    out = rows.groupBy("conv", F.shiftright("id", CHUNK_BITS).alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    before = F.lag(F.element_at("x", -1)["initial"]).over(Window.partitionBy("conv").orderBy("chunk"))
    firsts = F.concat(F.array(before), F.slice(F.transform("x", lambda e: e["initial"]), 1, F.size("x") - 1))
    pairs = F.zip_with(firsts, "x", lambda a, e: F.concat(a, e["initial"]))
    return out.withColumn("pairs", pairs).select(
        "conv", "chunk", F.array_join(F.transform("x", lambda e: e["letter"]), "").alias("letters"),
        F.size(F.filter("pairs", lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        *[F.col("x")[0][c].alias(c) for c in ("turn", "role", "digest", "copy")])


# --- parallel Viterbi ------------------------------------------------------------

def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def _run_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets ``begin``, the vector before each chunk, from ``end``, the one
    after it, which becomes ``used``; chunks run from that vector before pass."""
    machine = Backward()
    for batch in batches:
        out = []
        for letters, end, used, begin in zip(*[_column(batch, c) for c in ("letters", "end", "used", "begin")]):
            if end != used:
                new = machine.first(letters, tuple(end), tuple(used) if used else None)
                begin = begin if new is None else list(new)
            out.append(begin)
        columns = {c: batch.column(c) for c in batch.schema.names if c != "end"}
        columns |= {"used": batch.column("end"), "begin": pa.array(out, batch.schema.field("begin").type)}
        yield pa.RecordBatch.from_pydict(columns)


def costs_to_go(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``used``, the true vector after each chunk.

    Chunks of rows that must all be deleted pass a vector on as it is, so they
    are skipped when a chunk looks for its successor.  Passes end when every
    chunk was run from its successor's vector: one more than the longest
    series of neighbouring chunks whose runs never meet."""
    last = F.array(*[F.lit(x).cast("long") for x in LAST])
    none = F.lit(None).cast("array<bigint>")
    runs = on_workers(chunks).withColumns({"used": none, "begin": none})
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    behind = Window.partitionBy("conv").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("letters").rlike("[a-zA-Z]"), F.col("begin")), ignorenulls=True).over(behind)
    runs = store(runs.withColumn("end", last).mapInArrow(_run_chunks, ddl), "repair-pass")
    while True:
        runs = runs.withColumn("end", F.coalesce(end, last))
        if runs.where(F.col("end") != F.col("used")).isEmpty():
            return runs.drop("begin", "end")
        runs = store(runs.mapInArrow(_run_chunks, ddl), "repair-pass")


def _trace_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``marks, costs, exits``: a chunk's trace for each state it can be entered in."""
    machine = Backward()
    for batch in batches:
        traces = [[machine.trace(letters, tuple(used), s) for s in range(4)] for letters, used in zip(_column(batch, "letters"), _column(batch, "used"))]
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("letters", "used")}
        for at, (name, kind) in enumerate((("marks", pa.string()), ("costs", pa.int64()), ("exits", pa.int32()))):
            columns[name] = pa.array([[t[at] for t in ts] for ts in traces], pa.list_(kind))
        yield pa.RecordBatch.from_pydict(columns)


# --- edits meet texts --------------------------------------------------------------

_MARKS = re.compile("([UA]*)([kdua])")
_EDITS = str.maketrans("UAkdua", "IIKDRR")


class _Conversation:
    """One conversation as it streams by: chunks' marks first, then their rows."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.illegal = conv, START, 0, 0
        self.marks, self.waiting, self.hash, self.empty = [], deque(), hashlib.sha256(), True

    def chunk(self, marks, costs, exits, illegal):
        chosen = marks[self.state]
        self.marks.append(chosen)
        self.waiting.extend(_MARKS.findall(chosen))
        self.cost += costs[self.state]
        self.illegal += illegal
        self.state = exits[self.state]

    def line(self, role: str, text: str):
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def insert(self, roles: str):
        for r in roles.lower():
            self.line(ROLES[r], "")

    def row(self, role: str, text: str):
        before, mark = self.waiting.popleft()
        self.insert(before)
        if mark != "d":
            self.line(ROLES.get(mark, role), text)

    def result(self):
        tail = completion(self.state)
        self.insert(tail)
        return self.conv, self.illegal, self.cost + INSERT * len(tail), "".join([*self.marks, tail]).translate(_EDITS), self.hash.hexdigest()


def _apply(kind: pa.DataType):
    fields = [("conv", kind), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done, size = None, [], 0
        for batch in batches:
            for conv, role, text, marks, costs, exits, illegal in zip(*[_column(batch, c) for c in ("conv", "role", "text", "marks", "costs", "exits", "illegal")]):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.result())
                        size += 100 + len(done[-1][3])
                        if size > 1 << 22:
                            yield batch_of(done)
                            done, size = [], 0
                    current = _Conversation(conv)
                if marks is not None:
                    current.chunk(marks, costs, exits, illegal)
                else:
                    current.row(role, text)
        if current is not None:
            yield batch_of([*done, current.result()])
    return run


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation id of ``turns``: ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256`` of its rows
    after ``damaged``.

    NULL roles and texts count as one blank; rows of a NULL id are one
    conversation.  Rows of a NULL turn come first and count for no gap; rows of
    one turn are ordered by role and by the SHA-256 of their text, so repeated
    rows lie together.  An empty role has no initial and is no legal neighbour.
    A conversation of no row after the damage has zeros, an empty audit and the
    empty text's hash; an empty table gives an empty result.  Other columns are
    ignored.  Texts and conversations of any length are handled whole; only
    the hash of a repaired conversation, which has to read it in order, and its
    audit are made by one task, as a stream."""
    from pyspark.sql.pandas.types import to_arrow_type
    named = turns.select(*[F.col(c).alias(a) for c, a in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    rows = damaged(named).withColumn("digest", F.unhex(F.sha2("text", 256)))
    faults = row_faults(rows)
    traced = costs_to_go(chunked(faults))
    kind = {f.name: f.dataType.simpleString() for f in traced.schema}
    ddl = ", ".join(f"{c} {kind[c]}" for c in ("conv", "chunk", "illegal", "turn", "role", "digest", "copy"))
    traced = traced.select("conv", "chunk", "illegal", "turn", "role", "digest", "copy", "letters", "used").mapInArrow(
        _trace_chunks, f"{ddl}, marks array<string>, costs array<bigint>, exits array<int>")
    stream = (traced.unionByName(rows, allowMissingColumns=True).repartition("conv")
              .sortWithinPartitions(*_order(), F.col("chunk").asc_nulls_last())
              .select("conv", "role", "text", "marks", "costs", "exits", "illegal"))
    repaired = stream.mapInArrow(_apply(to_arrow_type(named.schema["conv"].dataType)),
                                 f"conv {kind['conv']}, illegal long, cost long, audit string, repaired_sha256 string")
    counts = faults.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, True)).alias(f) for f in ("blank", "duplicate", "truncated")])
    parts = (named.select("conv").distinct().unionByName(counts, allowMissingColumns=True)
             .unionByName(repaired, allowMissingColumns=True))
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    default = zero | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return parts.groupBy("conv").agg(*[F.coalesce(F.max(c), d).alias(c) for c, d in default.items()]).withColumnRenamed("conv", "conv_id")
