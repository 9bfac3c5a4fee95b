"""Repair of conversations whose turns are lost, blank, repeated, cut off or out of order.

The cheapest edits that make a conversation's roles read ``(s?(ua)+)?`` are found by a run-length
dynamic programme. A row is a symbol (its role's initial and its fault), and consecutive equal
symbols are one run. A symbol's transition is a min-plus matrix over what stands last (nothing, s, u
or a); a run of n rows is the n-th power, taken from cached binary powers, so a run costs the
logarithm of its length. Choices kept beside the costs are unrolled into the audit at the end.

Ties go to the ASCII-least audit without comparing strings: two edit strings over the same rows, from
the same state to different ones, differ before either ends (each ends in a row's edit, and equal
edits lead to equal states), so an order of the states is all that has to be carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: What may stand last: nothing yet, s, u, a; and what an added or reroled turn leads to.
_STATES, _NEXT, _NAMES = range(4), (2, 2, 3, 2), ("", "system", "user", "assistant")
_FAR = 1 << 60
#: Symbols: 0 must go; otherwise 1 + 2 * (initial's place in "?sua") + (1 if cut off).
_INITIALS = "sua"
_SPACE = r"\x20\x09-\x0D"


class Power:
    """A min-plus matrix: costs, the middle state chosen, and the order of a row's edit strings."""

    __slots__ = ("cost", "middle", "order", "edits")

    def __init__(self, cost: list, middle: list | None, order: list, edits: list | None = None):
        self.cost, self.middle, self.order, self.edits = cost, middle, order, edits


def _kept(state: int, role: int) -> bool:
    return state == 0 if role == 1 else state == 2 if role == 3 else role == 2 and state != 2


def _single(symbol: int) -> Power:
    """The transition of one row: added turns, then keep, rerole or delete."""
    role, cut_off = divmod(symbol - 1, 2) if symbol else (0, 0)
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for start in _STATES:
        state = start
        for added in range(3):
            price, before = added * INSERT, "I" * added
            ways = [(state, price + DELETE, before + "D")]
            if symbol:
                ways.append((_NEXT[state], price + REROLE + CUT_OFF * cut_off, before + "R"))
                if _kept(state, role):
                    ways.append((role, price + CUT_OFF * cut_off, before + "K"))
            for end, cost, edits in ways:
                found[start, end] = min(found.get((start, end), (_FAR, "")), (cost, edits))
            state = _NEXT[state]
    grid = [[found.get((i, j), (_FAR, "")) for j in _STATES] for i in _STATES]
    return Power([[c for c, _ in row] for row in grid], None, [_places([e for _, e in row]) for row in grid], [[e for _, e in row] for row in grid])


def _places(keys: list) -> list[int]:
    places = [0] * len(keys)
    for place, j in enumerate(sorted(range(len(keys)), key=keys.__getitem__)):
        places[j] = place
    return places


def _step(costs: list[int], order: list[int], by: Power) -> tuple[list[int], list[int], list[int]]:
    """One row of edit strings carried through ``by``: new costs, states come from, new order."""
    new, came = [], []
    for j in _STATES:
        cost, _, i = min((costs[i] + by.cost[i][j], order[i], i) for i in _STATES)
        new.append(min(cost, _FAR))
        came.append(i)
    return new, came, _places([(order[i], by.order[i][j]) for j, i in zip(_STATES, came)])


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Power:
    """The transition of 2 ** k equal rows; at most 9 symbols and as many k as a count has bits."""
    if k == 0:
        return _single(symbol)
    half = power(symbol, k - 1)
    rows = [_step(half.cost[i], half.order[i], half) for i in _STATES]
    return Power([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def _unrolled(symbol: int, k: int, i: int, j: int) -> Iterator[str]:
    here = power(symbol, k)
    if here.edits is not None:
        yield here.edits[i][j]
    else:
        m = here.middle[i][j]
        yield from _unrolled(symbol, k - 1, i, m)
        yield from _unrolled(symbol, k - 1, m, j)


def cheapest(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of (symbol, length) runs, in order."""
    costs, order = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3]
    trail: list[tuple[int, int, list[int]]] = []
    for symbol, length in runs:
        for k in range(length.bit_length()):
            if length >> k & 1:
                costs, came, order = _step(costs, order, power(symbol, k))
                trail.append((symbol, k, came))
    # Turns added at the end: none after nothing or a, one after u, two after s.
    closing = ("", "II", "I", "")
    cost, _, state = min((costs[s] + INSERT * len(closing[s]), order[s], s) for s in _STATES)
    steps, end = [], state
    for symbol, k, came in reversed(trail):
        steps.append((symbol, k, came[state], state))
        state = came[state]
    return cost, "".join(e for step in reversed(steps) for e in _unrolled(*step)) + closing[end]


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that the audit leaves or adds; ``rows`` are the (role, text) before."""
    state = 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "K":
            state = 1 + _INITIALS.index(role[0])
        elif edit in "RI":
            state = _NEXT[state]
            role = _NAMES[state]
        if edit != "D":
            yield edit, role, text


def _symbol(role: Column, fault: Column) -> Column:
    place = F.coalesce(*[F.when(F.substring(role, 1, 1) == i, k) for k, i in enumerate(_INITIALS, 1)], F.lit(0))
    return F.when(fault.isin("blank", "duplicate"), 0).otherwise(1 + 2 * place + (fault == "truncated").cast("int")).cast("int")


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, place, fault of every row, split by conversation.

    Null roles and texts are one space. Rows stand in order of turn (nulls first), then role, then
    text, so that rows that share a turn have a defined order. fault is '' for a sound row.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]).repartition("conv_id")
    ordered = [F.col("turn").asc_nulls_first(), "role", "text"]
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(ordered[0])) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank")
        .when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "truncated")
        .otherwise("")
    )
    placed = rows.withColumn("again", again).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(ordered)))
    return placed.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"))


def _streamed(turns: DataFrame) -> DataFrame:
    """Every row twice within its task: first all of a conversation's symbols, without text, then
    all its texts. So a task that meets a conversation knows its repair before it sees a text, and
    holds its runs and its audit, never its texts; sorting spills to disk."""
    rows = judged(turns)
    twice = rows.withColumn("symbol", _symbol(F.col("role"), F.col("fault"))).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    first = F.col("pass") == 0
    slim = twice.select(
        "conv_id", "pass", "place", F.when(first, F.col("turn")).alias("turn"), F.when(first, F.col("symbol")).alias("symbol"), F.when(first, F.col("fault")).alias("fault"),
        F.when(first, F.substring("role", 1, 1)).alias("initial"), F.when(~first, F.col("role")).alias("role"), F.when(~first, F.col("text")).alias("text"),
    )
    return slim.sortWithinPartitions("conv_id", "pass", "place").drop("place")


class _Case:
    """What is gathered of one conversation's symbols, and then its repair."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.runs: list[list[int]] = []
        self.turns = self.illegal = 0
        self.least = self.most = self.last = None
        self.audit: str | None = None
        self.cost = 0

    def see(self, turn: int | None, symbol: int, fault: str, initial: str) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        if fault:
            self.faults[fault] += 1
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def solve(self) -> None:
        self.cost, self.audit = cheapest([(s, n) for s, n in self.runs])

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Case, Iterator[tuple[str, str]]]]:
    """Each conversation with its repair, and its rows (role, text) as a stream to be used up at once."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    stream = rows()
    head = next(stream, None)

    while head is not None:
        case = _Case(head[0])
        while head is not None and head[1] == 0 and head[0] == case.conv_id:
            case.see(*head[2:6])
            head = next(stream, None)
        case.solve()

        def texts() -> Iterator[tuple[str, str]]:
            nonlocal head
            while head is not None and head[1] == 1 and head[0] == case.conv_id:
                yield head[6], head[7]
                head = next(stream, None)

        left = texts()
        yield case, left
        for _ in left:
            pass


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _run(turns: DataFrame, made: Callable[[_Case, Iterator[tuple[str, str, str]]], Iterator[tuple]], columns: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    kind = turns.schema["conv_id"].dataType.simpleString()
    key = pa.string() if kind == "string" else pa.int64()
    source = turns if kind == "string" else turns.withColumn("conv_id", F.col("conv_id").cast("long"))
    schema = pa.schema([("conv_id", key), *[(n, t) for n, (_, t) in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((row for case, rows in _cases(batches) for row in made(case, edited(case.audit, rows))), schema)

    ddl = ", ".join([f"conv_id {'string' if kind == 'string' else 'long'}", *[f"{n} {d}" for n, (d, _) in columns.items()]])
    return _streamed(source).mapInArrow(lean(run), ddl)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of every turn after the repair, counted from 0.

    Nulls, ties and empty tables as in ``repair_report``.
    """

    def made(case: _Case, rows: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        for place, (edit, role, text) in enumerate(rows):
            yield case.conv_id, place, edit, role, text

    return _run(turns, made, {"place": ("long", pa.int64()), "edit": ("string", pa.string()), "role": ("string", pa.string()), "text": ("string", pa.string())})


def repair_report(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text; other columns don't matter. Null roles and texts are one
    space; rows without conv_id are one conversation; rows without turn stand first and count for
    no gap; rows that share a turn stand in order of role and text. An empty role is no role, so
    its row must be reroled or deleted. An empty table gives no rows. One conversation is the work
    of one task, which holds its runs of symbols and its audit but not its texts.
    """

    def made(case: _Case, rows: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        digest, before = hashlib.sha256(), ""
        for _, role, text in rows:
            digest.update(f"{before}{role}:{text}".encode("utf-8", "replace"))
            before = "\n"
        yield case.conv_id, case.gaps, *case.faults.values(), case.illegal, case.cost, case.audit, digest.hexdigest()

    counts = {n: ("long", pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return _run(turns, made, counts | {"audit": ("string", pa.string()), "repaired_sha256": ("string", pa.string())})
