"""Chat formatting (operator 7): role repair of minimum cost by dynamic programming over an automaton of legal turns.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ended by the assistant.
Every input turn is kept, merged into the turn before it, or relabelled, and empty turns may be inserted; the sum of
costs is least, and of the cheapest repairs the first in the order of ``ACTIONS`` is taken turn by turn.

A conversation may hold a large part of all turns, so no task needs a whole one: the table is range-partitioned by
(conversation, turn), and a conversation that crosses partitions is repaired in segments.  A segment is a 4 x 4 matrix
of least costs between automaton states; matrices are composed (at most two segments a partition come to the driver),
which gives each segment the costs after it and the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallel, pinned

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "merge", "relabel", "merge+relabel", "insert", "insert+relabel")
MERGE, RELABEL, INSERT = 1, 2, 3
NEVER = 1 << 40
#: Empty turns after the last one, by state, and their cost: a conversation ends with the assistant.
ENDINGS = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}
AFTER_ALL = tuple(ENDINGS[s][0] for s in range(4))

Vector = tuple[int, int, int, int]


class Step(NamedTuple):
    cost: int
    action: int
    inserted: int
    to: int


def _steps(role: int) -> tuple[tuple[Step, ...], ...]:
    """What may be done with a turn of this role (0: any other name) in each state, in order of preference."""
    out = []
    for state in range(4):
        own = []
        for to in (SYSTEM, USER, ASSISTANT):
            other = RELABEL if to != role else 0
            if to in FOLLOWS[state]:
                own.append(Step(other, 2 if other else 0, 0, to))
            if to == state:
                own.append(Step(MERGE + other, 3 if other else 1, 0, to))
            own += [Step(INSERT + other, 5 if other else 4, e, to) for e in FOLLOWS[state] if to in FOLLOWS[e]]
        out.append(tuple(sorted(own, key=lambda s: (s.action, s.to, s.inserted))))
    return tuple(out)


STEPS = {role: _steps(role) for role in range(4)}


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else 0


def costs_before(role: int, after: Vector) -> Vector:
    """Least cost to the end from each state, a turn of this role included."""
    return tuple(min((s.cost + after[s.to] for s in steps), default=NEVER) for steps in STEPS[role])


def matrix(roles: list[int]) -> list[Vector]:
    """Row t: the least cost from each state to state t over these turns."""
    out = []
    for t in range(4):
        v: Vector = tuple(0 if s == t else NEVER for s in range(4))
        for role in reversed(roles):
            v = costs_before(role, v)
        out.append(v)
    return out


def repair(roles: list[int], state: int = START, after: Vector = AFTER_ALL) -> tuple[list[Step], int]:
    """The steps of the preferred cheapest repair from a state, given the costs after the last turn; and the last state."""
    ahead = [after]
    for role in reversed(roles):
        ahead.append(costs_before(role, ahead[-1]))
    out = []
    for k, role in enumerate(roles):
        rest = ahead[len(roles) - 1 - k]
        best = min(s.cost + rest[s.to] for s in STEPS[role][state])
        step = next(s for s in STEPS[role][state] if s.cost + rest[s.to] == best)
        out.append(step)
        state = step.to
    return out, state


def _open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSE = "<|im_end|>\n"


def escape(text: str | None) -> str:
    """Content cannot open or close a turn."""
    return (text or "").replace("<|im_", "< |im_")


def render_steps(steps: list[Step], texts: list[str | None], first: bool, last: bool) -> list[str]:
    """What each turn adds to the rendered conversation; joined in order, these are the whole of it."""
    out = []
    for k, (step, text) in enumerate(zip(steps, texts, strict=True)):
        if step.action in (1, 3):
            out.append("\n" + escape(text))
        else:
            close = "" if first and k == 0 else CLOSE
            empty = _open(step.inserted) + CLOSE if step.inserted else ""
            out.append(close + empty + _open(step.to) + escape(text))
    if last and steps:
        out[-1] += CLOSE + "".join(_open(e) + CLOSE for e in ENDINGS[steps[-1].to][1])
    return out


SCHEMA = "conv_id long, turn long, role string, action string, new_role string, inserted string, cost long, rendered string"


class _Run(NamedTuple):
    conv: int | None
    turns: list
    roles: list
    texts: list


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """The conversations of a partition, in order."""
    run: _Run | None = None
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if run is None or run.conv != conv:
                if run is not None:
                    yield run
                run = _Run(conv, [], [], [])
            run.turns.append(turn)
            run.roles.append(role)
            run.texts.append(text)
    if run is not None:
        yield run


def _marked(runs: Iterator[_Run]) -> Iterator[tuple[_Run, bool, bool]]:
    """Each run with whether it is the partition's first and last."""
    held, first = None, True
    for run in runs:
        if held is not None:
            yield held, first, False
            first = False
        held = run
    if held is not None:
        yield held, first, True


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first and last run as cost matrices."""
    part, rows = TaskContext.get().partitionId(), []
    for run, first, last in _marked(_runs(batches)):
        if first or last:
            rows.append({"part": part, "first": first, "last": last, "conv": run.conv, "m": [x for row in matrix(list(map(role_of, run.roles))) for x in row]})
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("conv", pa.int64()), ("m", pa.list_(pa.int64()))]))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each input turn: (conv_id, turn, role, action, new_role, inserted, cost, rendered).

    ``inserted`` names the empty turn put before it ("" if none); ``rendered`` is what the turn adds to the
    conversation's text, in the order of turns.  Turns of a conversation are ordered by turn (nulls last), then role
    and a hash of the text, so repeated turns have a place each.  Role names ignore case and outer space; any other name or null
    must be relabelled.  Null texts are empty.  Rows without a conversation form one of their own.  An empty table gives
    an empty result; other columns are not read.  A text of any length is copied as it is, except for the names of
    special tokens in it; a conversation of any length is repaired in segments (see the module's text).
    """
    spark = turns.sparkSession
    given = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # rows that are equal in all columns are told apart by their number alone, so that ranges can split them too
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("tie"), F.col("number")]
    numbered = given.withColumn("tie", F.xxhash64("text", "role")).withColumn("number", F.monotonically_increasing_id())
    rows = numbered.repartitionByRange(parallel(spark), *order).sortWithinPartitions(*order).drop("tie", "number")
    rows = pinned(rows)
    ends = sorted(rows.mapInArrow(_edges, "part long, first boolean, last boolean, conv long, m array<long>").collect(), key=lambda r: (r["part"], not r["first"]))
    chains: list[list] = []
    for r in ends:  # two rows for each partition at most
        if chains and r["first"] and chains[-1][-1]["last"] and chains[-1][-1]["conv"] == r["conv"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    after: dict[tuple[int, bool], Vector] = {}
    for chain in chains:
        ahead: Vector = AFTER_ALL
        for r in reversed(chain):
            after[r["part"], r["first"]] = ahead
            m = [r["m"][4 * t : 4 * t + 4] for t in range(4)]
            ahead = tuple(min(NEVER, *(m[t][s] + ahead[t] for t in range(4))) for s in range(4))
    split = {(r["part"], r["first"]) for chain in chains if len(chain) > 1 for r in chain}
    entry: dict[tuple[int, bool], int] = {}
    if split:
        shared = spark.sparkContext.broadcast((split, after))

        def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, ahead = shared.value
            part, found = TaskContext.get().partitionId(), []
            for run, first, last in _marked(_runs(batches)):
                if (first or last) and (part, first) in wanted:
                    roles = list(map(role_of, run.roles))
                    found.append({"part": part, "first": first, "to": [repair(roles, s, ahead[part, first])[1] for s in range(4)]})
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("part", pa.int64()), ("first", pa.bool_()), ("to", pa.list_(pa.int64()))]))

        to = {(r["part"], r["first"]): r["to"] for r in rows.mapInArrow(exits, "part long, first boolean, to array<long>").collect()}
        for chain in chains:
            state = START
            for r in chain if len(chain) > 1 else ():
                key = r["part"], r["first"]
                entry[key] = state
                state = to[key][state]
    opens = {(c[0]["part"], c[0]["first"]) for c in chains}
    closes = {(c[-1]["part"], c[-1]["first"]) for c in chains}
    plan = spark.sparkContext.broadcast((after, entry, opens, closes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, begin, opening, closing = plan.value
        part = TaskContext.get().partitionId()
        for run, first, last in _marked(_runs(batches)):
            key = part, first
            edge = first or last
            steps, _ = repair(list(map(role_of, run.roles)), begin.get(key, START) if edge else START, ahead[key] if edge else AFTER_ALL)
            text = render_steps(steps, run.texts, not edge or key in opening, not edge or key in closing)
            n = len(steps)
            yield pa.RecordBatch.from_arrays(
                [pa.array([run.conv] * n, pa.int64()), pa.array(run.turns, pa.int64()), pa.array(run.roles, pa.string()), pa.array([ACTIONS[s.action] for s in steps]), pa.array([NAMES[s.to] for s in steps]), pa.array([NAMES[s.inserted] for s in steps]), pa.array([s.cost for s in steps], pa.int64()), pa.array(text, pa.string())],
                names=["conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "rendered"],
            )

    return rows.mapInArrow(work, SCHEMA)
