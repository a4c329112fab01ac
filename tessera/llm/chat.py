"""Chat formatting: role sequences repaired at least cost over an automaton of legal turns, then rendered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import stash

ROLES = ("system", "user", "assistant", "tool")
START = 4
#: Which role may follow which; a conversation ends after the assistant.
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1, 3), 3: (2, 3)}
LAST = 2
ALIASES = {"human": 1, "prompter": 1, "customer": 1, "bot": 2, "ai": 2, "gpt": 2, "model": 2, "function": 3, "developer": 0} | {r: i for i, r in enumerate(ROLES)}
INFINITE = 1 << 40
#: Turns of a partition on average, and of a block, at most; characters of a conversation that a task holds until it knows its end.
BLOCK_TURNS, BLOCK_CHARS = 20_000, 8 << 20


@dataclass(frozen=True)
class Costs:
    """Of joining a turn to the one before, of giving it another role (less if its role is unknown), of an empty turn."""

    merge: int = 2
    relabel: int = 5
    unknown: int = 1
    insert: int = 3


@lru_cache(maxsize=4096)
def role_number(role: str | None) -> int | None:
    return ALIASES.get((role or "").strip().lower())


def _inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from a state to another."""
    out = {}
    for s in range(5):
        reached, edge = {s: ()}, [s]
        while edge:
            x = edge.pop(0)
            for y in FOLLOWS[x]:
                if y not in reached:
                    reached[y] = (*reached[x], y)
                    edge.append(y)
        out |= {(s, t): way for t, way in reached.items()}
    return out


WAYS = _inserted()
#: Before a turn of role t after state s: the empty turns to insert, at least as many as needed for t to be legal.
BEFORE = {(s, t): min((WAYS[s, x] for x in range(5) if (s, x) in WAYS and t in FOLLOWS[x]), key=len, default=None) for s in range(5) for t in range(4)}


@lru_cache(maxsize=1024)
def choices(r: int | None, s: int, c: Costs) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """What may become of a turn of role r (None: unknown) after state s: cost, state after it, action, empty turns before it; the
    best come first for equal costs: keep, merge, relabel."""
    cost = lambda t: 0 if t == r else c.unknown if r is None else c.relabel
    out = []
    for t in range(4):
        ways = BEFORE[s, t]
        if ways is not None:
            out.append((cost(t) + c.insert * len(ways), t, "keep" if t == r else "relabel", ways))
    if s != START:
        out.append((cost(s) + c.merge, s, "merge", ()))
    order = {"keep": 0, "merge": 1, "relabel": 2}
    return sorted(out, key=lambda x: (x[0], order[x[2]], x[1]))


def block_costs(roles: list[str | None], c: Costs) -> list[list[int]]:
    """Least cost from each state before the block to each after it."""
    out = []
    numbers = [role_number(role) for role in roles]
    for start in range(5):
        row = [INFINITE] * 5
        row[start] = 0
        for role in numbers:
            after = [INFINITE] * 5
            for s in range(5):
                if row[s] < INFINITE:
                    for cost, t, _, _ in choices(role, s, c):
                        after[t] = min(after[t], row[s] + cost)
            row = after
        out.append(row)
    return out


def end_cost(s: int, c: Costs) -> int:
    return INFINITE if (s, LAST) not in WAYS else c.insert * len(WAYS[s, LAST])


def costs_ahead(blocks: list[list[list[int]]], c: Costs) -> list[list[int]]:
    """Before each block and after the last: the least cost from each state to the end of the conversation."""
    out = [[end_cost(s, c) for s in range(5)]]
    for m in reversed(blocks):
        out.append([min(m[s][t] + out[-1][t] for t in range(5)) for s in range(5)])
    return out[::-1]


def repair(roles: list[str | None], entry: int, after: list[int], c: Costs) -> list[tuple[str, int, tuple[int, ...], int]]:
    """For each turn of a block: action, role, empty turns before it, cost; the cheapest way from entry on, where `after` holds the
    cost of what follows the block by the state that it is left in. Of ways that cost the same, the first choice at the first
    turn where they differ: so it makes no difference where a conversation is cut into blocks."""
    numbers = [role_number(role) for role in roles]
    ahead = [after]
    for r in reversed(numbers):
        last = ahead[-1]
        ahead.append([min((cost + last[t] for cost, t, _, _ in choices(r, s, c)), default=INFINITE) for s in range(5)])
    out, s = [], entry
    for r, then in zip(numbers, ahead[-2::-1], strict=True):
        cost, t, action, ways = min(choices(r, s, c), key=lambda x: x[0] + then[x[1]])  # noqa: B023
        out.append((action, t, ways, cost))
        s = t
    return out


@lru_cache(maxsize=20_000)
def _repaired(roles: tuple[str | None, ...], c: Costs) -> list[tuple[str, int, tuple[int, ...], int]]:
    """repair() of a whole conversation; few sequences of roles make up most conversations."""
    return repair(list(roles), START, [end_cost(s, c) for s in range(5)], c)


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE = "<|im_end|>\n"


def render(text: str | None, action: str, role: int, ways: tuple[int, ...], first: bool) -> str:
    """A turn's part of the conversation: what stands before it is closed, empty turns come whole, its own is left open."""
    body = text or ""
    if action == "merge":
        return "\n" + body
    return ("" if first else CLOSE) + "".join(_open(w) + CLOSE for w in ways) + _open(role) + body


DONE = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role_in", pa.string()), ("action", pa.string()), ("role_out", pa.string()),
    ("n_inserted", pa.int32()), ("cost", pa.int64()), ("rendered", pa.string()),
])
DONE_SQL = "conv_id long, seq long, turn long, role_in string, action string, role_out string, n_inserted int, cost long, rendered string"


def _write_turns(out: list[list], conv: int | None, rows: list[tuple], steps: list, before: int, last: bool, c: Costs) -> None:
    """Add the repaired turns (turn, role, text) of a block to the columns of DONE."""
    for k, ((turn, role, text), (action, own, ways, cost)) in enumerate(zip(rows, steps, strict=True)):
        part, inserted = render(text, action, own, ways, before + k == 0), len(ways)
        if last and k == len(rows) - 1:
            tail = WAYS[own, LAST]
            part += CLOSE + "".join(_open(w) + CLOSE for w in tail)
            inserted, cost = inserted + len(tail), cost + c.insert * len(tail)
        for column, x in zip(out, (conv, before + k, turn, role, action, ROLES[own], inserted, cost, part), strict=False):
            column.append(x)


def format_turns(turns: DataFrame, costs: Costs = Costs(), partitions: int | None = None) -> DataFrame:  # noqa: B008
    """One row a turn of (conv_id, turn, role, text): conv_id, seq (from 0), turn, role_in, action, role_out, n_inserted (empty
    turns before it, at the last turn also after it), cost, rendered. A conversation is its rendered parts in order of seq.

    Turns are ordered by turn (null last), then role and text; repeated rows are turns of their own. Null ids are one
    conversation. Null and unknown roles take whichever role is cheapest, null texts are empty. An empty table has an empty result;
    other columns are left behind. A turn of any length is one row.

    Turns are range-partitioned and sorted in that order. One pass repairs every conversation that begins and ends inside a
    partition. What is left, the conversations at the ends of partitions and those too long to hold, is written as it is, in
    blocks: a block's least costs between states are a 5 x 5 matrix, from which follow, backwards over a conversation's blocks,
    the costs ahead of each; with these a block tells in which state it is left for each state it is entered in; and so, forwards,
    where each block begins. No task holds more of a conversation than a block, and how it is cut doesn't show.
    """
    spark = turns.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(turns.count() / BLOCK_TURNS))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "mark", "tie"]
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text",
        F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("tie"),
    )
    placed = own.repartitionByRange(n, *order).sortWithinPartitions(*order)
    met_schema = pa.schema([*DONE, ("pos", pa.int64())])

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        conv, began, chars, inside, cut = None, False, 0, False, False  # inside: begins in this partition; cut: too long to hold
        out: list[list] = [[] for _ in met_schema]

        def leave_open() -> None:
            for pos, turn, role, text in held:
                for column, x in zip(out, (conv, None, turn, role, None, None, None, None, text, pos), strict=True):
                    column.append(x)
            held.clear()

        for batch in batches:
            for c, turn, role, text, pos in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not began or c != conv:
                    if held and inside and not cut:
                        steps = _repaired(tuple(x[2] for x in held), costs)
                        _write_turns(out, conv, [x[1:] for x in held], steps, 0, True, costs)
                        out[-1] += [None] * len(held)
                        held.clear()
                    leave_open()
                    conv, inside, cut, chars, began = c, began, False, 0, True
                held.append((pos, turn, role, text))
                chars += len(text or "")
                if len(held) >= BLOCK_TURNS or chars >= BLOCK_CHARS:
                    cut = True
                    leave_open()
                    chars = 0
                if len(out[0]) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, met_schema, strict=True)], schema=met_schema)
                    out = [[] for _ in met_schema]
        leave_open()
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, met_schema, strict=True)], schema=met_schema)

    met = stash(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")).mapInArrow(one_pass, DONE_SQL + ", pos long"), "chat-turns")
    finished = met.where("pos is null").drop("pos")
    part, row = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)  # as monotonically_increasing_id() counts
    rest = met.where("pos is not null").select("conv_id", "turn", F.col("role_in").alias("role"), F.col("rendered").alias("text"), "pos", (part * (1 << 20) + F.floor(row / BLOCK_TURNS)).alias("block"))

    def by_block(table: pa.Table) -> tuple[int | None, int, pa.Table]:
        return table.column("conv_id")[0].as_py(), table.column("block")[0].as_py(), table.sort_by("pos")

    def measure(table: pa.Table) -> pa.Table:
        conv, block, table = by_block(table)
        m = block_costs(table.column("role").to_pylist(), costs)
        return pa.table({"conv_id": pa.array([conv], pa.int64()), "block": [block], "rows": [table.num_rows], "matrix": [sum(m, [])]})

    def look_ahead(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        ahead = costs_ahead([[r["matrix"][5 * s : 5 * s + 5] for s in range(5)] for r in rows], costs)
        before = [0]
        for r in rows:
            before.append(before[-1] + r["rows"])
        return pa.table({
            "conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "block": [r["block"] for r in rows], "ahead": ahead[1:], "before": before[:-1],
            "last": [k == len(rows) - 1 for k in range(len(rows))],
        })

    def leave(table: pa.Table) -> pa.Table:
        conv, block, table = by_block(table)
        roles, ahead = table.column("role").to_pylist(), table.column("ahead")[0].as_py()
        states = [repair(roles, s, ahead, costs)[-1][1] for s in range(5)]
        return pa.table({"conv_id": pa.array([conv], pa.int64()), "block": [block], "states": [states]})

    def enter(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        entry = [START]
        for r in rows:
            entry.append(r["states"][entry[-1]])
        return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "block": [r["block"] for r in rows], "entry": entry[:-1]})

    def finish(table: pa.Table) -> pa.Table:
        conv, _, table = by_block(table)
        head = table.slice(0, 1).to_pylist()[0]
        rows = list(zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True))
        out: list[list] = [[] for _ in DONE]
        _write_turns(out, conv, rows, repair([r[1] for r in rows], head["entry"], head["ahead"], costs), head["before"], head["last"], costs)
        return pa.table([pa.array(x, f.type) for x, f in zip(out, DONE, strict=True)], schema=DONE)

    def known(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "__conv", "block": "__block"})
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))).drop("__conv", "__block")

    blocks = rest.select("conv_id", "block", "pos", "role")
    matrices = blocks.groupBy("conv_id", "block").applyInArrow(measure, "conv_id long, block long, rows long, matrix array<long>")
    ahead = stash(matrices.groupBy("conv_id").applyInArrow(look_ahead, "conv_id long, block long, ahead array<long>, before long, last boolean"), "chat-ahead")
    leaves = known(blocks, ahead).groupBy("conv_id", "block").applyInArrow(leave, "conv_id long, block long, states array<long>")
    entries = leaves.groupBy("conv_id").applyInArrow(enter, "conv_id long, block long, entry long")
    repaired = known(known(rest, ahead), entries).groupBy("conv_id", "block").applyInArrow(finish, DONE_SQL)
    return finished.unionByName(repaired)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
