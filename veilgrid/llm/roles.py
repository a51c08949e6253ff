"""Minimum-cost repair of the roles of conversations, and their rendering.

A legal conversation is accepted by a small automaton: an optional system turn, then user and assistant in turn. Each
given turn may be kept, relabelled or merged into the one before, and empty turns may be inserted; dynamic
programming over the automaton finds the cheapest repair. The cost of a run of turns between two states
is a (min, +) matrix, so runs of one conversation that lie in several partitions are solved apart: their
matrices fix the states at the seams, and each run is then traced back by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: States of the automaton: the role of the last turn, 0 before the first.
ROLES = ["", "system", "user", "assistant"]
#: Roles that may follow each state, and states in which a conversation may end.
FOLLOW = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FINAL = (2, 3)
#: Costs of relabelling a known and an unknown role, of merging and of an inserted empty turn.
RELABEL, UNKNOWN, MERGE, INSERT = 1.5, 1.0, 1.0, 2.0

_INF = float("inf")


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest turns to insert between a state and a following role."""
    out: dict[tuple[int, int], tuple[int, ...]] = {}
    for start in FOLLOW:
        paths = [((), start)]
        while paths:
            path, at = paths.pop(0)
            for role in FOLLOW[at]:
                if (start, role) not in out:
                    out[start, role] = path
                    paths.append(((*path, role), role))
    return out


BRIDGES = _bridges()


def steps(role: int) -> list[tuple[float, int, int, str, tuple[int, ...]]]:
    """(cost, state before, state after, action, inserted) of each way to take a turn of a given role (0: unknown)."""
    out = []
    for before in range(4):
        for after in (1, 2, 3):
            label = 0.0 if role == after else RELABEL if role else UNKNOWN
            name = "" if role == after else "relabel"
            if after == before:
                out.append((label + MERGE, before, after, "merge" + ("+" + name if name else ""), ()))
            if (bridge := BRIDGES.get((before, after))) is not None:
                out.append((label + INSERT * len(bridge), before, after, name or "keep", bridge))
    return out


_STEPS = [steps(r) for r in range(4)]


def forward(costs: list[float], role: int) -> tuple[list[float], list[tuple | None]]:
    """Least cost of each state after one more turn, and the step that reaches it (the first of equals)."""
    best: list[float] = [_INF] * 4
    how: list[tuple | None] = [None] * 4
    for step in _STEPS[role]:
        total = costs[step[1]] + step[0]
        if total < best[step[2]]:
            best[step[2]], how[step[2]] = total, step
    return best, how


def ending(costs: list[float]) -> tuple[float, int, tuple[int, ...]]:
    """Cheapest end: cost, state after the last given turn, turns to append."""
    options = [(c, s, ()) for s, c in enumerate(costs) if s in FINAL]
    options += [(c + INSERT, s, (2,)) for s, c in enumerate(costs) if s < 2]
    return min(options)


def repair(roles: list[int], start: int = 0, end: int | None = None) -> tuple[float, list[tuple], tuple[int, ...]]:
    """Cost, one step for each turn, and turns appended at the end; ``end`` fixes the last state instead."""
    costs = [_INF] * 4
    costs[start] = 0.0
    trace = []
    for role in roles:
        costs, how = forward(costs, role)
        trace.append(how)
    total, state, extra = ending(costs) if end is None else (costs[end], end, ())
    path = []
    for how in reversed(trace):
        path.append(how[state])
        state = how[state][1]
    return total, path[::-1], extra


def matrix(roles: list[int]) -> list[list[float]]:
    """Least cost from each state to each over a run of turns."""
    out = []
    for start in range(4):
        costs = [_INF] * 4
        costs[start] = 0.0
        for role in roles:
            costs, _ = forward(costs, role)
        out.append(costs)
    return out


def number_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def _runs(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation within a partition."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(wide))):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def seams(parts: list[tuple[int, int, object, list[list[float]]]]) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """(entry state, exit state, whether it begins the conversation) of each run that is part of a longer conversation.

    ``parts`` are (partition, run, conversation, matrix) in order; an exit state None ends the conversation.
    """
    out = {}
    i = 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and parts[j + 1][2] == parts[i][2]:
            j += 1
        if j > i:
            costs = [[0.0, _INF, _INF, _INF]]
            for part in parts[i : j + 1]:
                costs.append([min(costs[-1][s] + part[3][s][t] for s in range(4)) for t in range(4)])
            _, state, _ = ending(costs[-1])
            for k in range(j, i - 1, -1):
                before = min(range(4), key=lambda s: costs[k - i][s] + parts[k][3][s][state])
                out[parts[k][0], parts[k][1]] = (before, None if k == j else state, k == i)
                state = before
        i = j + 1
    return out


def head(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


END = "<|end|>\n"


def rendered(texts: list[str], path: list[tuple], extra: tuple[int, ...], opens: bool, closes: bool) -> list[str]:
    """The part of the rendered conversation that each turn gives; together they are the whole."""
    out = []
    for i, (text, (_, _, after, action, inserted)) in enumerate(zip(texts, path)):
        if action.startswith("merge"):
            part = "\n" + text
        else:
            part = ("" if opens and not i else END) + "".join(head(r) + END for r in inserted) + head(after) + text
        out.append(part)
    if closes:
        out[-1] += END + "".join(head(r) + END for r in extra)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role_given, role, action, inserted, cost, rendered) for every turn of every conversation.

    Turns are ordered by number (nulls first), then role, then text. Null and unknown roles are relabelled, null texts are
    empty, rows without a conversation form one conversation of their own, and an empty table gives no rows. Parts
    rendered for the turns of a conversation, in order, make the whole conversation. Only the four named columns are
    read. A conversation may span any number of partitions; the driver sees two small matrices for each partition.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    near = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, out = TaskContext.get().partitionId(), None, []
        for run, (key, found) in enumerate(_runs(batches, 3)):
            last = (at, run, key, [number_of(r[2]) for r in found])
            if not run:
                out.append(last)
        if last is not None and last[1]:
            out.append(last)
        cols = list(zip(*[(p, r, k, [c for line in matrix(roles) for c in line]) for p, r, k, roles in out])) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "run", "key", "costs"])

    ends = near.select("conv_id", "turn", "role").mapInArrow(edges, "part int, run int, key long, costs array<double>").collect()
    parts = sorted(((r["part"], r["run"], r["key"], [r["costs"][i : i + 4] for i in (0, 4, 8, 12)]) for r in ends), key=lambda p: p[:2])
    fixed = turns.sparkSession.sparkContext.broadcast(seams(parts))  # at most two entries for each partition

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = TaskContext.get().partitionId(), []
        names = ["conv_id", "turn", "role_given", "role", "action", "inserted", "cost", "rendered"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names=names)
        for run, (_, found) in enumerate(_runs(batches, 4)):
            start, end, opens = fixed.value.get((at, run), (0, None, True))
            _, path, extra = repair([number_of(r[2]) for r in found], start, end)
            parts = rendered([r[3] or "" for r in found], path, extra, opens, end is None)
            for i, (r, step, part) in enumerate(zip(found, path, parts)):
                after_all = extra if i + 1 == len(found) else ()
                inserted = ",".join(ROLES[x] for x in (*step[4], *after_all))
                out.append((r[0], r[1], r[2], ROLES[step[2]], step[3], inserted, step[0] + INSERT * len(after_all), part))
            if len(out) > 4096:
                yield made(out)
                out = []
        yield made(out)

    return near.mapInArrow(solve, "conv_id long, turn long, role_given string, role string, action string, inserted string, cost double, rendered string")
