"""Chat formatting by minimum-cost role repair.

Legal conversations are an automaton over roles: an optional system turn, then user and assistant in turn, beginning
with user and ending with assistant. Dynamic programming picks, turn by turn, the cheapest mix of keeping a turn,
relabelling it, merging it into the turn before, and inserting an empty turn; the repaired turns are then rendered.

The cost of a stretch of turns is a matrix from the state before it to the state after it, and stretches combine by the
min-plus product, which is associative. So a conversation is cut into blocks of turns; blocks are solved in parallel,
their small matrices are combined along the conversation, and each block is traced back between the states so found.
Blocks go by turn number; where turns repeat or are null, a block of too many rows is cut again by the rows' order. So
no block has more than BLOCK rows, however long a conversation is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, numbers, whole_groups
from .shared import partitions, prepare, stored_by_workers

#: States of the automaton: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = ("", "system", "user", "assistant")
#: Costs of the edits (fixed values of the operator).
MERGE, RELABEL, INSERT = 2, 3, 4
FORBIDDEN = 1 << 40
#: Legal next roles of each state, and the empty turns that lead from a state to a role that may not follow it.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BLOCK = 256


def bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """(state, role) -> the roles to insert so that role may follow; missing if it never may."""
    out = {}
    for state in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            if role in NEXT[state]:
                out[state, role] = ()
            else:
                for mid in NEXT[state]:
                    if role in NEXT[mid]:
                        out.setdefault((state, role), (mid,))
    return out


BRIDGE = bridges()


def moves(role: int) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(from, to, cost, edit, inserted) for one turn of the given role (0: unknown), cheapest first, each pair once."""
    best: dict[tuple[int, int], tuple[int, str, tuple[int, ...]]] = {}
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            ways = []
            if state == to:
                ways.append((MERGE + RELABEL * (role != to), "merge", ()))
            if (state, to) in BRIDGE:
                inserted = BRIDGE[state, to]
                ways.append((RELABEL * (role != to) + INSERT * len(inserted), "keep" if role == to else "relabel", inserted))
            if ways:
                best[state, to] = min(ways)
    return [(a, b, *w) for (a, b), w in best.items()]


MOVES = {role: moves(role) for role in range(4)}
#: Cost of ending in a state: an empty assistant turn is added where the last is a user's (or none).
ENDING = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLE.index(name) if name in ROLE else 0


def step(costs: np.ndarray, role: int) -> np.ndarray:
    """costs (k by state) after one more turn."""
    out = np.full_like(costs, FORBIDDEN)
    for a, b, cost, _, _ in MOVES[role]:
        out[:, b] = np.minimum(out[:, b], costs[:, a] + cost)
    return np.minimum(out, FORBIDDEN)


def matrix(roles: list[int]) -> np.ndarray:
    out = np.full((4, 4), FORBIDDEN, np.int64)
    np.fill_diagonal(out, 0)
    for r in roles:
        out = step(out, r)
    return out


def trace(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """For each turn the role it gets, its edit, and the roles inserted before it, on a cheapest way from begin to end."""
    costs = np.full(4, FORBIDDEN, np.int64)
    costs[begin] = 0
    back: list[dict[int, tuple[int, str, tuple[int, ...]]]] = []
    for r in roles:
        new, how = np.full(4, FORBIDDEN, np.int64), {}
        for a, b, cost, edit, inserted in MOVES[r]:
            if costs[a] + cost < new[b]:
                new[b], how[b] = costs[a] + cost, (a, edit, inserted)
        costs = new
        back.append(how)
    out, state = [], end
    for how in reversed(back):
        a, edit, inserted = how[state]
        out.append((state, edit, inserted))
        state = a
    return out[::-1]


MARKER = re.compile(r"<(\\*)\|im_(start|end)\|>")


def escape(text: str) -> str:
    """A text in which no marker of a turn can be read: one backslash more in each; taking it away gives the text back."""
    return MARKER.sub(r"<\\\1|im_\2|>", text) if "|im_" in text else text


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


KEYS = ["none", "conv", "block", "sub"]
ORDER = ["turn", "role", "text"]


def cut(base: DataFrame, block: int) -> DataFrame:
    """base (none, conv, turn, role, text) with the block and the part of it (sub) of each row: at most `block` rows to a
    part. Parts follow in the order of turn, role and text; rows equal in these may change places."""
    base = base.withColumn("block", F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / block).cast("long"))
    groups = KEYS[:-1]
    big = base.groupBy(*groups).count().where(F.col("count") > block).select(*groups)
    big = stored_by_workers(big, iter, big.schema, "crowded")
    whole = base.withColumn("sub", F.lit(0).cast("long"))
    if not big._rows:
        return whole

    def number(batches):
        last, n, first = None, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sub = []
            for key in zip(*(column(batch, k).to_pylist() for k in groups), strict=True):
                last, n = key, n + 1 if key == last else 0
                sub.append(first + n // block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sub, pa.int64())], names=[*batch.schema.names, "sub"])

    # the row number deals out rows that are equal
    crowd = base.join(F.broadcast(big), groups).select(*base.columns, F.monotonically_increasing_id().alias("row"))
    crowd = crowd.repartitionByRange(partitions(base.sparkSession), *groups, *ORDER, "row").sortWithinPartitions(*groups, *ORDER, "row").drop("row")
    numbered = stored_by_workers(crowd, number, whole.schema, "numbered")
    return whole.join(F.broadcast(big), groups, "left_anti").select(*whole.columns).unionByName(numbered)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input turn: conversation, turn, role, new_role, edit, inserted (empty turns before it), closing
    (empty turns after the last), cost (of the whole conversation), rendered (its part of the conversation's text).

    The parts of a conversation, in the order of turn, join to its rendered text. edit is keep, relabel or merge; a
    merged turn goes on in the turn before it. Turns with equal numbers follow in the order of role and text; a null
    turn comes first; a null role is unknown and is relabelled; a null text is empty; markers of
    turns inside a text are escaped; rows with a null conversation
    form one conversation. An empty table gives no rows.
    """
    spark = turns.sparkSession
    prepare(spark)
    base = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("none", F.col("conv").isNull()).withColumn("conv", F.coalesce("conv", F.lit(0)))
    base = cut(base, block)
    order = [F.asc_nulls_first(c) for c in ORDER]
    keys = KEYS

    def solve(batches):
        for batch, bounds in whole_groups(batches, *keys):
            codes = [role_code(r) for r in column(batch, "role").to_pylist()]
            firsts = pa.array(bounds[:-1])
            mats = [matrix(codes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, k).take(firsts) for k in keys] + [pa.array(mats, pa.binary())], names=[*keys, "mat"])

    def walk(batches):
        for batch, bounds in whole_groups(batches, "none", "conv"):
            mats = column(batch, "mat")
            begin, end, total, last = ([0] * batch.num_rows for _ in range(4))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                costs = [np.array([0] + [FORBIDDEN] * 3, np.int64)]
                held = [np.frombuffer(mats[i].as_py(), np.int64).reshape(4, 4) for i in range(lo, hi)]
                for m in held:
                    costs.append(np.minimum((costs[-1][:, None] + m).min(axis=0), FORBIDDEN))
                finish = costs[-1] + np.array([ENDING[s] for s in range(4)])
                state = int(finish.argmin())
                cost = int(finish[state])
                for i in range(hi - 1, lo - 1, -1):
                    before = costs[i - lo] + held[i - lo][:, state]
                    begin[i], end[i], total[i], last[i] = int(before.argmin()), state, cost, int(i == hi - 1)
                    state = begin[i]
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in keys] + [pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(total, pa.int64()), pa.array(last, pa.int32())], names=[*keys, "begin", "end", "cost", "last"])

    def write(batches):
        for batch, bounds in whole_groups(batches, *keys):
            raw, texts = column(batch, "role").to_pylist(), [escape(t or "") for t in column(batch, "text").to_pylist()]
            codes = [role_code(r) for r in raw]
            begin, end, last = numbers(batch, "begin"), numbers(batch, "end"), numbers(batch, "last")
            new, edits, inserted, closing, parts = [], [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i, (state, edit, extra) in zip(range(lo, hi), trace(codes[lo:hi], int(begin[lo]), int(end[lo])), strict=True):
                    part = "".join(render(ROLE[x], "") for x in extra)
                    if edit == "merge":
                        part = "\n" + texts[i]
                    else:
                        part += f"<|im_start|>{ROLE[state]}\n{texts[i]}"
                    new.append(ROLE[state])
                    edits.append(edit)
                    inserted.append(len(extra))
                    closing.append(0)
                    parts.append(part)
                if last[lo]:
                    after = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(int(end[lo]), ())
                    closing[-1] = len(after)
                    parts[-1] += "<|im_end|>\n" + "".join(render(ROLE[x], "") for x in after)
            opening = {i for i in bounds[:-1].tolist() if begin[i] == START}
            for i in range(len(parts)):  # a turn that is not merged first ends the one before it
                if edits[i] != "merge" and i not in opening:
                    parts[i] = "<|im_end|>\n" + parts[i]
            conv = pa.array([None if n else c for n, c in zip(column(batch, "none").to_pylist(), column(batch, "conv").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([conv, column(batch, "turn"), pa.array(raw, pa.string()), pa.array(new), pa.array(edits), pa.array(inserted, pa.int32()), pa.array(closing, pa.int32()), column(batch, "cost"), pa.array(parts)], names=names)

    names = ["conv_id", "turn", "role", "new_role", "edit", "inserted", "closing", "cost", "rendered"]
    blocks = base.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(solve, "none boolean, conv long, block long, sub long, mat binary")
    states = stored_by_workers(blocks.repartition("none", "conv").sortWithinPartitions(*keys), walk, "none boolean, conv long, block long, sub long, begin int, end int, cost long, last int", "states")
    joined = base.join(states, keys).repartition(*keys).sortWithinPartitions(*keys, *order)
    return joined.mapInArrow(write, f"`{conv_col}` long, turn long, role string, new_role string, edit string, inserted int, closing int, cost long, rendered string".replace("conv_id", conv_col))

