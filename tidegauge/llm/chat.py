"""Chat formatting by minimum-cost role repair (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

ROLES = ("system", "user", "assistant")
#: States of the legal-turn automaton: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.5, 1.0, 3.0
#: Messages of one block. A longer conversation is dealt out by blocks, and all that is gathered of it
#: in one place is a matrix of 16 numbers a block.
BLOCK = 4096
#: Ranges of long conversations whose first rows are broadcast (at most some 40 MB); beyond, they are shuffled.
MOST_SPANS = 1 << 20
_INFINITE = float("inf")

#: The cheapest way from state to state by adding one turn: (cost, inserted roles).
_WAYS: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
for _s in range(4):
    for _t in (SYSTEM, USER, ASSISTANT):
        if _t in NEXT[_s]:
            _WAYS[_s, _t] = (0.0, ())
        else:
            _between = [m for m in NEXT[_s] if _t in NEXT[m]]
            if _between:
                _WAYS[_s, _t] = (INSERT, (_between[0],))
_CLOSE = {START: (0.0, ()), ASSISTANT: (0.0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}


def _relabel(role: str | None, target: int) -> float:
    own = (role or "").strip().lower()
    return (0.0 if own == ROLES[target - 1] else RELABEL) if own in ROLES else UNKNOWN


def _options(state: int, target: int) -> Iterator[tuple[float, tuple[int, ...], bool]]:
    """How a message labelled ``target`` can follow ``state``: (cost, inserted roles, merged)."""
    if (way := _WAYS.get((state, target))) is not None:
        yield (*way, False)
    if state == target:
        yield MERGE, (), True


def _step(costs: list[float], role: str | None) -> tuple[list[float], list]:
    best, back = [_INFINITE] * 4, [None] * 4
    for target in (SYSTEM, USER, ASSISTANT):
        label = _relabel(role, target)
        for state in range(4):
            if costs[state] < _INFINITE:
                for cost, inserted, merged in _options(state, target):
                    if costs[state] + label + cost < best[target]:
                        best[target], back[target] = costs[state] + label + cost, (state, inserted, merged)
    return best, back


def matrix(roles: list[str | None]) -> list[float]:
    """Least cost from each state to each by a run of messages, row by row."""
    out = []
    for entry in range(4):
        costs = [0.0 if s == entry else _INFINITE for s in range(4)]
        for role in roles:
            costs, _ = _step(costs, role)
        out += costs
    return out


def chain(matrices: list[list[float]]) -> list[tuple[int, int]]:
    """Entry and exit state of each of consecutive runs on the cheapest way from start to close."""
    costs, backs = [0.0 if s == START else _INFINITE for s in range(4)], []
    for m in matrices:
        best, back = [_INFINITE] * 4, [0] * 4
        for e in range(4):
            for x in range(4):
                if costs[e] + m[4 * e + x] < best[x]:
                    best[x], back[x] = costs[e] + m[4 * e + x], e
        costs = best
        backs.append(back)
    state, out = min(range(4), key=lambda s: costs[s] + _CLOSE[s][0]), []
    for back in reversed(backs):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def repair(messages: list[tuple[str | None, str | None]], entry: int = START, leave: int | None = None, close: bool = True) -> tuple[float, list[dict]]:
    """Cost and turns of the cheapest legal sequence for (role, text) messages in order.

    Each message keeps its label or gets another, opens a turn (after an empty turn of the role that
    is missing between, if need be) or is merged into the last. ``leave`` is the state to end in."""
    costs, backs = [0.0 if s == entry else _INFINITE for s in range(4)], []
    for role, _ in messages:
        costs, back = _step(costs, role)
        backs.append(back)
    end = leave if leave is not None else min(range(4), key=lambda s: costs[s] + (_CLOSE[s][0] if close else 0.0))
    path, state = [], end
    for back in reversed(backs):
        path.append((state, *back[state][1:]))
        state = back[state][0]
    turns: list[dict] = []
    for (target, inserted, merged), (role, text) in zip(reversed(path), messages, strict=True):
        for m in inserted:
            turns.append({"role": ROLES[m - 1], "text": "", "messages": 0, "relabelled": 0, "inserted": True, "continued": False})
        changed = int((role or "").strip().lower() != ROLES[target - 1])
        if merged and turns:
            turns[-1]["text"] += "\n\n" + (text or "")
            turns[-1]["messages"] += 1
            turns[-1]["relabelled"] += changed
        else:
            turns.append({"role": ROLES[target - 1], "text": text or "", "messages": 1, "relabelled": changed, "inserted": False, "continued": merged})
    if close:
        for m in _CLOSE[end][1]:
            turns.append({"role": ROLES[m - 1], "text": "", "messages": 0, "relabelled": 0, "inserted": True, "continued": False})
    return costs[end] + (_CLOSE[end][0] if close else 0.0), turns


def render(turns: list[dict], first: bool, last: bool) -> list[str]:
    """The turns in a chat template, one piece each; the pieces of all blocks in order are the whole."""
    out = []
    for i, t in enumerate(turns):
        head = "\n\n" if t["continued"] else ("" if first and not i else "<|end|>\n") + f"<|{t['role']}|>\n"
        out.append(head + t["text"] + ("<|end|>\n" if last and i == len(turns) - 1 else ""))
    return out


SCHEMA = "conv_id long, block long, position long, role string, text string, rendered string, messages int, relabelled int, inserted boolean, block_cost double"
_FIELDS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string()), ("messages", pa.int32()), ("relabelled", pa.int32()), ("inserted", pa.bool_()), ("block_cost", pa.float64())])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a sorted partition, run by run of equal leading columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """rows (conv_id, turn, role, text) with the block of each: its place in its conversation over
    ``block``. Conversations of up to ``block`` messages are one block.

    Longer ones are dealt out by ranges of the message order, so even one conversation that has most
    rows is many tasks' work; a place is that in the task's sorted rows plus the conversation's rows in
    the ranges before. Equal messages are told apart by nothing, so it does not matter which is first."""
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    counts = rows.groupBy("conv_id").count().filter(F.col("count") > block).select("conv_id")
    counts = materialise(counts, "long-conversations")
    short = rows.join(counts, same(rows, counts), "left_anti").withColumn("block", F.lit(0).cast("long"))
    if counts.isEmpty():
        return short
    long = rows.join(counts, same(rows, counts), "left_semi")
    ties = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))
    order = ["conv_id", "turn", "role", "_h", "text", "_tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = long.withColumns({"_h": F.xxhash64("text"), "_tie": ties}).repartitionByRange(parts, *(c for c in order if c != "text")).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "long-messages")
    spans = dealt.groupBy("conv_id", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = materialise(spans.select(F.col("conv_id").alias("_conv"), F.col("_part").alias("_of"), (before - F.col("_from")).alias("_shift")), "long-spans")
    placed = dealt.join(F.broadcast(spans) if spans.count() <= MOST_SPANS else spans, dealt["conv_id"].eqNullSafe(spans["_conv"]) & (dealt["_part"] == spans["_of"]))
    return short.unionByName(placed.select("conv_id", "turn", "role", "text", F.floor((F.col("_at") + F.col("_shift")) / F.lit(block)).cast("long").alias("block")))


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired turns of each conversation (conv_id, turn, role, text), a row each.

    ``block`` and ``position`` order a conversation's turns, and its ``rendered`` pieces in that
    order are its text in the chat template. Messages are ordered by turn, ties by role, then by the
    hash of the text; null turns come first. A role that is null or none of ROLES is relabelled at a
    lower cost. Null text counts as empty. Rows with a null conv_id are one conversation. Repeated rows
    are messages like others. An empty table gives no rows.

    Rows are dealt by conversation and block of messages. Only of conversations with several blocks
    the blocks' (min, +) matrices are gathered, to fix the state at each block's ends."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = _numbered(rows, block).select("conv_id", "block", "turn", "role", "text")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(*key, matrix([r[1] for r in run])) for key, run in _runs(batches, 2)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["conv_id", "block", "costs"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), run in _runs(batches, 1):
            found = chain([r[1] for r in run])
            last = len(run) - 1
            columns = [[conv] * len(run), [r[0] for r in run], [e for e, _ in found], [x for _, x in found], [not i for i in range(len(run))], [i == last for i in range(len(run))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], ["conv_id", "block", "entry", "leave", "first", "last"])

    order = ["conv_id", "block", "turn", "role", F.xxhash64("text"), "text"]
    ends = materialise(rows.groupBy("conv_id").agg(F.max("block").alias("_last")).filter("_last > 0").select("conv_id"), "long-conversations")
    long = rows.join(ends, rows["conv_id"].eqNullSafe(ends["conv_id"]), "left_semi").repartition("conv_id", "block").sortWithinPartitions(*order)
    fixed = long.select("conv_id", "block", "turn", "role").mapInArrow(matrices, "conv_id long, block long, costs array<double>")
    fixed = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(states, "conv_id long, block long, entry int, leave int, first boolean, last boolean")
    fixed = materialise(fixed, "block-states")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, part), run in _runs(batches, 2):
            _, _, _, entry, leave, first, last = run[0]
            alone = entry is None
            first, last = alone or first, alone or last
            cost, turns = repair([(r[1], r[2]) for r in run], entry or START, leave, last)
            for i, (t, text) in enumerate(zip(turns, render(turns, first, last), strict=True)):
                out.append((conv, part, i, t["role"], t["text"], text, t["messages"], t["relabelled"], t["inserted"], cost))
            if len(out) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)

    named = fixed.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    joined = rows.join(named, rows["conv_id"].eqNullSafe(named["_conv"]) & (rows["block"] == named["_block"]), "left").drop("_conv", "_block")
    return joined.repartition("conv_id", "block").sortWithinPartitions(*order).mapInArrow(repaired, SCHEMA)
