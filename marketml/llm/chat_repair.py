"""Minimum-cost repair of chat roles.

A conversation is legal if a finite automaton accepts its roles: an optional
system turn, then user and assistant in turn, ending with the assistant.  Dynamic programming
over the automaton's states finds the cheapest way to make it so: a turn keeps its role, is
relabelled, or is merged into the turn before it, and empty turns are inserted
where one is missing.  The repaired sequence is then rendered, turn by turn.

Scale: of a turn, the dynamic program needs only its role and whether it is empty, a small number (``code``).  Turns are
range-partitioned by (conversation, turn, role, text) and a row number that is written first, so one conversation with a third
of all rows spreads over many segments, and so do as many equal rows; what is kept of a segment is its rows' numbers and codes,
so a segment of long texts is as small as one of short texts.  The cheapest costs between states over a segment form a 4 x 4
matrix, and (min, +) products of such matrices join the segments.  They are taken in Spark, for each conversation ``fan``
segments at a time, then ``fan`` of those products, until one is left; then the states at the borders are handed down
the same way.  No task holds more than one segment or ``fan`` matrices, and the driver none.  A last join on the row number
brings the texts to their decisions.  Rendered pieces stay one for each turn; in order of ``place`` they make up the conversation.

Nulls and ties: a null or unknown role costs little to relabel; a null text is empty, and an empty
turn may be merged into any; rows without conv_id are one conversation; turns without a number
come first; turns that tie are taken in order of role and text, equal rows in that of their row numbers; of equally cheap repairs the first
in the order keep, merge, relabel, with fewest insertions, is taken, by the lowest state.  An empty
table gives no rows, a text of any length is rendered whole, and columns other than these four are not looked at.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import prepare
from marketml.session import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the three roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
FAR = float("inf")


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest row of empty turns from each state to each other."""
    paths: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (s, t), path in list(paths.items()):
            for x in NEXT[t]:
                if len(path) + 1 < len(paths.get((s, x), (0,) * 9)):
                    paths[s, x] = (*path, x)
    return paths


INSERTIONS = _insertions()


def _moves(role: int | None, empty: bool) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...]]]:
    """The cheapest (cost, action, insertions) from state to state over one turn."""
    best: dict = {}

    def offer(s, t, cost, action, inserted):
        rank = ("keep", "merge", "relabel").index(action)
        if (s, t) not in best or (cost, len(inserted), rank) < best[s, t][0]:
            best[s, t] = (cost, len(inserted), rank), (cost, action, inserted)

    for s in range(4):
        if s != START and (role in (s, None) or empty):
            offer(s, s, MERGE if role is not None else MERGE + NAME, "merge", ())
        for via, x in product(range(4), ROLES):
            if (s, via) in INSERTIONS and x in NEXT[via]:
                path = INSERTIONS[s, via]
                offer(s, x, len(path) * INSERT + (0 if x == role else NAME if role is None else RELABEL), "keep" if x == role else "relabel", path)
    return {k: v for k, (_, v) in best.items()}


MOVES = {(r, e): _moves(r, e) for r in (None, *ROLES) for e in (False, True)}
#: What it costs to end the conversation in each state.
CLOSE = {s: INSERTIONS[s, ASSISTANT] for s in ROLES}


def kind(role: str | None, text: str | None) -> tuple[int | None, bool]:
    return NAMES.get((role or "").strip().lower()), not (text or "").strip()


def costs(kinds: list, begin: list[float]) -> list[list[float]]:
    """Cheapest cost to reach each state after each turn, from ``begin``."""
    out = [begin]
    for k in kinds:
        new = [FAR] * 4
        for (s, t), (cost, _, _) in MOVES[k].items():
            new[t] = min(new[t], out[-1][s] + cost)
        out.append(new)
    return out


def final_state(cost: list[float]) -> int:
    return min(CLOSE, key=lambda s: (cost[s] + INSERT * len(CLOSE[s]), s))


def repair(kinds: list, first: int = START, last: int | None = None) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], float]:
    """(state before, state after, action, insertions) for each turn, and the cost;
    ``last`` is the state to end in, by default the cheapest to close."""
    reach = costs(kinds, [0 if s == first else FAR for s in range(4)])
    closing = last is None
    state = final_state(reach[-1]) if closing else last
    total = reach[-1][state] + (INSERT * len(CLOSE[state]) if closing else 0)
    steps = []
    for i in range(len(kinds) - 1, -1, -1):
        moves = MOVES[kinds[i]]
        before = next(s for s in range(4) if (s, state) in moves and reach[i][s] + moves[s, state][0] == reach[i + 1][state])
        steps.append((before, state, *moves[before, state][1:]))
        state = before
    return steps[::-1], total


def _say(role: int, text: str = "") -> str:
    return f"<|{ROLES[role]}|>\n{text}"


END = "<|end|>\n"


def render(before: int, after: int, action: str, inserted: tuple[int, ...], text: str | None, last: bool) -> str:
    """The piece that a turn adds; marks of the template in a text are parted."""
    text = (text or "").replace("<|", "< |")
    if action == "merge":
        piece = f"\n{text}" if text else ""
    else:
        piece = (END if before != START else "") + "".join(_say(r) + END for r in inserted) + _say(after, text)
    return piece + (END + "".join(_say(r) + END for r in CLOSE[after]) if last else "")


_ORDER = ("conv_id", "turn", "role", "text", "row")
#: Segments whose matrices one task multiplies.
FAN = 1024
KINDS = [(r, e) for r in (None, *ROLES) for e in (False, True)]


@F.arrow_udf(T.IntegerType())
def _code(roles: pa.Array, texts: pa.Array) -> pa.Array:
    """The place in KINDS of each turn."""
    return pa.array([KINDS.index(kind(r, t)) for r, t in zip(roles.to_pylist(), texts.to_pylist(), strict=True)], pa.int32())


def _conversations(table: pa.Table):
    """(conversation, places, codes) of each conversation of a segment, in order."""
    table = table.sort_by("place")
    conv, place, code = (table.column(c).to_pylist() for c in ("conv_id", "place", "code"))
    at = 0
    while at < len(conv):
        end = at
        while end < len(conv) and conv[end] == conv[at]:
            end += 1
        yield conv[at], place[at:end], code[at:end]
        at = end


def _matrix(kinds: list) -> list[float]:
    return [x for first in range(4) for x in costs(kinds, [0 if s == first else FAR for s in range(4)])[-1]]


def _times(a: list[float], b: list[float]) -> list[float]:
    """The (min, +) product of two matrices."""
    return [min(a[4 * s + v] + b[4 * v + t] for v in range(4)) for s in range(4) for t in range(4)]


def _matrices(table: pa.Table) -> pa.Table:
    seg = table.column("seg")[0].as_py()
    out = [(conv, _matrix([KINDS[c] for c in codes])) for conv, _, codes in _conversations(table)]
    return pa.table({"conv_id": pa.array([o[0] for o in out], table.schema.field("conv_id").type), "seg": pa.array([seg] * len(out), pa.int32()), "m": pa.array([o[1] for o in out], pa.list_(pa.float64()))})


def _product(fan: int):
    def run(table: pa.Table) -> pa.Table:
        """One matrix for up to ``fan`` neighbouring ones of a conversation."""
        rows = table.sort_by("seg").to_pylist()
        m = rows[0]["m"]
        for r in rows[1:]:
            m = _times(m, r["m"])
        return pa.table({"conv_id": table.column("conv_id")[:1], "seg": pa.array([rows[0]["seg"] // fan], pa.int32()), "m": pa.array([m], pa.list_(pa.float64()))})

    return run


def _borders(table: pa.Table) -> pa.Table:
    """The states at both ends of neighbouring parts, from those of their whole (before, after, ends)."""
    parts = table.sort_by("seg").to_pylist()
    whole = parts[0]
    reach = [[0 if s == whole["before"] else FAR for s in range(4)]]
    for p in parts:
        reach.append([min(reach[-1][s] + p["m"][4 * s + t] for s in range(4)) for t in range(4)])
    state, out = whole["after"], []
    for i in range(len(parts) - 1, -1, -1):
        before = next(s for s in range(4) if reach[i][s] + parts[i]["m"][4 * s + state] == reach[i + 1][state])
        out.append((parts[i]["seg"], before, state, whole["ends"] and i == len(parts) - 1))
        state = before
    seg, before, after, ends = zip(*out, strict=True)
    return pa.table({"conv_id": table.column("conv_id"), "seg": pa.array(seg, pa.int32()), "before": pa.array(before, pa.int32()), "after": pa.array(after, pa.int32()), "ends": pa.array(ends, pa.bool_())})


@F.arrow_udf(T.IntegerType())
def _final(matrices: pa.Array) -> pa.Array:
    return pa.array([final_state(m[4 * START : 4 * START + 4]) for m in matrices.to_pylist()], pa.int32())


def _boundaries(matrices: DataFrame, segments: int, fan: int) -> DataFrame:
    """(conv_id, seg, before, after, ends) for each row of ``matrices`` (conv_id, seg, m): the states that the
    cheapest repair has before and after it, and whether its conversation ends there."""
    conv = matrices.schema["conv_id"].dataType.simpleString()
    levels = [matrices]
    while segments > 1 or len(levels) == 1:
        segments = -(-segments // fan)
        above = levels[-1].groupBy("conv_id", F.floor(F.col("seg") / fan)).applyInArrow(_product(fan), f"conv_id {conv}, seg int, m array<double>")
        levels.append(materialize(above, "chat-products"))
    found = levels.pop().select("conv_id", "seg", F.lit(START).alias("before"), _final("m").alias("after"), F.lit(True).alias("ends"))
    for parts in reversed(levels):
        whole = found.select(F.col("conv_id").alias("w_id"), F.col("seg").alias("w_seg"), "before", "after", "ends")
        joined = parts.join(whole, F.col("conv_id").eqNullSafe(F.col("w_id")) & (F.floor(F.col("seg") / fan) == F.col("w_seg"))).drop("w_id")
        found = joined.groupBy("conv_id", "w_seg").applyInArrow(_borders, f"conv_id {conv}, seg int, before int, after int, ends boolean")
        found = materialize(found, "chat-borders")
    return found


def _decide(table: pa.Table) -> pa.Table:
    """The repair of each turn of a segment, between its boundary states."""
    borders = table.select(["conv_id", "before", "after", "ends"]).group_by("conv_id", use_threads=False).aggregate([("before", "max"), ("after", "max"), ("ends", "max")]).to_pylist()
    borders = {b["conv_id"]: (START, None, True) if b["before_max"] is None else (b["before_max"], b["after_max"], b["ends_max"]) for b in borders}
    row_of = dict(zip(table.column("place").to_pylist(), table.column("row").to_pylist(), strict=True))
    out = []
    for conv, places, codes in _conversations(table):
        first, last, ends = borders[conv]
        steps, _ = repair([KINDS[c] for c in codes], first, last)
        for i, (place, (before, after, action, inserted)) in enumerate(zip(places, steps, strict=True)):
            out.append((row_of[place], place, before, after, action, inserted, ends and i == len(places) - 1))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["d_row", "place", "before", "after", "action", "inserted", "final"])


@F.arrow_udf(T.StringType())
def _rendered(before: pa.Array, after: pa.Array, action: pa.Array, inserted: pa.Array, text: pa.Array, final: pa.Array) -> pa.Array:
    return pa.array([render(*r) for r in zip(*(c.to_pylist() for c in (before, after, action, inserted, text, final)), strict=True)], pa.string())


def repair_roles(conversations: DataFrame, segment_rows: int = 20_000, fan: int = FAN) -> DataFrame:
    """One row for each turn: conv_id, turn, place, role, new_role, action (keep, merge,
    relabel), inserted_before, inserted_after and the rendered piece."""
    prepare(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # Written before it is sorted on, so that a task that runs again sees the same numbers.
    turns = materialize(turns.withColumns({"row": F.monotonically_increasing_id(), "code": _code("role", "text")}), "chat-rows")
    segments = max(1, -(-turns.count() // segment_rows))
    order = [F.asc_nulls_first(c) for c in _ORDER]
    placed = turns.repartitionByRange(segments, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(placed.select("conv_id", "row", "code", F.spark_partition_id().alias("seg"), (F.shiftleft(F.spark_partition_id().cast("long"), 40) + within).alias("place")), "chat-places")
    spans = placed.groupBy("conv_id").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("s_id"))
    spanning = placed.join(spans, F.col("conv_id").eqNullSafe(F.col("s_id")), "left_semi")
    # At most two conversations of a segment span others too.
    conv = placed.schema["conv_id"].dataType.simpleString()
    matrices = materialize(spanning.groupBy("seg").applyInArrow(_matrices, f"conv_id {conv}, seg int, m array<double>"), "chat-matrices")
    borders = _boundaries(matrices, segments, fan).withColumnsRenamed({"conv_id": "b_id", "seg": "b_seg"})
    bound = placed.join(borders, F.col("conv_id").eqNullSafe(F.col("b_id")) & (F.col("seg") == F.col("b_seg")), "left").drop("b_id", "b_seg")
    decided = bound.groupBy("seg").applyInArrow(_decide, "d_row long, place long, before int, after int, action string, inserted array<int>, final boolean")
    names = F.array(*[F.lit(ROLES.get(s)) for s in range(4)])
    closing = F.array(*[F.array(*[F.lit(ROLES[r]) for r in CLOSE.get(s, ())]).cast("array<string>") for s in range(4)])
    none = F.array().cast("array<string>")
    return turns.join(decided, F.col("row") == F.col("d_row")).select(
        "conv_id", "turn", "place", "role", names[F.col("after")].alias("new_role"), "action",
        F.transform("inserted", lambda s: names[s]).alias("inserted_before"), F.when(F.col("final"), closing[F.col("after")]).otherwise(none).alias("inserted_after"),
        _rendered("before", "after", "action", "inserted", "text", "final").alias("rendered"))
