"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns in alternation, ending on an assistant
turn. Every turn can be kept, merged into a like turn before it, or given another role, and empty turns can be put in
anywhere; dynamic programming over the automaton's states finds the cheapest repair. A block of turns is a matrix of
least costs between states, and such matrices multiply in (min, +), so long conversations are repaired block by block:
blocks send their matrices, the states at their borders are fixed, and each block is then repaired and rendered by itself.
Turns are numbered by a range-partitioned sort, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailwork.llm.common import materialize

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then after a turn of each role.
START, STATES = 0, 4
#: Costs: merge, empty turn put in, relabel of a known role, relabel of a null or unknown role.
MERGE, INSERT, RELABEL, NAME = 2, 3, 5, 1
BLOCK = 4096
FAR = 1 << 40
#: state -> roles that may follow it
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}


@cache
def inserts(state: int) -> dict[int, tuple[int, ...]]:
    """State -> shortest roles to put in to reach it from ``state`` (at least none)."""
    found = {state: ()}
    edge = [state]
    while edge:
        later = []
        for s in edge:
            for role in NEXT[s]:
                # A system turn is never made up.
                if role and role + 1 not in found:
                    found[role + 1] = (*found[s], role)
                    later.append(role + 1)
        edge = later
    return found


@cache
def moves(role: int) -> dict[tuple[int, int], tuple[int, str, tuple[int, ...], int]]:
    """(state, state) -> (cost, act, roles put in before, role given) for a turn of a role (-1: unknown)."""
    out: dict[tuple[int, int], tuple[int, str, tuple[int, ...], int]] = {}

    def offer(key: tuple[int, int], value: tuple[int, str, tuple[int, ...], int]) -> None:
        if key not in out or value[0] < out[key][0]:
            out[key] = value

    for s in range(STATES):
        for given in range(3):
            change = 0 if given == role else NAME if role < 0 else RELABEL
            act = "keep" if given == role else "relabel"
            for t, put in inserts(s).items():
                if given in NEXT[t]:
                    offer((s, given + 1), (INSERT * len(put) + change, act, put, given))
            if s == given + 1:
                offer((s, s), (MERGE + change, "merge" if given == role else "relabel and merge", (), given))
    return out


def product(rows: list[list[int]], role: int) -> list[list[int]]:
    """Least costs after one more turn."""
    out = [[FAR] * STATES for _ in rows]
    for (a, b), (cost, *_) in moves(role).items():
        for r, row in enumerate(rows):
            if row[a] + cost < out[r][b]:
                out[r][b] = row[a] + cost
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    rows = [[0 if a == b else FAR for b in range(STATES)] for a in range(STATES)]
    for role in roles:
        rows = product(rows, role)
    return rows


def path(roles: list[int], begin: int, end: int) -> list[tuple[int, str, tuple[int, ...], int]]:
    """The cheapest acts for turns of these roles from one state to another; the first of equals, by state."""
    costs, back = [0 if s == begin else FAR for s in range(STATES)], []
    for role in roles:
        new, came = [FAR] * STATES, [0] * STATES
        for (a, b), (cost, *_) in sorted(moves(role).items()):
            if costs[a] + cost < new[b]:
                new[b], came[b] = costs[a] + cost, a
        costs = new
        back.append(came)
    acts, at = [], end
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        acts.append(moves(role)[came[at], at])
        at = came[at]
    return acts[::-1]


def best_borders(matrices: list[list[list[int]]]) -> tuple[list[int], int, tuple[int, ...]]:
    """States before each block and after the last, the least cost, and roles put in at the end to end on an assistant."""
    costs, back = [0 if s == START else FAR for s in range(STATES)], []
    for m in matrices:
        new, came = [FAR] * STATES, [0] * STATES
        for a in range(STATES):
            for b in range(STATES):
                if costs[a] + m[a][b] < new[b]:
                    new[b], came[b] = costs[a] + m[a][b], a
        costs = new
        back.append(came)
    finish = {s: inserts(s)[3] for s in range(STATES)}
    at = min(range(STATES), key=lambda s: (costs[s] + INSERT * len(finish[s]), s))
    total, put = costs[at] + INSERT * len(finish[at]), finish[at]
    states = [at]
    for came in reversed(back):
        at = came[at]
        states.append(at)
    return states[::-1], total, put


def _keyed(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of one key at a time, over batch borders; rows come sorted by key."""
    rows = (r for b in batches for r in b.to_pylist())
    for k, group in groupby(rows, key=lambda r: tuple(r[c] for c in key)):
        yield k, list(group)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """The turns, written, with ``nth`` (1, 2, ...) in their conversation by turn (null first), role and text.

    A task counts within its range of the sort; a conversation that began in an earlier range goes on from there, which one
    small row a partition tells.
    """
    spark = turns.sparkSession

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id")
            # Null is a conversation too.
            known, ids = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
            fresh = np.r_[True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])]
            fresh[0] = last != (ids[0], known[0])
            rows = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(fresh, rows, -1))
            at = np.where(start < 0, count + rows, rows - start)
            last, count = (ids[-1], known[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "code", "text")], pa.array(np.full(len(rows), part, np.int32)), pa.array(at)], names=["conv_id", "code", "text", "part", "at"])

    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kept = materialize(ordered.mapInArrow(running, "conv_id long, code int, text string, part int, at long"), "chat-order")
    # A partition's first conversation is the smallest, null before all, as the order is by conv_id.
    key = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    ends = kept.groupBy("part", "conv_id").agg(F.max("at").alias("at")).groupBy("part").agg(F.min(F.struct(key.alias("key"), "at")).alias("first"), F.max(F.struct(key.alias("key"), "at")).alias("last"))
    offsets, before, count = [], None, 0
    for r in sorted(ends.collect()):  # one row a partition
        first, last = r["first"].key.conv_id, r["last"].key.conv_id
        ahead = count if before is not None and before[0] == first else 0
        offsets.append((r.part, first, ahead))
        count = r["last"].at + 1 + (ahead if first == last else 0)
        before = (last,)
    ahead = F.broadcast(spark.createDataFrame(offsets, "part int, __first long, __ahead long"))
    told = kept.join(ahead, "part").withColumn("nth", F.col("at") + 1 + F.when(F.col("conv_id").eqNullSafe(F.col("__first")), F.col("__ahead")).otherwise(0))
    return told.select("conv_id", "code", "text", "nth", F.floor((F.col("nth") - 1) / BLOCK).cast("int").alias("block"))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, blocks, place, part, role, text, act, cost: the turns of every repaired conversation; act tells where a turn came from.

    Turns are ordered by turn (null first), role and text, so ties and repeated rows have an order. Roles are compared
    without case; others and null are unknown. A null text is empty. Rows without a conv_id are one conversation. cost is
    the whole conversation's, blocks the number of its blocks. Merged turns are rows of their own with act merge;
    ``rendered`` joins them.
    """
    spark = conversations.sparkSession
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower("role")).cast("int"), F.lit(0)) - 1
    turns = numbered_turns(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", role.alias("code"), F.coalesce("text", F.lit("")).alias("text")))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _keyed(batches, ("conv_id", "block")):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": block, "costs": [x for row in matrix([r["code"] for r in rows]) for x in row]}], pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("costs", pa.list_(pa.int64()))]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_block = turns.select("conv_id", "block", "nth", "code").repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "nth")
    costs = by_block.mapInArrow(batched(matrices), "conv_id long, block int, costs array<long>")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("put", pa.list_(pa.int32())), ("blocks", pa.int32())])
        for (conv,), rows in _keyed(batches, ("conv_id",)):
            states, cost, put = best_borders([[r["costs"][i : i + STATES] for i in range(0, STATES * STATES, STATES)] for r in rows])
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": r["block"], "begin": states[i], "end": states[i + 1], "cost": cost, "put": list(put) if i + 1 == len(rows) else [], "blocks": len(rows)} for i, r in enumerate(rows)], schema)

    fixed = costs.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(batched(borders), "conv_id long, block int, begin int, end int, cost long, put array<int>, blocks int")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("place", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("act", pa.string()), ("cost", pa.int64())])
        for _, rows in _keyed(batches, ("conv_id", "block")):
            out = []
            kept = lambda r: {c: r[c] for c in ("conv_id", "block", "blocks", "cost")} | {"place": r["nth"]}
            for r, (_, act, put, given) in zip(rows, path([r["code"] for r in rows], rows[0]["begin"], rows[0]["end"]), strict=True):
                for k, x in enumerate(put):
                    out.append(kept(r) | {"part": k, "role": ROLES[x], "text": "", "act": "insert"})
                out.append(kept(r) | {"part": len(put), "role": ROLES[given], "text": r["text"], "act": act})
            for k, x in enumerate(rows[-1]["put"]):
                out.append(kept(rows[-1]) | {"part": 10 + k, "role": ROLES[x], "text": "", "act": "insert"})
            yield pa.RecordBatch.from_pylist(out, schema)

    told = turns.join(fixed.withColumnsRenamed({"conv_id": "__conv", "block": "__block"}), F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block")))
    dealt = told.select("conv_id", "block", "nth", "code", "text", "begin", "end", "cost", "put", "blocks").repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "nth")
    return dealt.mapInArrow(batched(repair), "conv_id long, block int, blocks int, place long, part int, role string, text string, act string, cost long")


def batched(make, rows: int = 4096):
    """make's small batches, gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in make(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, parts, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, rendered: a row for each part of a conversation.

    A conversation has a part for every BLOCK turns, nearly always one, so that none has to fit a row. The texts of its
    parts, one after the other, are the rendered conversation, and their counts add up; cost is the whole conversation's. A
    turn reads ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed; merged texts are joined by a line feed.
    """
    turns = repaired_turns(conversations).alias("turns")
    merged = F.col("act").contains("merge")
    # What comes between two turns depends on whether the next one is merged into the one before.
    piece = F.concat(F.when(merged, F.lit("\n")).otherwise(F.concat(F.lit("<|end|>\n<|"), F.col("role"), F.lit("|>\n"))), F.col("text"))
    count = lambda c: F.count_if(c)
    per = turns.groupBy("conv_id", F.col("block").alias("part")).agg(
        F.max("blocks").alias("parts"), count(F.col("act") != "insert").alias("n_turns"), count(~merged).alias("n_out"), count(merged).alias("n_merged"), count(F.col("act").contains("relabel")).alias("n_relabelled"), count(F.col("act") == "insert").alias("n_inserted"),
        F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("turns.part").alias("part"), piece.alias("piece")))), lambda x: x["piece"]), "").alias("joined"),
    )
    begin = F.when(F.col("part") == 0, F.expr("substring(joined, 9)")).otherwise(F.col("joined"))
    end = F.when(F.col("part") + 1 == F.col("parts"), "<|end|>\n").otherwise("")
    return per.select("conv_id", "part", "parts", "n_turns", "n_out", "n_merged", "n_relabelled", "n_inserted", "cost", F.concat(begin, end).alias("rendered"))
