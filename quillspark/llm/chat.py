"""Repair of chat role sequences at minimum cost, and their rendering.

A legal conversation is: an optional system message, then user and assistant in turn, ending with assistant. Each message keeps its
role or is relabelled; it opens a turn or is merged into the turn before it; and an empty turn may be inserted before it. The
cheapest way is found by dynamic programming over the automaton of the last turn's role. Blocks of ``BLOCK`` turns
become matrices of least costs from state to state, which combine by (min, +), so that one conversation of any
length is shared among tasks. Where many messages share their turns, or have none, blocks are cut by turn, role and a hash of the text.
The first pass moves roles and hashes only, the second the texts; messages are then repaired block by block, between the states that the whole picks.

Costs: merge 2, inserted turn 3, relabel 4 (of an unknown or null role too). In a tie the states come first in the order system, user,
assistant, and opening a turn before merging, before inserting.

Nulls and edges: a null role is unknown; roles are compared in lower case without space around them. A null text is
empty, and its turn is kept. A null conv_id is a conversation. Messages with the same turn go by role, then a hash of the text, then text; a null
turn comes first. In a rendered text a bar after ``<`` is set off by one more backslash, so that no text can forge a tag (``plain`` undoes it).
Repeated rows are messages like others (and so merged), and equal ones stay in one block. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shuffle_partitions, small, written

ROLES = ("system", "user", "assistant")
START, END = 3, 2
MERGE, INSERT, RELABEL = 2, 3, 4
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
BLOCK, FAR = 1024, 1 << 40
OPEN, JOIN, FILL = 0, 1, 2
TAGS = {"open": "<|{}|>\n", "close": "<|end|>\n"}


def steps(role: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(state before, role given) -> (cost, how, inserted role or -1) for a message of a role (3: unknown)."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in (*range(3), START):
        for x in range(3):
            change = 0 if x == role else RELABEL
            ways = []
            if x in NEXT[s]:
                ways.append((change, OPEN, -1))
            if x == s:
                ways.append((change + MERGE, JOIN, -1))
            ways += [(change + INSERT, FILL, y) for y in NEXT[s] if x in NEXT[y]]
            if ways:
                out[s, x] = min(ways)
    return out


STEPS = [steps(r) for r in range(4)]


def advance(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Costs by state after one more message, and the state each came from."""
    new, came = [FAR] * 4, [0] * 4
    for (s, x), (c, *_) in STEPS[role].items():
        if costs[s] + c < new[x]:
            new[x], came[x] = costs[s] + c, s
    return new, came


def closing(costs: list[int]) -> tuple[int, int]:
    """(total, last state): a conversation that ends with user gets an empty answer, one that ends with system a question and an answer."""
    return min((costs[x] + INSERT * (END - x), -x) for x in range(3))


def code(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def messages(rows: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in rows:
        for at in range(0, b.num_rows, 1024):
            yield from zip(*(b.slice(at, 1024).column(c).to_pylist() for c in columns), strict=True)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def plain(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def blocks(chats: DataFrame) -> DataFrame:
    """Rows with their block: (block, sub). ``sub`` is empty unless the block has more than four times its turns; then it is made of turn, role and as many leading bits of the text's hash as part it."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long")
    c = chats.select(chats["conv_id"].cast("long").alias("conv_id"), chats["turn"].cast("long").alias("turn"), chats["role"].cast("string").alias("role"), F.coalesce(chats["text"].cast("string"), F.lit("")).alias("text"))
    c = c.withColumn("block", block).withColumn("tie", F.xxhash64("text"))
    full = c.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * BLOCK)
    full = written(full.select(F.col("conv_id").alias("__c"), F.col("block").alias("__b"), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int").alias("__bits")))
    if not full.limit(1).count():
        return c.withColumn("sub", F.lit(""))
    c = c.join(small(full, 100_000), c["conv_id"].eqNullSafe(F.col("__c")) & (c["block"] == F.col("__b")), "left")
    turn = F.coalesce(F.lpad((F.col("turn") - F.col("block") * BLOCK).cast("string"), 4, "0"), F.lit(""))
    role = F.coalesce(F.concat(F.lit("\x01"), "role"), F.lit(""))
    piece = F.lpad(F.expr("hex(shiftright(tie, 64 - __bits) + shiftleft(1L, __bits - 1))"), 16, "0")
    return c.withColumn("sub", F.when(F.col("__bits").isNull(), "").otherwise(F.concat_ws("\x00", turn, role, piece))).drop("__c", "__b", "__bits")


ORDER = ["conv_id", "block", "sub", "turn", "role", "tie"]


def repair(chats: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, new_role, action (keep, relabel, merge, insert; several joined by +), inserted (role or null), cost, piece.

    The pieces of a conversation in order, with the closing one of its last message, are its rendering.
    """
    rows = blocks(chats)
    n = shuffle_partitions(chats.sparkSession)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, table, out = None, None, []
        for conv, block, sub, role in messages(batches, ["conv_id", "block", "sub", "role"]):
            if (conv, block, sub) != key:
                if key:
                    out.append((*key, [v for t in table for v in t]))
                key, table = (conv, block, sub), [[0 if i == j else FAR for j in range(4)] for i in range(4)]
            table = [advance(t, code(role))[0] for t in table]
            if len(out) == 4096:
                yield batch(out)
                out = []
        if key:
            out.append((*key, [v for t in table for v in t]))
        if out:
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], ["conv_id", "block", "sub", "costs"])

    dealt = rows.select(*ORDER).repartition(n, "conv_id", "block", "sub").sortWithinPartitions(*ORDER)
    costs = written(dealt.select("conv_id", "block", "sub", "role").mapInArrow(tables, "conv_id long, block long, sub string, costs array<long>"))

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states between which each block runs, for conversations whose blocks stand together."""
        held, key, out = [], None, []

        def solve():
            before, front = [], [FAR] * 3 + [0]
            for *_, t in held:
                before.append(front)
                front = [min(front[s] + t[4 * s + x] for s in range(4)) for x in range(4)]
            last = -closing(front)[1]
            for i in reversed(range(len(held))):
                block, sub, t = held[i]
                first = min(range(4), key=lambda s: before[i][s] + t[4 * s + last])  # noqa: B023
                out.append((key, block, sub, first, last, i == len(held) - 1))
                last = first

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["__conv", "__block", "__sub", "first", "last", "ends"])

        for conv, block, sub, t in messages(batches, ["conv_id", "block", "sub", "costs"]):
            if held and conv != key:
                solve()
                held = []
                if len(out) > 4096:
                    yield flush()
                    out = []
            key = conv
            held.append((block, sub, t))
        if held:
            solve()
        if out:
            yield flush()

    ways = costs.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "sub").mapInArrow(path, "__conv long, __block long, __sub string, first int, last int, ends boolean")
    ready = rows.join(ways, rows["conv_id"].eqNullSafe(ways["__conv"]) & (rows["block"] == ways["__block"]) & (rows["sub"] == ways["__sub"])).repartition(n, "conv_id", "block", "sub").sortWithinPartitions(*ORDER, "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def solve():
            first, last, ends = held[0][4:]
            front, back = [0 if s == first else FAR for s in range(4)], []
            for _, _, role, *_ in held:
                front, came = advance(front, code(role))
                back.append(came)
            states = [last]
            for came in reversed(back):
                states.append(came[states[-1]])
            states.reverse()
            for i, (conv, turn, role, text, *_) in enumerate(held):
                s, x = states[i], states[i + 1]
                c, how, y = STEPS[code(role)][s, x]
                action = (["insert"] if how == FILL else []) + (["relabel"] if x != code(role) else []) + (["merge"] if how == JOIN else [])
                piece = "" if how == OPEN and s == START else "\n\n" if how == JOIN else TAGS["close"] if s != START else ""
                if how != JOIN:
                    piece += (TAGS["open"].format(ROLES[y]) + TAGS["close"] if how == FILL else "") + TAGS["open"].format(ROLES[x])
                piece += escaped(text)
                tail = []
                if ends and i == len(held) - 1:
                    tail = list(range(x + 1, END + 1))
                    piece += TAGS["close"] + "".join(TAGS["open"].format(ROLES[z]) + TAGS["close"] for z in tail)
                    c += INSERT * len(tail)
                inserted = [ROLES[y]] * (how == FILL) + [ROLES[z] for z in tail]
                out.append((conv, turn, role, ROLES[x], "+".join(action + ["insert"] * bool(tail and how != FILL)) or "keep", ",".join(inserted) or None, c, piece))

        def flush():
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "piece"])

        for conv, block, sub, *rest in messages(batches, ["conv_id", "block", "sub", "turn", "role", "text", "first", "last", "ends"]):
            if held and (conv, block, sub) != key:
                solve()
                held = []
                if len(out) > 512:
                    yield flush()
                    out = []
            key = (conv, block, sub)
            held.append((conv, *rest))
        if held:
            solve()
        if out:
            yield flush()

    return ready.select("conv_id", "block", "sub", "turn", "role", "text", "first", "last", "ends").mapInArrow(apply, "conv_id long, turn long, role string, new_role string, action string, inserted string, cost long, piece string")


def report(chats: DataFrame) -> DataFrame:
    return repair(chats)
