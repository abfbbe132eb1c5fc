"""Repair of a conversation's structure at minimum cost, with the least audit string among the cheapest, by integer weights.

``damaged`` breaks rows in known ways; ``repair`` takes any rows. A row's first fault counts: blank (no character but white space), duplicate (role and text
seen earlier in the conversation), truncated (the last such character is none of ``.!?``). Edits bring the roles' initials to the form ``(s?(ua)+)?``: keep 0, rerole to user or
assistant 2, delete 3 (the only one for blank and duplicate rows), insert an empty user or assistant 2; a truncated row that stays costs 1 more.

A path through the automaton (start, s, u, a) is one integer: the cost in the high digits, below it two digits for each row - an insert or not, then
what becomes of the row; more inserts before one row never pay - as letters D, I, K, R from 1 to 4, left-aligned, and zeros to the end. A row's letters end
with its first D, K or R, so no row's letters begin another's, and the order of the integers is that of (cost, audit). Least integers decide
everything. A piece has at most ``PIECE`` rows; behind a piece, the audits of all later ones go as one digit: their rank among the four states.

1. Rows without text, dealt over blocks of turns, become a string of codes, a character a row, in pieces.
2. The codes of a conversation come together - as its audit, a letter a row in one cell of the result, must - and are solved.
3. Texts move once, to their block; each block's audit comes ahead of them and tells what to write. The hash is read as a stream; a
   conversation of several blocks sends them on in chunks of about 1 MB to the task that hashes it.

Nulls and edges: null turns, roles and texts become one space (the turn only where it is hashed; it comes first). A null conv_id is a conversation.
Rows with the same turn go by role, then a hash of the text; equal rows stay in one block. A conversation without rows has an empty audit and the hash of nothing. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NONE, looked_up, shuffle_partitions, small, written
from quillspark.llm.turns import ORDER, dealt

WHITE = " \t\n\x0b\f\r"
PIECE, CHUNK = 1024, 1 << 20
START, S, U, A = range(4)
INITIALS = "sua"
#: Faults, and what a row's code is made of: 4 * initial (3: another) + fault.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
LETTERS = "DIKR"
WIDTH = 3  # bits a letter
#: Inserts that end a conversation, by its last state: all letters, and their rank (as strings).
ENDS = {START: ("", 0), A: ("", 0), U: ("I", 1), S: ("II", 2)}
LEGAL = re.compile("(?=su|ua|au)")


def following(state: int) -> int:
    """The role (as a state) that an inserted or reroled message has after a state."""
    return A if state == U else U


def field(letters: str) -> int:
    value = 0
    for k in range(2):
        value = value << WIDTH | (LETTERS.index(letters[k]) + 1 if k < len(letters) else 0)
    return value


def edges(code: int) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, letters) for a row of a code."""
    initial, fault = divmod(code, 4)
    found = []
    for q in range(4):
        found.append((q, q, DELETE, field("D")))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = CUT if fault == TRUNCATED else 0
        for p, paid, before in ((q, 0, ""), (following(q), INSERT, "I")):
            if (initial == 0 and p == START) or (initial == 1 and p != U) or (initial == 2 and p == U):
                found.append((q, initial + 1, paid + KEEP + extra, field(before + "K")))
            found.append((q, following(p), paid + REROLE + extra, field(before + "R")))
    return found


EDGES = [edges(c) for c in range(16)]


def advanced(codes: str, first: int) -> list[int | None]:
    """By last state the least weight of a way through a piece from a state: cost above 2 letters for each row."""
    n = len(codes)
    front: list[int | None] = [None] * 4
    front[first] = 0
    for i, c in enumerate(codes):
        new: list[int | None] = [None] * 4
        low, high = 2 * WIDTH * (n - 1 - i), 2 * WIDTH * n
        for q, t, cost, letters in EDGES[ord(c) - 65]:
            if front[q] is not None:
                w = front[q] + (cost << high) + (letters << low)
                if new[t] is None or w < new[t]:
                    new[t] = w
        front = new
    return front


def spelled(weight: int, rows: int) -> str:
    """The letters of a weight's low digits."""
    return "".join(LETTERS[d - 1] for k in range(2 * rows - 1, -1, -1) if (d := weight >> WIDTH * k & (1 << WIDTH) - 1))


def solved(pieces: list[str]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the cheapest edits with the least audit, and for each piece the state before it and its letters; the last one's include the closing inserts."""
    if not pieces:
        return 0, [(START, "")]
    ahead = [(INSERT * len(ENDS[t][0]), ENDS[t][1]) for t in range(4)]  # by state: cost and rank of all that follows
    follow = [ahead]
    for codes in reversed(pieces[1:]):
        high = 2 * WIDTH * len(codes)
        best = [min(((w + (ahead[t][0] << high)) << 2) + ahead[t][1] for t, w in enumerate(advanced(codes, s)) if w is not None) for s in range(4)]
        low = [w & (1 << high + 2) - 1 for w in best]
        order = {v: k for k, v in enumerate(sorted(set(low)))}
        ahead = [(w >> high + 2, order[v]) for w, v in zip(best, low, strict=True)]
        follow.append(ahead)
    state, total, told = START, 0, []
    for codes, ahead in zip(pieces, reversed(follow), strict=True):
        high = 2 * WIDTH * len(codes)
        weight, last = min((((w + (ahead[t][0] << high)) << 2) + ahead[t][1], t) for t, w in enumerate(advanced(codes, state)) if w is not None)
        total = total or weight >> high + 2
        told.append((state, spelled(weight >> 2, len(codes))))
        state = last
    told[-1] = (told[-1][0], told[-1][1] + ENDS[state][0])
    return total, told


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(conv_id:turn) % 20: 0 drops the row (``dropped``), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes the role user."""
    spelt = lambda c: F.coalesce(chats[c].cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")).cast("binary")) % 20
    text, role = F.coalesce(chats["text"].cast("string"), F.lit(" ")), F.coalesce(chats["role"].cast("string"), F.lit(" "))
    x = chats.select(chats["conv_id"].cast("long").alias("conv_id"), chats["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    x = x.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    x = x.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    x = x.withColumn("dropped", F.col("kind") == 0).withColumn("__times", F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("conv_id", "turn", "role", "text", "dropped", F.explode("__times").alias("__t")).drop("__t")


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, block, sub, piece, codes, low and high turn, turns (distinct), from rows of ``damaged``; a conversation whose rows are all dropped has a piece without codes."""
    last = trimmed(F.col("text"))
    x = rows.select("conv_id", "turn", "role", "dropped", F.xxhash64("text").alias("tie"), F.length(last) == 0, (~F.right(last, F.lit(1)).isin(".", "!", "?")), F.unhex(F.substring(F.sha2(F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256), 1, 32)))
    x = written(dealt(x.toDF("conv_id", "turn", "role", "dropped", "tie", "blank", "cut", "same")))
    # where a text first stands; equal rows of one turn are told apart in their block
    said = x.where(~F.col("dropped") & ~F.col("blank")).groupBy("same").agg(F.min(F.coalesce("turn", F.lit(NONE))).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    said = written(said)
    hot = said.where("times > 50000").select("same")
    x = x.join(F.broadcast(said.drop("times")), "same", "left") if said.limit(100_001).count() <= 100_000 else looked_up(x, said.drop("times"), "same", "left", hot)
    x = x.withColumn("again", F.coalesce(F.coalesce("turn", F.lit(NONE)) > F.col("first"), F.lit(False)))
    n = shuffle_partitions(rows.sparkSession)
    x = x.select(*ORDER, "dropped", "blank", "cut", "same", "again").repartition(n, "conv_id", "block", "sub").sortWithinPartitions(*ORDER)
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["conv_id", "block", "sub", "piece", "codes", "low", "high", "turns"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, out = None, None, []
        piece, codes, low, high, turns = 0, [], None, None, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                for conv, block, sub, turn, role, _, dropped, blank, cut, same, again in zip(*(c.to_pylist() for c in b.slice(at, 2048).columns), strict=True):
                    if (conv, block, sub) != key or len(codes) == PIECE:
                        if key is not None:
                            out.append((*key, piece, "".join(codes), low, high, turns))
                        piece = piece + 1 if (conv, block, sub) == key else 0
                        if not piece:
                            before = None
                        key, codes, low, high, turns = (conv, block, sub), [], None, None, 0
                        if len(out) > 4096:
                            yield flush()
                            out = []
                    if dropped:
                        continue
                    fault = BLANK if blank else DUPLICATE if again or before == (turn, same) else TRUNCATED if cut else CLEAN
                    before = (turn, same)
                    codes.append(chr(65 + 4 * (INITIALS.index(role[0]) if role and role[0] in INITIALS else 3) + fault))
                    if turn is not None:
                        turns += turn != high
                        low, high = turn if low is None else low, turn
        if key is not None:
            out.append((*key, piece, "".join(codes), low, high, turns))
        if out:
            yield flush()

    return x.mapInArrow(work, "conv_id long, block long, sub string, piece int, codes string, low long, high long, turns long")


def decided(pieces: DataFrame) -> DataFrame:
    """conv_id, block, sub, state, letters for each block, ``blocks`` of its conversation; and in the first block's row gaps, blank, duplicate, truncated, illegal, cost, audit."""
    n = shuffle_partitions(pieces.sparkSession)
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), *[pa.int64()] * 6, pa.string())
    names = ["conv_id", "block", "sub", "state", "letters", "blocks", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def summary(held: list[tuple]) -> Iterator[tuple]:
        codes = "".join(h[3] for h in held)
        faults = [sum(codes.count(chr(65 + 4 * i + f)) for i in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        initials = codes.translate({65 + 4 * i + f: "sua-"[i] for i in range(4) for f in range(4)})
        illegal = max(0, len(initials) - 1) - len(LEGAL.findall(initials))
        low = high = None
        turns = 0
        for *_, a, z, k in held:
            if a is not None:
                turns += k - (a == high)
                low, high = a if low is None else low, z
        gaps = 0 if low is None else high - low + 1 - turns
        cost, told = solved([h[3] for h in held if h[3]])
        told = iter(told)
        merged: list[list] = []  # pieces of one block are one
        filled = [h for h in held if h[3]] or held[:1]
        for (block, sub, *_), (state, letters) in zip(filled, told, strict=True):
            if merged and merged[-1][:2] == [block, sub]:
                merged[-1][3] += letters
            else:
                merged.append([block, sub, state, letters])
        audit = "".join(m[3] for m in merged)
        for k, m in enumerate(merged):
            yield (*m, len(merged), *((gaps, *faults, illegal, cost, audit) if not k else [None] * 7))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                for conv, block, sub, _, codes, low, high, turns in zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True):
                    if held and conv != key:
                        out += [(key, *r) for r in summary(held)]
                        held = []
                        if len(out) > 2048:
                            yield flush()
                            out = []
                    key = conv
                    held.append((block, sub, None, codes, low, high, turns))
        if held:
            out += [(key, *r) for r in summary(held)]
        if out:
            yield flush()

    x = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "sub", "piece")
    return x.mapInArrow(work, "conv_id long, block long, sub string, state int, letters string, blocks long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def rendered(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, block, sub, part, sha256 (of a conversation of one block) or chunk (of one of several): the repaired lines, from texts and their blocks' letters."""
    n = shuffle_partitions(rows.sparkSession)
    texts = dealt(rows.withColumn("tie", F.xxhash64("text"))).where(~F.col("dropped"))  # dealt as in coded(), dropped rows included
    texts = texts.select(*ORDER, "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("long").alias("blocks"))
    heads = plans.select("conv_id", "block", "sub", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("tie"), F.col("letters").alias("text"), "state", "blocks")
    x = texts.unionByName(heads).withColumn("body", F.col("state").isNull()).repartition(n, "conv_id", "block", "sub").sortWithinPartitions("conv_id", "block", "sub", "body", "turn", "role", "tie", "text")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, letters, at_letter, state, several, digest, lines, size, part, begun = None, "", 0, START, False, None, [], 0, 0, False

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "block", "sub", "part", "sha256", "chunk"])

        def send():
            nonlocal lines, size, part, begun
            if lines:
                chunk = "\n".join(lines)
                if several:
                    out.append((*key, part, None, chunk))
                    part += 1
                else:
                    digest.update((("\n" if begun else "") + chunk).encode("utf-8"))
                begun, lines, size = True, [], 0

        def line(role: str, text: str):
            nonlocal size
            lines.append(f"{role}:{text}")
            size += len(text)
            if size > CHUNK:
                send()

        def inserts():
            nonlocal at_letter, state
            while letters[at_letter : at_letter + 1] == "I":
                state, at_letter = following(state), at_letter + 1
                line("user" if state == U else "assistant", "")

        def end():
            inserts()
            send()
            if not several:
                out.append((*key, 0, digest.hexdigest(), None))

        for b in batches:
            for k in range(0, b.num_rows, 256):
                for conv, block, sub, _, role, _, text, first, blocks, body in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                    if not body:
                        if key is not None:
                            end()
                        if len(out) > 1024 or sum(len(r[5] or "") for r in out) > 8 * CHUNK:
                            yield flush()
                            out.clear()
                        key, letters, at_letter, state, several, digest, begun, part = (conv, block, sub), text, 0, first, blocks > 1, hashlib.sha256(), False, 0
                        continue
                    inserts()
                    letter, at_letter = letters[at_letter], at_letter + 1
                    if letter == "K":
                        state = INITIALS.index(role[0]) + 1
                        line(role, text)
                    elif letter == "R":
                        state = following(state)
                        line("user" if state == U else "assistant", text)
        if key is not None:
            end()
        if out:
            yield flush()

    return x.mapInArrow(work, "conv_id long, block long, sub string, part int, sha256 string, chunk string")


def joined(chunks: DataFrame) -> DataFrame:
    """conv_id, sha256 of chunks in order, read as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["conv_id", "sha256"])

        for b in batches:
            for at in range(b.num_rows):
                conv, chunk = (c[0].as_py() for c in b.slice(at, 1).columns)
                if digest is None or conv != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    if len(out) > 4096:
                        yield flush()
                        out = []
                    key, digest = conv, hashlib.sha256(chunk.encode("utf-8"))
                else:
                    digest.update(b"\n" + chunk.encode("utf-8"))
        if digest is not None:
            out.append((key, digest.hexdigest()))
            yield flush()

    n = shuffle_partitions(chunks.sparkSession)
    return chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "sub", "part").select("conv_id", "chunk").mapInArrow(work, "conv_id long, sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, dropped): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    plans = written(decided(coded(rows)))
    lines = written(rendered(rows, plans))
    whole = lines.where("sha256 is not null").select("conv_id", "sha256").unionByName(joined(lines.where("chunk is not null")))
    whole = written(whole.withColumnRenamed("conv_id", "__c"))
    x = plans.where("gaps is not null").drop("block", "sub", "state", "letters", "blocks")
    x = x.join(small(whole, 100_000), x["conv_id"].eqNullSafe(F.col("__c")), "left").drop("__c")
    return x.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def report(chats: DataFrame) -> DataFrame:
    return repair(damaged(chats))
