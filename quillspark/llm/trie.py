"""The prefix trie of conversations, by a skeleton of splitter paths over sorted shards.

Conversations are rebuilt first: conversation c begins with the first h turns of conversation c - c % 5, h = crc32(decimal c) % 9, and goes on with
its own after its first h. A node is a distinct sequence of the first d turns (role, text); turns go as 128 bits of a SHA-256, texts don't move.

1. A rebuilt conversation's path of digests, cut into segments of ``SEGMENT`` turns, is a row a segment, in a group by all that came
   before it (a sum of hashes). Rows are dealt over ranges of (group, path, conv_id) and written with their shard.
2. Shards' first and last paths make the skeleton: a node is shared by shards only where it is a prefix of the last path of one
   and the first of the next. Each task learns how many levels it shares with its neighbours.
3. A task walks its sorted rows with a stack of open nodes and finishes every node that is its own. Of a skeleton node, and of one that ends a segment, it
   gives partial aggregates, which are added up: the shard where a node begins counts it as a child and takes off its
   one kept copy, the shard where it ends tells whether it is a leaf. All are sums, so a group of copies of any size is shared among tasks.
4. The ids that end at a skeleton node come packed, in ascending order of shards, to the task that hashes them: a SHA-256 can't be
   shared, but it is read as a stream.

A segment's nodes need what lies in deeper segments. As a node belongs to its least member, which keeps all nodes below it on its path, what
a conversation owns in its later segments is added to its row of each earlier one; for this, later segments are walked once before.

Nulls and edges: a null role or text is empty; a null turn comes first; turns alike go by role, then the SHA-256 of role and text; rows without conv_id are in no
conversation and left out. Repeated rows are turns like others. A conversation left without turns ends at the root. An empty table gives
an empty result. Extra columns are ignored. The segments of one conversation, a row of sums for each ``SEGMENT`` turns, meet in one window.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import fetched, shuffle_partitions, small, written
from quillspark.llm.turns import dealt, numbered

#: Turns a segment, and bytes a turn's digest.
SEGMENT, DIGEST = 256, 16
#: Most turns taken from the conversation that a rebuilt one begins with, and how many share one beginning.
HEAD, FAMILY = 8, 5
#: Ids packed into one row for a node's hash.
PACK = 65536
LANE = 1 << 61
KEY = ["seg", "p1", "p2", "path", "more", "conv_id"]


def turns(chats: DataFrame) -> DataFrame:
    """conv_id, pos, digest (hex), bytes of each turn."""
    role, text = F.coalesce(chats["role"].cast("string"), F.lit("")), F.coalesce(chats["text"].cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    tie = (F.conv(F.substring("digest", 1, 15), 16, 10).cast("long") - (1 << 59)) * 16  # in the order of digests
    x = chats.select(chats["conv_id"].cast("long").alias("conv_id"), chats["turn"].cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(dealt(x.where(F.col("conv_id").isNotNull()).withColumn("tie", tie)))


def rebuilt(x: DataFrame) -> DataFrame:
    """conv_id, d (from 0), digest, bytes, len of each rebuilt turn; and a row without digest for every conversation."""
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    heads = x.where(F.col("pos") < HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))
    convs = x.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("array()").cast("array<struct<pos:bigint,digest:string,bytes:bigint>>")))
    convs = written(convs.select("conv_id", "h", "head", F.size("head").alias("from"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")))
    own = fetched(x.where(F.col("pos") >= taken), convs.drop("head"), "conv_id").select("conv_id", (F.col("from") + F.col("pos") - F.col("h")).cast("long").alias("d"), "digest", "bytes", "len")
    first = convs.select("conv_id", F.explode("head").alias("t"), "len").select("conv_id", "t.pos", "t.digest", "t.bytes", "len").withColumnRenamed("pos", "d")
    none = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("bytes"), "len")
    return own.unionByName(first).unionByName(none)


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg, path (packed digests), sizes, more (turns follow), p1, p2 (of all before the segment), q1, q2 (with it)."""
    turn = F.when(F.col("digest").isNotNull(), F.struct("d", "digest", "bytes"))
    s = rows.groupBy("conv_id", F.floor(F.col("d") / SEGMENT).cast("int").alias("seg")).agg(F.sort_array(F.collect_list(turn)).alias("items"), F.max("len").alias("len"))
    path = F.unhex(F.array_join(F.transform("items", lambda t: t["digest"]), ""))
    s = written(s.select("conv_id", "seg", path.alias("path"), F.transform("items", lambda t: t["bytes"]).alias("sizes"), "len", ((F.col("seg") + 1) * SEGMENT < F.col("len")).alias("more")))
    zero = F.lit(0).cast("long")
    several = s.where(F.col("len") >= SEGMENT).select("conv_id", "seg", *[F.pmod(F.xxhash64("path", "seg", F.lit(k)), F.lit(LANE)).alias(f"l{k}") for k in (1, 2)])
    upto = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda k: F.sum(F.col(f"l{k}").cast("decimal(20,0)")).over(upto)
    lanes = several.select("conv_id", "seg", *[(total(k) % LANE).cast("long").alias(f"q{k}") for k in (1, 2)], *[((total(k) - F.col(f"l{k}")) % LANE).cast("long").alias(f"p{k}") for k in (1, 2)])
    lanes = written(lanes)
    return s.join(small(lanes, 100_000), ["conv_id", "seg"], "left").select("conv_id", "seg", "path", "sizes", "more", *[F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "q1", "q2")])


def levels(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common."""
    return len(os.path.commonprefix([a, b])) // DIGEST if a != b else len(a) // DIGEST


def skeleton(shards: DataFrame) -> dict[int, tuple]:
    """By shard: its first group, last group and last path, and the levels of its first path shared with the shard before, of its last with the next (-1: not even the group).

    Of each shard two paths of at most ``SEGMENT`` turns (4 KB) reach the driver, and go to all tasks.
    """
    ends = shards.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("a"), F.max(F.struct(*KEY)).alias("b")).orderBy("shard").collect()
    group = lambda r: (r["seg"], r["p1"], r["p2"])
    met = [levels(bytes(x["b"]["path"]), bytes(y["a"]["path"])) if group(x["b"]) == group(y["a"]) else -1 for x, y in zip(ends, ends[1:], strict=False)]
    return {r["shard"]: (group(r["a"]), group(r["b"]), bytes(r["b"]["path"]), before, after) for r, before, after in zip(ends, [-1, *met], [*met, -1], strict=False)}


OUT = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, own long, ends string, ids binary"
TYPES = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "own")], ("ends", pa.string()), ("ids", pa.binary())])
NOTHING = hashlib.sha256().hexdigest()


class Node:
    __slots__ = ("began", "children", "continues", "conv", "depth", "ends", "held", "hash", "ids", "inner", "key", "leaves", "more", "n", "saved", "size")

    def __init__(self, depth: int, size: int, key: bytes | None, began: bool, continues: bool):
        self.depth, self.size, self.key, self.began, self.continues = depth, size, key, began, continues
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.inner, self.more, self.hash, self.ids, self.held = None, False, False, None, [], []


class Walk:
    """One task's walk over the sorted rows of a shard; ``out`` takes rows of ``OUT``."""

    def __init__(self, bones: tuple):
        self.first, self.last, self.last_path, self.before, self.after = bones
        self.group, self.path, self.stack, self.out = None, b"", [], []

    def opened(self, depth: int, path: bytes, size: int, whole: tuple | None, fresh: bool) -> Node:
        """A node at a depth of the current group; fresh: on the way to the shard's first row."""
        seg, p1, p2 = self.group
        began = not (fresh and depth <= self.before)
        continues = self.group == self.last and depth <= self.after and path[: DIGEST * depth] == self.last_path[: DIGEST * depth]
        key = None
        if depth == 0 and (seg or not began or continues):
            key = struct.pack("<qq", p1, p2)
        elif depth == SEGMENT:
            key = struct.pack("<qq", *whole)
        elif not began or continues:
            key = hashlib.blake2b(struct.pack("<qq", p1, p2) + path[: DIGEST * depth], digest_size=16).digest()
        return Node(depth, size, key, began, continues)

    def row(self, conv: int, group: tuple, path: bytes, sizes: list[int], more: bool, whole: tuple, leaves: int, saved: int) -> None:
        fresh = self.group is None and group == self.first
        if group != self.group:
            self.close(0)
            self.group, common = group, 0
            self.stack.append(self.opened(0, path, 0, None, fresh))
        else:
            common = levels(path, self.path)
            self.close(common + 1)
        for d in range(common + 1, len(path) // DIGEST + 1):
            self.stack.append(self.opened(d, path, sizes[d - 1], whole, fresh))
        self.path = path
        end = self.stack[-1]
        end.n += 1
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.leaves += leaves
        end.saved += saved
        if more:
            end.more = True
        elif end.key is None:
            end.hash = end.hash or hashlib.sha256()
            end.hash.update(f",{conv}".encode() if end.ids else str(conv).encode())
            end.ids = [conv]
        else:
            end.ids.append(conv)
            if len(end.ids) == PACK:
                self.pack(end)

    def pack(self, node: Node) -> None:
        if node.ids:
            self.out.append((node.key, None, node.ids[0], self.group[0] * SEGMENT + node.depth, *[None] * 7, np.array(node.ids, "<i8").tobytes()))
            node.ids = []

    def close(self, keep: int) -> None:
        """Ends the nodes of the stack beyond so many."""
        while len(self.stack) > keep:
            v = self.stack.pop()
            up = self.stack[-1] if self.stack else None
            if not (v.inner or v.more or v.continues) and (v.depth or not self.group[0]):
                v.leaves += 1
            own = v.n * v.size - (v.size if v.began else 0)
            v.saved += own
            if up:
                up.n += v.n
                up.conv = v.conv if up.conv is None else min(up.conv, v.conv)
                up.inner = True
                up.children += v.began
                up.leaves += v.leaves
                up.saved += v.saved
            depth = self.group[0] * SEGMENT + v.depth
            if v.key is not None:
                self.pack(v)
            for row in v.held:
                self.out.append((*row[:4], v.conv, *row[5:]))
            ends = None if v.key is not None else v.hash.hexdigest() if v.hash else NOTHING
            if v.depth == 0 and self.group[0]:  # a segment's top: the node itself ends the segment before
                self.out.append((v.key, None, None, depth, None, 0, v.children, 0, 0, 0, None, None))
                continue
            row = (v.key, up.key if up else None, v.conv, depth, None, v.n, v.children, v.leaves, v.saved, own, ends, None)
            if up is None or up.key is not None:
                self.out.append(row)
            else:
                up.held.append(row)


def walked(rows: DataFrame, bones: dict[int, tuple]) -> DataFrame:
    """Finished nodes, partial aggregates of open ones (``key``) and packed ids that end there, from rows with their shard and tails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, walk = None, None

        def flush():
            columns = list(zip(*walk.out, strict=True))
            walk.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.types, strict=True)], schema=TYPES)

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                for p, conv, seg, p1, p2, path, sizes, more, q1, q2, leaves, saved in zip(*(c.to_pylist() for c in b.slice(at, 1024).columns), strict=True):
                    if p != shard:
                        if walk:
                            walk.close(0)
                            yield flush()
                        shard, walk = p, Walk(bones[p])
                    walk.row(conv, (seg, p1, p2), path, sizes, more, (q1, q2), leaves, saved)
                    if len(walk.out) > 8192:
                        yield flush()
        if walk:
            walk.close(0)
            yield flush()

    dealt_rows = rows.repartitionById(max(bones, default=0) + 1, F.col("shard")).sortWithinPartitions("shard", *KEY)
    return dealt_rows.select("shard", "conv_id", "seg", "p1", "p2", "path", "sizes", "more", "q1", "q2", "tail_leaves", "tail_saved").mapInArrow(work, OUT)


def hashed(packed: DataFrame) -> DataFrame:
    """key, depth, ends of the ids that end at open nodes, read as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["key", "depth", "ends"])

        for b in batches:
            for at in range(b.num_rows):
                key, depth, ids = (c[0].as_py() for c in b.slice(at, 1).columns)
                if (key, depth) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    if len(out) > 4096:
                        yield flush()
                        out = []
                    node, digest = (key, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, np.frombuffer(ids, "<i8").tolist())).encode())
        if node:
            out.append((*node, digest.hexdigest()))
            yield flush()

    n = shuffle_partitions(packed.sparkSession)
    return packed.select("key", "depth", "conv_id", "ids").repartition(n, "key", "depth").sortWithinPartitions("key", "depth", "conv_id").select("key", "depth", "ids").mapInArrow(work, "key binary, depth long, ends string")


def reduced(rows: DataFrame, bones: dict[int, tuple]) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, own, ends."""
    out = written(walked(rows, bones))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved", "own")]
    open_nodes = out.where("key is not null and ids is null").groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.max("parent_conv_id").alias("parent_conv_id"), F.min("conv_id").alias("conv_id"), *sums)
    ends = written(hashed(out.where("ids is not null")))
    open_nodes = written(open_nodes.join(small(ends, 100_000), ["key", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING))))
    nodes = out.where("key is null").drop("key", "ids").unionByName(open_nodes.drop("key"))
    names = open_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    below = fetched(nodes.where("parent_key is not null"), written(names), "parent_key").withColumn("parent_conv_id", F.col("__parent")).drop("__parent")
    return nodes.where("parent_key is null").unionByName(below).drop("parent_key")


def tails(rows: DataFrame, bones: dict[int, tuple]) -> DataFrame:
    """conv_id, seg, tail_leaves, tail_saved: what a conversation owns in the segments after each of its own."""
    later = rows.where("seg > 0").withColumns({"tail_leaves": F.lit(0).cast("long"), "tail_saved": F.lit(0).cast("long")})
    nodes = reduced(later, bones).where("conv_id is not null and n_convs > 0")
    seg = F.floor((F.col("depth") - 1) / SEGMENT).cast("int")
    owned = nodes.groupBy("conv_id", seg.alias("seg")).agg(F.sum((F.col("n_children") == 0).cast("long")).alias("l"), F.sum("own").alias("s"))
    every = rows.where(F.col("more") | (F.col("seg") > 0)).select("conv_id", "seg").join(owned, ["conv_id", "seg"], "left")
    after = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return every.select("conv_id", "seg", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"tail_{name}") for c, name in (("l", "leaves"), ("s", "saved"))]).where("tail_leaves > 0 or tail_saved > 0")


def trie(chats: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = segments(rebuilt(turns(chats)))
    n = shuffle_partitions(chats.sparkSession)
    rows = written(rows.repartitionByRange(n, *KEY).withColumn("shard", F.spark_partition_id()))
    bones = skeleton(rows)
    zero = F.lit(0).cast("long")
    if rows.where("seg > 0").limit(1).count():
        rows = rows.join(small(written(tails(rows, bones)), 100_000), ["conv_id", "seg"], "left")
        rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("tail_leaves", "tail_saved")})
    else:
        rows = rows.withColumns({"tail_leaves": zero, "tail_saved": zero})
    return reduced(rows, bones).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def report(chats: DataFrame) -> DataFrame:
    return trie(chats)
