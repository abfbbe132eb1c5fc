"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges, and full sets to confirm.

A document's set holds the hashes of its distinct n-word shingles, letters A-Z in lower case; all its words are one shingle where
they are fewer than n; without words it is empty and linked with nothing. Documents with 100 * common >= 80 * united are linked;
``component_id`` is the least doc_id that links lead to.

1. One pass over the texts writes, per document, set size, a digest of the set, and one key per band. Equal sets count as
   confirmed by digest, and only the least doc_id of each goes on as a node.
2. Buckets are formed from packed keys. Each task first makes stars of what it holds itself and passes on one member for
   each key, so that a bucket of any size reaches its reducer as one row for each task. With 64 bands of 8, a
   pair at 0.8 shares no bucket once in 100,000 times.
3. Full sets of the nodes met in buckets are written once; stars are confirmed on them, at first the likeliest centre of each node, then
   those between documents not yet connected.
4. A star leaves pairs that its centre is not linked with. The members of buckets that still hold several components go through an
   exact prefix join: with the shingles of each set ordered from the rarest among these members on, two sets that are
   alike enough share one of the first ``size - ceil(0.8 * size) + 1``, and at the first they share, what is left of both
   must suffice. Pairs of different components that meet so are confirmed on full sets. No link is given up, shingles that one
   member alone has are not sent at all, and rows sent grow with shared shingles, not with the square of a bucket.

Nulls and edges: a null text is empty; a null doc_id is linked with nothing and has a null component_id and kept false. Rows that
repeat a doc_id are one document for linking. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrays import mix, runs, shingle_sets
from quillspark.llm.common import HOT, hot_keys, looked_up, shuffle_partitions, small, text_of, written

BANDS, ROWS = 64, 8
SLOTS = BANDS * ROWS
BITS = SLOTS.bit_length() - 1
PERCENT = 80
TOGETHER = 16384
#: Rows up to which ids or edges are broadcast (at most 32 bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 100_000
#: Members of one star that one task confirms.
STAR = 128
#: Bytes of band keys that one task brings together.
MEET_BYTES = 64 << 20

_rng = np.random.default_rng(5)
#: For each slot all slots in random order: an empty slot borrows from the first in its order that is not empty.
ORDER = np.argsort(_rng.random((SLOTS, SLOTS)), axis=1).astype(np.int16)
PLACE = np.argsort(ORDER, axis=1).astype(np.int16)
FACTORS = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (texts x BANDS) of non-empty sets of sorted hashes."""
    sizes = np.array([len(s) for s in sets])
    flat, text = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    slot = (flat >> np.uint64(64 - BITS)).astype(np.int64)
    cell = text * SLOTS + slot
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    least = np.zeros(len(sets) * SLOTS, np.uint64)
    full = np.zeros(len(sets) * SLOTS, bool)
    least[cell[first]], full[cell[first]] = flat[first], True
    least, full = least.reshape(-1, SLOTS), full.reshape(-1, SLOTS)
    count, source = full.sum(1), least.copy()
    for i in np.flatnonzero(count < 24):
        have = np.flatnonzero(full[i])
        near = have[PLACE[:, have].argmin(1)]
        least[i] = np.where(full[i], least[i], source[i, near])
    row, col = np.nonzero(~full & (count >= 24)[:, None])
    for k in range(SLOTS):
        if not len(row):
            break
        probe = ORDER[col, k]
        hit = full[row, probe]
        least[row[hit], col[hit]] = source[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    with np.errstate(over="ignore"):
        return mix((least.reshape(-1, BANDS, ROWS) * FACTORS).sum(2, dtype=np.uint64))


def signatures(docs: DataFrame, n: int, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), bands (packed keys), and ``__row`` from a column of longs, if one is named."""
    names, kinds = ["doc_id", "n_shingles", "digest", "bands"], "doc_id long, n_shingles long, digest binary, bands binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for first, last, raw, at in runs(b.column(1)):
                sets = shingle_sets(raw, at, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = dict(zip(some, (k.tobytes() for k in sketch([sets[i] for i in some])), strict=True)) if some else {}
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                rows = [c.slice(first, last - first) for c in b.columns[2:]]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([keys.get(i) for i in range(len(sets))], pa.binary()), *rows], [*names, *["__row"] * len(rows)])

    along = [docs[row].cast("long").alias("__row")] if row else []
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("__text"), *along).mapInArrow(work, kinds + ", __row long" * len(along))


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by key, then node: (keys, their centres, centre of each other member, that member)."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    head = np.flatnonzero(first)
    centre = np.repeat(node[head], np.diff(np.append(head, len(key))))
    other = ~first & (centre != node)
    return key[head], node[head], centre[other], node[other]


def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    return a[head], b[head], np.diff(np.append(head, len(a)))


PACKED = "part int, edges boolean, left binary, right binary"


def candidates(nodes: DataFrame, rows: int) -> DataFrame:
    """Star edges (a, b, times met), a < b, from (node, bands). Keys are dealt over as many tasks as keep each within ``MEET_BYTES``."""
    n = max(shuffle_partitions(nodes.sparkSession), -(-rows * BANDS * 16 // MEET_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, held = [], [], 0

        def flush():
            key = np.concatenate(keys)
            key, centre, a, b = stars(key, np.repeat(np.concatenate(ids), BANDS))
            part = (key % np.uint64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, centre, at = key[order], centre[order], np.searchsorted(part[order], np.arange(n + 1))
            rows = [(p, False, key[i:j].tobytes(), centre[i:j].tobytes()) for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
            if len(a):
                rows.append((int(a[0] % n), True, a.tobytes(), b.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["part", "edges", "left", "right"])

        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            keys.append(unpacked(b.column(1), np.uint64))
            held += b.num_rows
            if held >= TOGETHER:
                yield flush()
                ids, keys, held = [], [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, centres, left, right = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            for edges, x, y in zip(*(b.column(c).to_pylist() for c in ("edges", "left", "right")), strict=True):
                (left if edges else keys).append(np.frombuffer(x, np.int64 if edges else np.uint64))
                (right if edges else centres).append(np.frombuffer(y, np.int64))
        if keys:
            _, _, a, b = stars(np.concatenate(keys), np.concatenate(centres))
            left, right = [*left, a], [*right, b]
        a, b, times = counted(np.concatenate(left), np.concatenate(right))
        for i in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536].astype(np.int64)) for x in (a, b, times)], ["a", "b", "times"])

    met = nodes.select("node", "bands").mapInArrow(deal, PACKED).repartitionById(n, F.col("part")).mapInArrow(meet, "a long, b long, times long")
    return met.groupBy("a", "b").agg(F.sum("times").alias("times"))


def full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, set as packed hashes) of the documents named that have words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, raw, at in runs(b.column(1)):
                sets = shingle_sets(raw, at, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first).take(pa.array(some)), pa.array([sets[i].tobytes() for i in some], pa.binary())], ["node", "set"])

    d = docs.select(docs["doc_id"].cast("long").alias("node"), text_of(docs).alias("__text"))
    return d.join(small(nodes, BROADCAST_ROWS), "node", "left_semi").mapInArrow(work, "node long, set binary")


def confirm(sets: DataFrame, edges: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The edges (a, b), written, whose full sets are alike enough. Sets of b move to a; a centre with many members is dealt over several tasks."""
    per = written(edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("__salts")))
    salted = looked_up(edges.select("a", "b"), per, "a", hot=per.where(F.col("__salts") * STAR > HOT).select("a"))
    salted = salted.select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("__salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    centres = per.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    roles = written(salted.unionByName(centres))
    x = sets.join(small(roles, BROADCAST_ROWS), "node").select("a", "salt", "member", "node", "set")
    x = x.repartition(shuffle_partitions(sets.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centres = None, []
        for b in batches:
            for at in range(0, b.num_rows, 512):
                left, right = [], []
                for a, salt, member, node, packed in zip(*(c.to_pylist() for c in b.slice(at, 512).columns), strict=True):
                    s = np.frombuffer(packed, np.uint64)
                    if (a, salt) != star:
                        star, centres = (a, salt), []
                    if not member:
                        centres.append(s)
                    elif any(alike(c, s, percent) for c in centres):
                        left.append(a)
                        right.append(node)
                if left:
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return written(x.mapInArrow(work, "a long, b long"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of an edge, comp the least node connected: labels fall to the least of the neighbours', then to their label's label, until none changes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hot = written(hot_keys(both, "b"))
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        near = looked_up(both, labels.withColumnRenamed("node", "b"), "b", hot=hot).groupBy("a").agg(F.min("comp").alias("__near"))
        low = written(labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("__old"), F.least("comp", "__near").alias("comp")))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("__far"))
        new = written(looked_up(low, jump, "comp").select("node", "__old", F.least("comp", "__far").alias("comp")))
        labels = new.select("node", "comp")
        if not new.where("comp < __old").limit(1).count():
            return labels


def apart(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """The edges between nodes of different components; a node not yet in one is its own."""
    c = small(comps, BROADCAST_ROWS)
    x = edges.join(c.select(F.col("node").alias("a"), F.col("comp").alias("__ca")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("comp").alias("__cb")), "b", "left")
    return x.where(F.coalesce("__ca", "a") != F.coalesce("__cb", "b")).select(edges.columns)


def unsettled(met: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, comp) of all members of buckets that hold several components, and some more.

    The star edges of a bucket connect its members by way of the centres of the tasks' own stars. If the bucket holds several components, one
    of these edges joins two. From the ends of one, (centre of a task, member) say, the way to any other member is at longest by the bucket's first centre, another
    task's centre and to the member: three further edges.
    """
    ends = lambda e: e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    both = written(met.select("a", "b").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    near = written(ends(apart(met.select("a", "b"), comps)))
    for _ in range(3):
        near = written(near.unionByName(both.join(small(near.withColumnRenamed("node", "a"), BROADCAST_ROWS), "a", "left_semi").select(F.col("b").alias("node"))).distinct())
    return written(near.join(small(comps, BROADCAST_ROWS), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))


def prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(token, node, comp, size, at): the shingles that two nodes or more have, in the prefix of each set by rarity among the nodes; ``at`` is their place from 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                node, comp, packed = (c for c in b.slice(at, 256).columns)
                held = [np.frombuffer(p, np.int64) for p in packed.to_pylist()]
                n = [len(h) for h in held]
                which = [int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=4).digest()) >> 1 for h in held]  # a doc_id may have several sets
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), *(pa.array(np.repeat(np.asarray(v, np.int64), n)) for v in (node.to_numpy(), which, comp.to_numpy(), n))], ["token", "node", "which", "comp", "size"])

    rows = written(sets.join(small(nodes, BROADCAST_ROWS), "node").select("node", "comp", "set").mapInArrow(each, "token long, node long, which long, comp long, size long"))
    shared = written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("met")).where("met > 1"))
    rows = looked_up(rows, shared, "token", hot=shared.where(F.col("met") > HOT).select("token"))
    own = Window.partitionBy("node", "which")
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    rows = rows.withColumn("at", alone + F.row_number().over(own.orderBy("met", "token")) - 1)
    return rows.where(F.col("at") <= F.col("size") - F.expr(f"({percent} * size + 99) div 100")).select("token", "node", "comp", "size", "at")


def meeting(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle of their prefixes and may be alike enough, by size and by what is left of both at that shingle; each once."""
    rows = written(prefixes(sets, nodes, percent))
    per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("__comps"), F.max(F.struct("n", "comp"))["comp"].alias("__most")).where("__comps > 1").drop("__comps")
    rows = written(looked_up(rows, written(per), "token").withColumn("few", F.col("comp") != F.col("__most")).drop("__most"))
    # members of a shingle's largest component are not held against each other; of two others each pair once
    x, y = rows.where("few").alias("x"), rows.alias("y")
    new = F.expr("x.token = y.token and x.comp <> y.comp and (not y.few or x.node < y.node)")
    sizes = F.expr(f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)")
    left = F.expr(f"{100 + percent} * least(x.size - x.at, y.size - y.at) >= {percent} * (x.size + y.size)")
    return x.join(y, new & sizes & left).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def repeated(signed: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) from a doc_id b that stands with several sets to the least doc_id of each of them."""
    h = F.xxhash64("digest")
    ids = written(signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(h).alias("__low"), F.max(h).alias("__high")).where("__low <> __high").select("doc_id"))
    rows = signed.select("doc_id", "digest").join(small(ids, BROADCAST_ROWS), "doc_id").join(first, "digest")
    return rows.where(F.col("doc_id") != F.col("__rep")).select(F.col("__rep").alias("a"), F.col("doc_id").alias("b"))


def link(docs: DataFrame, n: int, percent: int = PERCENT, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, digest, component_id, kept for every row of docs, and ``__row`` from the column ``row``."""
    signed = written(signatures(docs, n, row))
    first = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("__rep"), F.count(F.lit(1)).alias("__times"))
    first = written(first)
    nodes = signed.join(first.select("digest", F.col("__rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "bands")
    met = written(candidates(nodes, first.count()))
    ends = written(met.select(F.col("a").alias("node")).unionByName(met.select("b").withColumnRenamed("b", "node")).distinct())
    sets = written(full_sets(docs, ends, n))
    likely = met.groupBy("b").agg(F.max(F.struct(F.col("times"), (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    likely = written(likely)
    linked = written(confirm(sets, likely, percent).unionByName(repeated(signed, first)))
    comps = components(linked)
    rest = written(apart(met.select("a", "b").join(likely, ["a", "b"], "left_anti"), comps))
    if rest.limit(1).count():
        linked = linked.unionByName(confirm(sets, rest, percent))
        comps = components(linked)
    nodes = unsettled(met, comps)
    if nodes.limit(1).count():
        linked = linked.unionByName(confirm(sets, written(meeting(sets, nodes, percent)), percent))
        comps = components(linked)
    comps = comps.select(F.col("node").alias("__node"), "comp")
    own = first.join(small(comps, BROADCAST_ROWS), F.col("__rep") == F.col("__node"), "left").select("digest", F.coalesce("comp", "__rep").alias("__comp"))
    x = looked_up(signed.where(F.col("digest").isNotNull()), written(own), "digest", "left", first.where(F.col("__times") > HOT).select("digest"))
    blank = signed.where(F.col("digest").isNull())
    blank = blank.join(small(comps, BROADCAST_ROWS), blank["doc_id"] == F.col("__node"), "left").select(*signed.columns, F.col("comp").alias("__comp"))
    x = x.select(*blank.columns).unionByName(blank)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__comp", "doc_id"))
    return x.select("doc_id", "n_shingles", "digest", *(["__row"] if row else []), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def report(docs: DataFrame, n: int = 2) -> DataFrame:
    return link(docs, n).select("doc_id", "n_shingles", "component_id", "kept")
