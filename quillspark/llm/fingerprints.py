"""Fingerprints of documents from prefix polynomial hashes.

``Prefixes`` holds one text's hash of every prefix, for two bases modulo a prime: any span's hash is then one subtraction,
so spans are compared in constant time and the longest common extension of two places is found by binary search.

A fingerprint is text: length and hash of the whole; hashes of prefixes and of suffixes at lengths on a geometric grid; and
``LEAST`` anchors, the spans of ``SPAN`` code points with the least hashes, each with its place and with hashes of what reaches from it to
either side at doubling lengths. Two fingerprints' likeness is 1 for equal wholes; else it is the part of the longer text
that longest common extensions cover: from the first character on, up to the last one, and around each anchor that both have, all found by
binary search over the grids (so a length is the last grid length that agrees).

Nulls and edges: a null text is empty; two empty texts are alike (1), an empty and another are not (0). The next document is
the next row by (doc_id, hash of the text, text), null ids first; the last one's is the first. A table of one row has itself as the next; an empty
table gives an empty result. Extra columns are ignored. Texts of any length are hashed whole. Rows that share a doc_id, or have
none, are dealt over several tasks by that hash; equal rows stay together.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounds, placed, shuffle_partitions, text_of

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
SPAN, LEAST = 24, 8
#: Lengths at which prefixes and suffixes are kept, about 10 % apart, and those at which extensions of an anchor are.
GRID = sorted({round(1.1**i) for i in range(1, 250)})
REACH = [SPAN << i for i in range(1, 32)]
_P, _31 = np.uint64(PRIME), np.uint64(31)


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same residue: 2**31 is 1 modulo the prime."""
    return (x & _P) + (x >> _31)


def residue(x: np.ndarray) -> np.ndarray:
    x = fold(fold(x))
    x[x >= _P] -= _P
    return x


class Table:
    """Powers of a base and of its inverse modulo the prime, grown as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            for name, b in (("up", self.base), ("down", pow(self.base, -1, PRIME))):
                a = getattr(self, name)
                setattr(self, name, np.concatenate([a, residue(a * np.uint64(pow(b, len(a), PRIME)))]))


TABLES = tuple(Table(b) for b in BASES)


class Prefixes:
    """Prefix hashes of an array of code points; those of another text that begins alike can be taken over."""

    def __init__(self, points: np.ndarray, like: Prefixes | None = None, alike: int = 0):
        self.n, self.sums = len(points), []
        tail = points[alike:].astype(np.uint64) + np.uint64(1)
        for k, t in enumerate(TABLES):
            t.upto(self.n + 1)
            s = np.zeros(self.n + 1, np.uint64)
            if alike:
                s[: alike + 1] = like.sums[k][: alike + 1]
            np.cumsum(fold(tail * t.up[alike : self.n]), out=s[alike + 1 :])
            s[alike + 1 :] += s[alike]
            s[alike + 1 :] = residue(s[alike + 1 :])
            self.sums.append(s)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes (62 bits) of the spans from start to end, exclusive."""
        out = np.zeros(len(start), np.uint64)
        for t, s in zip(TABLES, self.sums, strict=True):
            out = (out << _31) | residue((s[end] + _P - s[start]) * t.down[start])
        return out

    def every(self, length: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of one length that start at first or later."""
        out, last = np.zeros(max(0, self.n - length + 1 - first), np.uint64), self.n - length + 1
        for t, s in zip(TABLES, self.sums, strict=True):
            out = (out << _31) | residue((s[first + length :] + _P - s[first:last]) * t.down[first:last])
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for t, s in zip(TABLES, self.sums, strict=True):
            out = out << 31 | (int(s[end]) - int(s[start])) * int(t.down[start]) % PRIME
        return out

    def equal(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """How far the texts agree from these places on."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(32)


def span_hashes(h: Prefixes, first: int = 0) -> np.ndarray:
    """Of all spans from first on, spread anew; of the whole text where it is shorter than a span."""
    return spread(h.every(SPAN, first) if h.n >= SPAN else np.array([h.span(0, h.n)], np.uint64))


def anchors_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least distinct span hashes and the first place of each."""
    few = 4 * LEAST
    while True:  # repeated spans may crowd out distinct ones
        at = np.flatnonzero(x <= np.partition(x, few)[few]) if few < len(x) else np.arange(len(x))
        value, first = np.unique(x[at], return_index=True)
        if len(value) >= LEAST or few >= len(x):
            return value[:LEAST], at[first[:LEAST]]
        few *= 8


def cut(x: np.ndarray) -> str:
    """The low 32 bits of hashes, eight hex digits each."""
    return x.astype(">u4").tobytes().hex()


def written_out(h: Prefixes, spans: np.ndarray) -> str:
    grid = np.array(GRID[: bisect_right(GRID, h.n)], np.int64)
    zero, whole = np.zeros(len(grid), np.int64), np.full(len(grid), h.n)
    anchors = []
    if h.n >= SPAN:
        value, place = anchors_of(spans)
        reach = np.array(REACH[: bisect_right(REACH, h.n)], np.int64)
        right = [reach[: bisect_right(REACH, h.n - p)] for p in place.tolist()]
        left = [reach[: bisect_right(REACH, p + SPAN)] for p in place.tolist()]
        start = np.concatenate([*(np.full(len(r), p) for r, p in zip(right, place, strict=True)), *(p + SPAN - r for r, p in zip(left, place, strict=True))])
        end = np.concatenate([*(p + r for r, p in zip(right, place, strict=True)), *(np.full(len(r), p + SPAN) for r, p in zip(left, place, strict=True))])
        text, at = cut(h.spans(start, end)), 0
        sides = []
        for r in (*right, *left):
            sides.append(text[at : at + 8 * len(r)])
            at += 8 * len(r)
        anchors = [f"{v:x}:{p:x}:{sides[len(place) + i]}:{sides[i]}" for i, (v, p) in enumerate(zip(value.tolist(), place.tolist(), strict=True))]
    return ".".join([f"{h.n:x}", f"{h.span(0, h.n):016x}", cut(h.spans(zero, grid)), cut(h.spans(whole - grid, whole)), ",".join(anchors)])


def fingerprint(text: np.ndarray) -> str:
    h = Prefixes(text)
    return written_out(h, span_hashes(h))


def agreed(a: str, b: str, grid: list[int]) -> int:
    """The greatest grid length up to which both hash alike, by binary search: agreeing at one length means agreeing at all before it."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[8 * mid - 8 : 8 * mid] == b[8 * mid - 8 : 8 * mid] else (low, mid - 1)
    return grid[low - 1] if low else 0


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def likeness(a: str, b: str) -> float:
    """From 0 to 1, from two fingerprints alone."""
    n, whole, prefixes, suffixes, anchors = a.split(".")
    m, other, prefixes2, suffixes2, anchors2 = b.split(".")
    if (n, whole) == (m, other):
        return 1.0
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    first, last = agreed(prefixes, prefixes2, GRID), agreed(suffixes, suffixes2, GRID)
    one, two = [(0, first), (n - last, n)], [(0, first), (m - last, m)]
    known = {x[0]: x for x in (y.split(":") for y in anchors2.split(",") if y)}
    for v, p, left, right in (y.split(":") for y in anchors.split(",") if y):
        if v in known:
            _, q, left2, right2 = known[v]
            before, after = max(SPAN, agreed(left, left2, REACH)), max(SPAN, agreed(right, right2, REACH))
            for spans, at in ((one, int(p, 16)), (two, int(q, 16))):
                spans.append((at + SPAN - before, at + after))
    return round(min(covered(one), covered(two)) / max(n, m), 6)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (bucket, order, doc_id, text, own): each range of ids in order, with the first row after it (own false) at its end.

    Only ids and one row per range are looked at beforehand; texts then move once, in one shuffle.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    edges = bounds(rows, "doc_id", "__tie", n)
    rows = rows.withColumn("__b", placed(F.col("doc_id"), F.col("__tie"), edges))
    heads = [(r["__b"], r["first"]) for r in rows.groupBy("__b").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "__tie")).alias("first")).orderBy("__b").collect()]  # one row a range
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    if not heads:
        return rows.select("__b", F.lit(0).alias("__late"), "doc_id", "__tie", "__text", F.lit(True).alias("__own"))
    first = spark.createDataFrame([(b, f["doc_id"], f["__tie"], before[b]) for b, f in heads], "__fb int, __first long, __ft long, __to int")
    lead = rows.join(F.broadcast(first), (F.col("__b") == F.col("__fb")) & F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("__tie") == F.col("__ft")))
    # of rows that share the first id and hash, the one with the least text
    lead = lead.groupBy("__to").agg(F.min(F.struct("doc_id", "__tie", "__text")).alias("r")).select(F.col("__to").alias("__b"), F.lit(1).alias("__late"), "r.doc_id", "r.__tie", "r.__text", F.lit(False).alias("__own"))
    own = rows.select("__b", F.lit(0).alias("__late"), "doc_id", "__tie", "__text", F.lit(True).alias("__own"))
    return own.unionByName(lead).repartitionById(max(n, len(edges) + 1), F.col("__b")).sortWithinPartitions("__b", "__late", "doc_id", "__tie", "__text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text, own in zip(*(part.column(c).to_pylist() for c in ("doc_id", "__text", "__own")), strict=True):
                    p = points(text)
                    h = Prefixes(p)
                    x = span_hashes(h)
                    f = written_out(h, x)
                    if held is not None:
                        done.append(compared(*held, p, f))
                        if len(done) == 256:
                            yield pack(done)
                            done = []
                    held = (doc, p, h, x, f) if own else None
        if done:
            yield pack(done)

    return with_next(docs).select("doc_id", "__text", "__own").mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def compared(doc: int | None, text: np.ndarray, h: Prefixes, spans: np.ndarray, own: str, after: np.ndarray, other: str) -> tuple:
    """One row of the report; what the edited text has in common with the text is not hashed again."""
    keep = len(text) - len(text) // 4
    edited = np.concatenate([text[:keep], after[: len(text) - keep]])
    e = Prefixes(edited, h, keep)
    same = max(0, keep - SPAN + 1)
    f = written_out(e, np.concatenate([spans[:same], span_hashes(e, same)]) if same and e.n >= SPAN else span_hashes(e))
    return doc, len(text), hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode()).hexdigest(), own, f, likeness(own, f), likeness(own, other)


def pack(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
