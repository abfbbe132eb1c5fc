"""Exact removal of passages that repeat across or within documents, behind a count-min prefilter.

A window is ``WINDOW`` words in a row of one document. Words of every window whose words also start anywhere else go.

1. Each window has an anchor: the ``GRAM`` words in it with the least hash (by its upper 32 bits), the first of them in a tie. Equal windows
   have equal anchors at equal places, so a window occurs no more often than its anchor. Each task sketches how often it meets each
   anchor, in counters that stop at 2, probed ``PROBES`` times; sketches are merged by parts of ``PART`` counters. A merged counter is
   never below the true count, so no repeated window is lost. There is a counter for every ``PER_CELL`` to ``2 * PER_CELL`` bytes of all texts,
   some fifteen or more for an anchor, so the sketch filters as well at any size. All probes of an anchor lie in one part.
2. Anchors go to their part of the merged sketch, and those it puts at two or more come back to their group of documents. Their windows are
   grouped exactly, by two hashes over the 64-bit hashes of their words. A group tells at once those it meets twice itself, and sends one of
   each hash, so that however common a window is, it is compared once for each group at most.
3. Windows found repeated go back to their texts, and words they cover are left out.

Texts are dealt once over groups of about ``GROUP_BYTES``, by doc_id and text, so that rows of one id are shared among groups; all steps after the sketch read them from that one shuffle.

Nulls and edges: a null text has no words; a text of fewer than ``WINDOW`` words keeps all. Null doc_ids are documents like others. Repeated rows lose all their words (if long enough), as their windows all start elsewhere too. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrays import grams, mix, runs, word_hashes, word_spans
from quillspark.llm.common import shuffle_partitions, text_of, written

WINDOW, GRAM = 35, 16
PROBES, PART, PER_CELL = 3, 1 << 22, 4
GROUP_BYTES = 64 << 20
#: Groups of documents for each shuffle partition, at least.
GROUPS = 4
#: Anchors that a task sketches at a time.
TOGETHER = 1 << 20


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows that lie in one text, the place of each one's anchor, hashes of all grams)."""
    n = len(words) - WINDOW + 1
    g = grams(words, GRAM)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    half = np.uint64(32)
    x = (g >> half << half) | np.arange(len(g), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < span:
        x = np.minimum(x[: len(x) - (span - width)], x[span - width :])
    place = (x[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)  # windows must end before their text does
    first, last = at[:-1], np.maximum(at[1:] - WINDOW + 1, at[:-1])
    keep = first < last
    np.add.at(valid, first[keep], 1)
    np.add.at(valid, last[keep], -1)
    start = np.flatnonzero(np.cumsum(valid[:n]))
    return start, place[start], g


def parts_for(size: int, part: int = PART, per_cell: int = PER_CELL) -> int:
    """Parts, a power of two, of the sketch of so many bytes of text."""
    return 1 << max(0, math.ceil(math.log2(max(1, size) / per_cell / part)))


def part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    return (mix(anchor) >> np.uint64(32)) & np.uint64(parts - 1)


def cells(anchor: np.ndarray, part: int) -> np.ndarray:
    """PROBES x anchors: where each is counted in its part."""
    step = mix(anchor) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(anchor + np.uint64(k) * step) & np.uint64(part - 1) for k in range(PROBES)])


def anchors_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, their hashes, starts of windows, first window of each run that has one anchor, these anchors)."""
    s, e, w = word_spans(raw, at)
    words = word_hashes(raw, s, e)
    start, place, g = anchors(words, w)
    head = np.flatnonzero(np.diff(place, prepend=-1))
    return len(s), words, start, head, g[place[head]]


def sketched(docs: DataFrame, parts: int, width: int = PART) -> DataFrame:
    """(part, bits): the merged sketch, packed: whether a counter has reached two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = [], 0
        for b in batches:
            for _, _, raw, at in runs(b.column(0)):
                met.append(anchors_of(raw, at)[-1])
                held += len(met[-1])
                if held > TOGETHER:
                    yield emit(np.concatenate(met))
                    met, held = [], 0
        if held:
            yield emit(np.concatenate(met))

    def emit(anchor: np.ndarray) -> pa.RecordBatch:
        x = np.sort((part_of(anchor, parts) * np.uint64(width) + cells(anchor, width)).ravel())
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        times, x = np.diff(np.append(head, len(x))), x[head]
        part, cell = (x // np.uint64(width)).astype(np.int64), (x % np.uint64(width)).astype(np.uint32)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        squeeze = lambda v: zlib.compress(np.diff(v, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1)
        cut = list(zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True))
        once = [squeeze(cell[i:j]) for i, j in cut]
        twice = [squeeze(cell[i:j][times[i:j] > 1]) for i, j in cut]
        return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["part", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two = None, None, None
        for b in batches:
            for part, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield bits(now, two)
                    now, one, two = part, np.zeros(width, bool), np.zeros(width, bool)
                once, twice = (np.cumsum(np.frombuffer(zlib.decompress(x), np.uint32), dtype=np.uint32) for x in packed)
                two[once[one[once]]] = True
                two[twice] = True
                one[once] = True
        if now is not None:
            yield bits(now, two)

    def bits(part: int, two: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["part", "bits"])

    dealt = docs.select(text_of(docs).alias("t")).mapInArrow(count, "part int, once binary, twice binary")
    return dealt.repartitionById(min(parts, shuffle_partitions(docs.sparkSession)), F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "part int, bits binary")


def ordered(t: pa.Table) -> pa.Table:
    """A group's rows in an order that the rows alone decide."""
    return t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def tell(start: np.ndarray) -> bytes:
    return zlib.compress(np.diff(np.sort(start), prepend=0).astype(np.uint32).tobytes(), 1)


def told(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)


def remove(docs: DataFrame, texts: bool = False, width: int = PART, per_cell: int = PER_CELL, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``texts`` also the kept text."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    size = docs.select(F.sum(F.octet_length(text_of(docs)).cast("long"))).first()[0] or 0
    parts, groups = parts_for(size, width, per_cell), max(GROUPS * n, -(-size // group_bytes))
    sketch = written(sketched(docs, parts, width))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(n, "group")

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        """The group's anchors, each once, by part of the sketch."""
        met = [anchors_of(raw, at)[-1] for _, _, raw, at in runs(t.column("text"))]
        a = np.unique(np.concatenate(met)) if met else np.zeros(0, np.uint64)
        part = part_of(a, parts).astype(np.int64)
        order = np.argsort(part, kind="stable")
        a, part = a[order], part[order]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        packed = [a[i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True)] if len(a) else []
        return pa.Table.from_arrays([pa.array(part[first], pa.int32()), pa.array([key[0].as_py()] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["part", "group", "packed"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which anchors their part calls repeated; the part's bits come first."""
        bits = None
        for b in batches:
            for group, packed in zip(b.column("group").to_pylist(), b.column("packed").to_pylist(), strict=True):
                if group is None:
                    bits = np.frombuffer(packed, np.uint8)
                    continue
                a = np.frombuffer(packed, np.uint64)
                often = np.ones(len(a), bool)
                for x in cells(a, width):
                    often &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([a[often].tobytes()], pa.binary())], ["group", "packed"])

    def likely(key: tuple, t: pa.Table, known: pa.Table) -> pa.Table:
        """The group's windows whose anchor may be repeated: one of each hash to be compared with other groups', and, as sure, the places of those that the group itself repeats."""
        group, base, hashes, seconds, starts = (key[0].as_py() if len(t) else 0), 0, [], [], []
        wanted = known.column("packed").to_pylist()
        wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in wanted])) if wanted else np.zeros(0, np.uint64)
        for _, _, raw, at in runs(ordered(t).column("text")) if len(wanted) else ():
            count, words, start, head, anchor = anchors_of(raw, at)
            often = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
            start = start[np.repeat(often, np.diff(np.append(head, len(start))))]
            if len(start):
                hashes.append(grams(words, WINDOW)[start])
                seconds.append(grams(words, WINDOW, True)[start])
                starts.append(start + base)
            base += count
        none = np.zeros(0, np.int64)
        h, k, start, sure = none, none, none, []
        if hashes:
            h, k, start = np.concatenate(hashes).view(np.int64), np.concatenate(seconds).view(np.int64), np.concatenate(starts)
            order = np.lexsort((start, k, h))
            h, k, start = h[order], k[order], start[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            head = np.flatnonzero(new)
            again = np.diff(np.append(head, len(h))) > 1
            mine = start[np.repeat(again, np.diff(np.append(head, len(h))))]
            # of each hash one goes on: its place, or none where it is told already; what is sure stands together in one row
            h, k, start = h[head], k[head], np.where(again, -1, start[head])
            if len(mine):
                h, k, start, sure = np.append(h, base), np.append(k, -1 - group), np.append(start, -1), [tell(mine)]
        return pa.Table.from_arrays([pa.array(h), pa.array(k), pa.array(np.full(len(h), group), pa.int32()), pa.array(start), pa.array([None] * (len(h) - len(sure)) + sure, pa.binary())], ["h", "k", "group", "start", "sure"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places by group, packed."""
        groups, starts, held = [], [], 0

        def flush():
            group, start = np.concatenate(groups), np.concatenate(starts)
            order = np.lexsort((start, group))
            group, start = group[order], start[order]
            first = np.flatnonzero(np.diff(group, prepend=-1))
            packed = [tell(x) for x in np.split(start, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(group[first], pa.int32()), pa.array(packed, pa.binary())], ["group", "starts"])

        for b in batches:
            sure = b.column("sure").is_valid()
            told_already = b.filter(sure)
            if told_already.num_rows:
                yield pa.RecordBatch.from_arrays([told_already.column("group"), told_already.column("sure")], ["group", "starts"])
            some = b.filter(pc.invert(sure))
            if some.num_rows:
                groups.append(some.column("group").to_numpy())
                starts.append(some.column("start").to_numpy())
                held += some.num_rows
            if held > TOGETHER:
                yield flush()
                groups, starts, held = [], [], 0
        if held:
            yield flush()

    def cut(key: tuple, t: pa.Table, marks: pa.Table) -> pa.Table:
        """The group's texts without the words that its repeated windows cover."""
        t, base, out = ordered(t), 0, []
        start = [told(x) for x in marks.column("starts").to_pylist()]
        start = np.sort(np.concatenate(start)) if start else np.zeros(0, np.int64)
        ids = t.column("doc_id").to_pylist()
        for first, _, raw, at in runs(t.column("text")):
            s, e, w = word_spans(raw, at)
            own = start[np.searchsorted(start, base) : np.searchsorted(start, base + len(s))] - base
            covered = np.zeros(len(s) + 1, np.int32)
            np.add.at(covered, own, 1)
            np.add.at(covered, np.minimum(own + WINDOW, len(s)), -1)
            gone = np.cumsum(covered[:-1]) > 0
            base += len(s)
            data, lost = raw.tobytes(), np.concatenate([[0], np.cumsum(gone)])
            for i, (a, b) in enumerate(zip(w[:-1].tolist(), w[1:].tolist(), strict=True)):
                removed = int(lost[b] - lost[a])
                if removed:
                    keep = a + np.flatnonzero(~gone[a:b])
                    kept = b" ".join([data[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist(), strict=True)])
                else:
                    kept = b" ".join([x for x in data[at[i] : at[i + 1]].translate(BLANKS).split(b" ") if x])
                out.append((ids[first + i], b - a, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
        return pa.Table.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    asked = rows.groupBy("group").applyInArrow(ask, "part int, group int, packed binary")
    known = asked.unionByName(sketch.select("part", F.lit(None).cast("int").alias("group"), F.col("bits").alias("packed")))
    known = known.repartitionById(max(min(parts, n), 1), F.col("part")).sortWithinPartitions("part", "group").select("group", "packed").mapInArrow(answer, "group int, packed binary")
    windows = rows.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(likely, "h long, k long, group int, start long, sure binary")
    times = F.count(F.lit(1)).over(Window.partitionBy("h", "k"))
    marks = windows.withColumn("times", times).where("sure is not null or start >= 0 and times > 1").select("group", "start", "sure").mapInArrow(together, "group int, starts binary")
    out = rows.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    return out if texts else out.drop("text")


BLANKS = bytes(32 if i in (0x20, *range(0x09, 0x0E)) else i for i in range(256))


def report(docs: DataFrame) -> DataFrame:
    return remove(docs)
