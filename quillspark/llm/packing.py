"""Packing documents into token batches: length buckets that minimise padding, then batches of a token budget in each.

The global histogram of lengths (one row per distinct length; beyond ``EXACT`` lengths are rounded up to steps of
about 1 %, so that it has at most some ten thousand rows however large the corpus) goes through dynamic programming:
``cost[k][j]`` is the least padding when the first j lengths make k buckets, each padded to its longest. Rounding touches the choice
of boundaries only (beyond ``EXACT`` these are optimal to about 1 %): a bucket is padded to its true longest document. A batch of a
bucket holds ``budget // longest`` documents (at least one), counted along the bucket.

Nulls and edges: a null or empty text has length 0 and goes in the first bucket. A text longer than the budget makes
a batch of its own. Repeated rows are packed each. With fewer distinct lengths than buckets, each has its own. An empty table gives an
empty result. Extra columns are ignored unless named in ``extra``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ranked, text_of, word_count, written

BUCKETS, BUDGET, EXACT, STEP = 8, 8192, 16384, 0.01


def rounded(length: Column, exact: int = EXACT) -> Column:
    """The length itself, or from ``exact`` on the next step of a geometric grid, rounded up."""
    grid = F.ceil(F.exp(F.ceil(F.log(F.greatest(length, F.lit(exact)) / float(exact)) / math.log1p(STEP)) * math.log1p(STEP)) * float(exact)).cast("long")
    return F.when(length <= exact, length).otherwise(F.greatest(grid, length))


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The longest length of each bucket of a partition with the least padding; among equals the shortest last boundaries.

    The cost of a run of lengths satisfies the quadrangle inequality, so best cuts rise with j, and each
    layer takes n log n steps by divide and conquer.
    """
    order = np.argsort(lengths)
    x, c = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    n = len(x)
    if n <= buckets:
        return x.tolist()
    total, weight = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = x[np.arange(n)] * total[1:] - weight[1:]  # one bucket
    cost = np.concatenate([[0], cost])
    cuts = []
    for k in range(2, buckets + 1):
        new, cut = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            v = cost[i] + x[j - 1] * (total[j] - total[i]) - (weight[j] - weight[i])
            m = int(v.argmin())
            new[j], cut[j] = v[m], i[m]
            todo += [(low, j - 1, first, int(i[m])), (j + 1, high, int(i[m]), last)]
        cuts.append(cut)
        cost = new
    ends, j = [n], n
    for cut in reversed(cuts):
        j = int(cut[j])
        ends.append(j)
    return [int(x[j - 1]) for j in reversed(ends)]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None, extra: list[str] = ()) -> DataFrame:
    """doc_id, length, bucket (from 0), padded_to, batch (from 0 in its bucket), ``slot`` in the batch; ``length`` defaults to the number of words."""
    length = word_count(text_of(docs)) if length is None else length
    rows = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), length.cast("long").alias("length"), *extra)).withColumn("__up", rounded(F.col("length")))
    histogram = rows.groupBy("__up").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()  # bounded: see above
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    longest = {r[0]: r[2] for r in histogram}
    bucket = F.lit(max(0, len(ends) - 1))
    for k in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("__up") <= ends[k], F.lit(k)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("padded_to", F.element_at(F.array(*[F.lit(longest[e]) for e in ends] or [F.lit(0)]), F.col("bucket") + 1).cast("long"))
    place = ranked(rows, ["bucket"], ["doc_id", "length"], "__place")
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1))), F.lit(1)).cast("long")
    at = F.col("__place") - 1
    return place.select("doc_id", "length", "bucket", "padded_to", F.floor(at / each).cast("long").alias("batch"), (at % each).alias("slot"), *extra)


def report(docs: DataFrame) -> DataFrame:
    return pack(docs)
