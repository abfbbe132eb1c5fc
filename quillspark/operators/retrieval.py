"""Batch retrieval: BM25, vector relevance, rank fusion and confidence, for a table of queries at once.

Index tables (postings, terms, statistics) derive from a table of chunks ``(chunk_key, text)``; queries are
``(query_id, text)``, both with scope columns if wanted. Nothing is collected; what is broadcast is counted first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import let, tokens
from quillspark.operators.sizes import fits, small

SCOPE = ("source", "doc_id", "source_type")
MIN_SCORE = 0.30
K1, B, RRF, TOP_K = 1.5, 0.75, 60, 4
STRONG_FLOOR, BOTH_BONUS = 0.75, 0.15
#: Pairs of a query and a chunk, and of a chunk and a term, that one task scores at most (a chunk is taken to hold about ``HELD`` of the terms asked).
PAIRS, HELD = 1_000_000, 100
#: Query vectors that one product takes, so that what it holds does not grow with their number.
SLICE = 256
#: Blocks of queries that are broadcast at most, and that one task otherwise meets.
BLOCKS = 16
#: More than two cosines can differ by where their scores, rounded to six digits, are equal.
MARGIN = 2e-6


def tokenized(chunks: DataFrame, along: list[str] = ()) -> DataFrame:
    return chunks.select("chunk_key", *along, tokens(F.col("text")).alias("tokens"))


def counted(words: Column) -> Column:
    """Array of (term, tf) of an array of words, told inside the row: the words are sorted, and a term's count is the distance to where the next one begins."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda v, j: F.struct(F.get(s, v).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - v).cast("long").alias("tf"))))

    return F.when(F.size(words) == 0, F.array().cast("array<struct<term:string,tf:bigint>>")).otherwise(let(F.sort_array(words), runs))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_key, tf, dl): one row per term of a chunk."""
    t = tokenized(chunks).select("chunk_key", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return t.groupBy("chunk_key", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "chunk_key", "tf", "dl")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n, avgdl), over all chunks, those without tokens included."""
    return tokenized(chunks).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))


def scope_columns(queries: DataFrame, chunks: DataFrame) -> list[str]:
    return [c for c in SCOPE if c in queries.columns and c in chunks.columns]


def in_scope(wanted: dict[str, Column], have: dict[str, Column]) -> Column:
    """All of the scope's fields that are set (neither null nor empty) agree with the chunk's."""
    parts = [some(w).isNull() | F.coalesce(w.cast("string") == have[c].cast("string"), F.lit(False)) for c, w in wanted.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def some(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v != "", v)


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_key, score) of every chunk that shares a term and is in the query's scope (columns named in ``SCOPE`` that both tables have); statistics stay those of the whole corpus.

    The terms asked are the small side: a chunk's terms are counted inside its row, and those that are asked go on, with one mark that carries its length. A
    single shuffle brings a chunk's together; document frequencies, corpus statistics and scores
    follow from it, and a chunk's scores need no other. It deals chunks to so many tasks that each scores at most about ``PAIRS``, so that a task's memory does not
    grow with the corpus or the queries. A stop word in a query gives every chunk that holds it a score, but no shuffle by term ever happens.
    """
    scope = scope_columns(queries, chunks)
    asked = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in scope], F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", *[f"q_{c}" for c in scope], "term").agg(F.count(F.lit(1)).alias("times"))
    light = fits(asked)
    hint = F.broadcast if light else lambda df: df
    mark = F.lit("")  # no token is empty
    wanted = asked.select("term").union(queries.sparkSession.range(1).select(mark.alias("term"))).distinct()
    words = F.concat(F.array(F.struct(mark.alias("term"), F.lit(1).cast("long").alias("tf"))), counted(F.col("tokens")))
    rows = tokenized(chunks, scope).select("chunk_key", *scope, F.size("tokens").cast("long").alias("dl"), F.explode(words).alias("w")).select("chunk_key", *scope, "dl", "w.term", "w.tf")
    own = ["chunk_key", "dl", *scope]
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() * (queries.count() + HELD) // PAIRS))
    tf = rows.join(hint(wanted), "term", "left_semi").repartition(tasks, "chunk_key").groupBy(*own, "term").agg(F.sum("tf").alias("tf"))
    tf = tf.where(F.col("tf") > 0)  # always so; both readers below then need the same columns, and share one shuffle
    per = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dls"))
    marked = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    stats = per.agg(marked("df").alias("n"), (marked("dls") / marked("df")).alias("avgdl"))  # one row
    weights = asked.join(per, "term").crossJoin(F.broadcast(stats)).withColumn("weight", F.col("times") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    x = tf.join(hint(weights.drop("df", "dls", "n", "times")), "term").where(in_scope({c: F.col(f"q_{c}") for c in scope}, {c: F.col(c) for c in scope}))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("query_id", *own).agg(F.round(F.sum(part), 6).alias("score")).select("query_id", "chunk_key", "score")


def top_k(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best per query with their rank; ties go to the smaller key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def blocks(rows: DataFrame, key: str, vector: str, scope: list[str], size: int) -> DataFrame:
    """Rows packed by ``size``: keys, their vectors as one matrix of doubles, and hashes of the scope columns (0 where unset). Null vectors are left out."""
    kind = rows.schema[key].dataType.simpleString()
    hashes = [F.when(some(F.col(c)).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(c).cast("string"))).alias(f"h_{c}") for c in scope]
    x = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), *hashes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                listed = [pa.array([c.to_pylist()], pa.list_(c.type)) for c in (part.column(0), *part.columns[2:])]
                yield pa.RecordBatch.from_arrays([listed[0], pa.array([flat.tobytes()], pa.binary()), *listed[1:]], ["k", "m", *[f"h_{c}" for c in scope]])

    return x.mapInArrow(pack, ", ".join([f"k array<{kind}>", "m binary", *[f"h_{c} array<long>" for c in scope]]))


def vector_top_k(vectors: DataFrame, query_vectors: DataFrame, k: int = TOP_K, mapping: str = "l2", size: int = 2048) -> DataFrame:
    """The k best (query_id, chunk_key, score, rank) of each stated query vector against all vectors (chunk_key, embedding) in its scope.

    Both sides are packed into blocks, and a pair of blocks is one matrix product. A task keeps the k best of each query that it has met, skips what
    can't be among them and passes them on at its end. Blocks of queries are broadcast if they are few; else vectors are dealt to a part for each core and queries to parts of
    ``BLOCKS``, and each pair of parts is a task. So work is queries x vectors, as an exact search has it, but what a task holds does not grow with either, and
    what is sent is k rows a query and part.
    """
    scope = scope_columns(query_vectors, vectors)
    v = blocks(vectors, "chunk_key", "embedding", scope, size)
    q = blocks(query_vectors, "query_id", "query_embedding", scope, size).withColumn("b", F.monotonically_increasing_id())
    n = q.count()
    v, q = (v, F.broadcast(q)) if n <= BLOCKS else (v.repartition(v.sparkSession.sparkContext.defaultParallelism), q.repartition(-(-n // BLOCKS)).hint("shuffle_replicate_nl"))
    x = v.crossJoin(q.toDF(*[f"q_{c}" for c in q.columns]))
    names = x.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {}
        for b in batches:
            for row in range(b.num_rows):
                at = dict(zip(names, (c[row] for c in b.columns), strict=True))
                keys, every = (at[c].values for c in ("k", "q_k"))
                m, every_w = (np.frombuffer(at[c].as_py(), np.float64).reshape(n, -1) for c, n in (("m", len(keys)), ("q_m", len(every))))
                for some_ in range(0, len(every), SLICE):
                    asked, own = every.slice(some_, SLICE), (at["q_b"].as_py(), some_)
                    low, left, found, c, _, _ = met.get(own) or (np.full((len(asked), k), -np.inf), np.empty(0, int), keys.slice(0, 0), np.empty(0), None, None)
                    cosine = every_w[some_ : some_ + SLICE] @ m.T
                    fits_in = np.ones(cosine.shape, bool)
                    for name in scope:
                        have, want = at[f"h_{name}"].values.to_numpy(), at[f"q_h_{name}"].values.to_numpy()[some_ : some_ + SLICE]
                        fits_in &= (want[:, None] == 0) | (want[:, None] == have[None, :])
                    least = np.fmin.reduce(low, axis=1)
                    if len(keys) > k and np.isneginf(least).any():  # the first block of these queries, or few in scope
                        least = np.maximum(least, np.partition(np.where(fits_in, cosine, -np.inf), -k, axis=1)[:, -k])
                    new, took = np.divmod(np.flatnonzero(fits_in & ~(cosine < least[:, None] - MARGIN)), len(keys))  # what is no number counts as the greatest, as in Spark
                    if not len(new):
                        continue
                    left, found, c = np.concatenate([left, new]), pa.concat_arrays([found, keys.take(pa.array(took))]), np.concatenate([c, cosine[new, took]])
                    s = np.round(1 - (2 - 2 * c) / np.sqrt(2.0) if mapping == "l2" else c, 6)
                    order = np.lexsort((pc.rank(found, tiebreaker="first").to_numpy(), np.where(np.isnan(s), -np.inf, -s), left))
                    nth = np.arange(len(order)) - np.searchsorted(left[order], left[order])
                    order, nth = order[nth < k], nth[nth < k]
                    left, c, low = left[order], c[order], np.full(low.shape, -np.inf)
                    low[left, nth] = c
                    met[own] = low, left, found.take(pa.array(order)), c, asked.take(pa.array(left)), s[order]
        for _, _, found, _, asked, s in met.values():
            yield pa.RecordBatch.from_arrays([asked, found, pa.array(s)], ["query_id", "chunk_key", "score"])

    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((query_vectors, "query_id"), (vectors, "chunk_key"))}
    return top_k(x.mapInArrow(score, f"query_id {kinds['query_id']}, chunk_key {kinds['chunk_key']}, score double"), k)


def lists(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Both ranked lists as one table, a row for each query and chunk, dealt by query, so that all that follows of a query needs no other shuffle."""
    both = vector.select("query_id", "chunk_key", F.col("score").alias("v"), F.col("rank").alias("vr"), F.lit(None).cast("double").alias("k"), F.lit(None).cast("int").alias("kr"))
    # the second list is dealt otherwise, as Spark 4.1 zips the partitions of a union of two parts dealt alike, even where they differ in number
    both = both.unionByName(keyword.repartition("chunk_key").select("query_id", "chunk_key", F.lit(None).cast("double").alias("v"), F.lit(None).cast("int").alias("vr"), F.col("score").alias("k"), F.col("rank").alias("kr")))
    return both.repartition("query_id").groupBy("query_id", "chunk_key").agg(*[F.max(c).alias(c) for c in ("v", "vr", "k", "kr")])


def fuse(vector: DataFrame, keyword: DataFrame, limit: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties by vector, then keyword score, then rank of first sight. ``top_vector``, on each row, is the query's best vector score, null without one."""
    share = lambda r: F.coalesce(1 / (RRF + F.col(r)), F.lit(0.0))
    own = Window.partitionBy("query_id")
    x = lists(vector, keyword).select(
        "query_id", "chunk_key", F.round(share("vr") + share("kr"), 9).alias("rrf_score"), F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)).alias("vector_score"), F.coalesce("k", F.lit(0.0)).alias("keyword_score"),
        F.col("vr").isNotNull().alias("in_vector"), F.col("kr").isNotNull().alias("in_keyword"), F.max(F.when(F.col("vr") == 1, F.col("v"))).over(own).alias("top_vector"), F.max(F.when(F.col("kr") == 1, F.col("chunk_key"))).over(own).alias("top_keyword"), "vr", "kr")
    w = own.orderBy(F.desc("rrf_score"), F.desc("vector_score"), F.desc("keyword_score"), F.asc_nulls_last("vr"), F.asc_nulls_last("kr"))
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("vr", "kr")


def strong_hit(queries: DataFrame, top: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, strong) for (query_id, chunk_key) of each query's best keyword chunk: whether it holds a query token with a digit, - or _, or as many as two (or all) of the query's tokens of two characters or more, or any in the scope of one doc_id."""
    one = some(F.col("doc_id")).isNotNull() if "doc_id" in queries.columns else F.lit(False)
    q = queries.select("query_id", one.alias("one"), F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 2).alias("q"))
    x = q.join(top.select("query_id", "chunk_key"), "query_id")
    x = chunks.select("chunk_key", "text").join(small(x), "chunk_key").select("query_id", "one", "q", tokens(F.col("text")).alias("tokens"))
    hit = F.filter("q", lambda t: F.array_contains(F.col("tokens"), t))
    enough = F.col("one") | (F.size(hit) >= F.least(F.size("q"), F.lit(2)))
    return x.select("query_id", (F.exists(hit, lambda t: t.rlike("[0-9_-]")) | (enough & (F.size(hit) > 0))).alias("strong"))


def confidence(fused: DataFrame, strong: DataFrame) -> DataFrame:
    """(query_id, confidence, strong) from the best vector score, whether the first fused chunk is in both lists, and a strong keyword hit."""
    x = fused.where("rank = 1").join(strong, "query_id", "left")
    top = F.coalesce("top_vector", F.lit(0.0))
    lifted = F.when(F.col("in_vector") & F.col("in_keyword"), F.least(F.lit(1.0), top + BOTH_BONUS)).otherwise(F.lit(0.0))
    hit = F.coalesce("strong", F.lit(False))
    best = F.greatest(top, lifted, F.when(hit, F.lit(STRONG_FLOOR)).otherwise(0.0), F.lit(0.0))
    return x.select("query_id", F.round(F.least(best, F.lit(1.0)), 6).alias("confidence"), hit.alias("strong"))
