"""The stored chunks and their keyword index: a segment for each batch, postings by bucket of terms, and top k by block maxima.

A batch's chunks are written with their postings, and a version of the store (``snapshots``) then names the batch, its folders and its sums; so a
batch that is repeated after a failure adds nothing, and one that died half way is not there. Number of chunks and sum of lengths are added up from the segments;
a term's document frequency from its blocks. Only the buckets of the terms asked are read.

A block holds a term's postings in up to ``BLOCK`` neighbouring chunks of a segment, with their number, their greatest term frequency and least length, from which
follows the most that the term can add to a score there, whatever the corpus's average length has become. No block grows with its term.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import tokens
from quillspark.operators.retrieval import B, K1, TOP_K, top_k
from quillspark.operators.sizes import small
from quillspark.sources.snapshots import changed, current, written

BUCKETS, BLOCK = 32, 256
#: Blocks of each query that are scored first, for a first k-th best score.
FIRST = 8
#: Scores are rounded to six digits; bounds are held this far below.
SLACK = 1e-5
#: Chunks whose blocks one task scores, about, and queries that are scored together.
DEALT, TOGETHER = 10_000, 1024


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def packed(chunks: DataFrame, key: str = "chunk_key") -> DataFrame:
    """(bucket, term, block, n, top_tf, least_dl, tfs, entries (k, tf, dl)) of chunks (key, text). Blocks are neighbouring rows of a task, whose postings are put together where they are, so nothing is shuffled."""
    kind = chunks.schema[key].dataType.simpleString()
    t = chunks.select(F.col(key).alias("k"), tokens(F.coalesce("text", F.lit(""))).alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                keys, words = b.slice(at, BLOCK).columns
                block += 1
                dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
                if not dl.sum():
                    continue
                coded = words.flatten().dictionary_encode()
                pair, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK + np.repeat(np.arange(len(dl)), dl), return_counts=True)
                code, row = pair // BLOCK, pair % BLOCK
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                entries = pa.StructArray.from_arrays([keys.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(dl[row])], ["k", "tf", "dl"])
                yield pa.RecordBatch.from_arrays([
                    coded.dictionary.take(pa.array(code[starts])), pa.array(np.full(len(starts), block)), pa.array(np.diff(starts, append=len(pair))), pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(dl[row], starts)),
                    pa.array(np.add.reduceat(tf, starts)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(pair)).astype(np.int32)), entries)], ["term", "block", "n", "top_tf", "least_dl", "tfs", "entries"])

    return t.mapInArrow(pack, f"term string, block long, n long, top_tf int, least_dl int, tfs long, entries array<struct<k:{kind},tf:int,dl:int>>").withColumn("bucket", bucket(F.col("term")))


def append(chunks: DataFrame, root: str, batch: str) -> bool:
    """Adds chunks (chunk_key, text, ...) as the segment of a batch; false, and nothing is added, where the store has that batch. Keys are the caller's: they should differ over batches."""
    spark = chunks.sparkSession
    if batch in current(spark, root)[1].get("batches", []):
        return False
    made = write_segment(chunks, root)

    def add(contents: dict) -> dict | None:
        if batch in contents.get("batches", []):
            return None
        return {"batches": [*contents.get("batches", []), batch], "segments": [*contents.get("segments", []), made]}

    return made in changed(spark, root, add)[1]["segments"]


def write_segment(chunks: DataFrame, root: str) -> dict:
    """Writes chunks and postings to a folder of their own, and tells its name and sums."""
    spark, name = chunks.sparkSession, f"segment-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{root}/{name}/chunks")
    held = spark.read.schema(chunks.schema).parquet(f"{root}/{name}/chunks")
    packed(held).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{root}/{name}/postings")
    dl = spark.read.schema("tfs long").parquet(f"{root}/{name}/postings").agg(F.coalesce(F.sum("tfs"), F.lit(0))).first()[0]
    return {"name": name, "n": held.count(), "dl": dl}


def compact(spark: SparkSession, root: str) -> None:
    """All segments of now become one; batches that come meanwhile stay, and all stay known."""
    old = current(spark, root)[1].get("segments", [])
    if len(old) < 2:
        return
    one = write_segment(stored(spark, root, old), root)

    def swap(contents: dict) -> dict | None:
        if any(s not in contents["segments"] for s in old):
            return None
        return contents | {"segments": [one, *[s for s in contents["segments"] if s not in old]]}

    changed(spark, root, swap)


def stored(spark: SparkSession, root: str, segments: list[dict] | None = None) -> DataFrame:
    """All chunks of the store."""
    segments = current(spark, root)[1].get("segments", []) if segments is None else segments
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{s['name']}/chunks" for s in segments]).drop("__block")


def blocks(spark: SparkSession, root: str, asked: DataFrame) -> tuple[DataFrame, int, float]:
    """The blocks of the terms asked (term), with their segment; number of chunks and average length. Only buckets of these terms are read; their numbers, at most ``BUCKETS``, reach the driver."""
    segments = current(spark, root)[1]["segments"]
    wanted = [r[0] for r in asked.select(bucket(F.col("term"))).distinct().collect()]
    read = [spark.read.parquet(f"{root}/{s['name']}/postings").where(F.col("bucket").isin(wanted)).withColumn("segment", F.lit(k)) for k, s in enumerate(segments)]
    every = read[0]
    for r in read[1:]:
        every = every.unionByName(r)
    n, dl = sum(s["n"] for s in segments), sum(s["dl"] for s in segments)
    return every.join(small(asked.select("term").distinct()), "term", "left_semi"), n, dl / n if n else 0.0


def bm25_from(spark: SparkSession, root: str, queries: DataFrame, k: int = TOP_K, skip: bool = True) -> tuple[DataFrame, DataFrame]:
    """The k best (query_id, chunk_key, score, rank) of the store for queries (query_id, text), and (query_id, blocks, scored): how many blocks of chunks a query's terms are in, and how many were opened.

    A block's bound is the sum of its terms' most. The ``FIRST`` blocks by bound are scored, and then those whose
    bound reaches a query's k-th best of these. Without ``skip`` all are. Ties go to the smaller key, as in ``retrieval.top_k``.

    Blocks are dealt with their postings, and each is scored where it is, as one product of its terms' weights and shares for up to about ``TOGETHER`` queries, which passes on k
    rows a query; so no pair of query and chunk is shuffled.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    every, n, average = blocks(spark, root, asked)
    share = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))
    df = every.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.col("times") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = written(asked.join(df, "term").select("query_id", "term", weight.alias("weight")))  # as all that is written here, small and read several times
    place = ["segment", "block"]
    most = written(every.select("term", *place, "top_tf", "least_dl").join(small(weights), "term").groupBy("query_id", *place).agg(F.sum(F.col("weight") * share(F.col("top_tf"), F.col("least_dl"))).alias("bound")))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), *place)

    parts, dealt = -(-queries.count() // TOGETHER), max(spark.sparkContext.defaultParallelism, n // DEALT)
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts))).alias("group")
    lists = small(weights.groupBy("term", group).agg(F.collect_list(F.struct("query_id", "weight")).alias("asked")), 20_000)
    kinds = queries.schema["query_id"].dataType.simpleString(), every.schema["entries"].dataType.elementType["k"].dataType.simpleString()

    def best(table: pa.Table) -> pa.Table:
        """The k best chunks of one block for each query of a group."""
        columns, sizes = zip(*((c.flatten(), pc.list_value_length(c).to_numpy(zero_copy_only=False)) for c in (table[x].combine_chunks() for x in ("entries", "asked"))), strict=True)
        (held, wanted), terms = columns, table.num_rows
        of_chunk, of_query = (np.repeat(np.arange(terms), s) for s in sizes)
        keys, ids = held.field("k").dictionary_encode(), wanted.field("query_id").dictionary_encode()
        at, who = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (keys, ids))
        tf, dl, weight = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (held.field("tf"), held.field("dl"), wanted.field("weight")))
        shares = np.bincount(of_chunk * len(keys.dictionary) + at, share(tf, dl), terms * len(keys.dictionary)).reshape(terms, -1)
        weights = np.bincount(who * terms + of_query, weight, terms * len(ids.dictionary)).reshape(-1, terms)
        order = np.argsort(np.array(keys.dictionary.to_pylist()), kind="stable")
        raw = (weights @ shares)[:, order]
        score = np.round(raw, 6)
        took = np.argsort(-score, axis=1, kind="stable")[:, :k]
        left, took = np.repeat(np.arange(len(score)), took.shape[1]), took.ravel()
        some = raw[left, took] > 0  # a term that they share adds more than 0
        left, took = left[some], took[some]
        return pa.table([ids.dictionary.take(pa.array(left)), keys.dictionary.take(pa.array(order[took])), pa.array(score[left, took])], names=["query_id", "chunk_key", "score"])

    def scored(chosen: DataFrame) -> DataFrame:
        x = every.join(small(chosen.select(*place).distinct()), place, "left_semi").select("term", *place, "entries").repartition(dealt, *place)
        x = x.join(lists, "term").select(*place, "group", "entries", "asked")
        return x.groupBy(*place, "group").applyInArrow(best, f"query_id {kinds[0]}, chunk_key {kinds[1]}, score double")

    if not skip:
        opened = most
    else:
        first = most.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= FIRST).select("query_id", *place)
        least = written(top_k(scored(first), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
        opened = most.join(small(least), "query_id", "left").where(F.col("bound") >= F.coalesce(F.col("least") - SLACK, F.lit(0.0)))
    opened = opened.select("query_id", *place)
    told = most.join(opened.withColumn("__o", F.lit(1)), ["query_id", *place], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count("__o").alias("scored"))
    return top_k(scored(opened), k), told
