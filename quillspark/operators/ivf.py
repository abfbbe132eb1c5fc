"""Inverted file for vectors: centroids fitted on a bounded sample, every vector stored with its nearest, and probes scored exactly.

Work is queries x vectors of the probed lists. A list of any size is shared among tasks, as its vectors come in packed rows of ``PACK`` and meet the
queries that probe it block by block. ``certain`` goes on to lists that could still hold a better one, by the triangle inequality, so that its result is that of
``retrieval.vector_top_k``, which remains the plain exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.retrieval import SLICE, TOP_K, top_k
from quillspark.operators.sizes import fits, small
from quillspark.sources.snapshots import changed, current

#: Rows that centroids are fitted on at most (those least by a hash of the key), steps, and vectors packed into one row.
SAMPLE, STEPS, PACK = 20_000, 12, 1024
#: Lists, and those probed. The probes suit vectors without clusters, whose neighbours are spread over many lists; clustered ones need far fewer.
LISTS, PROBES = 128, 56
#: Groups of queries (of about half a MB each) up to which they are broadcast, and packed rows that one of a list's parts has, about.
GROUPS = 64


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, steps: int = STEPS) -> np.ndarray:
    """Centroids (at most ``lists``) of a sample of vectors (chunk_key, embedding), by k-means; starts are spread by taking each time the farthest of some candidates."""
    rows = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(F.col("chunk_key").cast("string")), "chunk_key").limit(sample).select(F.col("embedding").cast("array<double>").alias("v")).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 1))
    rng = np.random.default_rng(7)
    centres = x[:1]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(lists, len(x)) and near.max() > 0:
        found = rng.choice(len(x), size=4, p=near / near.sum())
        gain = [np.minimum(near, ((x - x[i]) ** 2).sum(1)) for i in found]
        best = int(np.argmin([g.sum() for g in gain]))
        centres, near = np.vstack([centres, x[found[best]]]), gain[best]
    for _ in range(steps):
        own = distances(x, centres).argmin(1)
        centres = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def lists_of(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(list, far, keys, m): vectors with their nearest centroid, packed inside each task's batch; ``far`` is the farthest from the centroid."""
    kind, width = vectors.schema["chunk_key"].dataType.simpleString(), centres.shape[1]
    x = vectors.where(F.col("embedding").isNotNull()).select("chunk_key", F.col("embedding").cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1), width)
            d = distances(v, centres)
            own = d.argmin(1)
            for k in np.unique(own):
                rows = np.flatnonzero(own == k)
                for at in range(0, len(rows), PACK):
                    some = rows[at : at + PACK]
                    keys = b.column(0).take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([float(d[some, k].max())]), pa.array([keys.to_pylist()], pa.list_(keys.type)), pa.array([v[some].tobytes()], pa.binary())], ["list", "far", "keys", "m"])

    return x.mapInArrow(assign, f"list int, far double, keys array<{kind}>, m binary")


def add(vectors: DataFrame, root: str, batch: str, lists: int = LISTS) -> bool:
    """Adds vectors as a batch to the stored file at root, once; the first batch fits the centroids that all later ones keep."""
    spark = vectors.sparkSession
    before = current(spark, root)[1]
    if batch in before.get("batches", {}):
        return False
    centres = np.array(before["centres"]) if before else fit(vectors, lists)
    name = f"lists-{batch}-{np.random.default_rng().integers(1 << 62):x}"
    packed = lists_of(vectors, centres)
    # sorted by list over ranges, so that files and row groups hold few lists each, and a list of any size is shared among them
    packed.withColumn("__h", F.xxhash64("m")).repartitionByRange("list", "__h").sortWithinPartitions("list").drop("__h").write.parquet(f"{root}/{name}")

    def put(contents: dict) -> dict | None:
        if batch in contents.get("batches", {}):
            return None
        if contents and contents["centres"] != centres.tolist():
            raise ValueError("another writer's first batch has fitted other centroids; add this batch again")
        return {"centres": centres.tolist(), "batches": contents.get("batches", {}) | {batch: name}}

    return changed(spark, root, put)[1]["batches"][batch] == name


def opened(spark: SparkSession, root: str) -> tuple[np.ndarray, DataFrame]:
    """The centroids and the packed lists (list, far, keys, m) of all batches."""
    contents = current(spark, root)[1]
    read = [spark.read.parquet(f"{root}/{name}") for name in contents["batches"].values()]
    every = read[0]
    for r in read[1:]:
        every = every.unionByName(r)
    return np.array(contents["centres"]), every


def probes(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """(query_id, w, list, place, away): all lists of each query (query_id, query_embedding) from the nearest (place 0), with their centroids' distance."""
    kind, width = queries.schema["query_id"].dataType.simpleString(), centres.shape[1]
    x = queries.where(F.col("query_embedding").isNotNull()).select("query_id", F.col("query_embedding").cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v = matrix(part.column(1), width)
                d = distances(v, centres)
                order = d.argsort(1, kind="stable")
                n, k = d.shape
                row = np.repeat(np.arange(n), k)
                packed = pa.array([q.tobytes() for q in v], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), packed.take(pa.array(row)), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(np.take_along_axis(d, order, 1).ravel())], ["query_id", "w", "list", "place", "away"])

    return x.mapInArrow(work, f"query_id {kind}, w binary, list int, place int, away double")


def scored(asked: DataFrame, packed: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, chunk_key, score) of the k best of each packed row for the queries that probe its list: one product a packed row and up to ``PACK`` of its queries."""
    kinds = asked.schema["query_id"].dataType.simpleString(), packed.schema["keys"].dataType.elementType.simpleString()
    # queries of a list come in groups of about PACK, so that none grows with their number
    parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("__parts"))
    dealt = asked.join(F.broadcast(parts), "list").withColumn("__g", F.pmod(F.xxhash64("query_id"), F.col("__parts")))  # a row a list
    together = dealt.groupBy("list", "__g").agg(F.collect_list(F.struct("query_id", "w")).alias("asked")).drop("__g")
    rows = packed.select("list", "keys", "m")
    if fits(together, GROUPS):
        x = rows.join(F.broadcast(together), "list")
    else:
        # groups of queries go once to each part of their list's packed rows, so that no list comes to one task and none of them to the driver
        spread = packed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / GROUPS).alias("__n"))  # a row a list
        rows = rows.join(F.broadcast(spread), "list").withColumn("__part", F.pmod(F.xxhash64("m"), F.col("__n"))).drop("__n")
        x = rows.join(together.join(F.broadcast(spread), "list").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n").hint("shuffle_hash"), ["list", "__part"])
    x = x.select("keys", "m", F.col("asked.query_id").alias("ids"), F.col("asked.w").alias("ws"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                keys, m, ids, ws = (c[row] for c in b.columns)
                keys, ids = keys.values, ids.values
                v = np.frombuffer(m.as_py(), np.float64).reshape(len(keys), width)
                w = np.frombuffer(b"".join(ws.as_py()), np.float64).reshape(len(ids), width)
                place = np.argsort(np.argsort(np.array(keys.to_pylist()), kind="stable"), kind="stable")
                for at in range(0, len(ids), SLICE):
                    s = np.round(1 - (2 - 2 * (w[at : at + SLICE] @ v.T)) / np.sqrt(2.0), 6)
                    took = np.concatenate([np.lexsort((place, -s[i]))[:k] for i in range(len(s))])
                    left = np.repeat(np.arange(len(s)), min(k, len(keys)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(left + at)), keys.take(pa.array(took)), pa.array(s[left, took])], ["query_id", "chunk_key", "score"])

    return x.mapInArrow(score, f"query_id {kinds[0]}, chunk_key {kinds[1]}, score double")


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = TOP_K, nprobe: int = PROBES) -> DataFrame:
    """The k best (query_id, chunk_key, score, rank) among the vectors of each query's ``nprobe`` nearest lists, scored as ``retrieval.vector_top_k`` scores unit vectors."""
    centres, packed = opened(spark, root)
    asked = probes(queries, centres).where(F.col("place") < nprobe).select("query_id", "w", "list")
    return top_k(scored(asked, packed, centres.shape[1], k), k)


def certain(spark: SparkSession, root: str, queries: DataFrame, k: int = TOP_K, nprobe: int = PROBES) -> DataFrame:
    """As ``search``, but exact: after the first probes every list is opened whose nearest possible vector is not farther than the k-th best."""
    centres, packed = opened(spark, root)
    every = probes(queries, centres)
    first = top_k(scored(every.where(F.col("place") < nprobe).select("query_id", "w", "list"), packed, centres.shape[1], k), k)
    # of unit vectors score 1 - d * d / sqrt(2), so d = sqrt((1 - score) * sqrt(2))
    reach = first.where(F.col("rank") == k).select("query_id", F.sqrt((1 - F.col("score") + 1e-6) * np.sqrt(2.0)).alias("reach"))
    radius = packed.groupBy("list").agg(F.max("far").alias("radius"))
    more = every.where(F.col("place") >= nprobe).join(small(radius), "list").join(small(reach), "query_id", "left")
    more = more.where(F.col("reach").isNull() | (F.col("away") - F.col("radius") <= F.col("reach") + 1e-9)).select("query_id", "w", "list")
    return top_k(first.drop("rank").unionByName(scored(more, packed, centres.shape[1], k)), k)
