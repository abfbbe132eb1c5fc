"""Queries over stored indexes that are built from the given tables: keyword index in segments, inverted file of vectors, registry in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import flow, ivf
from quillspark.operators.sizes import small
from quillspark.plans.catalog import _BM25, _VEC, EVERY, asked, chunks, query, table, vectors
from quillspark.sources import keyword_index, snapshots, store

#: Batches in which the tables are appended.
BATCHES = 3


def keyword_store(spark, sf_dir) -> str:
    """The documents' chunks, stored in three appends, one of them sent twice."""
    root, c = snapshots.scratch(spark), chunks(spark, sf_dir)
    for k in (*range(BATCHES), 0):
        keyword_index.append(c.where(F.pmod("chunk_key", F.lit(BATCHES)) == k), root, f"batch-{k}")
    return root


@query(f"with {_BM25} select query_id, chunk_key, score, cast(rank as integer) as rank from kw")
def stored_bm25(spark, sf_dir):
    """The best chunks from the stored index, blocks below the k-th best score left closed."""
    return keyword_index.bm25_from(spark, keyword_store(spark, sf_dir), asked(spark, sf_dir))[0]


@query(f"with {_BM25} select query_id, chunk_key, score, cast(rank as integer) as rank from kw")
def compacted_bm25(spark, sf_dir):
    """The same after its segments have become one."""
    root = keyword_store(spark, sf_dir)
    keyword_index.compact(spark, root)
    return keyword_index.bm25_from(spark, root, asked(spark, sf_dir))[0]


def vector_store(spark, sf_dir) -> tuple[str, DataFrame]:
    """The embeddings, stored in two batches, and the stated query vectors."""
    root, e = snapshots.scratch(spark), table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk_key"), "embedding")
    for k in range(2):
        ivf.add(v.where(F.col("chunk_key") % 2 == k), root, f"batch-{k}")
    return root, e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@query(f"with {_VEC} select query_id, chunk_key, score, cast(rank as integer) as rank from vk")
def ivf_certain(spark, sf_dir):
    """The exact best vectors by the inverted file: after the nearest lists those that may hold a better one."""
    return ivf.certain(spark, *vector_store(spark, sf_dir))


@query()
def ivf_recall(spark, sf_dir):
    """One row: queries, and the share of the exact best four that the probed lists have, against the plain product of all vectors."""
    exact, found = vectors(spark, sf_dir).select("query_id", "chunk_key"), ivf.search(spark, *vector_store(spark, sf_dir)).select("query_id", "chunk_key", F.lit(1).alias("hit"))
    x = exact.join(found, ["query_id", "chunk_key"], "left")
    return x.agg(F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


@query("""with a as (select source as doc_id, count(*) as chunk_count from documents where doc_id % 2 = 0 group by source), b as (select source as doc_id, count(*) as chunk_count from documents where doc_id % 2 = 1 and doc_id % 3 <> 0 group by source)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(b.chunk_count, a.chunk_count) as chunk_count, case when b.doc_id is null then 'first' else 'second' end as updated_at, case when a.doc_id is null then 'second' else 'first' end as created_at from a full join b on a.doc_id = b.doc_id where coalesce(a.doc_id, b.doc_id) is not null""")
def registry_versions(spark, sf_dir):
    """Sources as documents, registered by two batches into the stored registry; its newest version."""
    root, d = snapshots.scratch(spark), table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    for name, some in (("first", d.where("doc_id % 2 = 0")), ("second", d.where("doc_id % 2 = 1 and doc_id % 3 <> 0"))):
        entries = some.groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunk_count")).withColumn("updated_at", F.lit(name))
        store.register(spark, root, entries)
    return store.registered(spark, root).select("doc_id", "chunk_count", "updated_at", "created_at")


@query()
def enriched_retrieval(spark, sf_dir):
    """From pages to sources: documents cut into chunks, their headers put in front, indexed in batches, and for each benchmark text where the best chunks are from. Held against BM25 over the same chunks in the tests."""
    root = snapshots.scratch(spark)
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(1).alias("page"), "source", F.concat(F.lit("/library/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit(1).alias("page_total"), F.lit("text").alias("extraction_method"), F.lit("").alias("section_title"), "text", F.col("lang").alias("language"))
    for k in range(BATCHES):
        made, entries = store.ingest(pages.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == k), F.lit("library"), F.lit(f"batch-{k}"))
        store.ingest_batch(made, entries, root, f"batch-{k}")
    best = small(snapshots.written(keyword_index.bm25_from(spark, f"{root}/chunks", asked(spark, sf_dir))[0]))
    held = keyword_index.stored(spark, f"{root}/chunks")
    of = flow.source_of(held)
    return best.join(held, "chunk_key").select("query_id", "rank", "score", *[of[c].alias(c) for c in flow.SOURCE])
