"""Stored indexes, versions and ledgers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ivf
from quillspark.operators import retrieval as R
from quillspark.plans.stores import ivf_recall
from quillspark.sources import keyword_index, snapshots, store


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    common, rare = [f"w{i}" for i in range(20)], [f"rare{i}" for i in range(400)]
    texts = [" ".join(r.choices(common, k=r.randint(0, 60)) + r.choices(rare, k=3)) for _ in range(6000)] + [None, "", "rare1 rare1 w1"]
    queries = [(0, "rare1 w1"), (1, "w1 w2 w2 nowhere"), (2, "nowhere"), (3, ""), (4, "rare7 rare8 rare9"), (5, "RARE3")]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_key long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def test_stored_index_equals_the_query_over_texts(spark, corpus):
    chunks, queries = corpus
    root = snapshots.scratch(spark)
    want = rows(R.top_k(R.bm25(chunks.fillna("", ["text"]), queries)).select("query_id", "chunk_key", "score", "rank"))
    for k in range(3):
        assert keyword_index.append(chunks.where(F.col("chunk_key") % 3 == k).coalesce(1).sortWithinPartitions("text"), root, f"b{k}")
    assert not keyword_index.append(chunks.where("chunk_key % 3 = 1"), root, "b1")  # repeated after a failure: nothing is added
    assert keyword_index.stored(spark, root).count() == chunks.count()
    for _ in range(2):
        got, told = keyword_index.bm25_from(spark, root, queries)
        assert rows(got.select("query_id", "chunk_key", "score", "rank")) == want
        assert rows(keyword_index.bm25_from(spark, root, queries, skip=False)[0].select("query_id", "chunk_key", "score", "rank")) == want
        skipped = {r["query_id"]: (r["blocks"], r["scored"]) for r in told.collect()}
        assert skipped[4][1] < skipped[4][0] and all(s <= b for b, s in skipped.values())
        keyword_index.compact(spark, root)
    assert snapshots.current(spark, root)[1]["batches"] == ["b0", "b1", "b2"] and len(snapshots.current(spark, root)[1]["segments"]) == 1
    assert not keyword_index.append(chunks.limit(1), root, "b2")


def test_stored_index_reads_only_buckets_asked(spark, corpus):
    chunks, queries = corpus
    root = snapshots.scratch(spark)
    keyword_index.append(chunks, root, "b")
    asked = spark.createDataFrame([("rare1",)], "term string")
    every = keyword_index.blocks(spark, root, asked)[0]
    files = every.inputFiles()
    bucket = asked.select(keyword_index.bucket(F.col("term"))).first()[0]
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters" in plan and files
    assert {r[0] for r in every.select("bucket").distinct().collect()} == {bucket}


def test_two_writers_and_none_lost(spark):
    root = snapshots.scratch(spark)
    add = lambda i: lambda old: old.unionByName(spark.createDataFrame([(i,)], "id long"))
    tries = []

    def late(old):
        tries.append(old.count())
        if len(tries) == 1:
            snapshots.save(spark, root, add(1), "id long")  # another writer comes first
        return add(2)(old)

    assert snapshots.save(spark, root, late, "id long") == 2 and tries == [0, 1]
    assert rows(snapshots.load(spark, root, "id long")) == [(1,), (2,)]
    number, contents = snapshots.current(spark, root)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, number, contents)

    def dies(old):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        snapshots.save(spark, root, dies, "id long")
    spark.range(9).write.parquet(f"{root}/data-half")  # what a run left that died before it committed
    assert snapshots.current(spark, root) == (number, contents) and json.loads(contents["schema"])["fields"][0]["name"] == "id"
    assert rows(snapshots.load(spark, root, "id long")) == [(1,), (2,)] and snapshots.load(spark, snapshots.scratch(spark), "id long").count() == 0


def test_a_replayed_batch_adds_nothing(spark):
    root = snapshots.scratch(spark)
    chunks = spark.createDataFrame([("a:1", "one two"), ("a:2", "two three")], "chunk_key string, text string")
    entries = spark.createDataFrame([("a", "t1", 2)], "doc_id string, updated_at string, chunk_count long")
    assert store.ingest_batch(chunks, entries, root, "7")
    assert not store.ingest_batch(chunks, entries, root, "7")
    assert store.ingest_batch(spark.createDataFrame([("b:1", "four")], "chunk_key string, text string"), entries.withColumn("doc_id", F.lit("b")).withColumn("updated_at", F.lit("t2")), root, "8")
    assert keyword_index.stored(spark, f"{root}/chunks").count() == 3
    assert rows(store.registered(spark, f"{root}/registry").select("doc_id", "chunk_count", "updated_at", "created_at")) == [("a", 2, "t1", "t1"), ("b", 2, "t2", "t2")]


def test_inverted_file(spark):
    r = random.Random(3)

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    centres = [unit([r.gauss(0, 1) for _ in range(16)]) for _ in range(12)]
    data = [(i, unit([c + r.gauss(0, 0.15) for c in centres[0 if i % 3 == 0 else r.randrange(12)]])) for i in range(3000)] + [(9000, None)]
    vectors = spark.createDataFrame(data, "chunk_key long, embedding array<float>").repartition(4)
    queries = vectors.where("chunk_key % 50 = 0").selectExpr("chunk_key as query_id", "embedding as query_embedding")
    root = snapshots.scratch(spark)
    assert ivf.add(vectors.where("chunk_key % 2 = 0"), root, "a", lists=12) and ivf.add(vectors.where("chunk_key % 2 = 1"), root, "b") and not ivf.add(vectors, root, "b")
    exact = rows(R.vector_top_k(vectors, queries).select("query_id", "chunk_key", "score", "rank"))
    assert rows(ivf.certain(spark, root, queries, nprobe=2).select("query_id", "chunk_key", "score", "rank")) == exact
    found = {x[:2] for x in rows(ivf.search(spark, root, queries, nprobe=4).select("query_id", "chunk_key"))}
    assert len(found & {x[:2] for x in exact}) >= 0.9 * len(exact)
    assert ivf_recall(spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9
    _, packed = ivf.opened(spark, root)
    assert packed.selectExpr("sum(size(keys)) as n").first()[0] == 3000


def test_enriched_chunks_from_pages_to_sources(spark):
    """The stored way of pages equals BM25 over the chunks made at once, and every source tells where it is from."""
    from quillspark.plans import stores

    sf_dir = "/root/testdata/sf0.001"
    got = stores.enriched_retrieval(spark, sf_dir).collect()
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = d.selectExpr("concat('doc-', doc_id) as doc_id", "1 as page", "source", "text", "lang as language")
    chunks, _ = store.ingest(pages, F.lit("library"), F.lit("now"))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as query_id", "text")
    want = {(r["query_id"], r["rank"]): r["score"] for r in R.top_k(R.bm25(chunks, asked)).collect()}
    assert {(r["query_id"], r["rank"]): r["score"] for r in got} == want
    assert all(r[c] is not None for r in got for c in ("doc_id", "source", "source_type", "source_path", "page", "section", "chunk_index", "chunk_type", "extraction_method"))
