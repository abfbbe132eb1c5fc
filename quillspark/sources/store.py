"""The stored tables: chunks, registry and summaries, and the way of pages into them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chunking, registry
from quillspark.operators.flow import place
from quillspark.sources import keyword_index, snapshots


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one of this schema where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def add_chunks(chunks: DataFrame, path: str) -> None:
    """Appends; postings, frequencies and statistics derive from the table, so nothing else changes."""
    chunks.write.mode("append").partitionBy("source_type").parquet(path)


def register(spark: SparkSession, root: str, entries: DataFrame) -> int:
    """Upserts entries into the stored registry at root as its next version, again on top of another writer's if that came first. Sent twice, entries change nothing but the version."""
    kind = {f.name: f.dataType.simpleString() for f in entries.schema}
    schema = ", ".join(f"{c} {k}" for c, k in (kind | {"created_at": kind["updated_at"], "uploaded_at": kind["updated_at"]}).items())
    return snapshots.save(spark, root, lambda old: registry.upsert(old, entries), schema)


def registered(spark: SparkSession, root: str, schema: str = "doc_id string") -> DataFrame:
    """The newest version of the stored registry, or an empty table."""
    return snapshots.load(spark, root, schema)


def ingest_batch(chunks: DataFrame, entries: DataFrame, root: str, batch: str) -> bool:
    """Adds a batch's chunks (with ``chunk_key``) to the index and its entries to the registry, both below root; false if the store had the batch.

    The chunks' version names the batch, so that a repeated one adds nothing; the registry comes second and is upserted also then, as the run before may have died between the two.
    """
    added = keyword_index.append(chunks, f"{root}/chunks", batch)
    register(chunks.sparkSession, f"{root}/registry", entries)
    return added


def entry(entries: DataFrame, doc_id: str) -> DataFrame:
    return entries.where(F.col("doc_id") == doc_id)


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document in order, joined by line breaks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page").cast("long").isNull().alias("last"), F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def by_place(chunks: DataFrame) -> DataFrame:
    """All chunks by document, page and number; what has no number comes last."""
    return chunks.orderBy("doc_id", place("page"), place("chunk_index"))


def ingest(pages: DataFrame, source_type: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(chunks, entries) of pages (doc_id, page, source, text, language, ...): annotated, chunked, enriched and counted. What else a page says of itself (source_path, page_total, extraction_method, page_kind, headings, layout, ...) its chunks have too. Pages without text give no chunks, and a document without chunks no entry."""
    p = registry.annotated(pages, source_type)
    p = p.withColumn("lang", F.col("language")) if "lang" not in p.columns else p
    along = [c for c in p.columns if c not in chunking.OWN]
    chunks = chunking.chunk(p, "page", along)
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return chunking.enriched(chunks.withColumn("chunk_key", F.col("chunk_id"))), registry.entries(p, counts, now).where("chunk_count > 0")


def write_summary(summary: DataFrame, path: str, mode: str, benchmark: str, results: str) -> None:
    """The one-row summary as one JSON file, with how it came about."""
    summary.withColumns({"mode": F.lit(mode), "benchmark_path": F.lit(benchmark), "result_path": F.lit(results)}).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
