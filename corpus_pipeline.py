"""Quality rules, near-dedup, PII, mixing and packing, one after the other over the documents.

``run`` applies the stages to the table ``documents``; what one stage keeps is written and read as the next one's input.
Rows that repeat a doc_id: quality and mixing decide on each row by itself, near-dedup leaves
one of them, the one with the least text. A null doc_id is a document of its own at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, neardup, packing, pii, quality
from quillspark.llm.common import numbered_rows, small, with_decision, written

#: Repeated ids up to which they are broadcast (16 bytes a row).
IDS = 100_000

#: The rows that run() gives can't be said in SQL (near-dedup, mixing); the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language's reference let pass."""
    return quality.judge(docs, whole=True).where("kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five-word shingles and 0.8 the document with the least doc_id."""
    x = numbered_rows(docs)
    rows = written(neardup.link(x, 5, row="__row").select(F.col("doc_id").alias("__id"), "__row", (F.col("kept") | F.col("doc_id").isNull()).alias("__keep")))
    again = written(rows.where(F.col("__keep") & F.col("__id").isNotNull()).groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id", F.lit(True).alias("__again")))
    if again.limit(1).count():
        least = x.join(small(again, IDS), x["doc_id"] == F.col("__id")).groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("some"), "text", "__row"))["__row"].alias("__row"))
        rows = rows.join(small(again, IDS), "__id", "left").join(small(written(least.select("__row", F.lit(True).alias("__least"))), IDS), "__row", "left")
        rows = rows.withColumn("__keep", F.when(F.col("__again"), F.coalesce("__least", F.lit(False))).otherwise(F.col("__keep")))
    return with_decision(x, rows.select("__row", F.col("__keep").cast("int").alias("__keep")), "__keep").where("__keep = 1").select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    masked = pii.scan(docs, rest, redact=True).withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, or not at all; rows are written with a number of their own, by which copies come back to them."""
    x = numbered_rows(docs)
    x = with_decision(x, mixing.mix(x, extra=["__row"]).select("__row", F.col("copies").alias("__copies")), "__copies").where("__copies > 0")
    return x.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, length, bucket, padded_to, batch, slot of each copy."""
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", mask_pii), ("mixing", mix_sources), ("packing", pack_batches)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
