"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chat, fingerprints, licenses, mixing, neardup, packing, pii, quality, structure, substrings, trie, urls, warc
from quillspark.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.outcomes(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(docs: DataFrame) -> DataFrame:
    return quality.judge(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": over("documents", pii.report),
    "op2_neardup": over("documents", neardup.report),
    "op3_chat": over("conversations", chat.report),
    "op4_fingerprints": over("documents", fingerprints.report),
    "op5_packing": over("documents", packing.report),
    "op6_substrings": over("documents", substrings.report),
    "op7_mixing": over("documents", mixing.report),
    "op8_licenses": over("documents", licenses.report),
    "op9_quality": over("documents", quality_rules),
    "op10_warc": over("pages", warc.report),
    "op11_urls": url_filters,
    "op12_trie": over("conversations", trie.report),
    "op13_structure": over("conversations", structure.report),
}
