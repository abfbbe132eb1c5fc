"""Benchmark evaluation: rows chosen and validated, scopes resolved, retrieval and answers scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions.text import strip
from quillspark.operators import chat, flow, registry

#: Fixed value: fields that each row has.
REQUIRED = ["category", "document_source", "expected_answer_points", "id", "language", "question", "should_answer_from_docs"]


def chosen(items: DataFrame, ids: list[str] | None = None, limit: int = 0) -> DataFrame:
    """The items with these ids (all without), then the first so many by line (all for 0)."""
    x = items.where(F.col("id").isin(*ids)) if ids else items
    return x.orderBy("_line_no").limit(limit) if limit else x


def parsed(lines: DataFrame) -> DataFrame:
    """(_line_no, fields): raw JSON text of each field of each line (_line_no, line) that is not blank; null where the line is no JSON object."""
    x = lines.where(strip(F.col("line")) != "")
    good = F.expr("try_parse_json(line)").isNotNull() & F.col("line").rlike(r"(?s)^\s*\{")
    names = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    return x.select("_line_no", "line", F.when(good, names).alias("names"))


def problems(lines: DataFrame) -> DataFrame:
    """(_line_no, error), one row a problem of JSON lines (_line_no, line): broken JSON, missing fields, wrong types, empty id or question, an id seen in an earlier line."""
    x = parsed(lines)
    raw = lambda f: F.get_json_object("line", f"$.{f}")
    kind = lambda f: F.expr(f"schema_of_variant(try_variant_get(try_parse_json(line), '$.{f}', 'variant'))")
    has = lambda f: F.array_contains("names", f)
    text = lambda f: strip(F.coalesce(raw(f), F.lit("None")))
    say = lambda when, what: F.when(when, what)
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("names"))
    ident = F.when(has("id"), text("id"))
    again = F.row_number().over(Window.partitionBy(ident).orderBy("_line_no")) > 1
    x = x.withColumn("__again", again & (F.coalesce(ident, F.lit("")) != "")).withColumn("__id", ident)
    found = F.array(
        say(F.col("names").isNull(), F.lit("invalid JSON")),
        say(F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", "))),
        *[say(has(f) & ~F.coalesce(kind(f).startswith("ARRAY"), F.lit(False)), F.lit(f"{f} must be a list")) for f in ("expected_answer_points", "expected_sources")],
        say(has("should_answer_from_docs") & (F.coalesce(kind("should_answer_from_docs"), F.lit("")) != "BOOLEAN"), F.lit("should_answer_from_docs must be true/false")),
        *[say(has(f) & (text(f) == ""), F.lit(f"{f} must be non-empty")) for f in ("id", "question")],
        say(F.col("__again"), F.concat(F.lit("duplicate id '"), F.col("__id"), F.lit("'"))))
    return x.select("_line_no", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("error"))


def value_counts(items: DataFrame, name: str) -> DataFrame:
    """(value, n): rows for each value, stripped; null and blank ones are ``unknown``."""
    v = strip(F.coalesce(F.col(name).cast("string"), F.lit("unknown")))
    return items.groupBy(F.when(v == "", "unknown").otherwise(v).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def requests(items: DataFrame) -> DataFrame:
    """Resolved items as requests, by their id."""
    return items.where("resolved").select(F.col("id").alias("query_id"), F.col("question").alias("text"), "source", "doc_id", chat.whole_document(F.col("category"), F.col("full_document")).alias("full_document"), F.lit("").alias("history"), F.lit("").alias("system"))


def retrieval(items: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Items (with their scope resolved) and what retrieval finds for them; an unresolved one finds nothing and has confidence 0."""
    r = requests(items)
    found, results = flow.retrieve(r, chunks, vectors, query_vectors)
    x = items.join(results.withColumnRenamed("query_id", "__q"), F.col("id") == F.col("__q"), "left").drop("__q").join(flow.sources(found, chunks).withColumnRenamed("query_id", "__q"), F.col("id") == F.col("__q"), "left").drop("__q")
    no = lambda c, v: F.coalesce(c, F.lit(v))
    kind = "array<struct<source:string,page:int>>"
    actual = F.transform(F.coalesce("sources", F.array().cast(x.schema["sources"].dataType)), lambda s: F.struct(s["source"].alias("source"), s["page"].cast("int").alias("page"))).cast(kind)
    return x.select(*items.columns, no("confidence", 0.0).alias("confidence"), no("strong", False).alias("strong_keyword_hit"), no("used_full_document", False).alias("used_full_document"), actual.alias("retrieved_sources"), chat.source_recall(actual, F.col("expected_sources")).alias("source_scoring"))


def answers(items: DataFrame, replies: DataFrame) -> DataFrame:
    """Items with (query_id, answer, mode) from the chat flow and its generator; an unresolved one has an empty answer."""
    x = items.join(replies.select(F.col("query_id").alias("__q"), "answer", "mode"), F.col("id") == F.col("__q"), "left").drop("__q")
    x = x.withColumn("answer", F.when(F.col("resolved"), F.coalesce("answer", F.lit(""))).otherwise("")).withColumn("mode", F.when(F.col("resolved"), F.col("mode")).otherwise("unresolved"))
    return x.withColumn("answer_scoring", chat.point_recall(F.col("answer"), F.col("expected_answer_points"))).withColumn("answer_refusal_detected", I.mentions(F.col("answer"), I.REFUSAL))


def summary(items: DataFrame, scored: DataFrame | None = None, replied: DataFrame | None = None) -> DataFrame:
    """The one-row summary over retrieval scores, answer scores or both."""
    none: Column = F.lit(None).cast("double")
    x = items.select("id", "category", "resolved", F.coalesce("should_answer_from_docs", F.lit(True)).alias("should_answer"))
    x = x.join(scored.select("id", F.col("source_scoring.recall").alias("source_recall")), "id", "left") if scored is not None else x.withColumn("source_recall", none)
    x = x.join(replied.select("id", F.col("answer_scoring.recall").alias("answer_recall"), F.col("answer_refusal_detected").alias("refused")), "id", "left") if replied is not None else x.withColumn("answer_recall", none).withColumn("refused", F.lit(False))
    return chat.summary(x)


__all__ = ["answers", "chosen", "parsed", "problems", "registry", "requests", "retrieval", "summary", "value_counts"]
