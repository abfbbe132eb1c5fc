"""Requests from conversations, context for answers, and recall of benchmark answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions import text as T

HISTORY = 8
WHOLE_CATEGORIES = ("summary", "section_understanding")


def requests(messages: DataFrame) -> DataFrame:
    """conv_id, system, question, history of each conversation of (conv_id, turn, role, text).

    The last system text counts. A last message of the user is the question; if the assistant spoke last, the
    user's last text is, and stays in the history. The history is the last eight messages before. Ties in turn: the
    greater role, then the greater text counts as later. Null texts are empty. The rank limit applies before the
    shuffle, so a long conversation sends nine rows a task.
    """
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    last = m.where(F.col("role").isin("user", "assistant")).withColumn("r", F.row_number().over(late)).where(F.col("r") <= HISTORY + 1)
    kept = last.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "role", "text")))).alias("m"))
    per = m.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.struct("turn", "text")))["text"].alias("system"), F.max(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"].alias("__said"))
    x = per.join(kept, "conv_id", "left").withColumn("m", F.coalesce("m", F.array()))
    asks = F.coalesce(F.get("m", F.lit(0))["role"] == "user", F.lit(False))
    before = F.reverse(F.when(asks, F.slice("m", 2, HISTORY)).otherwise(F.slice("m", 1, HISTORY)))
    said = F.transform(before, lambda c: F.concat(F.lit("["), c["role"], F.lit("]\n"), c["text"]))
    question = F.when(asks, F.get("m", F.lit(0))["text"]).otherwise(F.coalesce("__said", F.lit("")))
    return x.select("conv_id", F.coalesce("system", F.lit("")).alias("system"), question.alias("question"), F.array_join(said, "\n\n").alias("history"))


def context_line(source: Column, page: Column, section: Column, lang: Column, text: Column) -> Column:
    """A chunk's text under a line of where it is from."""
    or_ = lambda c, d: F.coalesce(I.some(c.cast("string")), F.lit(d))
    return F.concat(F.lit("[Doc: "), or_(source, "unknown"), F.lit(" | Page: "), or_(page, "?"), F.lit(" | Section: "), or_(section, ""), F.lit(" | Lang: "), or_(lang, "unknown"), F.lit("]\n"), T.without_header(F.coalesce(text, F.lit(""))))


def context(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): the ranked chunks, each under a line of where it is from; chunks have chunk_key, source, page, section, lang, text."""
    line = context_line(*(F.col(c) for c in ("source", "page", "section", "lang", "text")))
    x = found.select("query_id", "chunk_key", "rank").join(chunks, "chunk_key").select("query_id", "rank", line.alias("line"))
    return x.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda c: c["line"]), "\n\n").alias("context"))


def normal(text: Column) -> Column:
    return T.normalized(F.coalesce(text, F.lit("")))


def point_recall(answer: Column, points: Column) -> Column:
    """Struct of total, hit, recall (three decimals, 1 without points), hits, misses."""
    said, points = normal(answer), F.coalesce(points, F.array().cast("array<string>"))
    has = lambda p: (normal(p) != "") & F.contains(said, normal(p))
    return _recall(points, F.filter(points, has), F.filter(points, lambda p: ~has(p)))


def source_recall(found: Column, expected: Column) -> Column:
    """As point_recall, of expected (source, page) among those found; a null page is any page."""
    hit = lambda e: F.exists(F.coalesce(found, F.array().cast("array<struct<source:string,page:int>>")), lambda f: F.coalesce(f["source"].eqNullSafe(e["source"]) & (e["page"].isNull() | (f["page"] == e["page"])), F.lit(False)))
    expected = F.coalesce(expected, F.array().cast("array<struct<source:string,page:int>>"))
    return _recall(expected, F.filter(expected, hit), F.filter(expected, lambda e: ~hit(e)))


def _recall(all_: Column, hits: Column, misses: Column) -> Column:
    n = F.size(all_)
    return F.struct(n.alias("total"), F.size(hits).alias("hit"), F.when(n == 0, 1.0).otherwise(F.round(F.size(hits) / n, 3)).alias("recall"), hits.alias("hits"), misses.alias("misses"))


def whole_document(category: Column, flag: Column) -> Column:
    return category.isin(*WHOLE_CATEGORIES) | F.coalesce(flag, F.lit(False))


def summary(results: DataFrame) -> DataFrame:
    """One row over (category, resolved, should_answer, answer_recall, source_recall, refused): counts, mean recalls (three decimals, null without any), refusals where no answer was due."""
    due = ~F.col("should_answer")
    per = results.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("resolved")).alias("u"), F.count_if(due).alias("neg"), F.count_if(due & F.col("refused")).alias("pass"), F.sum("answer_recall").alias("a"), F.count("answer_recall").alias("an"), F.sum("source_recall").alias("s"), F.count("source_recall").alias("sn"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda s, n: F.round(F.sum(s) / F.nullif(F.sum(n), F.lit(0)), 3)
    return per.agg(total("n").alias("total_rows"), total("u").alias("unresolved_document_scope_rows"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("unknown")), "n"))).alias("categories"), mean("a", "an").alias("avg_answer_point_recall"), mean("s", "sn").alias("avg_source_recall"), total("neg").alias("negative_case_count"), total("pass").alias("negative_case_refusal_pass"))
