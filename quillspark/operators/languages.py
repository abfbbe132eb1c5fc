"""Languages of texts by character trigrams: log-probabilities fitted on a bounded sample of labelled texts, applied as a small broadcast table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SPACES, language, strip
from quillspark.operators.sizes import small
from quillspark.sources.snapshots import written

#: Texts that a model is fitted on at most (those with the least ``order``), characters of each that count, trigrams and languages that a model has.
SAMPLE, CHARS, GRAMS, LANGUAGES = 20_000, 300, 2_000, 60
LEAST = 10


def grams(text: Column) -> Column:
    """Trigrams of the beginning of a text, letters in lower case, white space as one space."""
    t = F.regexp_replace(F.lower(F.substring(strip(text), 1, CHARS)), SPACES + "+", " ")
    return F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.array(t), lambda u: F.transform(F.sequence(F.lit(1), F.greatest(F.length(u) - 2, F.lit(1))), lambda i: F.substr(u, i, F.lit(3))))[0])


def fit(texts: DataFrame, order: str, sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(gram, one column of log-probabilities a language) and the languages, from (text, lang, order): the ``GRAMS`` commonest trigrams, counts raised by one."""
    known = texts.where((F.coalesce("lang", F.lit("")) != "") & F.col("text").isNotNull())
    # the order's own values tell the last one taken, so that texts don't move; only texts that share it are put in order (nulls come first)
    first = written(known.select(order).orderBy(order).limit(sample))
    cut = F.lit(first.agg(F.max(order)).first()[0]).cast(known.schema[order].dataType)
    before = cut.isNotNull() & (F.col(order).isNull() | (F.col(order) < cut))
    left = sample - first.where(before).count()
    some = known.where(before).select("text", "lang").unionByName(known.where(F.col(order).eqNullSafe(cut)).select("text", "lang").orderBy("text").limit(left))
    counts = some.select("lang", F.explode(grams(F.col("text"))).alias("gram")).groupBy("gram", "lang").agg(F.count(F.lit(1)).alias("n"))
    names = [r[0] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang").collect()]
    names.sort()
    wide = counts.groupBy("gram").agg(F.sum("n").alias("__n"), *[F.coalesce(F.sum(F.when(F.col("lang") == v, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, v in enumerate(names)])
    top = wide.orderBy(F.desc("__n"), "gram").limit(GRAMS)
    totals = top.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{k}").alias(f"t{k}") for k in range(len(names))])  # one row
    x = top.crossJoin(F.broadcast(totals))
    return x.select("gram", *[F.log((F.col(f"n{k}") + 1) / (F.col(f"t{k}") + F.col("v"))).alias(f"w{k}") for k in range(len(names))]), names


def detected(pages: DataFrame, model: tuple[DataFrame, list[str]], name: str = "language") -> DataFrame:
    """pages (text, ...) with their language: ``ko`` by its rule first, ``unknown`` below ten characters or without a known trigram, else the likeliest (ties: the first by name).

    A text's trigrams are added up by the text's beginning where they arise; equal beginnings are judged once.
    """
    table, names = model
    head = F.substring(strip(F.coalesce(F.col("text").cast("string"), F.lit(""))), 1, CHARS)
    x = pages.withColumn("__head", head)
    heads = x.where((F.length("__head") >= LEAST) & (language(F.col("__head")) != "ko")).select("__head").distinct()
    sums = heads.select("__head", F.explode(grams(F.col("__head"))).alias("gram")).join(small(table), "gram").groupBy("__head").agg(*[F.round(F.sum(f"w{k}"), 6).alias(f"w{k}") for k in range(len(names))])
    best = F.greatest(*[F.col(f"w{k}") for k in range(len(names))]) if len(names) > 1 else F.col("w0")
    which = reduce(lambda rest, k: F.when(F.col(f"w{k}") == best, names[k]).otherwise(rest), reversed(range(len(names))), F.lit("unknown")) if names else F.lit("unknown")
    told = sums.select(F.col("__head").alias("__h"), which.alias("__language"))
    rule = language(F.col("__head"))
    return x.join(told, F.col("__head") == F.col("__h"), "left").withColumn(name, F.when(rule == "ko", rule).otherwise(F.coalesce("__language", F.lit("unknown")))).drop("__head", "__h", "__language")
