"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share`` times all sizes; none gets more than
``most`` times its own size, and what it would is shared again by weight among the others. Documents: each is
expected target / source size times; the running sum of that along the source, plus one offset drawn
from the seed, crosses so many integers at each document, and it is taken as often. The order runs through size classes,
so that the words taken, and not only the documents, come near the target.

Nulls and edges: a null text has size 0, a null source is a source of its own. A source whose documents
are all empty has the target 0 and is not taken. Documents with equal ids in one source are ordered by size; equal rows
are each other's equals, so it does not matter which is taken more often. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ranked, running, small, text_of, word_count, written

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 20240607


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).randrange(1, 1 << 20) / (1 << 20)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target), one row per source.

    In the order of cap / weight, the capped sources come first. The rest share what those leave, by weight; the first
    source for which that stays within its cap ends the capped ones. Sources may be as many as documents: their places and
    running sums come from ranges (``running``), not from a window over all of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, [F.col("source").asc_nulls_last()], {"__place": F.lit(1).cast("long")})
    per = per.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = written(per.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__rate", F.col("__cap") / F.col("__w")))
    every = per.agg((F.sum("source_size") * F.lit(float(share))).alias("__all"), F.sum("__w").alias("__weights"))  # one row
    per = running(per, [F.col("__rate"), F.col("source").asc_nulls_last()], {"__caps": F.col("__cap"), "__ws": F.col("__w")}).crossJoin(F.broadcast(every))
    level = (F.col("__all") - (F.col("__caps") - F.col("__cap"))) / (F.col("__weights") - F.col("__ws") + F.col("__w"))
    per = per.withColumn("__level", level)
    # levels fall below cap / weight once and stay there; before that, a source is capped
    last = per.agg(F.max(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct(-F.col("__rate"), F.col("__level"))))["__level"].alias("__last"))  # one row
    per = per.crossJoin(F.broadcast(last))
    return per.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__last") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, extra: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies`` for each document; ``extra`` columns of docs go along."""
    sizes = written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text_of(docs)).alias("size"), *extra))
    goal = written(targets(sizes, weights, share, most))
    r = small(goal.withColumnRenamed("source", "__s"), 100_000)
    x = sizes.join(r, sizes["source"].eqNullSafe(F.col("__s"))).drop("__s")
    # documents of like size stand together: 8 classes to each doubling
    x = x.withColumn("__class", F.floor(8 * F.log2(F.col("size") + 1.0)).cast("int"))
    x = place(x)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda rank: F.floor(rank * rate + F.lit(offset(seed)))
    return x.withColumn("copies", (crossed(F.col("__rank")) - crossed(F.col("__rank") - 1)).cast("long")).drop("__class", "__rank")


def place(x: DataFrame) -> DataFrame:
    """Adds the document's place in its source, through the size classes in turn."""
    inside = ranked(x, ["source", "__class"], ["doc_id", "size"], "__in")
    per = x.groupBy("source", "__class").agg(F.count(F.lit(1)).alias("__n"))
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = small(per.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), "__before"), 100_000)
    return inside.join(per, inside["source"].eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))).withColumn("__rank", F.col("__in") + F.col("__before")).drop("__s", "__c", "__before", "__in")


def report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
