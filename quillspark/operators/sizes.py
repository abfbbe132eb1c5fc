"""Joins whose small side is broadcast only after a check of its size, and sums that run on over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.snapshots import written

#: Rows of bounded width up to which a side is broadcast.
ROWS = 200_000


def fits(df: DataFrame, rows: int = ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows (counted here), else df itself, for a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def running(df: DataFrame, group: str, order: list[str], count: str, name: str) -> DataFrame:
    """df with ``name``: the sum of count over the rows of its group (null is one) before it in a total order.

    Rows are dealt over ranges of group and order, so that a group of any size is shared among tasks, and written with their range's number, so that it
    stays. A window runs inside each range; what a group has in earlier ranges is added from a row for each range that it goes on in, at most one a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(df.repartitionByRange(n, group, *order).withColumn("__p", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = x.groupBy("__p", group).agg(F.sum(count).alias("__sum")).withColumn("__before", F.sum("__sum").over(before)).where("__before is not null")
    per = per.select(F.col("__p").alias("__q"), F.col(group).alias("__group"), "__before")
    inside = Window.partitionBy("__p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    x = x.join(F.broadcast(per), (x["__p"] == per["__q"]) & x[group].eqNullSafe(per["__group"]), "left")
    return x.select(*df.columns, (F.col("__inside") + F.coalesce("__before", F.lit(0))).alias(name))
