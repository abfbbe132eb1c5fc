"""Spark helpers that the corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^ \x09-\x0D]+"
SPACE = r"[ \x09-\x0D]+"
#: Rows that one key may have before its lookup row is broadcast instead of shuffled to.
HOT = 50_000
_written: dict[str, list[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in the one all executors share, ``spark.checkpoint.dir``. Where that is unset, a local run gets a folder of its own, and any other an error: executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-quill-"))
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/quill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder: cuts lineage, and what follows reads it as often as it likes. ``discard`` removes it."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Removes all tables that ``written`` has made in this application, and tells how many; for callers that have read their results."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted here), else df itself, for a shuffled join. For rows of bounded width; dear ones are ``written`` before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The values of key that more than ``HOT`` rows have; there are at most rows / HOT of them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT).select(key)


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined on key with a table of one row a key, where a key may have any share of the rows.

    The table's rows of the hot keys (``hot_keys`` unless given) are broadcast, all else is joined by a shuffle that no key overfills.
    """
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot.limit(1).count():
        return rows.join(table, key, how)
    hot = written(hot)
    most = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    return most.join(F.broadcast(hot), key, "left_semi").unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def fetched(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", limit: int = 100_000) -> DataFrame:
    """rows joined on key with a written table of one short row a key: broadcast where it has at most ``limit`` rows, else ``looked_up``."""
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, how)
    return looked_up(rows, table, key, how)


#: Decisions packed into one row, and packed rows (4 KB each) up to which they are broadcast: 64 MB, for 67 million rows.
DECISIONS, PACKED = 4096, 16_384


def numbered_rows(df: DataFrame) -> DataFrame:
    """df, written, with ``__row``: numbers that no two rows share, without gaps in what a task wrote."""
    return written(df.withColumn("__row", F.monotonically_increasing_id()))


def with_decision(rows: DataFrame, decisions: DataFrame, name: str) -> DataFrame:
    """Rows of ``numbered_rows`` with a small number from decisions (``__row``, name), which has one for each row. A byte a row moves, and no text, as long as the packed decisions can be broadcast."""
    per = decisions.select(F.expr(f"__row div {DECISIONS}").alias("__block"), F.struct("__row", F.col(name).cast("byte").alias("v")).alias("d"))
    per = written(per.groupBy("__block").agg(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["v"]).alias("__values")))
    x = rows.withColumn("__block", F.expr(f"__row div {DECISIONS}")).join(small(per, PACKED), "__block")
    return x.withColumn(name, F.get("__values", (F.col("__row") % DECISIONS).cast("int"))).drop("__block", "__values")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body names it, whatever the optimizer merges."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    return F.array_remove(F.split(text, SPACE), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: each word with the space around it becomes one character."""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, r"[ \x09-\x0D]*[^ \x09-\x0D]+[ \x09-\x0D]*", "x"))).otherwise(0).cast("long")


#: A prime; ids are multiplied modulo it, so that ids in steps spread over blocks (plain arithmetic, which SQL can repeat).
PRIME = 2147483647


def scrambled(first: Column, second: Column) -> Column:
    part = lambda c, by: F.pmod(F.coalesce(c, F.lit(0)).cast("long"), F.lit(PRIME)) * by
    return F.pmod(part(first, 48271) + part(second, 69621), F.lit(PRIME))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, rows: int = 1000) -> DataFrame:
    """Adds ``name``: the row's place (from 1) in its group, in the order (block, *order), where a group is dealt over blocks by its two order columns (longs, null as 0) scrambled.

    A group's blocks are counted first; ranks inside a block come from a window over that block
    alone and start after the counts of the blocks before it. So a task gets about ``rows`` rows of a group, however large
    the group is, unless more rows than that agree in both columns.
    """
    blocks, block, before, sizes = "__blocks", "__block", "__before", "__size"
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias(sizes)).withColumn(blocks, F.ceil(F.col(sizes) / rows)).select(*group, blocks)
    on = [df[g].eqNullSafe(counts[g]) for g in group]
    dealt = df.join(small(counts, 100_000), on).select(df["*"], counts[blocks]).withColumn(block, F.pmod(scrambled(F.col(order[0]), F.col(order[1])), F.col(blocks)))
    per = dealt.groupBy(*group, block).agg(F.count(F.lit(1)).alias(sizes))
    per = per.withColumn(before, F.sum(sizes).over(Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))).select(*group, block, F.coalesce(F.col(before), F.lit(0)).alias(before))
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*group, block).orderBy(*[F.col(c).asc_nulls_first() for c in order])))
    on = [inside[g].eqNullSafe(per[g]) for g in group] + [inside[block] == per[block]]
    return inside.join(small(per, 100_000), on).select(*[inside[c] for c in df.columns], (inside[name] + per[before]).cast("long").alias(name))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (columns of ``sums`` by their new names), the row itself included, in a total order, without a window over all rows in one task.

    Rows are dealt over ranges and written with their range's number, so that it stays; a window runs inside each range, and one
    over the ranges' totals, a row for each shuffle partition.
    """
    n = shuffle_partitions(df.sparkSession)
    x = written(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    per = x.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__t_{k}") for k in sums])
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.select("*", *[F.sum(c).over(inside).alias(f"__i_{k}") for k, c in sums.items()]).join(F.broadcast(per), "__p")  # a row a partition
    return x.select(*df.columns, *[(F.col(f"__i_{k}") + F.col(f"__t_{k}")).alias(k) for k in sums])


NONE, LAST = -(1 << 63), (1 << 63) - 1
STEPS = 4096


def bounds(df: DataFrame, name: str, tie: str, n: int) -> list[tuple[int, int]]:
    """Ascending pairs of values of two long columns that part the rows into about n ranges; null counts as the least long.

    The edges follow from exact counts over equal steps of the values, and again over steps of those that hold more than their
    share, so they do not depend on how the input is split. A single value of ``name`` that holds more than its share
    is parted by ``tie``, a hash. At most ``STEPS`` counts a round reach the driver.
    """
    x = df.select(F.coalesce(F.col(name), F.lit(NONE)).alias("v"), F.col(tie).alias("t"))
    low, high, total = x.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not total or n < 2:
        return []
    share, edges = math.ceil(total / n), {low: total}  # start of each piece: its rows
    ends = {low: high + 1}
    while True:
        wide = [v for v, c in edges.items() if c > share and ends[v] - v > 1]
        if not wide:
            break
        each = max(2, STEPS // len(wide))
        for v in wide:
            step = max(1, -(-(ends[v] - v) // each))
            cut = list(range(v, ends[v], step))
            ends.update(zip(cut, [*cut[1:], ends[v]], strict=True))
        starts = sorted(ends)
        counts = x.groupBy(placed(F.col("v"), F.lit(0).cast("long"), [(v, NONE) for v in starts[1:]]).alias("k")).count().collect()
        edges = {starts[k]: c for k, c in counts}
        # pieces without rows are left out, and neighbours that fit into one share become one
        kept, until, held = {}, {}, None
        for v in sorted(edges):
            if held is not None and kept[held] + edges[v] <= share:
                kept[held] += edges[v]
            else:
                kept[v], held = edges[v], v
            until[held] = ends[v]
        edges, ends = kept, until
    found = []
    for v in sorted(edges):
        parts = min(n, math.ceil(edges[v] / share)) if ends[v] - v == 1 else 1
        found += [(v, NONE + (2**64 // parts) * k) for k in range(parts)]
    return found[1:]


def placed(value: Column, tie: Column, edges: list[tuple[int, int]]) -> Column:
    """Which of the ranges between the edges a pair of longs belongs to, from 0; a null value counts as the least long."""
    first, second = np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series, t: pd.Series) -> pd.Series:
        x, t = x.to_numpy(np.int64), t.to_numpy(np.int64)
        low, high = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        for v in np.unique(x[high > low]):
            a, b = np.searchsorted(first, v, "left"), np.searchsorted(first, v, "right")
            own = x == v
            low[own] = a + np.searchsorted(second[a:b], t[own], "right")
        return pd.Series(low.astype(np.int32))

    return place(F.coalesce(value, F.lit(NONE)), tie)
