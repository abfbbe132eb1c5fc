"""A watched folder as a stream of its listings, with what is known and what is kept quiet as state by name.

``post`` appends a listing of the folder to a log, ``suppress`` a name to be left alone for some seconds; ``fresh`` streams over the log and gives each file that the listing before had
not. So a name that was removed and put back is new again, the files of the first listing are not new, and a file listed while it is suppressed counts as
known. State is kept by Spark in the query's checkpoint; suppression ends by a timeout of the state, and so is a name forgotten that no listing has had for ``KEEP``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.files import folder

LOG = "name string, path string, listing long, quiet_until timestamp"
OUT = "name string, path string, listing long"
QUIET_SECONDS, KEEP = 90, 24 * 3600 * 1000


def last_listing(spark: SparkSession, log: str) -> int:
    """The number of the newest listing in the log; -1 before the first."""
    try:
        found = spark.read.schema(LOG).parquet(log).agg(F.max("listing")).first()[0]
    except AnalysisException:
        return -1
    return -1 if found is None else found


def post(spark: SparkSession, path: str, log: str) -> int:
    """Appends a listing of the folder (one poller for a log) and returns its number. Only what is there is listed; an empty folder gives a row without a name."""
    number = last_listing(spark, log) + 1
    try:
        files = folder(spark, path, content=False).select("name", "path")
    except AnalysisException:
        files = spark.createDataFrame([], "name string, path string")
    mark = spark.createDataFrame([(None, None)], "name string, path string")
    rows = files.unionByName(mark).withColumn("listing", F.lit(number).cast("long")).withColumn("quiet_until", F.lit(None).cast("timestamp"))
    rows.coalesce(1).write.mode("append").parquet(log)
    return number


def suppress(spark: SparkSession, log: str, name: str, seconds: float = QUIET_SECONDS) -> None:
    """From now on, and for so many seconds, a file of this name isn't given."""
    row = spark.createDataFrame([(name,)], "name string").select("name", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("listing"), F.expr(f"current_timestamp() + make_interval(0, 0, 0, 0, 0, 0, {float(seconds)})").alias("quiet_until"))
    row.coalesce(1).write.mode("append").parquet(log)


def told(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The files of one name that are new; state is the last listing that had it, and until when (milliseconds) it is quiet."""
    now = state.getCurrentProcessingTimeMs()
    before, until = state.get if state.exists else (-1, 0)
    if state.hasTimedOut:
        if until:  # the name may be given again; what was listed stays known
            state.update((before, 0))
            state.setTimeoutDuration(KEEP)
        else:
            state.remove()
        return
    x = pd.concat(rows)
    quiet, listed = x["quiet_until"].max(), x.dropna(subset=["listing"]).sort_values("listing")
    until = max(until, 0 if pd.isna(quiet) else int(quiet))
    found = []
    for listing, path in zip(listed["listing"].astype("int64"), listed["path"], strict=True):
        if listing > 0 and (before < 0 or before < listing - 1) and until <= now:
            found.append((key[0], path, listing))
        before = max(before, listing)
    state.update((int(before), int(until) if until > now else 0))
    state.setTimeoutDuration(int(until - now) if until > now else KEEP)
    if found:
        yield pd.DataFrame(found, columns=["name", "path", "listing"])


def fresh(spark: SparkSession, log: str) -> DataFrame:
    """(name, path, listing) of files that a listing has and the one before had not. For a trigger by time, or once: with ``availableNow`` Spark goes on with empty batches, as a timeout may still come."""
    rows = spark.readStream.schema(LOG).parquet(log).where(F.col("name").isNotNull())
    rows = rows.select("name", "path", F.col("listing").cast("double").alias("listing"), F.unix_millis("quiet_until").cast("double").alias("quiet_until"))
    return rows.groupBy("name").applyInPandasWithState(told, OUT, "seen long, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)
