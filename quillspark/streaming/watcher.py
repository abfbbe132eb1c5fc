"""A watched folder as a stream: new files of a known kind, less suppressed and already ingested names.

The source log in the checkpoint keeps a path from being read twice, also after a failure or a restart; a file that was
removed and comes back under its name is not read again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.sizes import small
from quillspark.sources.files import EXTENSIONS, FILE, GLOB, folder, named


def new_files(spark: SparkSession, path: str) -> DataFrame:
    return named(spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", GLOB).load(path)).where(F.col("extension").isin(*EXTENSIONS))


def wanted(files: DataFrame, known: DataFrame, suppressed: DataFrame, now: datetime) -> DataFrame:
    """Files whose name is neither in known (name) nor in suppressed (name, expires_at) with its time not over."""
    active = suppressed.where(F.col("expires_at") > F.lit(now)).select("name")
    return files.join(known.select("name"), "name", "left_anti").join(active, "name", "left_anti")


def there_at_first(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """(path) of the files that were there when the watch first started; kept beside the checkpoint, so that a restart goes on with what came since."""
    at = f"{checkpoint.rstrip('/')}-present"
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        folder(spark, path, content=False).select("path").write.parquet(at)
        return spark.read.parquet(at)


def watch(spark: SparkSession, path: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], known: Callable[[], DataFrame], suppressed: Callable[[], DataFrame], present: bool = False, settle: float = 1.0, every: str | None = "5 seconds") -> StreamingQuery:
    """Starts the stream; ``known`` and ``suppressed`` are asked anew at each batch. Files there at the first start are left out unless ``present``, whatever their times (one more than a week older than the newest is never seen: Spark's maxFileAge); each batch waits ``settle`` seconds before
    files are read, so that they are written to the end. ``every`` None takes what is there and ends."""
    old = None if present else there_at_first(spark, path, checkpoint)

    def batch(files: DataFrame, number: int) -> None:
        time.sleep(settle)
        files = files if old is None else files.join(small(old), "path", "left_anti")
        ingest(wanted(files, known(), suppressed(), datetime.now()), number)

    writer = new_files(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
