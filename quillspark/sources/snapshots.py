"""Tables in versions: data are written beside what is there, and a small numbered file then names what belongs to the new version.

A version's file comes by a rename that never replaces one, so of two writers from the same version one is first and the other
gets ``Conflict``, reads the new version and does its change again; what a run that died has written is named by no version. Readers keep the
version that they began with. On HDFS such a rename is atomic; a store without one needs a lock around ``commit``.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has made this version."""


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below ``spark.checkpoint.dir``, or for a local session without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-quill-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet in a new shared folder, for what reads them several times: plans stay short, and lost executors cost no lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and contents of the newest version; (0, {}) before the first."""
    fs, at = _files(spark, f"{root}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if not number:
        return 0, {}
    text = spark.read.text(f"{root}/versions/{number:010d}.json", wholetext=True).first()[0]
    return number, json.loads(text)


def commit(spark: SparkSession, root: str, number: int, contents: dict) -> None:
    """Makes contents version ``number`` or raises ``Conflict``."""
    fs, target = _files(spark, f"{root}/versions/{number:010d}.json")
    fs.mkdirs(target.getParent())
    _, draft = _files(spark, f"{root}/versions/.{number}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(contents, sort_keys=True).encode("utf-8")))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        context.rename(draft, target, options)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(f"version {number} of {root} is there") from error
        raise


def changed(spark: SparkSession, root: str, change: Callable[[dict], dict | None], tries: int = 10) -> tuple[int, dict]:
    """The version after ``change`` of the newest version's contents (None: nothing to do), done again on each conflict."""
    for _ in range(tries):
        number, contents = current(spark, root)
        new = change(contents)
        if new is None:
            return number, contents
        try:
            commit(spark, root, number + 1, new)
            return number + 1, new
        except Conflict:
            continue
    raise Conflict(f"{tries} tries at {root} met another writer's version")


def load(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version of a table of ``save``, or an empty one of this schema."""
    _, contents = current(spark, root)
    return spark.read.schema(StructType.fromJson(json.loads(contents["schema"]))).parquet(f"{root}/{contents['data']}") if contents else spark.createDataFrame([], schema)


def save(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Writes change(newest version, or an empty table of this schema) as the next version and returns its number; after a conflict it is worked out and written again."""

    def write(contents: dict) -> dict:
        old = spark.read.schema(StructType.fromJson(json.loads(contents["schema"]))).parquet(f"{root}/{contents['data']}") if contents else spark.createDataFrame([], schema)
        new, data = change(old), f"data-{uuid.uuid4().hex}"
        new.write.parquet(f"{root}/{data}")
        return {"data": data, "schema": new.schema.json()}

    return changed(spark, root, write)[0]
