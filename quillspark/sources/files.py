"""Folders of files, JSON lines and their sinks as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.text import strip
from quillspark.operators.sizes import small

IMAGES = ("png", "jpg", "jpeg", "webp")
EXTENSIONS = ("pdf", *IMAGES)
FILE = "path string, modificationTime timestamp, length long, content binary"


def named(files: DataFrame) -> DataFrame:
    """Adds name, extension and is_image to rows of the binaryFile source."""
    x = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    x = x.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    return x.withColumn("is_image", F.col("extension").isin(*IMAGES))


#: Glob of the known extensions in any case, so that no other file is opened.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS) + "}"


def folder(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The files of a folder with a known extension, subfolders left out, with the id of each by its checksum. Without content only their listing is read."""
    x = named(spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path)).where(F.col("extension").isin(*EXTENSIONS))
    return x.withColumn("file_id", file_id(F.col("name"), F.col("content"))) if content else x.drop("content")


def in_order(files: DataFrame) -> DataFrame:
    """Documents before images, each by path."""
    return files.orderBy("is_image", "path")


def file_id(name: Column, content: Column) -> Column:
    """Stem and the first 12 hex digits of the SHA-256."""
    return F.concat_ws("-", F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.substring(F.sha2(content, 256), 1, 12))


def source_type(path: Column, library: str, uploads: str) -> Column:
    inside = lambda d: path.startswith(d.rstrip("/") + "/")
    return F.when(inside(library), "library").when(inside(uploads), "upload").otherwise("external")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _line_no, line) of text files, numbered from 1 in each file. Files are read in splits: lines are counted for each, and a line's number is its place there plus the counts of the splits before."""
    at = "_metadata.file_path", "_metadata.file_block_start"
    x = spark.read.option("lineSep", "\n").text(path).select(F.col(at[0]).alias("file"), F.col(at[1]).alias("__start"), F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("__id"))
    per = x.groupBy("file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return x.join(small(per), ["file", "__start"]).select("file", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("_line_no"), "line")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of JSON-lines files with ``_line_no`` (from 1 in each file, blank lines counted but left out) and ``_corrupt`` (the text of a line that is not JSON of this schema)."""
    fields = spark.createDataFrame([], schema).schema
    parsed = F.from_json("line", fields.add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return numbered_lines(spark, path).where(strip(F.col("line")) != "").select("_line_no", parsed.alias("r")).select("_line_no", "r.*")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
