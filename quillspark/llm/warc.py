"""A deterministic sharded WARC writer, and its reader.

Records are sorted by (page id, hash of the payload's digest) over ranges of exact counts, one shard a range, so the shards too depend on
the rows alone; one page id with more rows than a shard is parted by that hash. A shard's task writes each file under a temporary name,
rolls to the next once the compressed bytes reach ``roll_bytes``, and renames each when complete; names depend on shard and
number alone, and bytes on the records, so that a task run again leaves the same files. The manifest, written last,
names what belongs to the archive; the reader goes by it and sees nothing else.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page id is a
response and the others revisit it. A record's id is made of page id, digest and the row's number among those that agree in both. Each record is a gzip member of its own, with headers and digests
made anew.

Nulls and edges: a null html is an empty payload; a null url becomes ``urn:page:<id>``; a null page id is written as id ``-`` and
read back as null; it is a response always. Equal rows stay in one shard, whose files roll as others do. Rows that repeat a page id and a payload are written each; the first in
order of url is the response, and the others revisit that id. An empty table gives no files and an empty result. Extra columns are ignored.

Files go to ``folder``, which driver and executors must share: a local path or ``file:`` URI, or any URI that
``pyarrow.fs`` opens.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bounds, hot_keys, looked_up, placed, scratch, shuffle_partitions, small, written

MIN_REVISIT = 1000
ROLL_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of (page, url, bytes, digest, length), and for those whose payload is met again (page, digest, id of the response).

    Payloads are compared by digest, on small rows; only those met more than once are joined back.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("__page"), pages["url"].cast("string").alias("__url"), html.alias("__html"))
    rows = rows.withColumns({"__digest": F.sha1("__html"), "__bytes": F.octet_length("__html").cast("long")})
    long = written(rows.where((F.col("__bytes") >= MIN_REVISIT) & F.col("__page").isNotNull()).select(F.col("__digest").alias("__d"), "__page"))
    met = written(long.groupBy("__d").agg(F.max("__page").alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    to = looked_up(long, met.drop("__n"), "__d", hot=hot_keys(long, "__d")).select(F.col("__page").alias("__p"), F.col("__d"), F.col("__last")).distinct()
    return rows, to


def header(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def named(page: int | None, digest: str, number: int) -> str:
    return f"<urn:page:{'-' if page is None else page}:{digest}:{number}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "-" else int(page)


def record(page: int | None, url: str | None, digest: str, number: int, size: int, to: int | None, html: bytes) -> bytes:
    name = "-" if page is None else page
    url = "".join(c for c in url or "" if c > " " and c != "\x7f") or f"urn:page:{name}"
    top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = top if to is not None else top + html
    fields = [("WARC-Record-ID", named(page, digest, number)), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}")]
    if to is not None:
        fields += [("WARC-Refers-To", named(to, digest, 0)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return header("revisit" if to is not None else "response", [*fields, ("Content-Type", "application/http;msgtype=response")], block)


class Shard:
    """The files of one shard, one open at a time."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.shard, self.roll, self.number, self.sink, self.done = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.name = f"part-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.sink, self.records, self.bytes, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            self.put(header("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"))
        self.put(data)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def put(self, data: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.sink.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.bytes, self.sum.hexdigest()))
            self.sink, self.number = None, self.number + 1


def write(pages: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES) -> str:
    """Writes the archive and its manifest; returns the folder, with ``manifest.parquet`` (file, records, bytes, sha1) inside."""
    spark = pages.sparkSession
    folder = folder or f"{scratch(spark)}/warc"
    rows, to = decide(pages)
    full = rows.select("__page", "__url", "__digest", "__bytes", F.lit(None).cast("long").alias("__to"), "__html", F.lit(1).alias("__kind"))
    told = to.select(F.col("__p").alias("__page"), F.lit(None).cast("string").alias("__url"), F.col("__d").alias("__digest"), F.lit(None).cast("long").alias("__bytes"), F.col("__last").alias("__to"), F.lit(None).cast("binary").alias("__html"), F.lit(0).alias("__kind"))
    # what is known of a page stands before it in its shard, so that payloads move once
    n = shuffle_partitions(spark)
    tie = F.xxhash64("__digest")
    edges = bounds(rows.select("__page", tie.alias("__tie")), "__page", "__tie", n)
    both = full.unionByName(told).withColumn("__tie", tie)
    both = both.repartitionById(max(n, len(edges) + 1), placed(F.col("__page"), F.col("__tie"), edges)).sortWithinPartitions("__page", "__tie", "__digest", "__kind", "__url").drop("__tie")
    spark.createDataFrame([(folder,)], "folder string").write.mode("overwrite").parquet(f"{folder}/_started")  # makes the folder, by Spark's own file system

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, last, number = Shard(folder, TaskContext.get().partitionId(), roll_bytes), None, None, 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for page, url, digest, size, to, html, kind in zip(*(c.to_pylist() for c in b.slice(at, 64).columns), strict=True):
                    if (page, digest) != key:
                        key, last, number = (page, digest), None, 0
                    if not kind:
                        last = to
                        continue
                    revisit = None if last is None or (page == last and not number) else last
                    shard.add(record(page, url, digest, number, size, revisit, html))
                    number += 1
        shard.close()
        if shard.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*shard.done, strict=True)], ["file", "records", "bytes", "sha1"])

    both.mapInArrow(work, "file string, records long, bytes long, sha1 string").write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return folder


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, one gzip member after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # bit by bit, since what is left over is copied
            if at >= len(view):
                raise ValueError("a record is cut short")
            parts.append(z.decompress(view[at : at + 16384]))
            at = min(at + 16384, len(view)) - len(z.unused_data)
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


def read(spark, folder: str) -> DataFrame:
    """Every record of the files that the manifest names: url, page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit). A payload or file that differs from its digest fails the job."""
    names = spark.read.parquet(f"{folder}/manifest.parquet")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(small(names.select("file", "sha1"), 100_000), "file")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, sha1 in zip(b.column("content"), b.column("sha1").to_pylist(), strict=True):
                data = content.as_buffer()
                if hashlib.sha1(data).hexdigest() != sha1:
                    raise ValueError("a file differs from its manifest")
                rows = []
                for fields, block in records(data):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    cut = block.index(b"\r\n\r\n") + 4
                    size = int(block[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    digest, to = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
                    payload = None if to else block[cut:]
                    if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError("a payload differs from its digest")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], to and page_of(to), payload))
                    if len(rows) == 256:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return found.select("content", "sha1").mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def pack(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names)


def report(pages: DataFrame) -> DataFrame:
    return read(pages.sparkSession, write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
