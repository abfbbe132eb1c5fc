"""Chunks of pages: sections by heading, tables apart, paragraphs grouped, long pieces split at the best separator.

Headings, tables and paragraphs are Column code: matches are set off by marks (control characters, which texts lose first) and the text is split
at these; pieces over ``SIZE`` are split by folds over arrays of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SPACES, context_header, strip
from quillspark.operators.sizes import fits, running
from quillspark.sources.snapshots import written

SIZE, OVERLAP, TABLE_CHARS = 1200, 150, 50
#: Fixed values.
HEADING = rf"(?md)^(#{{1,4}}){SPACES}+(.+)$"
TABLE_ROW = rf"(?md)^[|].*[|]{SPACES}*\n?"
SEPARATORS = ["\n\n", "\n", "다. ", "요. ", "다.\n", "요.\n", ". ", "? ", "! ", " "]
LEVELS = 4
MARKS = "\x01\x02\x03\x04\x05\x06"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit("[^" + SPACES[1:]))


def sections(text: Column) -> Column:
    """Array of (title, breadcrumb, body); text before the first heading has neither title nor breadcrumb, and a page without headings is one such section."""
    marked = F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, HEADING, "\x01$1\x02$2\x03")).otherwise(text)
    return _let(F.split(marked, "\x01"), _sections)


def _sections(parts: Column) -> Column:
    headed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.length(F.substring_index(p, "\x02", 1)).alias("level"), strip(F.substring_index(F.substring_index(p, "\x03", 1), "\x02", -1)).alias("title"), F.regexp_extract(p, "(?s)\x03(.*)", 1).alias("body")))
    slots = [F.lit(None).cast("string").alias(f"h{i}") for i in range(1, LEVELS + 1)]
    row = "array<struct<title:string,breadcrumb:string,body:string>>"

    def step(acc: Column, p: Column) -> Column:
        # a heading voids those of its own and deeper levels
        now = [F.when(p["level"] == i, p["title"]).when(p["level"] > i, acc[f"h{i}"]).alias(f"h{i}") for i in range(1, LEVELS + 1)]
        one = F.struct(p["title"].alias("title"), F.concat_ws(" > ", *now).alias("breadcrumb"), p["body"].alias("body"))
        return F.struct(*now, F.concat(acc["out"], F.array(one)).alias("out"))

    first = F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("breadcrumb"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("body"))).cast(row)
    return F.aggregate(headed, F.struct(*slots, first.alias("out")), step, lambda acc: acc["out"])


def tables(text: Column) -> Column:
    """Struct of ``found``, the tables (two rows or more) of over 50 characters, and ``left``, the text with a blank line for each table if any is that long, else the whole."""
    rows = F.when(F.contains(text, F.lit("|")), F.regexp_replace(text, TABLE_ROW, "\x04$0\x05")).otherwise(text)
    runs = F.replace(rows, F.lit("\x05\x04"), F.lit("\x06"))
    return _let(F.split(runs, "[\x04\x05]"), lambda parts: _tables(text, parts))


def _tables(text: Column, parts: Column) -> Column:
    """Runs of rows have odd places."""
    table = lambda p, i: (i % 2 == 1) & F.contains(p, F.lit("\x06"))
    bare = lambda p: F.replace(p, F.lit("\x06"), F.lit(""))
    long = F.filter(F.transform(F.filter(parts, table), lambda p: strip(bare(p))), lambda p: F.length(p) > TABLE_CHARS)
    rest = strip(F.array_join(F.transform(parts, lambda p, i: F.when(table(p, i), F.lit("\n\n")).otherwise(p)), ""))
    return _let(long, lambda found: F.struct(found.alias("found"), F.when(F.size(found) > 0, rest).otherwise(text).alias("left")))


def grouped(text: Column, size: int = SIZE) -> Column:
    """Paragraphs joined while their lengths together stay within size."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{SPACES}*\n"), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["now"].isNotNull() & (acc["n"] + F.length(p) > size)
        out = F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
        now = F.when(full | acc["now"].isNull(), p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(out.alias("out"), now.alias("now"), F.when(full, F.length(p)).otherwise(acc["n"] + F.length(p)).alias("n"))

    return F.aggregate(paragraphs, start, step, lambda acc: F.concat(acc["out"], F.filter(F.array(acc["now"]), lambda x: x.isNotNull())))


_OPEN = "array<struct<open:boolean,t:string>>"


def _joined(parts: Column, size: int, overlap: int) -> Column:
    """Array of (open, t): parts joined while they stay within size. A chunk starts with the last whole parts of the one before it, as far as overlap lets them. Parts of ``size`` or more stay open."""

    def closed(acc: Column) -> Column:
        t = strip(F.array_join(F.slice(parts, acc["first"] + 1, acc["k"] - acc["first"]), ""))
        return F.filter(F.array(F.struct(F.lit(False).alias("open"), t.alias("t"))), lambda x: x["t"] != "")

    def state(out: Column, first: Column, k: Column, total: Column) -> Column:
        return F.struct(out.alias("out"), first.alias("first"), k.alias("k"), total.alias("total"))

    def after(acc: Column, room: Column) -> Column:
        """(left, gone): the characters and the number of parts that a chunk leaves to the next and drops."""
        drop = lambda x, h: F.when(x["left"] > room, F.struct((x["left"] - F.length(h)).alias("left"), (x["gone"] + 1).alias("gone"))).otherwise(x)
        return F.aggregate(F.slice(parts, acc["first"] + 1, acc["k"] - acc["first"]), F.struct(acc["total"].alias("left"), F.lit(0).alias("gone")), drop)

    def step(acc: Column, p: Column) -> Column:
        n, next_ = F.length(p), acc["k"] + 1
        long = state(F.concat(acc["out"], closed(acc), F.array(F.struct(F.lit(True).alias("open"), p.alias("t")))), next_, next_, F.lit(0))
        full = _let(after(acc, F.least(F.lit(overlap), size - n)), lambda d: state(F.concat(acc["out"], closed(acc)), acc["first"] + d["gone"], next_, d["left"] + n))
        return F.when(n >= size, long).when((acc["total"] > 0) & (acc["total"] + n > size), full).otherwise(state(acc["out"], acc["first"], next_, acc["total"] + n))

    start = state(F.array().cast(_OPEN), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], closed(acc)))


def _cut(text: Column, separator: Column, size: int, overlap: int) -> Column:
    parts = F.filter(F.split(F.replace(text, separator, F.concat(F.lit("\x01"), separator)), "\x01"), lambda p: p != "")
    return _let(parts, lambda ps: _joined(ps, size, overlap))


def _by_length(text: Column, size: int, overlap: int) -> Column:
    """The text in pieces of ``size`` characters, each ``size - overlap`` after the one before."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size - overlap}}}"), F.lit(0))
    return _let(runs, lambda r: F.filter(F.transform(r, lambda x, i: F.when((i > 0) & (i == F.size(r) - 1) & (F.length(x) <= overlap), "").otherwise(strip(F.concat(x, F.coalesce(F.left(F.get(r, i + 1), F.lit(overlap)), F.lit("")))))), lambda x: x != ""))


def split(text: Column, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] = SEPARATORS) -> Column:
    """Array of pieces of at most ``size`` characters, cut at the first separator that the text has; what is still too long is cut at the next ones, by a fold over the separators, and at last by length. The text has lost ``MARKS`` before; overlap is at most half of size."""
    whole = F.array(F.struct(F.lit(True).alias("open"), text.alias("t"))).cast(_OPEN)
    at = lambda x, separator: F.flatten(F.transform(x, lambda p: F.when(p["open"] & F.contains(p["t"], separator), _cut(p["t"], separator, size, overlap)).otherwise(F.array(p))))
    cut = F.aggregate(F.array(*[F.lit(s) for s in separators]), whole, at)
    return F.flatten(F.transform(cut, lambda p: F.when(p["open"], _by_length(p["t"], size, overlap)).otherwise(F.array(p["t"]))))


def pieces(text: Column, given: Column) -> Column:
    """Array of (section, breadcrumb, chunk_type, text): a page's chunks in order. A section without text gives none; a page without headings has ``given`` as section."""
    row = "array<struct<section:string,breadcrumb:string,chunk_type:string,text:string>>"

    def chunks(section: Column, headed: Column, t: Column) -> Column:
        title, crumb = F.when(headed, section["title"]).otherwise(given), section["breadcrumb"]
        whole = F.length(t["left"]) <= SIZE
        left = F.when(_blank(t["left"]), F.array().cast("array<string>")).when(whole, F.array(t["left"])).otherwise(grouped(t["left"]))
        kind = F.when(~whole, "paragraph").when(headed, "section").otherwise("page")
        typed = lambda texts, kind: F.transform(texts, lambda x: F.struct(title.alias("section"), crumb.alias("breadcrumb"), kind.alias("chunk_type"), x.alias("text")))
        return F.concat(typed(t["found"], F.lit("table")), typed(left, kind))

    def section(s: Column, headed: Column) -> Column:
        body = F.when(headed, strip(s["body"])).otherwise(s["body"])
        return _let(body, lambda b: F.when(_blank(b), F.array().cast(row)).otherwise(_let(tables(b), lambda t: chunks(s, headed, t))))

    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARKS, "")
    found = _let(_let(clean, sections), lambda all_: F.flatten(F.transform(all_, lambda s: section(s, F.size(all_) > 1))))
    parts = lambda c: F.when(F.length(c["text"]) > SIZE, F.transform(split(c["text"]), lambda x: F.struct(c["section"].alias("section"), c["breadcrumb"].alias("breadcrumb"), c["chunk_type"].alias("chunk_type"), x.alias("text")))).otherwise(F.array(c))
    return F.flatten(F.transform(found, parts))


#: Columns that a chunk has of its own; all others of its page may go along.
OWN = ("doc_id", "page", "chunk_index", "chunk_id", "chunk_chars", "section", "breadcrumb", "chunk_type", "text")


def chunk(pages: DataFrame, page: str | None = None, along: list[str] = ()) -> DataFrame:
    """doc_id, page, chunk_index (from 0, running on over a document's pages), chunk_id, chunk_chars, section, breadcrumb, chunk_type, text, and the page's columns ``along``.

    Ids of documents keep their type. Null text is empty and gives no chunks; without a page column each row is page 1. Pages come by number, null first, equal numbers one after the other in order of a hash of what they hold.
    Ids follow from document, page and number, so that reruns agree. Pages are written once with their chunks; counts alone are added up (``running``), and a page's first number comes back to it.
    """
    number = pages[page].cast("long") if page else F.lit(1).cast("long")
    given = F.coalesce(pages["section_title"].cast("string"), F.lit("")) if "section_title" in pages.columns else F.lit("")
    x = pages.select(pages["doc_id"], number.alias("page"), *[pages[c] for c in along], pieces(pages["text"], given).alias("__chunks"))
    tie = F.xxhash64("__chunks", *[F.col(c).cast("string") for c in along])
    x = x.withColumns({"__n": F.size("__chunks").cast("long"), "__tie": tie, "__row": F.monotonically_increasing_id()})
    x = written(x)
    first = running(x.select("doc_id", "page", "__tie", "__row", "__n"), "doc_id", ["page", "__tie", "__row"], "__n", "__first").select("__row", "__first")
    x = x.join(F.broadcast(first) if fits(first) else first.hint("shuffle_hash"), "__row")
    x = x.select("doc_id", "page", *along, "__first", F.posexplode("__chunks").alias("__k", "__chunk")).withColumn("chunk_index", F.col("__first") + F.col("__k"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("page").cast("string"), F.lit("-")), "chunk_index"), 256)
    return x.select("doc_id", "page", "chunk_index", F.substring(key, 1, 32).alias("chunk_id"), F.length("__chunk.text").alias("chunk_chars"), "__chunk.section", "__chunk.breadcrumb", "__chunk.chunk_type", "__chunk.text", *along)


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks (source, page, lang, section, breadcrumb, text) with ``context_header``, that header in front of the text, and the breadcrumb, if there is one, as section."""
    titled = F.coalesce(F.when(F.col("breadcrumb") != "", F.col("breadcrumb")), F.col("section"))
    x = chunks.withColumn("section", titled).withColumn("context_header", context_header(F.col("source"), F.col("section"), F.col("page"), F.col("lang")))
    return x.withColumn("text", F.concat("context_header", F.lit("\n"), F.coalesce("text", F.lit(""))))


def average_header(chunks: DataFrame) -> DataFrame:
    """One row: the mean length of the headers, rounded down; 0 without chunks."""
    return chunks.agg(F.expr("coalesce(sum(length(context_header)), 0) div greatest(count(*), 1)").alias("average_header"))


def chunk_key(chunk_id: Column, doc_id: Column, source: Column, page: Column, index: Column) -> Column:
    """A chunk's id, or document (else source), page and number."""
    some = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.coalesce(some(chunk_id), F.concat_ws("::", F.coalesce(some(doc_id), text(source)), text(page), text(index)))
