"""Page layout: headings by font, page kinds, page text, choice among extraction candidates. JVM-side, but for the passes that count and squeeze whole pages.

``blocks`` is ARRAY<STRUCT<type INT, bbox ARRAY<DOUBLE>, lines ARRAY<STRUCT<spans ARRAY<STRUCT<text STRING, size DOUBLE>>>>>>;
type 0 is text, 1 an image, others are ignored. A null array is a page without blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import passes
from quillspark.functions import text as T
from quillspark.sources.snapshots import written

HEADING_CHARS, LARGE, RATIO, SMALL_RATIO = 120, 16.0, 1.4, 1.18
#: Ends that no heading has.
SENTENCE_END = "(?:[.?!;:]|다|요)$"
LINE_END = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
TEXT_MARGIN = 18.0


def split_lines(text: Column) -> Column:
    """Lines; a text whose only line ends are line feeds, as most have, is split without a pattern."""
    return F.when(F.rlike(text, F.lit(r"[\x0B-\x1E\x7F-\uFFFF&&[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]]")), F.split(text, LINE_END)).otherwise(F.split(text, "\n"))


def squeezed(text: Column) -> Column:
    """Spaces inside lines become one, lines are stripped, at most one blank line in a row stays."""
    lines = F.transform(split_lines(text), lambda s: T.strip(F.regexp_replace(s, f"(?: (?={T.SPACE})|{T.SPACE}(?<! )){T.SPACE}*", " ")))
    return T.strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def is_heading(text: Column, n_lines: Column, top: Column, page_average: Column, page_top: Column) -> Column:
    """Short text in a font that is large, or large for its page."""
    average = F.greatest(page_average, F.lit(1.0))
    gap = F.greatest(page_top - average, F.lit(0.0))
    shape = (text != "") & (F.length(text) <= HEADING_CHARS) & (n_lines <= 3) & ~text.rlike(SENTENCE_END)
    size = (top >= LARGE) | (top >= RATIO * average) | ((gap >= 0.8) & (top >= SMALL_RATIO * average))
    return shape & ~((gap < 0.5) & (top < LARGE)) & size


def block_type(text: Column, heading: Column) -> Column:
    t = T.strip(text)
    return F.when(t == "", "empty").when(heading, "heading").when(t.rlike(rf"\A([-*•]|[0-9]+[.)]){T.SPACES}+"), "list").when((F.length(t) - F.length(F.replace(t, F.lit("\n"))) >= 3) & t.rlike(rf"[^{T.SPACES[1:-1]}]{T.SPACES}{{3,}}[^{T.SPACES[1:-1]}]"), "table").otherwise("paragraph")


def heading_guesses(text: Column) -> Column:
    """The first three lines that could be headings, of text without layout."""
    lines = F.transform(split_lines(text), T.strip)
    return F.slice(F.filter(lines, lambda s: (s != "") & (F.length(s) <= HEADING_CHARS) & ~s.rlike("(?:[.?!;]|다|요)$")), 1, 3)


#: A block at least this share of its page's width ends what stands beside each other above it; columns are this far apart.
SPANNING, GAP = 0.6, 1.0


def by_rows(blocks: Column) -> Column:
    """Blocks by their lower edge, then their left one; those without a box come last, as given."""
    side = lambda b, k: F.get(b["bbox"], F.lit(k))
    keyed = F.transform(blocks, lambda b, i: F.struct(side(b, 3).isNull().alias("none"), side(b, 3).alias("bottom"), side(b, 0).alias("left"), i.alias("i"), b.alias("b")))
    return F.transform(sorted_by(keyed, "none", "bottom", "left", "i"), lambda k: k["b"])


def sorted_by(keyed: Column, *names: str) -> Column:
    """An array of structs in the order of some of their fields (their maps and arrays needn't be orderable)."""
    order = F.transform(F.array_sort(F.transform(keyed, lambda k, j: F.struct(*[k[n].alias(n) for n in names], j.alias("j")))), lambda o: o["j"])
    return F.transform(order, lambda j: F.get(keyed, j))


def by_columns(blocks: Column) -> Column:
    """Blocks in reading order: bands between blocks that span the page, in each band columns from left to right, in each column from top to bottom.

    A column begins where, of a band's blocks from the left on, none before reaches so far. Blocks without a box come last, as given.
    """
    side = lambda b, k: F.get(b["bbox"], F.lit(k))
    boxed = F.filter(blocks, lambda b: side(b, 3).isNotNull())
    rest = F.filter(blocks, lambda b: side(b, 3).isNull())
    width = F.array_max(F.transform(boxed, lambda b: side(b, 2))) - F.array_min(F.transform(boxed, lambda b: side(b, 0)))
    keyed = F.transform(boxed, lambda b, i: F.struct(side(b, 1).alias("top"), side(b, 0).alias("left"), side(b, 2).alias("right"), (side(b, 2) - side(b, 0) >= SPANNING * width).alias("spans"), i.alias("i"), b.alias("b")))

    def given(k: Column) -> Column:
        """Numbers the bands: a spanning block is one of its own."""
        placed = sorted_by(k, "top", "left", "i")
        before = lambda x: F.filter(placed, lambda y: y["spans"] & ((y["top"] < x["top"]) | ((y["top"] == x["top"]) & (y["i"] < x["i"]))))
        return F.transform(placed, lambda x: x.withField("band", 2 * F.size(before(x)) + F.when(x["spans"], 1).otherwise(0)))

    def columned(k: Column) -> Column:
        """Numbers the columns: blocks of the band wholly left of this one's left edge whose right edges no other block there bridges."""
        starts = F.filter(k, lambda x: ~F.exists(k, lambda y: (y["band"] == x["band"]) & (y["left"] < x["left"]) & (y["right"] > x["left"] - GAP)))
        return F.transform(k, lambda x: x.withField("column", F.size(F.array_distinct(F.transform(F.filter(starts, lambda s: (s["band"] == x["band"]) & (s["left"] <= x["left"])), lambda s: s["left"])))))

    once = lambda value, body: F.transform(F.array(value), body)[0]
    ordered = once(keyed, lambda k: once(given(k), lambda g: once(columned(g), lambda c: F.transform(sorted_by(c, "band", "column", "top", "left", "i"), lambda x: x["b"]))))
    return F.concat(ordered, rest)


def analyse(pages: DataFrame) -> DataFrame:
    """Adds n_images, n_texts, n_tables, headings, heading_box (of the first), block_types (sorted, comma-joined), font_average, font_top, kind and text to (doc_id, page, blocks). Blocks are in reading order."""
    spans = lambda b: F.flatten(F.transform(F.coalesce(b["lines"], F.array()), lambda x: x["spans"]))
    sizes = lambda s: F.filter(F.transform(s, lambda x: x["size"]), lambda v: v != 0)  # noqa: E731 - null and 0 say nothing
    said = lambda b: F.filter(F.transform(b["lines"], lambda line: T.strip(F.array_join(F.transform(line["spans"], lambda s: s["text"]), ""))), lambda s: s != "")
    blocks = F.coalesce("blocks", F.array())
    x = pages.withColumn("n_images", F.size(F.filter(blocks, lambda b: b["type"] == 1)))
    x = x.withColumn("__text", F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: F.struct(
        squeezed(F.array_join(said(b), "\n")).alias("text"),
        F.greatest(F.size(said(b)), F.lit(1)).alias("lines"),
        F.coalesce(F.array_max(sizes(spans(b))), F.lit(0.0)).alias("top"),
        T.box(b["bbox"]).alias("box"),
        sizes(spans(b)).alias("sizes"))), lambda b: b["text"] != ""))
    all_ = F.flatten(F.transform("__text", lambda b: b["sizes"]))
    x = x.withColumn("__top", F.coalesce(F.array_max(all_), F.lit(0.0))).withColumn("__avg", F.coalesce(F.aggregate(all_, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(all_), F.lit(0)), F.lit(0.0)))
    x = x.withColumn("__is", F.transform("__text", lambda b: is_heading(b["text"], b["lines"], b["top"], F.col("__avg"), F.col("__top"))))
    n, many = F.size("__text"), F.size(F.filter("__is", lambda h: h))
    first = F.array_position("__is", F.lit(True)) - 1
    few = F.transform("__is", lambda h, i: h & (i == first))
    x = x.withColumn("__is", F.when((n >= 3) & (many >= F.greatest(F.lit(3), F.floor(0.6 * n))), few).otherwise(F.col("__is")))
    marked = F.transform(F.arrays_zip("__text", "__is"), lambda z: F.concat(F.when(z["__is"], "## ").otherwise(""), z["__text"]["text"]))
    chars = T.real_chars(F.array_join(marked, ""))
    kind = F.when((chars == 0) & (F.col("n_images") > 0), "scanned").when((F.col("n_images") > 0) & (chars < T.HYBRID_CHARS), "hybrid").otherwise("digital")
    headings = F.transform(F.filter(F.arrays_zip("__text", "__is"), lambda z: z["__is"]), lambda z: z["__text"]["text"])
    types = F.transform(F.arrays_zip("__text", "__is"), lambda z: block_type(z["__text"]["text"], z["__is"]))
    x = x.withColumn("n_texts", n).withColumn("n_tables", F.size(F.filter(types, lambda t: t == "table"))).withColumn("block_types", F.array_join(F.array_sort(F.array_distinct(types)), ","))
    x = x.withColumn("heading_box", F.coalesce(F.get(F.transform(F.filter(F.arrays_zip("__text", "__is"), lambda z: z["__is"]), lambda z: z["__text"]["box"]), F.lit(0)), F.lit(""))).withColumn("font_average", F.round("__avg", 2)).withColumn("font_top", F.round("__top", 2))
    return x.withColumn("headings", headings).withColumn("kind", kind).withColumn("text", F.array_join(marked, "\n\n")).drop("__text", "__top", "__avg", "__is")


def measured(text: Column) -> Column:
    """Struct of text, chars and garble, its characters counted once."""
    return F.struct(text.alias("text"), *_sized(passes.counted(text)))


def _sized(counted: Column) -> tuple[Column, Column]:
    return counted["chars"].alias("chars"), T.garble_of(counted["chars"], counted["readable"]).alias("garble")


def choose(candidates: DataFrame) -> DataFrame:
    """One row per (doc_id, page) of (doc_id, page, method, text, hint): the best score, but readable text of a digital page wins if within 18 points of it. Ties go to text, then vision, then OCR."""
    x = candidates if {"chars", "garble"} <= set(candidates.columns) else candidates.withColumn("__m", measured(F.coalesce("text", F.lit("")))).withColumns({"chars": F.col("__m.chars"), "garble": F.col("__m.garble")}).drop("__m")
    return _best(x.withColumn("score", _score(F.col("method"), F.col("hint"), F.col("chars"), F.col("garble"))).withColumn("__most", F.col("score")))


def _score(method: Column, hint: Column, chars: Column, raw: Column) -> Column:
    return T.candidate_score(method, hint, chars, raw, T.extraction_confidence(method, chars, raw))


def _close(method: Column, hint: Column, raw: Column, score: Column, most: Column) -> Column:
    return (method == "text") & (hint == "digital") & (F.round(raw, 3) <= T.GARBLED) & (score >= most - TEXT_MARGIN)


def _order(method: Column) -> Column:
    return F.when(method == "text", 0).when(method == "vlm", 1).otherwise(2)


def _best(x: DataFrame) -> DataFrame:
    """One row per (doc_id, page) of candidates with their score, and in ``__most`` the best score among those for which a row stands."""
    page = Window.partitionBy("doc_id", "page")
    x = x.withColumn("__close", _close(F.col("method"), F.col("hint"), F.col("garble"), F.col("score"), F.max("__most").over(page)))
    x = x.withColumn("__r", F.row_number().over(page.orderBy(F.desc("__close"), F.desc("score"), _order(F.col("method")), "text")))
    return x.where("__r = 1").drop("__r", "__close", "__most")


#: Names of extractors by method.
EXTRACTORS = {"text": "pymupdf", "vlm": "qwen2.5vl", "ocr": "tesseract", "ocr_image": "tesseract", "marker_pdf": "marker"}
LEAST_CHARS, STRUCTURED_RATIO = 10, 1.75


def judged(pages: DataFrame) -> DataFrame:
    """Pages (method, text) with language (of the first 300 characters), chars, gibberish, flags and confidence."""
    if {"chars", "garble"} <= set(pages.columns):  # measured already, and their texts are stripped
        x = pages.withColumn("gibberish", F.round("garble", 3)).drop("garble")
    else:
        x = pages.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).withColumn("__m", measured(F.col("text"))).withColumns({"chars": F.col("__m.chars"), "gibberish": F.round("__m.garble", 3)}).drop("__m")
    x = x.withColumn("language", T.language(F.substring("text", 1, 300)))
    return x.withColumn("flags", T.quality_flags(F.col("chars"), F.col("gibberish"), F.col("language"))).withColumn("confidence", T.extraction_confidence(F.col("method"), F.col("chars"), F.col("gibberish")))


def _read(pages: DataFrame) -> DataFrame:
    """Pages with ``every``: the candidates (method, chars, garble, kind, reason, chain) of each, as an array, chars 0 for those without text. Their texts stay as they are, in columns of their own."""
    x = pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("__text", passes.counted(F.col("text")))
    x = x.withColumns(dict(zip(("__chars", "__rough"), _sized(F.col("__text")), strict=True))).withColumn("__rough", F.round("__rough", 3))
    x = x.withColumn("__more", T.needs_fallback(F.col("kind"), F.col("__chars"), F.col("__rough"))).withColumn("__why", T.routing_reason(F.col("kind"), F.col("__chars"), F.col("__rough")))
    x = x.withColumns({c: F.when(F.col("__more") & (F.length(T.strip(F.coalesce(F.col(c), F.lit("")))) >= LEAST_CHARS), F.col(c)) for c in ("vlm_text", "ocr_text")})
    x = x.withColumns({f"__{c}": passes.counted(F.col(c)) for c in ("vlm_text", "ocr_text")})
    kind = F.when(F.col("kind") == "digital", F.when(F.col("__chars") > 0, "hybrid").otherwise("scanned")).otherwise(F.col("kind"))
    seen = F.concat_ws(">", F.lit(EXTRACTORS["text"]), F.when(F.col("vlm_text").isNotNull(), EXTRACTORS["vlm"]))
    one = lambda method, c, kind, reason, chain: F.struct(F.lit(method).alias("method"), *_sized(F.col(c)), kind.alias("kind"), reason.alias("reason"), chain.alias("chain"))
    every = F.array(
        one("text", "__text", F.col("kind"), F.lit("fast_text_layer"), F.lit(EXTRACTORS["text"])),
        one("vlm", "__vlm_text", kind, F.col("__why"), seen),
        one("ocr", "__ocr_text", kind, F.col("__why"), F.concat_ws(">", seen, F.lit(EXTRACTORS["ocr"]))))
    return x.select("doc_id", "page", F.col("kind").alias("hint"), F.coalesce("headings", F.array().cast("array<string>")).alias("__headings"), "text", "vlm_text", "ocr_text", every.alias("every"))


def _with_text() -> Column:
    """Of ``every``, those with text: squeezing leaves all but white space, so what was counted before tells which they are, and holds after it."""
    return F.filter("every", lambda c: c["chars"] > 0)


def _text_of(method: Column) -> Column:
    return passes.squeezed(F.when(method == "text", F.col("text")).when(method == "vlm", F.col("vlm_text")).otherwise(F.col("ocr_text"))).alias("text")


def _headed(x: DataFrame) -> DataFrame:
    guessed = F.when(F.col("method") != "text", F.get(heading_guesses(F.col("text")), F.lit(0)))
    return x.withColumn("heading", F.coalesce(F.get("__headings", F.lit(0)), guessed, F.lit(""))).drop("__headings")


def candidates(pages: DataFrame) -> DataFrame:
    """(doc_id, page, method, text, hint, kind, reason, chain, heading) of pages (doc_id, page, text, kind, headings, vlm_text, ocr_text): the text layer, and where it is too little or garbled what vision and OCR have read, if ten characters or more."""
    x = _read(pages).withColumn("c", F.explode(_with_text()))
    return _headed(x.select("doc_id", "page", "hint", "__headings", "c.method", _text_of(F.col("c.method")), "c.kind", "c.reason", "c.chain", "c.chars", "c.garble"))


def route(pages: DataFrame) -> DataFrame:
    """One row per page that any extractor has read: the best candidate, with its provenance and quality. A page without any gives none.

    The best of a row's candidates is told inside the row, so that one text a row is squeezed, and moves to where rows of one page, if there are several, meet.
    """
    hint = F.col("hint")
    scores = lambda e: F.transform(e, lambda c: _score(c["method"], hint, c["chars"], c["garble"]))
    rank = lambda e, s: F.array_max(F.transform(e, lambda c, i: F.struct(_close(c["method"], hint, c["garble"], F.get(s, i), F.array_max(s)).alias("close"), F.get(s, i).alias("score"), (-_order(c["method"])).alias("order"), i.alias("i"))))
    pick = lambda e, s, r: F.struct(F.get(e, r["i"]).alias("c"), r["score"].alias("score"), F.array_max(s).alias("most"))
    best = T.let(_with_text(), lambda e: T.let(scores(e), lambda s: T.let(rank(e, s), lambda r: pick(e, s, r))))
    x = _read(pages).withColumn("b", F.explode(F.filter(F.array(best), lambda b: b["c"].isNotNull())))
    x = x.select("doc_id", "page", "hint", "__headings", "b.c.method", _text_of(F.col("b.c.method")), "b.c.kind", "b.c.reason", "b.c.chain", "b.c.chars", "b.c.garble", "b.score", F.col("b.most").alias("__most"))
    best = _headed(_best(x)).withColumn("extractor", F.coalesce(*[F.when(F.col("method") == m, n) for m, n in EXTRACTORS.items()], F.col("method")))
    return judged(best).drop("score", "hint")


def with_document_fallback(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Pages (of ``route``; written here, as they are read twice) of files (doc_id, page_total, converted); a file's converted text stands for all its pages if it has more than 1.75 times their characters and a third of them (one at least) are garbled, or if no page was read."""
    routed = written(routed)
    per = routed.groupBy("doc_id").agg(F.sum(F.length("text")).alias("__chars"), F.count_if(F.contains("flags", F.lit("garbled_text"))).alias("__bad"))
    text = T.without_images(F.coalesce("converted", F.lit("")))
    better = lambda m: (m["chars"] > STRUCTURED_RATIO * F.col("__chars")) & (F.col("__bad") >= F.greatest(F.lit(1), F.floor(F.col("page_total") / 3)))
    # a conversion is measured once, and only where it could stand
    open_ = (F.coalesce("converted", F.lit("")) != "") & (F.col("__chars").isNull() | (F.col("__bad") >= F.greatest(F.lit(1), F.floor(F.col("page_total") / 3))))
    x = files.join(per, "doc_id", "left").where(open_).withColumn("__text", text).withColumn("__m", measured(F.col("__text")))
    told = F.filter(F.array("__m"), lambda m: F.coalesce(better(m), F.lit(True)))
    x = written(x.select("doc_id", F.when(F.col("__chars").isNull(), "marker_only_result").otherwise("marker_structure_fallback").alias("reason"), F.explode(told).alias("m")).select("doc_id", "reason", F.col("m.text").alias("__text"), "m.chars", "m.garble"))
    marker = x.select("doc_id", F.lit(1).alias("page"), F.lit("marker_pdf").alias("method"), F.col("__text").alias("text"), F.lit("digital").alias("kind"), "reason", F.lit(EXTRACTORS["marker_pdf"]).alias("chain"), F.lit("").alias("heading"), F.lit(EXTRACTORS["marker_pdf"]).alias("extractor"), "chars", "garble")
    return routed.join(x.select("doc_id"), "doc_id", "left_anti").unionByName(judged(marker), allowMissingColumns=True)
