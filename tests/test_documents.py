"""Chunking, layout, chat, evaluation, files and the watched folder."""

import os
import random
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions import text as T
from quillspark.operators import chat, chunking, evaluation, flow, layout
from quillspark.operators import registry as G
from quillspark.sources import files, store
from quillspark.streaming import watcher

BLOCKS = "doc_id string, page int, blocks array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>"


def bare(text):
    return re.sub(r"\s+", "", text)


def plain_sections(text):
    out, open_, title, crumb, at = [], [], "", "", 0
    for m in re.finditer(r"^(#{1,4})\s+(.+)$", text, re.M):
        out.append((title, crumb, text[at : m.start()]))
        level, title, at = len(m[1]), m[2].strip(), m.end()
        open_ = [x for x in open_ if x[0] < level] + [(level, title)]
        crumb = " > ".join(t for _, t in open_)
    return [*out, (title, crumb, text[at:])]


def plain_tables(text):
    table = re.compile(r"(?:^[|].*[|]\s*\n?){2,}", re.M)
    found = [t for m in table.finditer(text) if len(t := m[0].strip()) > 50]
    return found, table.sub("\n\n", text).strip() if found else text


def plain_groups(text, size=1200):
    out, total = [], 0
    for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        if out and total + len(p) <= size:
            out[-1] += "\n\n" + p
            total += len(p)
        else:
            out.append(p)
            total = len(p)
    return out


def plain_split(text, size=1200, overlap=150, separators=(*chunking.SEPARATORS, "")):
    """The splitter as loops over strings."""
    at = next(i for i, s in enumerate(separators) if s in text)
    sep, rest, out, held = separators[at], separators[at + 1 :], [], []
    if sep:
        cuts = [m.start() for m in re.finditer(re.escape(sep), text)]
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)]) if i < j]
    else:
        parts = list(text)
    for p in [*parts, None]:
        if p is None or len(p) >= size:
            out.append("".join(held))
            held = []
            out += plain_split(p, size, overlap, rest) if p and rest else [p] if p else []
            continue
        if held and len("".join(held)) + len(p) > size:
            out.append("".join(held))
            while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                held = held[1:]
        held.append(p)
    return [s.strip() for s in out if s.strip()]


def plain_chunks(text):
    headed = re.search(r"^(#{1,4})\s+(.+)$", text, re.M) is not None
    out = []
    for title, crumb, body in plain_sections(text):
        body = body.strip() if headed else body
        if not body.strip():
            continue
        found, left = plain_tables(body)
        long = lambda t: [t] if len(t) <= chunking.SIZE else plain_split(t)
        out += [(title, crumb, "table", p) for t in found for p in long(t)]
        if left.strip():
            if len(left) <= chunking.SIZE:
                out.append((title, crumb, "section" if headed else "page", left))
            else:
                out += [(title, crumb, "paragraph", p) for g in plain_groups(left) for p in long(g)]
    return out


def chunked(spark, texts):
    """Chunks of each text as (section, breadcrumb, type, text), in order."""
    out = {i: [] for i in range(len(texts))}
    for r in chunking.chunk(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id", "chunk_index").collect():
        assert r["chunk_index"] == len(out[r["doc_id"]]) and r["chunk_chars"] == len(r["text"])
        out[r["doc_id"]].append((r["section"], r["breadcrumb"], r["chunk_type"], r["text"]))
    return out


def test_sections_have_breadcrumbs(spark):
    text = "before\n# A\none\n## B\n##### no heading\n### C\n\n## D\ntwo\n# E\nthree"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.sections(F.col("t")).alias("s")).first()["s"]
    assert [(x["title"], x["breadcrumb"], x["body"].strip()) for x in got] == [("", "", "before"), ("A", "A", "one"), ("B", "A > B", "##### no heading"), ("C", "A > B > C", ""), ("D", "A > D", "two"), ("E", "E", "three")]
    assert [c[:2] for c in chunked(spark, [text])[0]] == [("", ""), ("A", "A"), ("B", "A > B"), ("D", "A > D"), ("E", "E")]


def test_tables_leave_the_text(spark):
    long, short = "| a long cell of a table | another |\n| and one more row | last |\n", "| a |\n| b |\n"
    df = spark.createDataFrame([(f"x\n{short}y",), (f"x\n{long}\nmiddle\n{short}y",), (f"intro\n{long}tail",), ("| one row of more than fifty characters, all alone here |\n",)], "t string")
    got = [(r["x"]["found"], r["x"]["left"]) for r in df.select(chunking.tables(F.col("t")).alias("x")).collect()]
    assert got == [([], f"x\n{short}y"), ([long.strip()], "x\n\n\nmiddle\n\n\ny"), ([long.strip()], "intro\n\n\ntail"), ([], "| one row of more than fifty characters, all alone here |\n")]


def test_table_of_many_rows(spark):
    row = "| cell | cell |\n"
    got = chunked(spark, [row * 50_000])[0]
    assert {c[2] for c in got} == {"table"} and all(len(c[3]) <= chunking.SIZE for c in got) and len(got) > 500


def test_chunks_by_plain_python(spark):
    r = random.Random(5)
    parts = ["# A", "## B b", "### C", "#### D", "##### E", "##", "#x", "| cell one of a row | and two |", "| x |", "|a|b|\t", "", "", "", "short words here", "word " * 60, "sentence of words. " * 30, "한국어 문장입니다. " * 40, " indented", "x" * 700, "y" * 1300, "| not closed"]
    texts = ["\n".join(r.choices(parts, k=r.randint(1, 14))).strip() for _ in range(250)] + ["", "  \n ", "a" * 1200, "b" * 1201, "p1 " * 200 + "\n\n" + "p2 " * 199, "p" * 600 + "\n\n" + "q" * 600, "p" * 600 + "\n\n" + "q" * 601]
    got = chunked(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == plain_chunks(t), t


def test_enriched_chunks_and_keys(spark):
    c = spark.createDataFrame([("f.pdf", 2, "en", "T", "A > T", "body"), (None, None, "unknown", "T", "", None)], "source string, page int, lang string, section string, breadcrumb string, text string")
    e = chunking.enriched(c)
    assert [(r["section"], r["text"]) for r in e.collect()] == [("A > T", "[Document: f.pdf | Section: A > T | Page: 2 | Lang: en]\nbody"), ("T", "[Document: unknown | Section: T | Page: ?]\n")]
    assert chunking.average_header(e).first()[0] == sum(len(r["context_header"]) for r in e.collect()) // 2
    assert chunking.average_header(e.limit(0)).first()[0] == 0
    lit, none = F.lit, F.lit(None).cast("string")
    assert spark.range(1).select(chunking.chunk_key(lit("id"), lit("d"), none, lit(1), lit(2)), chunking.chunk_key(none, lit(""), lit("s"), none, lit(2))).first()[:] == ("id", "s::None::2")


def splits(spark, texts, size, overlap):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", chunking.split(F.col("t"), size, overlap).alias("p")).collect()
    return [r["p"] for r in sorted(rows)]


def test_split_by_plain_python(spark):
    """Texts over small alphabets, longer than ``size`` and not, at several sizes; characters outside the basic plane count as one."""
    r = random.Random(8)
    texts = ["".join(r.choices(list(alphabet), k=r.randint(1, 400))) for alphabet in ("ab. \n다?", "abcdef. \n", "ab\n", "a ", "x", "다요. \n!", "a\U0001f600 ", "\u3000\xa0ab") for _ in range(40)]
    for size, overlap in ((8, 0), (10, 3), (30, 10), (40, 20)):
        for t, got in zip(texts, splits(spark, texts, size, overlap)):
            assert got == plain_split(t, size, overlap), (t, size, overlap)
            assert all(0 < len(p) <= size and p in t for p in got) and (overlap or bare("".join(got)) == bare(t))


def test_split_of_long_texts(spark):
    texts = ["w" * n for n in (1200, 1201, 2250, 2251, 100_000)] + ["word " * 40_000, "한국어 문장입니다. " * 5_000, "a\n\n\n\nb" * 3_000]
    assert splits(spark, texts, chunking.SIZE, chunking.OVERLAP) == [plain_split(t) for t in texts]


def test_numbers_of_a_document_shared_among_tasks(spark):
    """A null id with a third of all pages, repeated and null page numbers: no gaps, by page, the same in any split and without a Python worker or a window over texts."""
    rows = [(None if i % 3 == 0 else f"d{i % 7}", None if i % 11 == 0 else i % 40, f"text {i} " * (1 + 300 * (i % 5 == 0))) for i in range(600)] + [("d1", 1, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id string, page long, text string")
    got = [sorted(tuple(str(v) for v in r) for r in chunking.chunk(df.repartition(n), "page").collect()) for n in (1, 7)]
    assert got[0] == got[1]
    by = {}
    for d, page, k, *_ in got[0]:
        by.setdefault(d, []).append((int(k), -1 if page == "None" else int(page)))
    for of in by.values():
        of.sort()
        assert [k for k, _ in of] == list(range(len(of))) and [p for _, p in of] == sorted(p for _, p in of)
    plan = chunking.chunk(df, "page")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert not any("text" in line or "__chunks" in line for line in plan.split("\n") if "Window" in line)


def test_chunks_run_on_over_pages(spark):
    rows = [(1, 2, "second"), (1, 1, "# T\n" + "para graph. " * 300), (2, 1, None), (3, 1, " \n ")]
    got = chunking.chunk(spark.createDataFrame(rows, "doc_id long, page long, text string"), "page").orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"] for r in got} == {1} and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert got[-1]["text"] == "second" and got[-1]["chunk_type"] == "page" and got[0]["breadcrumb"] == "T"
    assert all(len(r["text"]) <= chunking.SIZE for r in got)


def test_whole_documents_are_chunked(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = {}
    for r in chunking.chunk(docs).collect():
        assert r["chunk_type"] == "table" or len(r["text"]) <= chunking.SIZE
        seen.setdefault(r["doc_id"], []).append(r["text"])
    for d, text in texts.items():
        words = {w for t in seen.get(d, []) for w in re.findall(r"\w+", t)}
        plain = "\n".join(s for s in text.split("\n") if not s.startswith(("|", "#")))
        assert not {w for w in re.findall(r"\w+", plain) if len(w) < 500} - words, d


def plain_route(page):
    """The best candidate of one page, in plain Python: (method, reason, chain)."""
    text, kind, vlm, ocr = page["text"] or "", page["kind"], page["vlm_text"], page["ocr_text"]
    real = lambda t: len(re.sub(r"\s+", "", t))

    def garble(t):
        t = re.sub(r"\s+", "", t)
        return 1.0 if not t else max(0.0, 1 - len(re.findall(r"[A-Za-z0-9.,:;!?()\[\]{}%/\-_=+\'\"@#&*]", t)) / len(t))

    def confidence(method, t):
        g = garble(t)
        base = {"text": 0.92, "vlm": 0.78, "ocr": 0.72}[method] - (0.08 if real(t) < 120 else 0) - (0.15 if real(t) < 40 else 0) - min(g, 0.5) * 0.6
        return round(max(0.05, min(0.99, base)), 2)

    def score(method, t):
        bonus = {"text": 45 if kind == "digital" else 25, "vlm": 20 if kind in ("scanned", "hybrid") else 0, "ocr": 10 if kind == "scanned" else 0}[method]
        return real(t) * max(0.2, 1 - min(garble(t), 0.7)) + 120 * confidence(method, t) + bonus

    g = round(garble(text), 3)
    more = kind == "scanned" or g > 0.35 or (real(text) < 150 if kind == "hybrid" else real(text) < 80)
    found = [("text", text, "fast_text_layer", "pymupdf")] if text.strip() else []
    if more:
        why = "+".join([kind] * (kind != "digital") + ["low_text_yield"] * (real(text) < 80) + ["garbled_text"] * (g > 0.35)) or "quality_gate"
        chain = "pymupdf"
        if len((vlm or "").strip()) >= 10:
            chain += ">qwen2.5vl"
            found.append(("vlm", vlm, why, chain))
        if len((ocr or "").strip()) >= 10:
            found.append(("ocr", ocr, why, chain + ">tesseract"))
    if not found:
        return None
    best = max(found, key=lambda c: round(score(c[0], c[1]), 2))
    first = found[0]
    if first[0] == "text" and kind == "digital" and g <= 0.35 and round(score("text", text), 2) >= round(score(best[0], best[1]), 2) - 18:
        best = first
    return best[0], best[2], best[3]


def test_page_routing(spark):
    r = random.Random(6)
    texts = ["", None, "short", "plain words of a page " * 5, "plain words of a page " * 12, "\u00e9\u00df\u4e2d" * 40, "\u4e2d\u6587" * 5 + "words " * 30, "ten chars.", "x" * 79, "y" * 80]
    rows = [(f"d{i // 7}", i % 7 + 1, r.choice(texts), r.choice(["digital", "hybrid", "scanned"]), r.choice([[], ["Head"], None]), r.choice(texts), r.choice(texts)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, page int, text string, kind string, headings array<string>, vlm_text string, ocr_text string").repartition(3)
    got = {(x["doc_id"], x["page"]): (x["method"], x["reason"], x["chain"]) for x in layout.route(df).collect()}
    for row in df.collect():
        assert got.get((row["doc_id"], row["page"])) == plain_route(row), row
    assert len({g[0] for g in got.values()}) == 3
    one = layout.route(spark.createDataFrame([("a", 1, "", "scanned", None, None, "Title line\nread by  machine.")], df.schema)).first()
    assert (one["heading"], one["kind"], one["extractor"], one["text"], one["language"]) == ("Title line", "scanned", "tesseract", "Title line\nread by machine.", "unknown")


def test_document_fallback(spark):
    page = lambda d, n, text: (d, n, text, "digital", None, None, None)
    bad = "\u4e2d\u6587\u5b57" * 40
    rows = [page("keep", 1, "good words " * 30), page("swap", 1, bad), page("swap", 2, "good words " * 10), page("few", 1, bad), page("few", 2, "good words " * 30)] + [page("few", n, "good words " * 30) for n in range(3, 10)]
    routed = layout.route(spark.createDataFrame(rows, "doc_id string, page int, text string, kind string, headings array<string>, vlm_text string, ocr_text string"))
    files = spark.createDataFrame([("keep", 1, "# T " + "w" * 9999), ("swap", 2, "# T\n\n\n\n![i](j)" + "w" * 999), ("few", 9, "w" * 99999), ("new", 3, "only converted"), ("none", 3, "")], "doc_id string, page_total int, converted string")
    got = {}
    for r in layout.with_document_fallback(routed, files).collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["method"], r["reason"]))
    assert got["keep"][0][1] == "text" and len(got["few"]) == 9 and "none" not in got
    assert got["swap"] == [(1, "marker_pdf", "marker_structure_fallback")] and got["new"] == [(1, "marker_pdf", "marker_only_result")]


def test_registry(spark):
    pages = [("d1", 2, "a.pdf", "ko", 10, "digital", "text", ""), ("d1", 1, "a.pdf", "unknown", 20, None, "ocr", "x,garbled_text"), ("d1", 3, "a.pdf", "en", None, "digital", "text", None), (None, 1, "b", "en", 1, "digital", "text", ""), ("", 1, "b", "en", 1, "digital", "text", "")]
    p = G.annotated(spark.createDataFrame(pages, "doc_id string, page int, source string, language string, n_chars long, page_kind string, extraction_method string, quality_flags string"), F.lit("library"))
    r = G.rollup(p).collect()
    assert len(r) == 1
    r = r[0]
    assert (r["source"], r["page_total"], r["extractors_used"], r["languages"], r["chars"], r["garbled_pages"], r["page_kind_counts"], r["doc_scope"]) == ("a.pdf", 3, ["ocr", "text"], ["en", "ko"], 30, 1, {"digital": 2, "unknown": 1}, "persistent")
    first = G.upsert(spark.createDataFrame([], "doc_id string, source string"), G.entries(p, spark.createDataFrame([("d1", 4)], "doc_id string, chunk_count long"), F.lit("t1")))
    assert [(x["doc_id"], x["chunk_count"], x["created_at"], x["uploaded_at"], x["updated_at"], x["status"]) for x in first.collect()] == [("d1", 4, "t1", "t1", "t1", "ingested")]
    new = spark.createDataFrame([("d1", None, "t2"), ("d2", "b.pdf", "t2")], "doc_id string, source string, updated_at string")
    second = {x["doc_id"]: x for x in G.upsert(first, new).collect()}
    assert (second["d1"]["source"], second["d1"]["updated_at"], second["d1"]["created_at"], second["d1"]["chunk_count"]) == (None, "t2", "t1", 4)
    assert (second["d2"]["source"], second["d2"]["created_at"]) == ("b.pdf", "t2")
    assert G.upload_total(spark.createDataFrame([(3,), (None,)], "chunks long")).first()[0] == 3 and G.upload_total(spark.createDataFrame([], "chunks long")).first()[0] == 0


def test_scope_resolution(spark):
    reg = spark.createDataFrame([("d1", "a", "upload", "2024-01-01", None), ("d2", "a", "library", "2024-03-01", None), ("d3", "a", "library", None, "2024-02-01"), ("d4", "b", "external", None, None)], "doc_id string, source string, source_type string, updated_at string, created_at string")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, document_source string")
    got = {r["id"]: (r["doc_id"], r["source_type"], r["resolved"], r["resolution_note"]) for r in G.resolve(items, reg).collect()}
    assert got == {1: ("d3", "library", True, "matched 3 documents; selected preferred scope"), 2: ("d4", "external", True, "matched exact source"), 3: (None, None, False, "document source not found in registry"), 4: (None, None, False, "document source not found in registry")}


def test_benchmark_problems(spark):
    good = '{"id":"a","category":"c","language":"en","document_source":"s","question":"q","should_answer_from_docs":true,"expected_answer_points":[],"expected_sources":[{"source":"s","page":1}]}'
    lines = [good, "", good, "{broken", "[1]", '{"id":" ","question":"  ","should_answer_from_docs":1,"expected_answer_points":{"a":1},"expected_sources":"x"}', good.replace('"a"', "null"), good.replace('"a"', "7")]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "_line_no int, line string")
    got = sorted((r["_line_no"], r["error"]) for r in evaluation.problems(df).collect())
    assert got == sorted([(3, "duplicate id 'a'"), (4, "invalid JSON"), (5, "invalid JSON"), (6, "missing required fields: category, document_source, language"), (6, "expected_answer_points must be a list"), (6, "expected_sources must be a list"), (6, "should_answer_from_docs must be true/false"), (6, "id must be non-empty"), (6, "question must be non-empty")])
    assert {r["value"]: r["n"] for r in evaluation.value_counts(spark.createDataFrame([(" en ",), ("",), (None,), ("ko",)], "l string"), "l").collect()} == {"en": 1, "unknown": 2, "ko": 1}


def test_evaluation(spark):
    chunks = spark.createDataFrame([(1, "d1", "a.pdf", "library", 1, 0, "", "en", "the valve E-401 opens"), (2, "d1", "a.pdf", "library", 2, 1, "", "en", "second page"), (3, "d2", "b.pdf", "library", 1, 0, "", "en", "other text")], "chunk_key long, doc_id string, source string, source_type string, page int, chunk_index int, section string, lang string, text string")
    vectors = chunks.select("chunk_key", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), "source", "doc_id")
    items = spark.createDataFrame([("q1", "exact_lookup", "a.pdf", "where is E-401", True, [("a.pdf", 1), ("b.pdf", None)], ["valve opens", "e-401"], None), ("q2", "summary", "a.pdf", "all of it", True, [("a.pdf", None)], [], None), ("q3", "not_found", "gone.pdf", "refund", False, [], ["x"], False), ("q4", "exact_lookup", "b.pdf", "whole", False, None, None, True)],
        "id string, category string, document_source string, question string, should_answer_from_docs boolean, expected_sources array<struct<source:string,page:int>>, expected_answer_points array<string>, full_document boolean")
    items = items.withColumn("_line_no", F.monotonically_increasing_id())
    reg = spark.createDataFrame([("d1", "a.pdf", "library", "1", "1"), ("d2", "b.pdf", "library", "1", "1")], "doc_id string, source string, source_type string, updated_at string, created_at string")
    q = items.select(F.col("id").alias("query_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("query_embedding"))
    resolved = G.resolve(items, reg)
    scored = evaluation.retrieval(resolved, chunks, vectors, q).cache()
    got = {r["id"]: r for r in scored.collect()}
    assert got["q1"]["strong_keyword_hit"] and got["q1"]["confidence"] == 0.75 and got["q1"]["source_scoring"]["recall"] == 0.5
    assert got["q2"]["used_full_document"] and got["q2"]["confidence"] == 1.0 and [s["page"] for s in got["q2"]["retrieved_sources"]] == [1, 2]
    assert (got["q3"]["confidence"], got["q3"]["retrieved_sources"], got["q3"]["source_scoring"]["recall"]) == (0.0, [], 1.0) and got["q4"]["used_full_document"]
    replies = spark.createDataFrame([("q1", "The valve opens.", "document_qa"), ("q4", "I couldn't find relevant information in it", "document_qa")], "query_id string, answer string, mode string")
    said = evaluation.answers(resolved, replies).cache()
    out = {r["id"]: (r["mode"], r["answer_scoring"]["recall"], r["answer_refusal_detected"]) for r in said.collect()}
    assert out == {"q1": ("document_qa", 0.5, False), "q2": (None, 1.0, False), "q3": ("unresolved", 0.0, False), "q4": ("document_qa", 1.0, True)}
    s = evaluation.summary(resolved, scored, said).first()
    assert (s["total_rows"], s["unresolved_document_scope_rows"], s["categories"], s["avg_source_recall"], s["avg_answer_point_recall"], s["negative_case_count"], s["negative_case_refusal_pass"]) == (4, 1, {"exact_lookup": 2, "summary": 1, "not_found": 1}, 0.875, 0.625, 2, 1)
    assert evaluation.summary(resolved, scored).first()["avg_answer_point_recall"] is None
    assert [r["id"] for r in evaluation.chosen(items, ["q2", "q3"], 1).collect()] == ["q2"] and evaluation.chosen(items).count() == 4


def test_last_turns_of_tied_and_null_messages(spark):
    rows = [(1, 1, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, "x")] + [(3, k // 3, "user", str(k)) for k in range(20)]
    got = {r["conv_id"]: r["history"] for r in G.last_turns(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)).collect()}
    assert got[1] == "[assistant]\na\n\n[assistant]\nb\n\n[user]\n" and got[2] == "[]\nx" and re.findall(r"\d+", got[3]) == [str(k) for k in (12, 13, 14, 15, 16, 17, 18, 19)]


def test_layout(spark):
    def block(text, size, kind=0):
        return (kind, [0.0, 0.0, 1.0, 1.0], [([(text, size)],)])

    image = (1, [0.0] * 4, None)
    rows = [
        ("a", 1, [block("Title", 20.0), block("Body text  of the page.", 10.0), block("more of the body", 10.0)]),
        ("b", 1, [block("One", 20.0), block("Two", 20.0), block("Three", 20.0), block("Four ends.", 20.0)]),
        ("c", 1, [image]), ("d", 1, [image, block("x" * 149, 10.0)]), ("e", 1, [image, block("x" * 150, 10.0)]), ("f", 1, None),
    ]
    got = {r["doc_id"]: r for r in layout.analyse(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got["a"]["headings"] == ["Title"] and got["a"]["text"] == "## Title\n\nBody text of the page.\n\nmore of the body"
    assert got["b"]["headings"] == ["One"]
    assert [got[d]["kind"] for d in "cdef"] == ["scanned", "hybrid", "digital", "digital"]
    kinds = spark.createDataFrame([(" ",), ("- x",), ("2) x",), ("a   b\n1\n2\n3",), ("text",)], "t string")
    assert [r[0] for r in kinds.select(layout.block_type(F.col("t"), F.lit(False))).collect()] == ["empty", "list", "list", "table", "paragraph"]


def test_candidate_choice(spark):
    rows = [("a", 1, "text", "readable words " * 10, "digital"), ("a", 1, "vlm", "readable words " * 11, "digital"), ("b", 1, "text", "�" * 200, "digital"), ("b", 1, "ocr", "readable words " * 10, "digital"), ("c", 1, "text", None, "scanned"), ("c", 1, "vlm", "seen", "scanned")]
    got = layout.choose(spark.createDataFrame(rows, "doc_id string, page int, method string, text string, hint string")).collect()
    assert {r["doc_id"]: r["method"] for r in got} == {"a": "text", "b": "ocr", "c": "vlm"}


def test_requests(spark):
    rows = [(1, 1, "system", "s1"), (1, 2, "system", "s2"), (1, 3, "user", "u1"), (1, 4, "assistant", "a1"), (1, 5, "user", "u2"), (2, 1, "user", "u"), (2, 2, "assistant", None), (3, 1, "system", "only")]
    rows += [(4, k, "user" if k % 2 else "assistant", str(k)) for k in range(1, 30)]
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.requests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == ("s2", "u2", "[user]\nu1\n\n[assistant]\na1")
    assert got[2] == ("", "u", "[user]\nu\n\n[assistant]\n") and got[3] == ("only", "", "")
    assert got[4][1] == "29" and re.findall(r"\d+", got[4][2]) == [str(k) for k in range(21, 29)]


def test_answers(spark):
    one = spark.range(1)
    lit, none = F.lit, F.lit(None).cast("string")
    got = one.select(I.mentions(lit("what is THIS"), I.SMALL_TALK), I.mentions(lit("what is this"), I.SMALL_TALK, True), I.mentions(none, I.WEB), I.not_found(lit("문서"), lit("f.pdf"), none), I.extracted(lit(" 글 ")), I.extracted(lit(" ")), I.mode(lit("c"), lit("w")), I.mode(none, lit("")), I.small_document(lit(3)), I.small_document(lit(4)), I.rejected(lit(1), lit(0.4), lit(False), I.threshold(lit(1), lit("upload"))), I.rejected(lit(2), lit(0.4), lit(False), I.threshold(lit(2), lit("upload")))).first()
    assert list(got) == [True, False, False, I.NOT_FOUND_KO.replace("%s", "f.pdf"), "추출된 텍스트:\n\n글", None, "document_qa+web", "general", True, False, False, True]


def test_recall_and_summary(spark):
    rows = [("A  is b.\nC", ["a IS b", "d", " "], [("x", 1), ("y", 2)], [("x", None), ("y", 3)]), (None, [], None, None)]
    df = spark.createDataFrame(rows, "a string, p array<string>, f array<struct<source:string,page:int>>, e array<struct<source:string,page:int>>")
    got = df.select(chat.point_recall(F.col("a"), F.col("p")).alias("p"), chat.source_recall(F.col("f"), F.col("e")).alias("s")).collect()
    assert got[0]["p"]["recall"] == 0.333 and got[0]["p"]["hits"] == ["a IS b"] and got[0]["s"]["recall"] == 0.5 and got[1]["p"]["recall"] == got[1]["s"]["recall"] == 1.0
    rows = [("s", True, True, 0.5, 1.0, False), ("s", False, False, 1.0, None, True), (None, True, False, None, None, False)]
    s = spark.createDataFrame(rows, "category string, resolved boolean, should_answer boolean, answer_recall double, source_recall double, refused boolean")
    assert list(chat.summary(s).first()) == [3, 1, {"s": 2, "unknown": 1}, 0.75, 1.0, 2, 1]
    assert list(chat.summary(s.limit(0)).first()) == [0, 0, {}, None, None, 0, 0]


def test_files(spark, tmp_path):
    for n in ("a.pdf", "b.PNG", "c.txt", ".pdf"):
        (tmp_path / n).write_bytes(n.encode())
    got = files.folder(spark, str(tmp_path)).orderBy("is_image", "path").collect()
    assert [r["name"] for r in got if not r["name"].startswith(".")] == ["a.pdf", "b.PNG"]
    assert re.fullmatch(r"a-[0-9a-f]{12}", next(r["file_id"] for r in got if r["name"] == "a.pdf"))
    (tmp_path / "x.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "3"}\nbroken\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "id string, n long").orderBy("_line_no").collect()
    assert [(r["_line_no"], r["id"], r["n"], r["_corrupt"]) for r in rows] == [(1, "1", 2, None), (3, "3", None, None), (4, None, None, "broken")]
    files.write_json_lines(spark.createDataFrame([("값",)], "v string"), str(tmp_path / "out"))
    assert [p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*.json") if p.stat().st_size] == ['{"v":"값"}\n']


def test_watched_folder(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    for n in ("old.pdf", "new.pdf", "hidden.pdf", "late.png", "note.txt"):
        (inbox / n).write_bytes(b"x")
    now = datetime.now()
    known = lambda: spark.createDataFrame([("old.pdf",)], "name string")
    quiet = lambda: spark.createDataFrame([("hidden.pdf", now + timedelta(hours=1)), ("late.png", now - timedelta(hours=1))], "name string, expires_at timestamp")

    def run():
        watcher.watch(spark, str(inbox), str(tmp_path / "log"), lambda d, _: seen.extend(r["name"] for r in d.collect()), known, quiet, present=True, settle=0, every=None).awaitTermination(120)

    run()
    assert sorted(seen) == ["late.png", "new.pdf"]
    (inbox / "more.webp").write_bytes(b"y")
    run()
    assert sorted(seen) == ["late.png", "more.webp", "new.pdf"]


def test_watch_leaves_out_what_was_there(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    inbox.mkdir()
    (inbox / "there.pdf").write_bytes(b"x")
    none = lambda: spark.createDataFrame([], "name string, expires_at timestamp")

    def run():
        watcher.watch(spark, str(inbox), str(tmp_path / "log"), lambda d, _: seen.extend(r["name"] for r in d.collect()), none, none, settle=0, every=None).awaitTermination(120)

    run()
    (inbox / "moved.PDF").write_bytes(b"y")
    os.utime(inbox / "moved.PDF", (time.time() - 86400,) * 2)
    run()
    assert seen == ["moved.PDF"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [f'{{"id": "{i}"}}' if i % 5 else "" for i in range(5000)]
    for n in ("a", "b"):
        (tmp_path / f"{n}.jsonl").write_text("\r\n".join(lines) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        got = files.json_lines(spark, str(tmp_path), "id string")
        assert got.rdd.getNumPartitions() > 4
        assert sorted((r["_line_no"], r["id"]) for r in got.collect()) == sorted([(i + 1, str(i)) for i in range(5000) if i % 5] * 2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pages_into_the_stored_tables(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 1, "a.pdf", "# T\nfirst page", "en"), ("d1", 2, "a.pdf", "second page", "unknown"), ("d2", 1, "b.pdf", " ", "en")], "doc_id string, page int, source string, text string, language string")
    chunks, entries = store.ingest(pages, F.when(F.col("source") == "a.pdf", "upload").otherwise("library"), F.lit("now"))
    got = chunks.orderBy("chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["text"]) for r in got] == [("d1", 0, "[Document: a.pdf | Section: T | Page: 1 | Lang: en]\nfirst page"), ("d1", 1, "[Document: a.pdf | Section:  | Page: 2]\nsecond page".replace(" | Section: ", "", 1))]
    assert [(r["doc_id"], r["chunk_count"], r["page_total"], r["doc_scope"]) for r in entries.collect()] == [("d1", 2, 2, "chat_upload")]
    path = str(tmp_path / "chunks")
    assert store.load(spark, path, "doc_id string").count() == 0
    store.add_chunks(chunks, path)
    store.add_chunks(chunks.withColumn("source_type", F.lit("library")), path)
    assert store.load(spark, path, "doc_id string").count() == 4 and len(store.by_place(store.load(spark, path, "")).collect()) == 4
    assert store.full_text(pages).where("doc_id = 'd1'").first()["text"] == "# T\nfirst page\nsecond page" and store.entry(entries, "d1").count() == 1
    store.write_summary(chat.summary(spark.createDataFrame([], "category string, resolved boolean, should_answer boolean, answer_recall double, source_recall double, refused boolean")), str(tmp_path / "s"), "both", "b", "r")
    assert spark.read.json(str(tmp_path / "s")).first()["mode"] == "both"
    assert spark.range(1).select(files.source_type(F.lit("/lib/a"), "/lib", "/up"), files.source_type(F.lit("/up/a"), "/lib/", "/up/"), files.source_type(F.lit("/upper/a"), "/lib", "/up"), chat.whole_document(F.lit("summary"), F.lit(None)), chat.whole_document(F.lit("x"), F.lit(True)), chat.whole_document(F.lit("x"), F.lit(None))).first()[:] == ("library", "upload", "external", True, True, False)


def test_white_space_beyond_ascii(spark):
    """No-break and wide spaces, separators: white space for all text rules."""
    t = "a\u00a0b\u3000\u001c\u2003c\u0085"
    rows = spark.createDataFrame([(t,)], "t string")
    c = rows["t"]
    assert rows.select(T.real_chars(c), T.gibberish_ratio(c), T.normalized(c), T.strip(F.lit("\u3000\u00a0 x \u2028")), layout.squeezed(c)).first()[:] == (3, 0.0, "a b c", "x", "a b\nc")
    lines = spark.createDataFrame([(1, "\t"), (2, "\u3000"), (3, "{")], "_line_no int, line string")
    assert [(r["_line_no"], r["error"]) for r in evaluation.problems(lines).collect()] == [(3, "invalid JSON")]


def test_layout_counts_lines_with_text_and_known_sizes(spark):
    """Blank lines are no lines, sizes that are null or 0 say nothing, and heading marks count as characters of the page."""
    line = lambda *spans: {"spans": [{"text": t, "size": s} for t, s in spans]}
    block = lambda *lines, type=0: {"type": type, "bbox": [0.0], "lines": list(lines)}
    big = block(line(("Big", 20.0)), line((" ", 20.0)), line(("Title", 20.0)), line(("Here", None)))
    pages = [
        (1, [big, block(line(("body text of the page.", 10.0)), line(("", 0.0)), line(("more", None)))]),
        (2, [block(type=1), block(line(("Heading A", 30.0))), block(line(("x" * 140 + ".", 0.0)))]),
        (3, [block(line(("a", 10.0)), line(("\u3000", 10.0)), line(("b.", 20.0)))]),
    ]
    kind = "doc_id int, blocks array<struct<type:int,bbox:array<double>,lines:array<struct<spans:array<struct<text:string,size:double>>>>>>"
    got = {r["doc_id"]: r for r in layout.analyse(spark.createDataFrame(pages, kind)).collect()}
    assert got[1]["text"] == "## Big\nTitle\nHere\n\nbody text of the page.\nmore" and got[1]["font_average"] == 17.5
    assert got[2]["font_average"] == 30.0 and got[2]["kind"] == "digital"  # 2 + 8 + 141 characters
    assert got[3]["text"] == "a\nb." and got[3]["font_average"] == 13.33


def test_page_metadata_reaches_the_sources(spark):
    pages = spark.createDataFrame([("stem-0123456789ab", 1, "a.pdf", "/lib/a.pdf", 2, "text", "digital", "", "# T\nfirst page", "en"), ("stem-0123456789ab", 2, "a.pdf", "/lib/a.pdf", 2, "ocr", "scanned", "Guessed", "second page", "en")],
        "doc_id string, page int, source string, source_path string, page_total int, extraction_method string, page_kind string, section_title string, text string, language string")
    chunks, entries = store.ingest(pages, F.lit("library"), F.lit("now"))
    rows = chunks.orderBy("chunk_index").collect()
    assert [(r["section"], r["page_total"], r["page_kind"]) for r in rows] == [("T", 2, "digital"), ("Guessed", 2, "scanned")] and "Section: Guessed" in rows[1]["text"]
    found = chunks.select(F.lit(1).alias("query_id"), "chunk_key", (F.col("chunk_index") + 1).alias("rank"))
    said = flow.sources(found, chunks).first()["sources"]
    assert [tuple(s)[1:] for s in said] == [("stem-0123456789ab", "a.pdf", "library", "/lib/a.pdf", "1", "T", "0", "section", "text"), ("stem-0123456789ab", "a.pdf", "library", "/lib/a.pdf", "2", "Guessed", "1", "page", "ocr")]
    assert entries.first()["page_total"] == 2


def test_a_null_source_that_was_expected_is_a_hit(spark):
    kind = "array<struct<source:string,page:int>>"
    x = spark.createDataFrame([([(None, 1)], [(None, 1), ("a", 1)])], f"found {kind}, expected {kind}")
    assert x.select(chat.source_recall(F.col("found"), F.col("expected"))["hit"]).first()[0] == 1


def test_reading_order(spark):
    """A title over two columns, a line across the page, two columns again; blocks without a box come last."""
    boxes = {"title": (0, 0, 200, 9), "l1": (0, 20, 90, 29), "l2": (0, 31, 95, 50), "r1": (110, 19, 200, 28), "r2": (110, 30, 190, 40), "bar": (5, 60, 195, 70), "x1": (0, 80, 60, 90), "y1": (70, 79, 130, 89), "z1": (140, 81, 200, 90)}
    want = ["title", "l1", "l2", "r1", "r2", "bar", "x1", "y1", "z1", "none1", "none2"]
    r = random.Random(2)
    rows = []
    for i in range(20):
        names = list(boxes)
        r.shuffle(names)
        rows.append((i, [(n, [float(v) for v in boxes[n]]) for n in names[:3]] + [("none1", None)] + [(n, [float(v) for v in boxes[n]]) for n in names[3:]] + [("none2", [1.0])]))
    df = spark.createDataFrame([*rows, (99, []), (100, None)], "doc_id int, blocks array<struct<text:string,bbox:array<double>>>")
    names = lambda c: F.transform(c, lambda b: b["text"])
    got = df.select("doc_id", names(layout.by_columns(F.col("blocks"))).alias("c"), names(layout.by_rows(F.col("blocks"))).alias("r")).collect()
    by_rows = sorted(boxes, key=lambda n: (boxes[n][3], boxes[n][0])) + ["none1", "none2"]
    for x in got:
        assert (x["c"], x["r"]) == ((want, by_rows) if x["doc_id"] < 99 else ([], []) if x["doc_id"] == 99 else (None, None))


def test_languages(spark):
    from quillspark.operators import languages

    r = random.Random(4)
    pool = {"en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(), "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec leur aux".split()}
    rows = [(i, " ".join(r.choices(pool[lang], k=40)), lang) for i in range(300) for lang in pool]
    d = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = languages.fit(d.where("doc_id < 150"), "doc_id", sample=120)
    assert model[1] == ["de", "en", "fr"] and model[0].count() <= languages.GRAMS
    got = languages.detected(d.where("doc_id >= 150"), model)
    assert got.where("lang = language").count() >= 0.98 * got.count() and got.count() == 450
    odd = spark.createDataFrame([(1, "안녕하세요 반갑습니다 여러분"), (2, "the of"), (3, "@@@@@@@@@@@@@"), (4, None), (5, "\\u3000 der die und in den von zu das")], "k int, text string")
    assert {x["k"]: x["language"] for x in languages.detected(odd, model).collect()} == {1: "ko", 2: "unknown", 3: "unknown", 4: "unknown", 5: "de"}
