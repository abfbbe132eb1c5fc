"""Queries over documents as pages (layout, routing, fallback of whole files) and over what retrieval and the benchmark give, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions import text as T
from quillspark.operators import chat, evaluation, flow, languages, layout
from quillspark.operators import registry as G
from quillspark.plans.catalog import _BARE, _BM25, _NORM, _READABLE, _RQ, _retrieval, bm25_topk, chunks, passage_vectors, passages, query, requests, table
from quillspark.sources import store

_SPACE = f"^{T.SPACES}+|{T.SPACES}+$"
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_END = "다|요)$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_SPACE}', '', 'g')"


def _squeezed(x: str) -> str:
    lines = f"list_transform(string_split_regex({x}, '{_LINE_END}'), lambda s: {_strip(f"regexp_replace(s, '{T.SPACES}+', ' ', 'g')")})"
    return _strip(rf"regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _rounded(x: str, digits: int) -> str:
    """Rounds half up by the decimal digits that a double prints."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(28, 18)), {digits}) as double)"


def _garble(x: str) -> str:
    bare = _BARE.replace("text", x)
    return f"case when length({bare}) = 0 then 1.0::double else greatest(0, 1 - length(regexp_replace({bare}, '[^{_READABLE}]+', '', 'g')) / length({bare})) end"


def laid_out(spark, sf_dir) -> DataFrame:
    """Documents as pages: each line a block in a font of its own size (every eleventh unknown, or 0), every seventh one an image, some with blank lines inside."""
    n = F.col("doc_id")
    size = lambda s, i: F.when((n + i) % 11 == 3, F.lit(None)).when((n + i) % 11 == 5, 0.0).otherwise((10 + F.length(s) % 9).cast("double"))
    line = lambda s, z: F.struct(F.array(F.struct(s.alias("text"), z.alias("size"))).alias("spans"))
    blank = lambda i: F.when((n + i) % 5 == 2, F.array(*[line(F.lit(t), F.lit(None).cast("double")) for t in ("", " ", "\u3000")])).otherwise(F.array())
    block = lambda s, i: F.struct(F.when((n + i) % 7 == 6, 1).otherwise(0).alias("type"), F.array(F.lit(0.0)).alias("bbox"), F.concat(F.array(line(s, size(s, i))), blank(i)).alias("lines"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), block).alias("blocks"))


@query(rf"""with s as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, i: struct_pack(t := {_strip(f"regexp_replace(s, '{T.SPACES}+', ' ', 'g')")}, size := case (doc_id + i - 1) % 11 when 3 then null when 5 then null else cast(10 + length(s) % 9 as double) end, image := (doc_id + i) % 7 = 0)) as s from documents),
b as (select doc_id, len(list_filter(s, lambda x: x.image)) as n_images, list_filter(s, lambda x: not x.image and x.t <> '') as b from s),
f as (select *, coalesce(list_max(list_transform(b, lambda x: x.size)), 0) as top, coalesce(list_sum(list_transform(b, lambda x: x.size)) / nullif(len(list_filter(b, lambda x: x.size is not null)), 0), 0) as avg from b),
g as (select *, greatest(avg, 1) as a, greatest(top - greatest(avg, 1), 0) as gap from f),
h as (select *, list_transform(b, lambda x: length(x.t) <= 120 and not regexp_matches(x.t, '([.?!;:]|{_END}') and not (gap < 0.5 and coalesce(x.size, 0) < 16) and (coalesce(x.size, 0) >= 16 or coalesce(x.size, 0) >= 1.4::double * a or (gap >= 0.8 and coalesce(x.size, 0) >= 1.18::double * a))) as h from g),
i as (select *, list_transform(h, lambda y, k: y and (not (len(b) >= 3 and len(list_filter(h, lambda z: z)) >= greatest(3, floor(0.6::double * len(b)))) or k = list_position(h, true))) as one from h),
j as (select *, list_transform(list_zip(b, one), lambda z: struct_pack(t := z[1].t, h := z[2])) as z, length(regexp_replace(array_to_string(list_transform(list_zip(b, one), lambda z: case when z[2] then '##' else '' end || z[1].t), ''), '{T.SPACES}+', '', 'g')) as chars from i)
select doc_id, cast(n_images as integer) as n_images, cast(len(b) as integer) as n_texts, array_to_string(list_transform(list_filter(z, lambda x: x.h), lambda x: x.t), ' / ') as headings, array_to_string(list_sort(list_distinct(list_transform(z, lambda x: case when x.h then 'heading' when regexp_matches(x.t, '^([-*•]|[0-9]+[.)]){T.SPACES}+') then 'list' else 'paragraph' end))), ',') as block_types,
{_rounded("avg", 2)} as font_average, top as font_top, case when n_images > 0 and chars = 0 then 'scanned' when n_images > 0 and chars < 150 then 'hybrid' else 'digital' end as kind, sha256(array_to_string(list_transform(z, lambda x: case when x.h then '## ' else '' end || x.t), chr(10) || chr(10))) as text_sha256 from j""")
def page_layout(spark, sf_dir):
    x = layout.analyse(laid_out(spark, sf_dir))
    return x.select("doc_id", "n_images", "n_texts", F.array_join("headings", " / ").alias("headings"), "block_types", "font_average", "font_top", "kind", F.sha2("text", 256).alias("text_sha256"))


def scattered(spark, sf_dir) -> DataFrame:
    """Documents as pages in two columns under a title, a line a block (60 at most of them), in an order of chance."""
    lines = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s != ""), 1, 60)
    half = F.ceil((F.size("lines") - 1) / 2)
    one = lambda s, x0, y0, x1: F.struct(F.lit(0).alias("type"), F.array(x0, y0, x1, y0 + 9.0).alias("bbox"), F.array(F.struct(F.array(F.struct(s.alias("text"), F.lit(10.0).alias("size"))).alias("spans"))).alias("lines"))
    place = lambda s, i: one(s, F.when(i == 0, 0.0).when(i <= half, 0.0).otherwise(120.0), F.when(i == 0, 0.0).when(i <= half, 20.0 + 10 * i).otherwise(20.0 + 10 * (i - half)).cast("double"), F.when(i == 0, 220.0).when(i <= half, 100.0).otherwise(220.0))
    x = table(spark, sf_dir, "documents").withColumn("lines", lines).select("doc_id", F.lit(1).alias("page"), F.transform("lines", place).alias("blocks"))
    mixed = layout.sorted_by(F.transform("blocks", lambda b, i: F.struct(F.xxhash64("doc_id", i).alias("h"), b.alias("b"))), "h")
    return x.withColumn("blocks", F.transform(mixed, lambda m: m["b"]))


@query(r"""with l as (select doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: s <> '')[:60] as s from documents),
h as (select *, cast(ceil((len(s) - 1) / 2) as bigint) as half from l), i as (select doc_id, unnest(range(1, len(s) + 1)) as k, unnest(s) as t, half from h),
r as (select doc_id, string_agg(t, chr(10) order by k) as columns, string_agg(t, chr(10) order by case when k = 1 then 0 when k <= half + 1 then k - 1 else k - 1 - half end, k) as rows from i group by doc_id)
select l.doc_id, sha256(coalesce(columns, '')) as columns_sha256, sha256(coalesce(rows, '')) as rows_sha256 from l left join r using (doc_id)""")
def reading_order(spark, sf_dir):
    """Blocks brought back into the order of reading, by columns and by rows."""
    said = lambda blocks: F.sha2(F.array_join(F.transform(blocks, lambda b: b["lines"][0]["spans"][0]["text"]), "\n"), 256)
    return scattered(spark, sf_dir).select("doc_id", said(layout.by_columns(F.col("blocks"))).alias("columns_sha256"), said(layout.by_rows(F.col("blocks"))).alias("rows_sha256"))


_GRAMS = "list_transform(range(1, greatest(length(u) - 1, 1)), lambda i: u[i:i + 2])"
_HEAD = lambda t: f"regexp_replace(lower(substr({_strip(t)}, 1, 300)), '{T.SPACES}+', ' ', 'g')"


@query(rf"""with s as (select lang, {_HEAD("text")} as u from documents where doc_id % 2 = 0 and coalesce(lang, '') <> '' and text is not null order by doc_id, text limit {languages.SAMPLE}),
g as (select lang, unnest({_GRAMS}) as gram from s where length(u) >= 3), c as (select gram, lang, count(*) as n from g group by all),
top as (select gram from c group by gram order by sum(n) desc, gram limit {languages.GRAMS}), k as (select gram, l.lang, coalesce(n, 0) as n from top cross join (select distinct lang from c) l left join c using (gram, lang)),
m as (select gram, lang, ln((n + 1) / (sum(n) over (partition by lang) + count(*) over (partition by lang))) as w from k),
d as (select doc_id, lang as given, {_strip("coalesce(text, '')")} as t, {_HEAD("coalesce(text, '')")} as u from documents where doc_id % 2 = 1),
e as (select doc_id, unnest({_GRAMS}) as gram from d where length(u) >= 3), b as (select doc_id, lang, round(sum(w), 6) as w from e join m using (gram) group by all),
f as (select doc_id, first(lang order by w desc, lang) as lang from b group by doc_id)
select d.doc_id, given, case when length(t) < 10 then 'unknown' else coalesce(f.lang, 'unknown') end as language from d left join f using (doc_id)""")
def page_language(spark, sf_dir):
    """Documents with an odd id, their language told by a model of those with an even one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.detected(d.where("doc_id % 2 = 1"), languages.fit(d.where("doc_id % 2 = 0"), "doc_id")).select("doc_id", F.col("lang").alias("given"), "language")


@query()
def language_accuracy(spark, sf_dir):
    """One row: texts of 40 characters or more that the model has not seen, and the share whose language it tells."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 40).select("doc_id")
    x = page_language(spark, sf_dir).join(d, "doc_id", "left_semi").where(F.col("given").isNotNull())
    return x.agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg((F.col("given") == F.col("language")).cast("double")), 6).alias("accuracy"))


#: Characters that a broken text layer has lost, and those that OCR has.
LOST, UNREAD = "aeionst", "e"
KINDS = ("digital", "hybrid", "scanned")


def extracted(spark, sf_dir) -> DataFrame:
    """Documents as pages that several extractors have read: some without a text layer or with a garbled one, some not seen by vision or OCR."""
    n, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    layer = F.when(n % 4 == 0, "").when(n % 4 == 1, F.translate(t, LOST, "~" * len(LOST))).otherwise(t)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), layer.alias("text"), kind.alias("kind"), F.lit(None).cast("array<string>").alias("headings"), F.when(n % 5 != 0, F.col("text")).alias("vlm_text"), F.when(n % 7 != 0, F.replace("text", F.lit(UNREAD), F.lit("~"))).alias("ocr_text"))


_SURE = lambda method, chars, rough: _rounded(f"least(greatest(case {method} when 'marker_pdf' then 0.95::double when 'text' then 0.92::double when 'vlm' then 0.78::double else 0.72::double end - case when {chars} < 120 then 0.08::double else 0 end - case when {chars} < 40 then 0.15::double else 0 end - 0.6::double * least({rough}, 0.5::double), 0.05::double), 0.99::double)", 2)
_FLAGS = "concat_ws(',', case when chars < 80 then 'low_text_yield' end, case when gibberish > 0.35 then 'garbled_text' end, case when chars >= 40 then 'language_uncertain' end) as flags"
_ROUTED = rf"""p as (select doc_id, {list(KINDS)!r}[doc_id % 3 + 1] as kind, case doc_id % 4 when 0 then '' when 1 then translate(coalesce(text, ''), '{LOST}', '{"~" * len(LOST)}') else coalesce(text, '') end as t, case when doc_id % 5 <> 0 then text end as v, case when doc_id % 7 <> 0 then replace(text, '{UNREAD}', '~') end as o from documents),
m as (select *, length({_BARE.replace("text", "t")}) as c, round({_garble("t")}, 3) as r from p),
w as (select *, kind = 'scanned' or r > 0.35 or case when kind = 'hybrid' then c < 150 else c < 80 end as more, coalesce(nullif(concat_ws('+', case when kind <> 'digital' then kind end, case when c < 80 then 'low_text_yield' end, case when r > 0.35 then 'garbled_text' end), ''), 'quality_gate') as why, case when kind <> 'digital' then kind when c > 0 then 'hybrid' else 'scanned' end as seen_kind from m),
u as (select *, case when more and length({_strip("coalesce(v, '')")}) >= 10 then v end as rv, case when more and length({_strip("coalesce(o, '')")}) >= 10 then o end as ro from w),
ca as (select doc_id, kind as hint, 'text' as method, t as x, kind, 'fast_text_layer' as reason, 'pymupdf' as chain from u union all select doc_id, kind, 'vlm', rv, seen_kind, why, 'pymupdf>qwen2.5vl' from u where rv is not null
  union all select doc_id, kind, 'ocr', ro, seen_kind, why, 'pymupdf' || case when rv is null then '' else '>qwen2.5vl' end || '>tesseract' from u where ro is not null),
cs as (select * exclude (x), {_squeezed("x")} as x from ca), cq as (select *, length({_BARE.replace("text", "x")}) as chars, {_garble("x")} as g from cs where x <> ''),
cr as (select *, {_rounded(f"(chars * greatest(0.2::double, 1 - least(g, 0.7::double)) + 120 * {_SURE('method', 'chars', 'g')} + case when method = 'text' then case when hint = 'digital' then 45 else 25 end when method = 'vlm' and hint <> 'digital' then 20 when method = 'ocr' and hint = 'scanned' then 10 else 0 end)", 2)} as score from cq),
ck as (select *, method = 'text' and hint = 'digital' and round(g, 3) <= 0.35 and score >= max(score) over (partition by doc_id) - 18 as close from cr),
cb as (select *, row_number() over (partition by doc_id order by close desc, score desc, case method when 'text' then 0 when 'vlm' then 1 else 2 end, x) as rank from ck qualify rank = 1),
rt as (select doc_id, method, x as text, kind, reason, chain, case when method = 'text' then '' else coalesce(list_filter(list_transform(string_split_regex(x, '{_LINE_END}'), lambda s: {_strip("s")}), lambda s: s <> '' and length(s) <= 120 and not regexp_matches(s, '([.?!;]|{_END}'))[1], '') end as heading, case method when 'text' then 'pymupdf' when 'vlm' then 'qwen2.5vl' else 'tesseract' end as extractor, cast(chars as integer) as chars, round(g, 3) as gibberish from cb),
rf as (select *, {_FLAGS}, {_SURE("method", "chars", "gibberish")} as confidence from rt)"""
_ROUTE = ("doc_id", "method", "kind", "reason", "chain", "heading", "extractor", "chars", "gibberish", "flags", "confidence")


@query(f"with {_ROUTED} select {', '.join(_ROUTE)}, sha256(text) as text_sha256 from rf")
def page_routing(spark, sf_dir):
    return layout.route(extracted(spark, sf_dir)).select(*_ROUTE, F.sha2("text", 256).alias("text_sha256"))


_IMAGE = "![x](y)"


@query(rf"""with {_ROUTED}, fi as (select doc_id, 1 + doc_id % 7 as total, {_strip(rf"regexp_replace(regexp_replace(text || repeat(chr(10), 4) || '{_IMAGE}' || text || text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} as text from documents where (doc_id % 2 = 0 or doc_id % 5 = 0) and text is not null),
fj as (select fi.doc_id, fi.text, length({_BARE.replace("text", "fi.text")}) as chars, length(rf.text) as was from fi left join rf using (doc_id) where rf.doc_id is null or (length({_BARE.replace("text", "fi.text")}) > 1.75 * length(rf.text) and (case when contains(flags, 'garbled_text') then 1 else 0 end) >= greatest(1, total // 3))),
fk as (select doc_id, text, cast(chars as integer) as chars, round({_garble("fj.text")}, 3) as gibberish, case when was is null then 'marker_only_result' else 'marker_structure_fallback' end as reason from fj)
select {", ".join(_ROUTE)}, sha256(text) as text_sha256 from rf where doc_id not in (select doc_id from fk)
union all select doc_id, 'marker_pdf', 'digital', reason, 'marker', '', 'marker', chars, gibberish, {_FLAGS}, {_SURE("'marker_pdf'", "chars", "gibberish")}, sha256(text) from fk""")
def document_fallback(spark, sf_dir):
    """Each document a file of one to seven pages; files whose id 2 or 5 divides have been converted as a whole, to their text three times and an image."""
    n = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", (1 + n % 7).alias("page_total"), F.when((n % 2 == 0) | (n % 5 == 0), F.concat("text", F.lit("\n" * 4 + _IMAGE), "text", "text")).alias("converted"))
    return layout.with_document_fallback(layout.route(extracted(spark, sf_dir)), files).select(*_ROUTE, F.sha2("text", 256).alias("text_sha256"))


@query("select conv_id as doc_id, string_agg(coalesce(text, ''), chr(10) order by turn nulls last, coalesce(text, '')) as text from conversations group by 1")
def full_text(spark, sf_dir):
    """Conversations as documents, their turns as pages."""
    return store.full_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"))


@query(f"with {_RQ} select query_id, count(*) as n_chunks from rq join documents d on (rq.source is null or rq.source = d.source) and (rq.doc_id is null or rq.doc_id = d.doc_id) where rq.source is not null or rq.doc_id is not null group by 1")
def scoped_counts(spark, sf_dir):
    return flow.chunk_counts(requests(spark, sf_dir), passages(spark, sf_dir))


@query("select cast(coalesce(sum(n_chars), 0) as bigint) as total_chunks from documents")
def upload_total(spark, sf_dir):
    return G.upload_total(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("chunks")))


@query(f"with {_BM25} select query_id, string_agg(concat_ws(':', chunk_key, chunk_key, source, case when chunk_key % 2 = 1 then 'upload' else 'library' end, 1, '', chunk_key), ',' order by rank) as sources from kw join documents on doc_id = chunk_key group by 1")
def retrieved_sources(spark, sf_dir):
    x = flow.sources(bm25_topk(spark, sf_dir), passages(spark, sf_dir))
    return x.select("query_id", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["chunk_key"], s["doc_id"], s["source"], s["source_type"], s["page"], s["section"], s["chunk_index"])), ",").alias("sources"))


@query(f"""with {_BM25}, hs as (select query_id, list(source) as s from kw join documents on doc_id = chunk_key group by 1), h as (select query_id, cast(coalesce(list_contains(s, 'src' || query_id % 20), false) as integer) + cast(coalesce(list_contains(s, 'src' || (query_id + 1) % 20), false) as integer) as hit from hs)
select query_id, cast(3 as integer) as total, hit, round(hit / 3, 3) as recall from h""")
def source_recall(spark, sf_dir):
    """Of three sources expected for each question (any page, the first page, a page that is not there) those among the best keyword chunks."""
    name = lambda k: F.concat(F.lit("src"), ((F.col("query_id") + k) % 20).cast("string"))
    one = lambda k, page: F.struct(name(k).alias("source"), F.lit(page).cast("int").alias("page"))
    found = F.transform("sources", lambda s: F.struct(s["source"].alias("source"), s["page"].cast("int").alias("page")))
    x = flow.sources(bm25_topk(spark, sf_dir), passages(spark, sf_dir)).select("query_id", chat.source_recall(found, F.array(one(0, None), one(1, 1), one(0, 2))).alias("r"))
    return x.select("query_id", "r.total", "r.hit", "r.recall")


CATEGORIES = ("exact_lookup", "summary", "not_found", "bilingual")


def benchmark_items(spark, sf_dir) -> DataFrame:
    n = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(n.alias("id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (n % 4 + 1).cast("int")).alias("category"), (n % 6 != 0).alias("resolved"), (n % 5 != 0).alias("should_answer_from_docs"), F.split("text", r"\. ").alias("expected_answer_points"))


def replied(spark, sf_dir) -> DataFrame:
    """The items, answered with the best keyword chunk."""
    best = bm25_topk(spark, sf_dir).where("rank = 1").select("query_id", "chunk_key")
    replies = best.join(chunks(spark, sf_dir), "chunk_key").select("query_id", F.col("text").alias("answer"), F.lit("document_qa").alias("mode"))
    return evaluation.answers(benchmark_items(spark, sf_dir), replies)


_REFUSED = f"coalesce(regexp_matches(lower(answer), '{I.pattern(I.REFUSAL).replace(chr(39), chr(39) * 2)}'), false)"
_ANSWERS = f"""{_BM25}, it as (select item_id as id, {list(CATEGORIES)!r}[item_id % 4 + 1] as category, item_id % 6 <> 0 as resolved, item_id % 5 <> 0 as due, string_split(text, '. ') as points from benchmark),
an as (select it.*, case when resolved then coalesce(d.text, '') else '' end as answer, case when not resolved then 'unresolved' when kw.query_id is not null then 'document_qa' end as mode from it left join kw on kw.query_id = id and rank = 1 left join documents d on d.doc_id = chunk_key),
ap as (select *, len(points) as total, len(list_filter(points, lambda p: {_NORM.format("p")} <> '' and contains({_NORM.format("answer")}, {_NORM.format("p")}))) as hit, {_REFUSED} as refused from an), ar as (select *, case when total = 0 then 1.0 else round(hit / total, 3) end as recall from ap)"""


@query(f"with {_ANSWERS} select id, mode, cast(total as integer) as total, cast(hit as integer) as hit, recall, refused from ar")
def benchmark_answers(spark, sf_dir):
    r = F.col("answer_scoring")
    return replied(spark, sf_dir).select("id", "mode", r["total"].alias("total"), r["hit"].alias("hit"), r["recall"].alias("recall"), F.col("answer_refusal_detected").alias("refused"))


@query(f"with {_ANSWERS}, k as (select string_agg(category || '=' || n, ',' order by category) as categories from (select category, count(*) as n from it group by 1)) select count(*) as total_rows, count(*) filter (not resolved) as unresolved, any_value(categories) as categories, {_rounded('sum(recall) / count(*)', 3)} as recall, count(*) filter (not due) as negatives, count(*) filter (not due and refused) as refused from ar cross join k")
def benchmark_summary(spark, sf_dir):
    x = evaluation.summary(benchmark_items(spark, sf_dir), replied=replied(spark, sf_dir))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("categories")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return x.select("total_rows", F.col("unresolved_document_scope_rows").alias("unresolved"), kinds.alias("categories"), F.col("avg_answer_point_recall").alias("recall"), F.col("negative_case_count").alias("negatives"), F.col("negative_case_refusal_pass").alias("refused"))



_EV = f"""en as (select source, arg_min(doc_id, (doc_id % 2, doc_id % 3, doc_id)) as doc_id from documents where source is not null group by 1),
ei as (select item_id as id, text, {list(CATEGORIES)!r}[item_id % 4 + 1] as category, 'src' || cast(item_id % 23 as varchar) as document_source from benchmark),
rq as (select id as query_id, text, document_source as source, en.doc_id, category = 'summary' as whole from ei join en on en.source = document_source)"""


@query(f"""with {_retrieval(_EV)}, hs as (select query_id, list(d.source) as s from found join documents d on d.doc_id = chunk_key group by 1),
hh as (select id, rq.query_id is not null as resolved, cast(coalesce(list_contains(s, document_source), false) as integer) + cast(coalesce(list_contains(s, 'src' || (id + 1) % 20), false) as integer) as hit from ei left join rq on rq.query_id = id left join hs on hs.query_id = id)
select id, resolved, coalesce(confidence, 0.0) as confidence, coalesce(strong, false) as strong, coalesce(used_full_document, false) as used_full_document, cast(2 as integer) as total, hit, round(hit / 2, 3) as recall from hh left join res on res.query_id = id""")
def retrieval_evaluation(spark, sf_dir):
    """Benchmark items: their document resolved among entries of one document each, retrieval in its scope, and the sources found against two expected."""
    n = F.col("item_id")
    expect = lambda name, page: F.struct(name.alias("source"), F.lit(page).cast("int").alias("page"))
    own = F.concat(F.lit("src"), (n % 23).cast("string"))
    items = table(spark, sf_dir, "benchmark").select(n.alias("id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (n % 4 + 1).cast("int")).alias("category"), own.alias("document_source"), F.col("text").alias("question"), F.lit(None).cast("boolean").alias("full_document"),
        F.array(expect(own, None), expect(F.concat(F.lit("src"), ((n + 1) % 20).cast("string")), 1)).alias("expected_sources"))
    d = F.col("doc_id")
    entries = table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", F.when(d % 2 == 0, "library").otherwise("upload").alias("source_type"), (d % 3).cast("string").alias("updated_at"), F.lit(None).cast("string").alias("created_at"))
    x = evaluation.retrieval(G.resolve(items, entries).drop("source_type"), passages(spark, sf_dir), *passage_vectors(spark, sf_dir))
    r = F.col("source_scoring")
    return x.select("id", "resolved", "confidence", F.col("strong_keyword_hit").alias("strong"), "used_full_document", r["total"].alias("total"), r["hit"].alias("hit"), r["recall"].alias("recall"))
