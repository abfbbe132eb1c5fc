"""The registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions import text as T
from quillspark.operators import chat, chunking, evaluation, flow, layout
from quillspark.operators import registry as G
from quillspark.operators import retrieval as R
from quillspark.sources import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Stated query vectors: those whose id 50 divides.
EVERY = 50


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_key"), F.coalesce("text", F.lit("")).alias("text"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TOK = r"list_transform(regexp_extract_all({}, '[A-Za-z0-9._-]+|[\x{{AC00}}-\x{{D7A3}}]+'), lambda x: lower(x))"
_C = f"c as (select doc_id as chunk_key, {TOK.format("coalesce(text, '')")} as t from documents)"
_P = "p as (select chunk_key, any_value(n) as dl, term, count(*) as tf from (select chunk_key, len(t) as n, unnest(t) as term from c) group by chunk_key, term)"
_BM25 = rf"""{_C}, {_P}, s as (select count(*) as n, avg(len(t)) as avgdl from c), df as (select term, count(*) as df from p group by term),
q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({TOK.format('text')}) as term from benchmark) group by all),
bm as (select query_id, chunk_key, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (term) join df using (term) cross join s group by query_id, chunk_key),
kw as (select *, row_number() over (partition by query_id order by score desc, chunk_key) as rank from bm qualify rank <= 4)"""


def _vec(stated: str) -> str:
    return f"""v as (select q.vec_id as query_id, e.vec_id as chunk_key, round(1 - (2 - 2 * list_dot_product(e.embedding::double[], q.embedding::double[])) / sqrt(2.0), 6) as score from embeddings e, embeddings q{stated}),
vk as (select *, row_number() over (partition by query_id order by score desc, chunk_key) as rank from v qualify rank <= 4)"""


_VEC = _vec(f" where q.vec_id % {EVERY} = 0")


@query(f"with {_C} select chunk_key, cast(len(t) as integer) as n_tokens, array_to_string(t, ' ') as tokens from c")
def tokenize(spark, sf_dir):
    t = F.col("tokens")
    return R.tokenized(chunks(spark, sf_dir)).select("chunk_key", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"with {_C}, {_P} select chunk_key, term, tf, cast(dl as bigint) as dl from p")
def term_frequency(spark, sf_dir):
    return R.postings(chunks(spark, sf_dir)).select("chunk_key", "term", "tf", "dl")


@query(f"with {_C}, {_P} select term, count(*) as df from p group by term")
def document_frequency(spark, sf_dir):
    return R.document_frequency(R.postings(chunks(spark, sf_dir)))


@query(f"with {_C} select count(*) as n, round(avg(len(t)), 6) as avgdl from c")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {_BM25} select query_id, chunk_key, score, cast(rank as integer) as rank from kw")
def bm25_topk(spark, sf_dir):
    return R.top_k(R.bm25(chunks(spark, sf_dir), asked(spark, sf_dir)))


@query(f"with {_BM25}, k2 as (select bm.*, row_number() over (partition by query_id order by score desc, chunk_key) as rank from bm join documents d on d.doc_id = chunk_key and d.source = 'src0' qualify rank <= 4) select query_id, chunk_key, score, cast(rank as integer) as rank from k2")
def bm25_scoped(spark, sf_dir):
    """Scope narrows the chunks, not the statistics."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_key"), F.coalesce("text", F.lit("")).alias("text"), "source")
    return R.top_k(R.bm25(docs, asked(spark, sf_dir).withColumn("source", F.lit("src0"))))


def vectors(spark, sf_dir, every: int | None = EVERY):
    """The nearest vectors of the stated ones, or without ``every`` of each row of the table."""
    e = table(spark, sf_dir, "embeddings")
    stated = e.where(F.col("vec_id") % every == 0) if every else e
    return R.vector_top_k(e.select(F.col("vec_id").alias("chunk_key"), "embedding"), stated.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")))


def relevant(spark, sf_dir, every: int | None = EVERY):
    return vectors(spark, sf_dir, every).where(F.col("score") >= R.MIN_SCORE)


@query(f"with {_VEC} select query_id, chunk_key, score, cast(rank as integer) as rank from vk")
def vector_topk(spark, sf_dir):
    return vectors(spark, sf_dir)


@query(f"with {_VEC} select query_id, chunk_key, score, cast(rank as integer) as rank from vk where score >= 0.3")
def vector_min_score(spark, sf_dir):
    return vectors(spark, sf_dir).where("score >= 0.3")



def _fused(vec: str) -> str:
    return f"""{_BM25}, {vec}, f as (select coalesce(vk.query_id, kw.query_id) as query_id, coalesce(vk.chunk_key, kw.chunk_key) as chunk_key, round(coalesce(1.0::double / (60 + vk.rank), 0) + coalesce(1.0::double / (60 + kw.rank), 0), 9) as rrf_score, greatest(coalesce(vk.score, 0), 0) as vector_score, coalesce(kw.score, 0) as keyword_score, vk.rank is not null as in_vector, kw.rank is not null as in_keyword, vk.rank as vr, kw.rank as kr from (select * from vk where score >= 0.3) vk full join kw on vk.query_id = kw.query_id and vk.chunk_key = kw.chunk_key),
fr as (select *, row_number() over (partition by query_id order by rrf_score desc, vector_score desc, keyword_score desc, vr nulls last, kr nulls last) as rank from f qualify rank <= 4)"""


_FUSED = _fused(_VEC)


@query(f"with {_FUSED} select query_id, chunk_key, rrf_score, vector_score, keyword_score, in_vector, in_keyword, cast(rank as integer) as rank from fr")
def rrf_fusion(spark, sf_dir):
    return R.fuse(relevant(spark, sf_dir), bm25_topk(spark, sf_dir)).drop("top_vector", "top_keyword")


def _strong(k: str, b: str, one: str) -> str:
    """Strong hits sg of the first chunk of each keyword list k, for questions b."""
    return f"""st as (select {k}.query_id, list_filter({TOK.format('b.text')}, lambda x: len(x) >= 2) as q, c.t, {one} as one from {k} join {b} using (query_id) join c using (chunk_key) where rank = 1),
sh as (select query_id, len(q) as nq, one, list_filter(q, lambda x: list_contains(t, x)) as h from st), sg as (select query_id, len(list_filter(h, lambda x: regexp_matches(x, '[0-9_-]'))) > 0 or (len(h) > 0 and (one or len(h) >= least(nq, 2))) as strong from sh)"""


_SURE = "round(least(greatest(coalesce(top, 0), 0, case when in_vector and in_keyword then least(1, coalesce(top, 0) + 0.15) else 0 end, case when coalesce(strong, false) then 0.75 else 0 end), 1), 6)"


def _confidence(vec: str) -> str:
    return f"""with {_fused(vec)}, b as (select query_id, max(score) as top from vk where rank = 1 and score >= 0.3 group by 1), {_strong(k="kw", b="(select item_id as query_id, text from benchmark) b", one="false")}
select query_id, {_SURE} as confidence from fr left join b using (query_id) left join sg using (query_id) where fr.rank = 1"""


def sure(spark, sf_dir, every: int | None):
    f, q = R.fuse(relevant(spark, sf_dir, every), bm25_topk(spark, sf_dir)), asked(spark, sf_dir)
    f = snapshots.written(f)  # four rows a question
    top = f.where("rank = 1 and top_keyword is not null").select("query_id", F.col("top_keyword").alias("chunk_key"))
    return R.confidence(f, R.strong_hit(q, top, chunks(spark, sf_dir))).drop("strong")


@query(_confidence(_vec("")))
def confidence(spark, sf_dir):
    """Of every question, and of every row of the vectors as one: a question's own vector is asked whatever its id."""
    return sure(spark, sf_dir, None)


_BARE = f"regexp_replace(coalesce(text, ''), '{T.SPACES}+', '', 'g')"
_READABLE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", T.READABLE).replace("'", "''")
_QUAL = rf"""q as (select doc_id, length({_BARE}) as chars, case when length({_BARE}) = 0 then 1.0::double else round(greatest(0, 1 - length(regexp_replace({_BARE}, '[^{_READABLE}]+', '', 'g')) / length({_BARE})), 3) end as gibberish, 'unknown' as lang from documents)"""


def judged(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.real_chars(t).alias("chars"), T.gibberish_ratio(t).alias("gibberish"), T.language(t).alias("lang"))


@query(f"with {_QUAL} select doc_id, cast(chars as integer) as chars, gibberish, lang, concat_ws(',', case when chars < 80 then 'low_text_yield' end, case when gibberish > 0.35 then 'garbled_text' end, case when chars >= 40 then 'language_uncertain' end) as flags, round(least(greatest(0.92::double - case when chars < 120 then 0.08::double else 0 end - case when chars < 40 then 0.15::double else 0 end - 0.6::double * least(gibberish, 0.5::double), 0.05), 0.99), 2) as confidence, gibberish > 0.35 or chars < 80 as fallback from q")
def page_quality(spark, sf_dir):
    x = judged(spark, sf_dir)
    c, g, lang, kind = F.col("chars"), F.col("gibberish"), F.col("lang"), F.lit("digital")
    return x.select("doc_id", "chars", "gibberish", "lang", T.quality_flags(c, g, lang).alias("flags"), T.extraction_confidence(F.lit("text"), c, g).alias("confidence"), T.needs_fallback(kind, c, g).alias("fallback"))


@query(f"with {_QUAL} select doc_id, case when chars < 80 and gibberish > 0.35 then 'low_text_yield+garbled_text' when chars < 80 then 'low_text_yield' when gibberish > 0.35 then 'garbled_text' else 'quality_gate' end as reason from q")
def routing_reason(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", T.routing_reason(F.lit("digital"), F.col("chars"), F.col("gibberish")).alias("reason"))


@query("select doc_id, '[Document: ' || coalesce(nullif(source, ''), 'unknown') || ' | Page: 1' || case when coalesce(lang, '') not in ('', 'unknown') then ' | Lang: ' || lang else '' end || ']' as header from documents")
def context_header(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.context_header(F.col("source"), F.lit(None).cast("string"), F.lit(1), F.col("lang")).alias("header"))


@query("select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as bigint) as n from documents")
def keyword_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_count(F.col("text"), F.lit("the")).alias("n"))


def file_pages(spark, sf_dir):
    """Documents as the pages of files: each source one, or two for documents of even and odd id."""
    d = table(spark, sf_dir, "documents")
    chars = F.coalesce("n_chars", F.lit(0))
    kind = F.when(chars < 500, "scanned").when(chars < 2000, "hybrid").otherwise("digital")
    file = F.concat(F.col("source"), F.lit("-"), (F.col("doc_id") % 2).cast("string"))
    x = d.select(file.alias("doc_id"), F.col("doc_id").alias("page"), "source", F.col("lang").alias("language"), "n_chars", kind.alias("page_kind"), F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("text").alias("extraction_method"), F.when(chars < 80, "garbled_text").alias("quality_flags"))
    return G.annotated(x, F.when(F.col("doc_id").endswith("-0"), "library").otherwise("upload"))


_PAGES = """g as (select source || '-' || doc_id % 2 as doc_id, doc_id as page, source, lang as language, n_chars, case when coalesce(n_chars, 0) < 500 then 'scanned' when n_chars < 2000 then 'hybrid' else 'digital' end as page_kind, case when doc_id % 3 = 0 then 'ocr' else 'text' end as method, coalesce(n_chars, 0) < 80 as garbled, case when doc_id % 2 = 0 then 'library' else 'upload' end as source_type from documents where source is not null),
k as (select doc_id, string_agg(page_kind || '=' || n, ',' order by page_kind) as kinds from (select doc_id, page_kind, count(*) as n from g group by all) group by doc_id),
e as (select doc_id, any_value(source) as source, any_value(source_type) as source_type, case when any_value(source_type) = 'library' then 'persistent' else 'chat_upload' end as doc_scope, count(*) as page_total, array_to_string(list_sort(list(distinct method)), ',') as extractors, array_to_string(list_sort(list(distinct language) filter (language not in ('', 'unknown'))), ',') as languages, cast(sum(n_chars) as bigint) as chars, round(sum(n_chars) / count(*), 6) as chars_per_page, count(*) filter (garbled) as garbled_pages from g group by doc_id)"""
_KINDS = lambda: F.array_join(F.transform(F.map_entries("page_kind_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query(f"with {_PAGES} select e.*, kinds from e join k using (doc_id)")
def registry_rollup(spark, sf_dir):
    x = G.rollup(file_pages(spark, sf_dir))
    return x.select("doc_id", "source", "source_type", "doc_scope", "page_total", F.array_join("extractors_used", ",").alias("extractors"), F.array_join("languages", ",").alias("languages"), "chars", "chars_per_page", "garbled_pages", _KINDS().alias("kinds"))


def versions(spark, sf_dir):
    """Entries as of a first day for a part of the files, and as of a second for another."""
    p = file_pages(spark, sf_dir)
    n = p.groupBy("doc_id").agg(F.count_if(F.col("n_chars") > 1000).alias("chunk_count"))
    first = G.entries(p.where("language = 'en'"), n, F.lit("2024-01-01")).withColumns({"created_at": F.lit("2024-01-01"), "uploaded_at": F.lit("2024-01-01")})
    return first, G.entries(p.where("language <> 'en' and page % 5 > 1"), n, F.lit("2024-02-02"))


@query(f"""with {_PAGES}, n as (select doc_id, count(*) filter (n_chars > 1000) as c from g group by 1), o as (select doc_id, count(*) as pages from g where language = 'en' group by 1), w as (select doc_id, count(*) as pages from g where language <> 'en' and page % 5 > 1 group by 1)
select doc_id, coalesce(w.pages, o.pages) as page_total, c as chunk_count, case when w.pages is null then '2024-01-01' else '2024-02-02' end as updated_at, case when o.pages is null then '2024-02-02' else '2024-01-01' end as created_at, 'ingested' as status from o full join w using (doc_id) join n using (doc_id)""")
def registry_upsert(spark, sf_dir):
    return G.upsert(*versions(spark, sf_dir)).select("doc_id", "page_total", "chunk_count", "updated_at", "created_at", "status")


_REG = """r as (select doc_id, source, source_type, case when doc_id like '%3-%' then '2024-01-03' else '2024-01-0' || (1 + page_total % 2) end as updated_at from e)"""


@query(f"""with {_PAGES}, {_REG}, i as (select item_id, 'src' || cast(item_id % 23 as varchar) as document_source from benchmark), b as (select source, arg_min(doc_id, (source_type <> 'library', updated_at, doc_id)) as doc_id, arg_min(source_type, (source_type <> 'library', updated_at, doc_id)) as source_type, count(*) as n from r group by 1)
select item_id as id, document_source, doc_id, source_type, n is not null as resolved, case when n is null then 'document source not found in registry' when n = 1 then 'matched exact source' else 'matched ' || n || ' documents; selected preferred scope' end as resolution_note from i left join b on source = document_source""")
def scope_resolution(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("src"), (F.col("item_id") % 23).cast("string")).alias("document_source"))
    r = G.rollup(file_pages(spark, sf_dir)).withColumn("updated_at", F.when(F.col("doc_id").like("%3-%"), "2024-01-03").otherwise(F.concat(F.lit("2024-01-0"), (1 + F.col("page_total") % 2).cast("string")))).withColumn("created_at", F.lit(None).cast("string"))
    return G.resolve(items, r).drop("source")


@query("select source as doc_id, lang as source, cast(1 as integer) as page, n_chars % 10 as chunk_index, arg_max(doc_id, doc_id) as source_path from documents group by all")
def docs_listing(spark, sf_dir):
    """Rows that share a key, the last of which stands."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("lang").alias("source"), F.lit(1).alias("page"), (F.col("n_chars") % 10).alias("chunk_index"), F.col("doc_id").alias("source_path"), F.col("doc_id").alias("ord"))
    return G.listing(d)


@query("select distinct source from documents where source <> ''")
def ingested_sources(spark, sf_dir):
    return G.distinct_values(table(spark, sf_dir, "documents"), "source")


@query("select case when doc_id % 7 = 0 then coalesce(source, '') || '::' || lang else cast(doc_id % 50 as varchar) end as document, count(*) as chunks from documents group by 1")
def chunks_per_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return G.per_document(d.select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 50).alias("doc_id"), "source", F.col("lang").alias("source_type")))


@query("select cast(coalesce(sum(length('[Document: ' || coalesce(nullif(source, ''), 'unknown') || ' | Page: 1' || case when coalesce(lang, '') not in ('', 'unknown') then ' | Lang: ' || lang else '' end || ']')), 0) // greatest(count(*), 1) as bigint) as average_header from documents")
def average_header(spark, sf_dir):
    none = F.lit("")
    d = table(spark, sf_dir, "documents").select("source", F.lit(1).alias("page"), "lang", none.alias("section"), none.alias("breadcrumb"), "text")
    return chunking.average_header(chunking.enriched(d))


@query("select lang as value, count(*) as n from documents group by 1")
def language_counts(spark, sf_dir):
    return evaluation.value_counts(table(spark, sf_dir, "documents"), "lang")


_LINES = """l as (select item_id + 1 as no, item_id, text from benchmark)"""


@query(f"""with {_LINES}, x as (select no, item_id, case when item_id % 11 = 0 then '' else 'b' || (item_id // 2) end as id from l where item_id % 7 <> 0), d as (select *, id <> '' and row_number() over (partition by id order by no) > 1 as again from x)
select no as _line_no, 'invalid JSON' as error from l where item_id % 7 = 0 union all select no, 'id must be non-empty' from d where id = '' union all select no, 'duplicate id ' || chr(39) || id || chr(39) from d where again
union all select no, 'expected_answer_points must be a list' from d where item_id % 5 = 0 union all select no, 'should_answer_from_docs must be true/false' from d where item_id % 3 = 0 union all select no, 'missing required fields: category, language' from d where item_id % 4 = 0 union all select no, 'question must be non-empty' from d where item_id % 13 = 0""")
def benchmark_problems(spark, sf_dir):
    """Lines made of the benchmark table, broken by rule."""
    n = F.col("item_id")
    pick = lambda when, a, b: F.when(when, a).otherwise(b)
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    fields = F.array(
        F.concat(F.lit('"id":'), text(pick(n % 11 == 0, F.lit(" "), F.concat(F.lit("b"), F.floor(n / 2).cast("string"))))), F.concat(F.lit('"question":'), text(pick(n % 13 == 0, F.lit(" "), F.col("text")))), F.lit('"document_source":"x"'),
        pick(n % 5 == 0, F.lit('"expected_answer_points":"no"'), F.lit('"expected_answer_points":["a","b"]')), pick(n % 3 == 0, F.lit('"should_answer_from_docs":"yes"'), F.lit('"should_answer_from_docs":true')), F.when(n % 4 != 0, F.lit('"category":"summary","language":"en"')))
    line = F.concat(F.lit("{"), F.concat_ws(",", *[fields[i] for i in range(6)]), pick(n % 7 == 0, F.lit(""), F.lit("}")))
    return evaluation.problems(table(spark, sf_dir, "benchmark").select((n + 1).alias("_line_no"), line.alias("line")))


@query("select doc_id, source from documents where source not in (select distinct source from documents where lang = 'es' and n_chars > 15000 and source is not null)")
def ingest_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return G.not_yet_ingested(d.select("doc_id", "source"), d.where("lang = 'es' and n_chars > 15000")).select("doc_id", "source")


@query("with r as (select conv_id, turn, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn desc, role desc, coalesce(text, '') desc) as r from conversations qualify r <= 8) select conv_id, string_agg('[' || coalesce(role, '') || ']' || chr(10) || text, chr(10) || chr(10) order by r.r desc) as history from r group by conv_id")
def history_window(spark, sf_dir):
    return G.last_turns(table(spark, sf_dir, "conversations"))


_SAYS = ", ".join(f"coalesce(regexp_matches(lower(text), '{I.pattern(t).replace(chr(39), chr(39) * 2)}'), false) as {n}" for n, t in (("web", I.WEB), ("whole_document", I.WHOLE_DOCUMENT), ("small_talk", I.SMALL_TALK), ("extraction", I.EXTRACTION), ("refusal", I.REFUSAL)))


@query(f"select conv_id, turn, role, {_SAYS} from conversations")
def intents(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", *[I.mentions(t, terms).alias(n) for n, terms in (("web", I.WEB), ("whole_document", I.WHOLE_DOCUMENT), ("small_talk", I.SMALL_TALK), ("extraction", I.EXTRACTION), ("refusal", I.REFUSAL))])


_REQ = """m as (select conv_id, turn, role, coalesce(text, '') as text from conversations), r as (select *, row_number() over (partition by conv_id order by turn desc, role desc, text desc) as r from m where role in ('user', 'assistant')),
a as (select conv_id, bool_or(r = 1 and role = 'user') as asks from r group by conv_id), h as (select conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) order by r.r desc) as history from r join a using (conv_id) where r.r between case when asks then 2 else 1 end and case when asks then 9 else 8 end group by conv_id),
q as (select conv_id, coalesce(max(struct_pack(turn := turn, text := text)) filter (role = 'system').text, '') as system, coalesce(max(struct_pack(turn := turn, text := text)) filter (role = 'user').text, '') as question from m group by conv_id),
rq as (select conv_id, system, question, coalesce(history, '') as history from q left join h using (conv_id))"""


@query(f"with {_REQ} select conv_id, system, question, history from rq")
def chat_requests(spark, sf_dir):
    return chat.requests(table(spark, sf_dir, "conversations"))


@query(f"with {_REQ} select conv_id, 'general' as mode, '[System]' || chr(10) || case when system = '' then '{I.SYSTEM}' else system end || case when history = '' then '' else chr(10) || chr(10) || '[Conversation history]' || chr(10) || history end || chr(10) || chr(10) || '[User message]' || chr(10) || question as prompt from rq")
def chat_prompts(spark, sf_dir):
    none = F.lit("")
    return chat_requests(spark, sf_dir).select("conv_id", I.mode(none, none).alias("mode"), I.prompt(F.col("question"), F.col("history"), none, none, F.col("system")).alias("prompt"))


def located(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_key"), "source", F.lit(1).alias("page"), F.lit("").alias("section"), "lang", "text")


@query(f"with {_BM25} select query_id, string_agg('[Doc: ' || coalesce(nullif(source, ''), 'unknown') || ' | Page: 1 | Section:  | Lang: ' || coalesce(nullif(lang, ''), 'unknown') || ']' || chr(10) || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by rank) as context from kw join documents on doc_id = chunk_key group by query_id")
def retrieved_context(spark, sf_dir):
    return chat.context(bm25_topk(spark, sf_dir), located(spark, sf_dir))


@query(f"""with cf as ({_confidence(_VEC)}) select query_id, confidence, confidence < {I.THRESHOLD} as rejected, case when confidence < {I.THRESHOLD} then case when regexp_matches(coalesce(text, ''), '[가-힣]') then replace('{I.NOT_FOUND_KO.replace(chr(39), chr(39) * 2)}', '%s', 'the uploaded document') else replace('{I.NOT_FOUND_EN.replace(chr(39), chr(39) * 2)}', '%s', 'the uploaded document') end end as answer from cf left join benchmark on item_id = query_id""")
def confidence_gate(spark, sf_dir):
    """Strong hits already lift the confidence over the threshold."""
    x = sure(spark, sf_dir, EVERY).join(asked(spark, sf_dir), "query_id", "left")
    nobody, c = F.lit(None).cast("string"), F.col("confidence")
    no = I.rejected(F.lit(4), c, F.lit(False), I.threshold(F.lit(4), F.lit("library")))
    return x.select("query_id", "confidence", no.alias("rejected"), F.when(no, I.not_found(F.coalesce("text", F.lit("")), nobody, nobody)).alias("answer"))


_NORM = "trim(regexp_replace(lower({}), '" + T.SPACES.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"


@query(f"""with {_BM25}, x as (select query_id, {_NORM.format("coalesce(d.text, '')")} as said, string_split(b.text, '. ') as points from kw join documents d on doc_id = chunk_key join benchmark b on item_id = query_id where rank = 1),
y as (select query_id, len(points) as total, len(list_filter(points, lambda p: {_NORM.format("p")} <> '' and contains(said, {_NORM.format("p")}))) as hit from x) select query_id, cast(total as integer) as total, cast(hit as integer) as hit, case when total = 0 then 1.0 else round(hit / total, 3) end as recall from y""")
def answer_point_recall(spark, sf_dir):
    """The best keyword chunk as the answer, the sentences of the benchmark text as the points expected."""
    best = bm25_topk(spark, sf_dir).where("rank = 1").select("query_id", "chunk_key")
    x = best.join(chunks(spark, sf_dir), "chunk_key").join(asked(spark, sf_dir).select("query_id", F.split("text", r"\. ").alias("points")), "query_id")
    return x.select("query_id", chat.point_recall(F.col("text"), F.col("points")).alias("r")).select("query_id", "r.total", "r.hit", "r.recall")


@query(r"""with l as (select doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda s: regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as l from documents)
select doc_id, array_to_string(list_filter(l, lambda s: s <> '' and length(s) <= 120 and not regexp_matches(s, '([.?!;]|다|요)$'))[1:3], ' / ') as guesses from l""".replace("\\\\", "\\"))
def heading_guesses(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(layout.heading_guesses(F.coalesce("text", F.lit(""))), " / ").alias("guesses"))


def passages(spark, sf_dir):
    """Documents as chunks: of the file ``source``, numbered by doc_id, and of one-chunk documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_key"), "doc_id", "source", F.when(F.col("doc_id") % 2 == 1, "upload").otherwise("library").alias("source_type"), F.lit(1).alias("page"), F.col("doc_id").alias("chunk_index"), F.lit("").alias("section"), "lang", F.coalesce("text", F.lit("")).alias("text"))


def passage_vectors(spark, sf_dir):
    """Vectors of existing documents, with their scope, and those of the questions."""
    e = table(spark, sf_dir, "embeddings")
    own = table(spark, sf_dir, "documents").select("doc_id", "source")
    v = e.select(F.col("vec_id").alias("chunk_key"), "embedding").join(own, F.col("chunk_key") == F.col("doc_id"))
    return v, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _retrieval(rq: str) -> str:
    """CTEs up to ``found`` and ``res`` for requests rq (query_id, text, source, doc_id, whole)."""
    inside = "(rq.source is null or rq.source = d.source) and (rq.doc_id is null or rq.doc_id = d.doc_id)"
    return rf"""{_C}, {_P}, s as (select count(*) as n, avg(len(t)) as avgdl from c), df as (select term, count(*) as df from p group by term), {rq},
q as (select query_id, term, count(*) as times from (select query_id, unnest({TOK.format('text')}) as term from rq where not whole) group by all),
bm as (select query_id, chunk_key, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join p using (term) join df using (term) cross join s group by query_id, chunk_key),
kw as (select query_id, chunk_key, score, row_number() over (partition by query_id order by score desc, chunk_key) as rank from bm join rq using (query_id) join documents d on d.doc_id = chunk_key where {inside} qualify rank <= 4),
va as (select rq.query_id, e.vec_id as chunk_key, round(1 - (2 - 2 * list_dot_product(e.embedding::double[], q.embedding::double[])) / sqrt(2.0), 6) as score, rq.source is not null or rq.doc_id is not null as scoped from rq join embeddings q on q.vec_id = rq.query_id cross join embeddings e join documents d on d.doc_id = e.vec_id where not whole and {inside}),
vb as (select *, row_number() over (partition by query_id order by score desc, chunk_key) as rank from va qualify rank <= 4), vk as (select * from vb where scoped or score >= 0.3),
f as (select coalesce(vk.query_id, kw.query_id) as query_id, coalesce(vk.chunk_key, kw.chunk_key) as chunk_key, round(coalesce(1.0::double / (60 + vk.rank), 0) + coalesce(1.0::double / (60 + kw.rank), 0), 9) as rrf_score, greatest(coalesce(vk.score, 0), 0) as vector_score, coalesce(kw.score, 0) as keyword_score, vk.rank is not null as in_vector, kw.rank is not null as in_keyword, vk.rank as vr, kw.rank as kr from vk full join kw on vk.query_id = kw.query_id and vk.chunk_key = kw.chunk_key),
fr as (select *, row_number() over (partition by query_id order by rrf_score desc, vector_score desc, keyword_score desc, vr nulls last, kr nulls last) as rank from f qualify rank <= 4),
wd as (select query_id, d.doc_id as chunk_key, row_number() over (partition by query_id order by d.doc_id) as rank from rq join documents d on {inside} where whole),
found as (select query_id, chunk_key, rank from fr union all select query_id, chunk_key, rank from wd),
b as (select query_id, max(score) as top from vk where rank = 1 group by 1), {_strong(k="kw", b="rq b", one="b.doc_id is not null")},
cf as (select query_id, {_SURE} as confidence, coalesce(strong, false) as strong from fr left join b using (query_id) left join sg using (query_id) where fr.rank = 1),
nd as (select query_id, count(*) as n_docs from found group by 1),
res as (select query_id, case when whole then case when n_docs > 0 then 1.0 else 0.0 end else coalesce(confidence, 0) end as confidence, case when whole then coalesce(n_docs, 0) > 0 else coalesce(strong, false) end as strong, whole as used_full_document, coalesce(n_docs, 0) as n_docs from rq left join nd using (query_id) left join cf using (query_id))"""


_RQ = """rq as (select item_id as query_id, text, case when item_id % 5 in (1, 3) then 'src' || cast(item_id % 20 as varchar) end as source, case when item_id % 5 in (2, 4) then item_id end as doc_id, item_id % 5 in (3, 4) as whole from benchmark)"""


def requests(spark, sf_dir):
    """Questions without a scope, in the scope of a source and of a document, and for the whole of both."""
    n = F.col("item_id") % 5
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.when(n.isin(1, 3), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("source"), F.when(n.isin(2, 4), F.col("item_id")).alias("doc_id"), n.isin(3, 4).alias("full_document"))


@query(f"with {_retrieval(_RQ)} select query_id, confidence, strong, used_full_document, n_docs from res")
def retrieve(spark, sf_dir):
    return flow.retrieve(requests(spark, sf_dir), passages(spark, sf_dir), *passage_vectors(spark, sf_dir))[1]


@query(f"with {_retrieval(_RQ)} select query_id, chunk_key, cast(rank as integer) as rank from found join rq using (query_id) where source is not null or doc_id is not null")
def retrieve_scoped(spark, sf_dir):
    r = requests(spark, sf_dir)
    return flow.retrieve(r.where(flow.scoped(r)), passages(spark, sf_dir), *passage_vectors(spark, sf_dir))[0]


@query(f"with {_RQ} select query_id, d.doc_id as chunk_key, cast(row_number() over (partition by query_id order by d.doc_id) as integer) as rank from rq join documents d on (rq.source is null or rq.source = d.source) and (rq.doc_id is null or rq.doc_id = d.doc_id) where whole")
def whole_document(spark, sf_dir):
    r = requests(spark, sf_dir)
    return flow.whole_document(r.where("full_document"), passages(spark, sf_dir))


def _says(terms: list[str]) -> str:
    return f"regexp_matches(lower(text), '{I.pattern(terms).replace(chr(39), chr(39) * 2)}')"


#: What a question begins with, by number.
OPENINGS = ["", "Summarize it. ", "Extract the text. ", "What is the latest? ", "Thanks. ", "E-401: "]
_ASK = f"""a0 as (select item_id as query_id, (case when item_id % 3 = 1 and (item_id // 3) % 6 in (1, 2) then '' else {OPENINGS!r}[(item_id // 3) % 6 + 1] end) || text as text, case when item_id % 3 = 1 then 'src' || cast(item_id % 20 as varchar) end as active_source, case when item_id % 3 = 2 then item_id end as active_doc_id from benchmark),
a1 as (select *, case when not {_says(I.SMALL_TALK)} then active_source end as source, case when not {_says(I.SMALL_TALK)} then active_doc_id end as doc_id from a0),
a2 as (select a1.*, a1.source is not null or a1.doc_id is not null as scoped, (select count(*) from documents d where (a1.source is not null or a1.doc_id is not null) and (a1.source is null or a1.source = d.source) and (a1.doc_id is null or a1.doc_id = d.doc_id)) as n_chunks from a1),
a3 as (select *, scoped and n_chunks > 0 and {_says(I.EXTRACTION)} as extract from a2), rq as (select *, extract or (scoped and ({_says(I.WHOLE_DOCUMENT)} or n_chunks between 1 and 3)) as whole from a3)"""
_MISSING = lambda said, name: f"replace(case when regexp_matches({said}, '[가-힣]') then '{I.NOT_FOUND_KO.replace(chr(39), chr(39) * 2)}' else '{I.NOT_FOUND_EN.replace(chr(39), chr(39) * 2)}' end, '%s', {name})"
_STRIPPED = f"regexp_replace(coalesce(d.text, ''), '^{T.SPACES}+|{T.SPACES}+$', '', 'g')"
_CHAT = rf"""{_retrieval(_ASK)},
cx as (select query_id, string_agg('[Doc: ' || coalesce(nullif(d.source, ''), 'unknown') || ' | Page: 1 | Section:  | Lang: ' || coalesce(nullif(d.lang, ''), 'unknown') || ']' || chr(10) || {_STRIPPED}, chr(10) || chr(10) order by rank) as context, string_agg({_STRIPPED}, chr(10) || chr(10) order by rank) filter ({_STRIPPED} <> '') as said, string_agg(cast(chunk_key as varchar), ',' order by rank) as sources, arg_min(case when d.doc_id % 2 = 1 then 'upload' else 'library' end, rank) as first_type from found join documents d on d.doc_id = chunk_key group by query_id),
z0 as (select rq.*, res.confidence, res.strong, res.n_docs, context, said, cx.sources, case when rq.source is null and {_says(I.WEB).replace("lower(text)", "lower(rq.text)")} then '- hit: ' || query_id end as web, first_type from rq join res using (query_id) left join cx using (query_id)),
z as (select *, scoped and not whole and (n_docs = 0 or (confidence < case when n_docs = 1 and first_type = 'upload' then 0.3 else 0.45 end and not strong)) as refused from z0)"""


@query(rf"""with {_CHAT} select query_id, case when extract then 'ocr_extract' when refused then 'document_qa' when coalesce(context, '') <> '' and web is not null then 'document_qa+web' when web is not null then 'web_search' when coalesce(context, '') <> '' then 'document_qa' else 'general' end as mode,
case when extract then case when said is null then {_MISSING("'x'", "coalesce(source, cast(doc_id as varchar))")} when regexp_matches(said, '[가-힣]') then '{I.EXTRACTED_KO}' || chr(10) || chr(10) || said else '{I.EXTRACTED_EN}' || chr(10) || chr(10) || said end when refused then {_MISSING("text", "coalesce(active_source, cast(active_doc_id as varchar), 'the uploaded document')")} end as answer,
case when not extract and not refused then sha256('[System]' || chr(10) || '{I.SYSTEM}' || case when coalesce(context, '') <> '' then chr(10) || chr(10) || '[Retrieved document context]' || chr(10) || context else '' end || case when web is not null then chr(10) || chr(10) || '[Web search results]' || chr(10) || web else '' end || chr(10) || chr(10) || '[User message]' || chr(10) || text) end as prompt_sha256,
case when refused then '' else coalesce(sources, '') end as sources, confidence from z""")
def chat_flow(spark, sf_dir):
    n = F.col("item_id")
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.floor(n / 3) % 6 + 1).cast("int"))
    opening = F.when((n % 3 == 1) & (F.floor(n / 3) % 6).isin(1, 2), "").otherwise(opening)
    r = table(spark, sf_dir, "benchmark").select(n.alias("query_id"), F.concat(opening, "text").alias("text"), F.when(n % 3 == 1, F.concat(F.lit("src"), (n % 20).cast("string"))).alias("source"), F.when(n % 3 == 2, n).alias("doc_id"), F.lit("").alias("history"), F.lit("").alias("system"))
    web = r.select("query_id", F.concat(F.lit("- hit: "), F.col("query_id").cast("string")).alias("results"))
    x = flow.chat_flow(r, passages(spark, sf_dir), *passage_vectors(spark, sf_dir), web)
    return x.select("query_id", "mode", "answer", F.sha2("prompt", 256).alias("prompt_sha256"), F.array_join(F.transform("sources", lambda s: s["chunk_key"].cast("string")), ",").alias("sources"), "confidence")
