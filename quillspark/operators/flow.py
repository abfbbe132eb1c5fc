"""Retrieval and the chat flow as a whole, over a table of requests.

Requests are (query_id, text, source, doc_id, full_document, ...): a scope where source or doc_id is set. Chunks are (chunk_key, doc_id,
source, source_type, page, chunk_index, section, lang, text); vectors (chunk_key, embedding, source, doc_id); query_vectors (query_id, query_embedding).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import intents as I
from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.operators.chat import context_line
from quillspark.operators.sizes import small
from quillspark.sources.snapshots import written

SOURCE = ("doc_id", "source", "source_type", "source_path", "page", "section", "chunk_index", "chunk_type", "extraction_method")


def scoped(requests: DataFrame) -> Column:
    return R.some(requests["source"]).isNotNull() | R.some(requests["doc_id"]).isNotNull()


def place(c: str) -> Column:
    """A page or chunk number to sort by; null comes last."""
    return F.expr(f"try_cast({c} as bigint)").asc_nulls_last()


def whole_document(requests: DataFrame, chunks: DataFrame, rank: bool = True) -> DataFrame:
    """(query_id, chunk_key, rank): all chunks in each request's scope, by page and chunk number. Requests are the small side; those with a doc_id meet chunks by it, the others by source."""
    q = requests.where(scoped(requests)).select("query_id", *[R.some(F.col(c)).alias(f"q_{c}") for c in R.SCOPE if c in requests.columns])
    names = [c for c in R.SCOPE if c in requests.columns]
    c = chunks.select("chunk_key", "page", "chunk_index", *[F.col(n).cast("string").alias(n) for n in names])
    fits = R.in_scope({n: F.col(f"q_{n}") for n in names}, {n: F.col(n) for n in names})
    by = lambda n, some_: c.join(small(some_), F.col(n) == F.col(f"q_{n}")).where(fits)
    found = by("doc_id", q.where("q_doc_id is not null")).unionByName(by("source", q.where("q_doc_id is null and q_source is not null")))
    if not rank:
        return found.select("query_id", "chunk_key")
    w = Window.partitionBy("query_id").orderBy(place("page"), place("chunk_index"), "chunk_key")
    return found.select("query_id", "chunk_key", F.row_number().over(w).alias("rank"))


def chunk_counts(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, n_chunks) of each scoped request that has any."""
    return whole_document(requests, chunks, rank=False).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def retrieve(requests: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, k: int = R.TOP_K, min_score: float = R.MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(query_id, chunk_key, rank) of the chunks found, and (query_id, confidence, strong, used_full_document, n_docs) for every request.

    Scoped requests that ask for the full document get all its chunks, with confidence 1 if there are any. The others get the fusion of the vector
    and the keyword list; without a scope vector hits below ``min_score`` are dropped after the k best are chosen.
    """
    full = F.coalesce(F.col("full_document"), F.lit(False)) & scoped(requests)
    whole, rest = requests.where(full), requests.where(~full)
    named = [c for c in R.SCOPE if c in requests.columns]
    asked = query_vectors.join(rest.select("query_id", *named), "query_id")
    best = R.vector_top_k(vectors, asked, k)
    free = rest.select("query_id", scoped(rest).alias("__scoped"))
    best = best.join(free, "query_id").where(F.col("__scoped") | (F.col("score") >= min_score)).drop("__scoped")
    fused = written(R.fuse(best, R.top_k(R.bm25(chunks, rest), k), k))  # k rows a request, which several joins below read
    top = fused.where("rank = 1 and top_keyword is not null").select("query_id", F.col("top_keyword").alias("chunk_key"))
    sure = R.confidence(fused, R.strong_hit(rest, top, chunks)).withColumn("used", F.lit(False))
    all_ = written(whole_document(whole, chunks))
    # dealt otherwise than the fused rows, as Spark 4.1 zips the partitions of a union of two parts dealt alike, even where they differ in number
    docs = fused.select("query_id", "chunk_key", "rank").unionByName(all_.repartition("chunk_key"))
    count = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    x = requests.select("query_id", full.alias("used_full_document")).join(count(fused, "n_fused"), "query_id", "left").join(count(all_, "n_whole"), "query_id", "left").join(sure, "query_id", "left").withColumn("n_docs", F.coalesce("n_fused", "n_whole", F.lit(0)))
    any_ = F.col("n_docs") > 0
    sure_ = F.when(F.col("used_full_document"), F.when(any_, 1.0).otherwise(0.0)).otherwise(F.coalesce("confidence", F.lit(0.0)))
    hit = F.when(F.col("used_full_document"), any_).otherwise(F.coalesce("strong", F.lit(False)))
    return docs, x.select("query_id", sure_.alias("confidence"), hit.alias("strong"), "used_full_document", "n_docs")


def source_of(chunks: DataFrame) -> Column:
    """Where a chunk is from, as a struct; fields that chunks lack are null."""
    field = lambda c: (F.coalesce(R.some(F.col("section")), F.lit("")) if c == "section" else F.col(c).cast("string")) if c in chunks.columns else F.lit(None).cast("string")
    return F.struct(F.col("chunk_key"), *[field(c).alias(c) for c in SOURCE])


def sources(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, sources): where each chunk found is from, in order, as an array of structs."""
    x = found.join(chunks, "chunk_key").select("query_id", "rank", source_of(chunks).alias("s"))
    return x.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda r: r["s"]).alias("sources"))


def told(found: DataFrame, chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, context, all_text, sources, first_type) of what was found for each request, in order, from one join with the chunks.

    A request (query_id, extract) gets all_text if ``extract`` says so and context otherwise, so that a chunk's text moves, and is held where its answer is made, once.
    """
    said = F.when(F.col("extract"), T.without_header(F.coalesce("text", F.lit("")))).otherwise(context_line(F.col("source"), F.col("page"), F.col("section"), F.col("lang"), F.col("text")))
    x = found.join(chunks, "chunk_key").join(small(requests.select("query_id", "extract")), "query_id").select("query_id", "extract", "rank", source_of(chunks).alias("s"), said.alias("said"))
    per = x.groupBy("query_id").agg(F.max("extract").alias("extract"), F.array_sort(F.collect_list(F.struct("rank", "s", "said"))).alias("r"))
    each = lambda name: F.transform("r", lambda c: c[name])
    text = F.array_join(F.filter(each("said"), lambda t: t != ""), "\n\n")
    return per.select("query_id", F.when(~F.col("extract"), text).alias("context"), F.when(F.col("extract"), text).alias("all_text"), each("s").alias("sources"), F.get("r", F.lit(0))["s"]["source_type"].alias("first_type"))


def chat_flow(requests: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, web: DataFrame | None = None, k: int = R.TOP_K) -> DataFrame:
    """(query_id, mode, answer, prompt, sources, confidence, active_source, active_doc_id) for each request (query_id, text, source, doc_id, history, system).

    Small talk drops the scope. A request for the text itself is answered with it. A scoped question about the whole, or on a small document, gets all of it;
    other scoped questions are refused where retrieval is not sure enough. What is left gets a prompt for a generator, and no answer here.
    ``web`` (query_id, results) holds search results for requests that may need them. A null text is empty.
    """
    r = requests.withColumn("text", F.coalesce("text", F.lit(""))).withColumnsRenamed({"source": "active_source", "doc_id": "active_doc_id"})
    talk = I.mentions(F.col("text"), I.SMALL_TALK)
    for c in ("source", "doc_id"):
        r = r.withColumn(c, F.when(~talk, R.some(F.col(f"active_{c}"))))
    r = r.withColumn("scoped", scoped(r)).withColumn("extract", F.col("scoped") & I.mentions(F.col("text"), I.EXTRACTION))
    r = r.join(chunk_counts(r, chunks), "query_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    r = r.withColumn("extract", F.col("extract") & (F.col("n_chunks") > 0))
    r = r.withColumn("full_document", F.col("extract") | (F.col("scoped") & (I.mentions(F.col("text"), I.WHOLE_DOCUMENT) | I.small_document(F.col("n_chunks")))))
    r = written(r)
    found, results = retrieve(r, chunks, vectors, query_vectors, k)
    x = r.join(results.drop("used_full_document"), "query_id")
    x = x.join(told(found, chunks, r), "query_id", "left")
    x = x.join(web.select("query_id", F.col("results").alias("__web")), "query_id", "left") if web is not None else x.withColumn("__web", F.lit(None).cast("string"))
    searched = F.when(R.some(F.col("source")).isNull() & I.mentions(F.col("text"), I.WEB), F.col("__web"))
    no = F.col("scoped") & ~F.col("full_document") & I.rejected(F.col("n_docs"), F.col("confidence"), F.col("strong"), I.threshold(F.col("n_docs"), F.col("first_type")))
    name = lambda c: F.col(f"active_{c}").cast("string")
    missing = I.not_found(F.col("text"), name("source"), name("doc_id"))
    blank = I.not_found(F.lit("extract text"), F.coalesce(F.col("source"), F.col("sources")[0]["source"]), F.coalesce(F.col("doc_id"), F.col("sources")[0]["doc_id"]))
    answer = F.when(F.col("extract"), F.coalesce(I.extracted(F.col("all_text")), blank)).when(no, missing)
    prompt = F.when(~F.col("extract") & ~F.coalesce(no, F.lit(False)), I.prompt(F.col("text"), F.col("history"), F.col("context"), searched, F.col("system")))
    mode = F.when(F.col("extract"), "ocr_extract").when(no, "document_qa").otherwise(I.mode(F.col("context"), searched))
    none = F.array().cast(x.schema["sources"].dataType)
    echo = lambda c: F.when(F.col("extract"), F.col(c)).otherwise(name(c)).alias(f"active_{c}")
    return x.select("query_id", mode.alias("mode"), answer.alias("answer"), prompt.alias("prompt"), F.when(no, none).otherwise(F.coalesce("sources", none)).alias("sources"), "confidence", echo("source"), echo("doc_id"))
