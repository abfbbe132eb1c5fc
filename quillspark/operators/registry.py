"""Document registry, listings, benchmark scopes and chat history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of an entry that a new version overwrites.
ENTRY = ("source", "source_path", "source_type", "doc_scope", "doc_checksum", "input_type", "page_total", "chunk_count", "extractors_used", "languages", "page_kind_counts", "status", "updated_at")


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def annotated(pages: DataFrame, source_type: Column) -> DataFrame:
    """Pages with source_type and doc_scope: what is in the library persists, all else is a chat's upload."""
    return pages.withColumn("source_type", source_type).withColumn("doc_scope", F.when(F.col("source_type") == "library", "persistent").otherwise("chat_upload"))


def counted(pages: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name): map from each value (null or empty: ``unknown``) to its number of pages, counted before values are brought together."""
    v = F.coalesce(F.when(value != "", value), F.lit("unknown"))
    per = pages.groupBy(key, v.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__v", "__n")))).alias(name))


def rollup(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, from its pages (key, page, ...): the fields of the first page, ``page_total``, ``n_pages``, distinct sorted extractors and languages (neither empty nor ``unknown``), page kinds counted, characters summed and averaged, and pages of garbled text. Pages without a key give no entry."""
    p = pages.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    first = ("source", "source_path", "source_type", "doc_scope", "doc_checksum", "input_type", "page_total")
    kept = [c for c in first if c in p.columns and c != key]
    method = F.coalesce(F.when(column(p, "extractors_used") != "", column(p, "extractors_used")), column(p, "extraction_method"))
    lang, flags, chars = column(p, "language"), column(p, "quality_flags"), column(p, "n_chars", "long")
    some = lambda c, *no: F.array_sort(F.collect_set(F.when(~c.isin("", *no), c)))
    x = p.groupBy(key).agg(
        F.min(F.struct(F.col("page"), *kept)).alias("f"), F.count(F.lit(1)).alias("n_pages"), some(method).alias("extractors_used"), some(lang, "unknown").alias("languages"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.count_if(F.contains(F.coalesce(flags, F.lit("")), F.lit("garbled_text"))).alias("garbled_pages"))
    x = x.select(key, *[F.col(f"f.{c}").alias(c) for c in kept if c != "page_total"], F.coalesce(F.col("f.page_total") if "page_total" in kept else F.lit(None), F.col("n_pages")).cast("long").alias("page_total"), "n_pages", "extractors_used", "languages", "chars", F.round(F.col("chars") / F.greatest("n_pages", F.lit(1)), 6).alias("chars_per_page"), "garbled_pages")
    return x.join(counted(p, key, column(p, "page_kind"), "page_kind_counts"), key)


def entries(pages: DataFrame, chunk_counts: DataFrame, now: Column) -> DataFrame:
    """Registry entries as of ``now``: the roll-up with chunk_count (doc_id, chunk_count) and status."""
    x = rollup(pages).join(chunk_counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))
    return x.withColumn("status", F.lit("ingested")).withColumn("updated_at", now).drop("n_pages", "chars", "chars_per_page", "garbled_pages")


def upsert(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Full outer merge by doc_id. A new entry overwrites every field it has a column for, with nulls too; created_at and uploaded_at stay if set, else they are ``now`` (by default the new row's updated_at)."""
    rest = [c for c in ENTRY if c in old.columns or c in new.columns]
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    now = F.col("n.updated_at") if now is None else now
    pick = lambda c: F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in old.columns and c in new.columns else F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}")
    stays = lambda c: (F.coalesce(F.col(f"o.{c}"), F.when(F.col("n.__new"), now)) if c in old.columns else F.when(F.col("n.__new"), now)).alias(c)
    return o.join(n, "doc_id", "full_outer").select("doc_id", *[pick(c).alias(c) for c in rest], stays("created_at"), stays("uploaded_at"))


def listing(chunks: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (doc_id, source, page, chunk_index), the last by ``order``."""
    key = ["doc_id", "source", "page", "chunk_index"]
    rest = [c for c in ("source_type", "page_total", "source_path", "extraction_method") if c in chunks.columns]
    return chunks.groupBy(*key).agg(F.max_by(F.struct(F.lit(1).alias("one"), *rest), order).alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def distinct_values(chunks: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column, neither null nor empty."""
    return chunks.where(F.col(name).cast("string") != "").select(name).distinct()


def per_document(chunks: DataFrame) -> DataFrame:
    """(document, chunks): counted by doc_id, or by source and its type where there is none."""
    some = F.when(F.col("doc_id").cast("string") != "", F.col("doc_id").cast("string"))
    return chunks.groupBy(F.coalesce(some, F.concat_ws("::", F.coalesce("source", F.lit("")), F.coalesce("source_type", F.lit("")))).alias("document")).agg(F.count(F.lit(1)).alias("chunks"))


def upload_total(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.sum(F.coalesce("chunks", F.lit(0))), F.lit(0)).alias("total_chunks"))


def resolve(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Each item (id, document_source, ...) with the scope that its source names: library entries first, then the one updated earliest (else created), then the least doc_id. Entries of one source are counted, and the best taken, before they meet the items."""
    when = F.coalesce("updated_at", "created_at", F.lit(""))
    best = registry.groupBy("source").agg(F.min(F.struct((F.coalesce("source_type", F.lit("")) != "library").alias("other"), when.cast("string").alias("when"), "doc_id", "source_type")).alias("b"), F.count(F.lit(1)).alias("n"))
    x = items.join(best.select(F.col("source").alias("__source"), "b", "n"), F.col("document_source") == F.col("__source"), "left")
    note = F.when(F.col("n").isNull(), "document source not found in registry").when(F.col("n") == 1, "matched exact source").otherwise(F.concat(F.lit("matched "), F.col("n").cast("string"), F.lit(" documents; selected preferred scope")))
    return x.select(*items.columns, F.col("document_source").alias("source"), F.col("b.doc_id").alias("doc_id"), F.col("b.source_type").alias("source_type"), F.col("n").isNotNull().alias("resolved"), note.alias("resolution_note"))


def not_yet_ingested(files: DataFrame, known: DataFrame, key: str = "source") -> DataFrame:
    return files.join(known.select(key).distinct(), key, "left_anti")


def last_turns(chats: DataFrame, n: int = 8) -> DataFrame:
    """The last n turns of each conversation as one history string: [role] and text, one message after the other. Null texts are empty; of equal turns the greater role, then the greater text, is the later."""
    m = chats.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    kept = m.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("__r")).alias("r"), "role", "text")))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda c: F.concat(F.lit("["), F.coalesce(c["role"], F.lit("")), F.lit("]\n"), c["text"])), "\n\n").alias("history"))
