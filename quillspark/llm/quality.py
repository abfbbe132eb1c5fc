"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and of its language's common words is compared
with the histogram of all documents in that language by the Jensen-Shannon distance. Documents that are too
short for a histogram are judged by the base rules alone.

Nulls and edges: a null or empty text has no words and fails the base rules. A null language, or one
with fewer than ``min_reference`` documents, is compared with the whole corpus and has no common words.
Repeated rows are judged each on its own and alike. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, WORD, let, small, text_of, words, written

#: Frequent function words of the languages that have a word reference.
COMMON = {
    "en": "the of and to a in is it that for was on with as",
    "fr": "de la le et les des en un du une que est dans qui",
    "de": "der die und in den von zu das mit sich des auf im ist",
    "es": "de la que el en y a los se del las un por con",
}
N_COMMON = 14
#: Character classes that are counted; with symbols and space, and all else (consonants, mostly) as the last one.
CLASSES = {"upper": "A-Z", "digit": "0-9", "stop": r".,;:!?'\"()\-", "vowel": "aeiou"}
SYMBOLS = r"#*$%&|<>"

MIN_WORDS = 50
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_WORDS = 100
#: Set between the labelled clean and junk documents, whose 99.9th and 1st percentiles lie well apart.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.285
MIN_REFERENCE = 20


def repeated_words(found: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the array.

    Every window becomes a struct of its whole 64-bit hash and its place; sorted, equal windows are neighbours. Texts
    whose windows all differ skip this.
    """

    def marks(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        places = let(packed, lambda s: F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))), lambda x: x["i"]))
        return let(places, lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda i: i + 1)), F.transform(p, lambda i: i + 2))))

    # the last two windows are cut short, and so equal to none of three words nor to each other
    hashes = F.transform(found, lambda x, i: F.xxhash64(x, F.get(found, i + 1), F.get(found, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marks(h))).cast("long")


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document: the base counts and both histograms, as arrays of longs; with ``whole`` also the row itself, as a struct ``__row``."""
    d = docs.select(*([F.struct(*[docs[c] for c in docs.columns]).alias("__row")] if whole else []), docs["doc_id"].alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("__lang"), text_of(docs).alias("__text"))
    t = F.col("__text")
    only = lambda inside: F.length(F.regexp_replace(t, f"[^{inside}]+", "")).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    common = [F.coalesce(*[F.when(F.col("__lang") == lang, F.lit(s.split()[k])) for lang, s in COMMON.items()], F.lit("")) for k in range(N_COMMON)]
    known = sorted({v for s in COMMON.values() for w in s.split() for v in (w, w.capitalize())})

    def counted(w: Column) -> Column:
        frequent = F.filter(w, lambda x: x.isin(known))
        hits = let(frequent, lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(F.array_remove(c, k), F.initcap(k)))).cast("long") for k in common]))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"), hits.alias("hits"))

    along = ["__row"] if whole else []
    row = d.select(
        *along, "doc_id", "__lang",
        F.length(t).cast("long").alias("n_chars"),
        let(words(t), counted).alias("w"),
        only(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*[only(c) for c in CLASSES.values()]).alias("classes"),
    )
    classes = F.concat("classes", F.array("n_symbols", F.col("n_chars") - F.col("w.word_chars")))
    return row.select(*along, "doc_id", "__lang", "n_chars", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", F.col("w.hits").alias("hits"), classes.alias("classes"))


def references(rows: DataFrame, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Summed histograms per language, over all documents; languages with few documents get none."""
    k = len(CLASSES) + 2
    sums = [F.sum("n_chars").alias("r_chars"), F.sum("n_words").alias("r_words"), F.array(*[F.sum(F.col("classes")[i]) for i in range(k)]).alias("r_classes"), F.array(*[F.sum(F.col("hits")[i]) for i in range(N_COMMON)]).alias("r_hits")]
    return rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("r_docs"), *sums).where(F.col("r_docs") >= min_reference).drop("r_docs")


def divergence(counts: Column, total: Column, ref: Column, ref_total: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence, base 2; from 0 to 1) of two histograms, each with what remains of its total as a last class."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    whole = lambda c, n: F.transform(F.concat(c, F.array(n - F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))), lambda x: x.cast("double") / n.cast("double"))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(whole(counts, total), whole(ref, ref_total), lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2)
    return F.sqrt(F.greatest(add(both), F.lit(0.0)))


def judge(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_reference: int = MIN_REFERENCE, whole: bool = False) -> DataFrame:
    """Per document: base counts, ``base_failed``, both distances (null where the document or its reference is too short) and ``kept``; with ``whole`` also its row, as a struct ``__row``."""
    rows = written(features(docs, whole))
    ref = references(rows, min_reference)
    k = len(CLASSES) + 2
    every = rows.agg(F.sum("n_chars").alias("a_chars"), F.array(*[F.sum(F.col("classes")[i]) for i in range(k)]).alias("a_classes"))  # one row
    r = small(ref.withColumnRenamed("__lang", "r_lang"), 10_000)
    x = rows.join(r, F.col("__lang") == F.col("r_lang"), "left").crossJoin(F.broadcast(every))
    x = x.withColumn("r_classes", F.coalesce("r_classes", "a_classes")).withColumn("r_chars", F.coalesce("r_chars", "a_chars"))
    classes = divergence(F.col("classes"), F.col("n_chars"), F.col("r_classes"), F.col("r_chars"))
    common = divergence(F.col("hits"), F.col("n_words"), F.col("r_hits"), F.col("r_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    x = x.withColumn("class_distance", F.when(F.col("n_chars") >= MIN_CHARS_FOR_CLASSES, F.round(classes, 6)))
    x = x.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS_FOR_WORDS) & F.col("__lang").isin(list(COMMON)) & F.col("r_words").isNotNull(), F.round(common, 6)))
    verdict = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return x.select(*(["__row"] if whole else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "class_distance", "word_distance")
