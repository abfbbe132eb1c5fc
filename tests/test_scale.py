"""What a task holds, and what is evaluated or moved how often, must not grow with the input; the results stay."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import passes
from quillspark.functions import text as T
from quillspark.operators import flow, ivf, languages, layout
from quillspark.operators import retrieval as R
from quillspark.sources import keyword_index, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    said = [" ".join(r.choices(["a", "b-1", "Cc", "dd", "e.e", "한글"], k=r.randint(0, 30))) for _ in range(300)]
    asked = [(0, "a b-1 b-1"), (1, "cc nowhere"), (2, ""), (3, "한글 e.e a"), (4, "nowhere")]
    return spark.createDataFrame(list(enumerate(said)), "chunk_key long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def test_bm25_deals_chunks_to_more_tasks_as_pairs_grow(spark, texts, monkeypatch):
    want = rows(R.bm25(*texts))
    monkeypatch.setattr(R, "PAIRS", 1000)
    many = R.bm25(*texts)
    assert "hashpartitioning(chunk_key" in plan(many) and ", 32)" in plan(many)  # 300 chunks x 105 pairs
    assert rows(many) == want and want
    for x in texts[0].select("text", R.counted(T.tokens(F.col("text"))).alias("c")).collect():
        assert {c["term"]: c["tf"] for c in x["c"]} == Counter(w.lower() for w in x["text"].split())


def test_postings_are_made_without_a_shuffle(spark, texts, monkeypatch):
    chunks, asked = texts
    assert "Exchange" not in plan(keyword_index.packed(chunks))
    root = snapshots.scratch(spark)
    keyword_index.append(chunks, root, "b")
    monkeypatch.setattr(keyword_index, "TOGETHER", 2)  # queries in several groups
    columns = ["query_id", "chunk_key", "score", "rank"]
    found = keyword_index.bm25_from(spark, root, asked)[0]
    assert rows(found.select(columns)) == rows(R.top_k(R.bm25(chunks, asked)).select(columns))
    assert snapshots.current(spark, root)[1]["segments"][0]["dl"] == sum(len(x["text"].split()) for x in chunks.collect())


def test_quick_patterns_and_squeezing_are_the_plain_ones(spark):
    every = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    x = every.select(F.rlike("c", F.lit(f"^{T.SPACES}$")) == F.rlike("c", F.lit(f"^{T.SPACE}$")), F.rlike("c", F.lit(f"^[^{T.READABLE}]$")) == F.rlike("c", F.lit(f"^{T.UNREADABLE}$"))).toDF("space", "unreadable")
    assert x.where("not space or not unreadable").count() == 0 and x.count() > 60_000
    r = random.Random(2)
    said = ["".join(r.choices(["a", "b.", " ", "  ", "\t", "　", "\n", "\r\n", "\x85", "\x0b", "\n\n"], k=r.randint(0, 40))) for _ in range(300)]
    plain = T.strip(F.regexp_replace(F.array_join(F.transform(F.split("t", layout.LINE_END), lambda s: T.strip(F.regexp_replace(s, T.SPACES + "+", " "))), "\n"), "\n{3,}", "\n\n"))
    got = spark.createDataFrame([(t,) for t in said], "t string").select(layout.squeezed(F.col("t")).alias("a"), plain.alias("b"))
    assert got.where("a <> b").count() == 0
    assert str(layout.measured(F.col("t"))._jc).count("regexp_replace") <= 2


def test_passes_over_whole_texts_are_the_plain_rules(spark, monkeypatch):
    every = ["".join(map(chr, range(at, at + 97))) for at in range(0, 0x10000, 97) if not 0xD800 - 97 < at < 0xE000]
    r = random.Random(4)
    parts = ["a", "b.", "Long words. ", "é", "한", "다", "😀", " ", "  ", "\t", "　", "\n", "\n", "\r\n", "\x85", "\x0b", "\n\n\n", "x" * 119, "y" * 120, ";", "?"]
    said = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(600)] + every + ["", None, " ", "😀" * 130 + "\nhead"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    t = F.coalesce("t", F.lit(""))
    x = df.select("t", layout.measured(t).alias("m"), T.real_chars(t).alias("chars"), T.garble(t).alias("garble"), layout.squeezed(t).alias("s"), passes.squeezed(t).alias("p"))
    assert x.where("m.chars <> chars or m.garble <> garble or s <> p").count() == 0 and x.count() == len(said)
    texts = pa.array(said).slice(3)
    want = [n.tolist() for n in passes.counts(texts)]
    monkeypatch.setattr(passes, "SLICE", 7)
    assert [n.tolist() for n in passes.counts(texts)] == want and passes.counts(pa.array([], pa.string()))[0].tolist() == []
    odd = df.limit(1).select(F.unhex(F.lit("61FF20E4B8")).cast("string").alias("t"))
    assert odd.select(layout.measured(F.col("t"))["chars"], F.length(passes.squeezed(F.col("t")))).first()[0] == 3


def test_a_page_is_read_by_few_passes_and_one_text_is_squeezed(spark):
    pages = spark.createDataFrame([(1, 1, "x", "scanned", None, "y", "z")], "doc_id long, page int, text string, kind string, headings array<string>, vlm_text string, ocr_text string")
    said = plan(layout.route(pages))
    assert said.count("_squeezed(") == 1 and said.count("_counted(") == 3 and "ArrowEvalPython" in said
    assert said.count("regexp_replace") <= 3  # of 300 characters, for their language
    assert T.language(F.col("text"))._jc.toString().startswith("CASE WHEN and(and(and(rlike(text")


def test_language_counts_only_texts_with_hangul(spark):
    plain = lambda t: "ko" if len(t.strip()) >= 10 and sum("가" <= c <= "힣" or c.isascii() and c.isalpha() for c in t) and sum("가" <= c <= "힣" or "ᄀ" <= c <= "ᇿ" or "㄰" <= c <= "㆏" for c in t) / sum("가" <= c <= "힣" or c.isascii() and c.isalpha() for c in t) > 0.3 else "unknown"
    r = random.Random(9)
    said = ["".join(r.choices("abc 가나ᄀㅏ12", k=r.randint(0, 30))) for _ in range(400)] + ["only words of it", "ᄀᄁᄂ" * 5, "ㅏㅑㅓ" * 5 + "a"]
    assert [x[0] for x in spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(T.language(F.col("t"))).collect()] == [plain(t) for t in said]


def test_a_page_in_several_rows_is_routed_as_its_candidates_are_chosen(spark):
    r = random.Random(8)
    words = ["engine", "valve", "~~~~", "e~~", "reads", "　", "\n"]
    said = lambda: r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 60)))])
    pages = spark.createDataFrame([(i // 3, 1, said(), r.choice(["digital", "hybrid", "scanned"]), None, said(), said()) for i in range(240)], "doc_id long, page int, text string, kind string, headings array<string>, vlm_text string, ocr_text string")
    columns = ["doc_id", "method", "text", "kind", "reason", "chain", "heading"]
    assert rows(layout.route(pages).select(columns)) == rows(layout.choose(layout.candidates(pages)).select(columns))
    assert plan(layout._best(layout.candidates(pages).withColumns({"score": F.lit(1.0), "__most": F.lit(1.0)}))).count("Generate") == 1


@pytest.mark.parametrize("sample", [1, 7, 25, 1000])
def test_language_sample_moves_keys_not_texts(spark, sample):
    r = random.Random(sample)
    d = spark.createDataFrame([(r.choice([None, *range(12)]), r.choice(["the cat", "der hund", "le chat", None]), r.choice(["en", "de", "", None])) for _ in range(60)], "k long, text string, lang string").repartition(3)
    some = d.where("coalesce(lang, '') <> '' and text is not null").orderBy("k", "text", "lang").limit(sample)
    got = languages.fit(d, "k", sample)[0]
    assert got.count() > 0 and {x["gram"] for x in got.collect()} == {x[0] for x in some.select(F.explode(languages.grams(F.col("text")))).collect()}


def test_inverted_file_by_shuffle_equals_broadcast(spark, monkeypatch):
    r = random.Random(6)

    def unit():
        v = [r.gauss(0, 1) for _ in range(8)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    vectors = spark.createDataFrame([(i, unit()) for i in range(600)], "chunk_key long, embedding array<float>").repartition(3)
    queries = vectors.where("chunk_key % 20 = 0").selectExpr("chunk_key as query_id", "embedding as query_embedding")
    root, columns = snapshots.scratch(spark), ["query_id", "chunk_key", "score", "rank"]
    ivf.add(vectors, root, "a", lists=6)
    want = rows(R.vector_top_k(vectors, queries).select(columns))
    monkeypatch.setattr(ivf, "GROUPS", 2)
    found = ivf.certain(spark, root, queries, nprobe=2).select(columns)
    assert "BroadcastExchange" in plan(found) and "ShuffledHashJoin" in plan(found)
    assert rows(found) == want


def test_an_answer_holds_a_text_once(spark):
    chunks = spark.createDataFrame([(i, "d", "a.pdf", "library", 1, i, "", "en", f"[Document: a.pdf]\npart {i}" if i else " ") for i in range(4)], "chunk_key long, doc_id string, source string, source_type string, page int, chunk_index long, section string, lang string, text string")
    found = spark.createDataFrame([(q, k, 4 - k) for q in (1, 2) for k in range(4)], "query_id long, chunk_key long, rank int")
    asks = spark.createDataFrame([(1, True), (2, False), (3, True)], "query_id long, extract boolean")
    got = flow.told(found, chunks, asks)
    said = {x["query_id"]: x for x in got.collect()}
    assert set(said) == {1, 2} and said[1]["context"] is None and said[2]["all_text"] is None and said[1]["first_type"] == "library"
    assert said[1]["all_text"] == "part 3\n\npart 2\n\npart 1"  # blank text is left out
    line = "[Doc: a.pdf | Page: 1 | Section: Lang: en]".replace("Section: ", "Section:  | ")
    assert said[2]["context"] == "\n\n".join(f"{line}\n{t}" for t in ("part 3", "part 2", "part 1", ""))
    assert [s["chunk_key"] for s in said[1]["sources"]] == [3, 2, 1, 0]
    # one text a chunk goes to the task that makes the answer, and from there no further shuffle is due to meet the requests
    moved = plan(asks.join(got, "query_id"))
    assert "line:string" not in moved and moved.count("collect_list") == 2 and "hashpartitioning(query_id, extract" not in moved
