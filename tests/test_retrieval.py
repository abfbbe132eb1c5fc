import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import intents as I
from quillspark.functions import text as T
from quillspark.operators import flow
from quillspark.operators import retrieval as R
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_text_rules(spark):
    df = spark.createDataFrame([("안녕하세요 세계 여러분입니다", "E-401 foo_bar v2.0", "", "aaa")], "ko string, tech string, blank string, a string")
    r = df.select(T.language(F.col("ko")), T.tokens(F.col("tech")), T.gibberish_ratio(F.col("blank")), T.keyword_count(F.col("a"), F.lit("aa")), T.keyword_count(F.col("a"), F.lit("")), T.context_header(F.lit(None), F.lit("S"), F.lit(None), F.lit("unknown")), T.without_header(F.lit("[Document: x]\n body "))).first()
    assert list(r) == ["ko", ["e-401", "foo_bar", "v2.0"], 1.0, 1, 4, "[Document: unknown | Section: S | Page: ?]", "body"]
    assert math.isclose(spark.range(1).select(T.extraction_confidence(F.lit("ocr"), F.lit(30), F.lit(0.9)).alias("x")).first()["x"], 0.19)
    assert spark.range(1).select(T.without_images(F.lit(" a ![x](y)\n\n\n\nb ")), T.box(F.array(F.lit(1.26), F.lit(2.0))), T.box(F.lit(None).cast("array<double>"))).first()[:] == ("a \n\nb", "1.3,2.0", "")


def test_readable_characters(spark):
    """Every mark that counts, those that do not, and letters beyond."""
    good = [*".,:;!?()[]{}%/-_=+'\"@#&*", "a", "Z", "0", "가", "힯", "ᄀ", "ㄱ"]
    bad = [*"\\$<>~|`^", "é", "ß", "中", "²"]
    rows = spark.createDataFrame([(c,) for c in good + bad], "t string").select("t", T.gibberish_ratio(F.col("t")).alias("g")).collect()
    assert {r["t"] for r in rows if r["g"] == 0.0} == set(good) and {r["t"] for r in rows if r["g"] == 1.0} == set(bad)


def test_fusion_with_overlaps_ties_and_single_lists(spark):
    r = random.Random(4)
    vector, keyword = [], []
    for q in range(40):
        for rows in (vector, keyword):
            keys = r.sample(range(7), r.randint(0, 4))
            scores = sorted((round(r.choice([-0.4, -0.1, 0.2, 0.5, 0.5, 0.9]), 6) for _ in keys), reverse=True)
            rows += [(q, k, s if rows is vector else abs(s) * 9, i) for i, (k, s) in enumerate(zip(keys, scores), 1)]
    schema = "query_id long, chunk_key long, score double, rank int"
    fused = R.fuse(spark.createDataFrame(vector, schema), spark.createDataFrame(keyword, schema)).cache()
    strong = spark.createDataFrame([(q, q % 3 == 0) for q in range(40)], "query_id long, strong boolean")
    sure = {x["query_id"]: x["confidence"] for x in R.confidence(fused, strong).collect()}
    both = 0
    for q in range(40):
        found = {}
        for name, rows in (("v", vector), ("k", keyword)):
            for _, key, score, rank in (x for x in rows if x[0] == q):
                e = found.setdefault(key, {"rrf": 0.0, "v": 0.0, "k": 0.0, "in": set()})
                e["rrf"] += 1 / (60 + rank)
                e[name] = max(e[name], score)
                e["in"].add(name)
        want = sorted(found.items(), key=lambda e: (round(e[1]["rrf"], 9), e[1]["v"], e[1]["k"]), reverse=True)[:4]
        got = sorted((x for x in fused.collect() if x["query_id"] == q), key=lambda x: x["rank"])
        assert [x["chunk_key"] for x in got] == [k for k, _ in want]
        assert all(math.isclose(x["rrf_score"], e["rrf"], abs_tol=1e-8) and x["in_vector"] == ("v" in e["in"]) for x, (_, e) in zip(got, want))
        if not want:
            assert q not in sure
            continue
        top = next((s for i, _, s, n in vector if i == q and n == 1), 0.0)
        c = max(0.0, top)
        if len(want[0][1]["in"]) == 2:
            both += 1
            c = max(c, min(1.0, top + 0.15))
        assert math.isclose(sure[q], min(1.0, max(c, 0.75 if q % 3 == 0 else 0.0)), abs_tol=1e-6)
    assert both > 5


def test_vectors_in_blocks_and_scopes(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[7] = m[3]
    v = spark.createDataFrame([(f"c{i:03}", m[i].tolist(), f"s{i % 4}", i % 10) for i in range(300)] + [("none", None, "s1", 1)], "chunk_key string, embedding array<double>, source string, doc_id long").repartition(3)
    asked = [(q, m[q].tolist(), "s1" if q % 3 == 1 else None, 3 if q % 3 == 2 else None) for q in range(20)]
    got = {}
    for x in R.vector_top_k(v, spark.createDataFrame(asked, "query_id int, query_embedding array<double>, source string, doc_id long"), 4, size=32).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["chunk_key"], x["score"])
    for q, e, s, d in asked:
        scored = sorted(((-round(1 - (2 - 2 * float(np.dot(m[i], e))) / math.sqrt(2), 6), f"c{i:03}") for i in range(300) if (s is None or f"s{i % 4}" == s) and (d is None or i % 10 == d)))[:4]
        assert [got[q][k] for k in range(1, 5)] == [(c, -x) for x, c in scored]


def test_all_vectors_as_queries_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[40:60] = m[3]  # equal scores: the smaller keys are taken
    rows = [(i, m[i].tolist(), f"s{i % 4}") for i in range(300)]
    v = spark.createDataFrame(rows, "chunk_key long, embedding array<double>, source string").repartition(3)
    q = spark.createDataFrame([(i, e, s if i % 3 == 1 else None) for i, e, s in rows], "query_id long, query_embedding array<double>, source string").repartition(2)
    ids = lambda found: {i: [(x["chunk_key"], x["score"]) for x in sorted((x for x in found if x["query_id"] == i), key=lambda x: x["rank"])] for i in range(300)}
    few = ids(R.vector_top_k(v, q, 4, size=16).collect())
    monkeypatch.setattr(R, "BLOCKS", 2)
    parts = R.vector_top_k(v, q, 4, size=16)
    assert "CartesianProduct" in parts._jdf.queryExecution().executedPlan().toString()
    s = np.round(1 - (2 - 2 * (m @ m.T)) / math.sqrt(2), 6)
    for i, got in ids(parts.collect()).items():
        want = sorted((-float(s[i, j]), j) for j in range(300) if i % 3 != 1 or j % 4 == i % 4)[:4]
        assert [(k, -x) for x, k in want] == got == few[i]


def test_confidence_asks_the_vector_of_every_question(spark, tmp_path):
    lengths = {0: 1.0, 7: 0.8, 13: 0.9, 50: 1.0, 51: 0.2}  # a vector of length a has a * a with itself, and 0 with the others
    vectors = {i: [a if j == n else 0.0 for j in range(5)] for n, (i, a) in enumerate(lengths.items())}
    docs = [(7, "pump shaft seal", "en", "s", 15), (13, "gear", "en", "s", 4)]
    asked = [(7, "zebra"), (13, "gear"), (60, "pump shaft"), (61, "unheard")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("embeddings", list(vectors.items()), "vec_id long, embedding array<float>"), ("benchmark", asked, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    score = {i: 1 - (2 - 2 * a * a) / math.sqrt(2) for i, a in lengths.items()}
    want = {i: s for i, s in score.items() if s >= 0.3}  # 51 has none that is relevant
    want[13] = min(1.0, max(score[13] + 0.15, 0.75))  # in both lists, and a strong hit
    want[60] = 0.75  # without a vector
    got = {x["query_id"]: x["confidence"] for x in entry.queries()["confidence"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in want)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert dict(con.execute(catalog.ORACLES["confidence"]).fetchall()) == pytest.approx(want, abs=1e-6)


CHUNKS = "chunk_key long, doc_id string, source string, source_type string, page string, chunk_index long, section string, lang string, text string"


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [(i, "big", "big.pdf", "library", str(i % 4), i, "", "en", f"[Document: big.pdf | Page: {i}]\npart {i} about engines and valves number{i}") for i in range(8)]
    rows += [(20, "note", "note.png", "upload", None, 1, "Top", "ko", " second part "), (21, "note", "note.png", "upload", "1", 0, None, "ko", "첫 부분 E-401")]
    rows += [(30, "one", "one.png", "upload", "1", 0, None, None, "alone"), (40, "blank", "blank.png", "upload", "1", 0, None, None, " ")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    vectors = spark.createDataFrame([(r[0], [1.0, 0.0] if r[0] < 4 else [0.0, 1.0], r[2], r[1]) for r in rows], "chunk_key long, embedding array<double>, source string, doc_id string")
    return chunks, vectors


def test_whole_document_order(spark, shelf):
    r = spark.createDataFrame([(1, "note.png", None), (2, None, "note"), (3, "note.png", "big"), (4, "", ""), (5, "gone", None), (6, "big.pdf", None)], "query_id int, source string, doc_id string")
    got = {}
    for x in flow.whole_document(r, shelf[0]).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["chunk_key"])
    assert got == {1: [21, 20], 2: [21, 20], 6: [0, 4, 1, 5, 2, 6, 3, 7]}
    assert {x["query_id"]: x["n_chunks"] for x in flow.chunk_counts(r, shelf[0]).collect()} == {1: 2, 2: 2, 6: 8}


def test_chat_flow_branches(spark, shelf):
    asks = [
        (1, "Extract the text.", "note.png", None), (2, "Extract the text.", "gone.png", None), (3, "hello, extract the text", "note.png", None), (4, "valves", "big.pdf", None), (5, "zebra", "big.pdf", None), (6, "Summarize", "big.pdf", None),
        (7, "elephant", "note.png", None), (8, "weather", None, None), (9, "weather", None, "one"), (10, "weather", "one.png", None), (11, None, None, None), (12, "문서", "big.pdf", None), (13, "E-401", None, None), (14, "Extract the text.", None, "blank"),
    ]
    r = spark.createDataFrame([(*a, "", "") for a in asks], "query_id int, text string, source string, doc_id string, history string, system string")
    q = spark.createDataFrame([(a[0], [-1.0, 0.0]) for a in asks], "query_id int, query_embedding array<double>")
    web = spark.createDataFrame([(a[0], "- w") for a in asks], "query_id int, results string")
    got = {x["query_id"]: x for x in flow.chat_flow(r, *shelf, q, web).collect()}
    keys = lambda n: [s["chunk_key"] for s in got[n]["sources"]]
    assert got[1]["mode"] == "ocr_extract" and got[1]["answer"] == f"{I.EXTRACTED_KO}\n\n첫 부분 E-401\n\nsecond part" and keys(1) == [21, 20] and got[1]["prompt"] is None
    assert got[2]["answer"] == I.NOT_FOUND_EN.replace("%s", "gone.png") and got[2]["mode"] == "document_qa" and keys(2) == []
    assert got[3]["answer"] is None and got[3]["active_source"] == "note.png"  # small talk drops the scope
    assert got[4]["answer"] == I.NOT_FOUND_EN.replace("%s", "big.pdf") or got[4]["confidence"] >= 0.75
    assert got[5]["answer"] == I.NOT_FOUND_EN.replace("%s", "big.pdf") and got[5]["mode"] == "document_qa"
    assert got[6]["mode"] == "document_qa" and keys(6) == [0, 4, 1, 5, 2, 6, 3, 7] and got[6]["confidence"] == 1.0 and "[Document:" not in got[6]["prompt"]
    assert keys(7) == [21, 20] and "[Doc: note.png | Page: ? | Section: Top | Lang: ko]\nsecond part" in got[7]["prompt"]
    assert got[8]["mode"] == "web_search" and "[Web search results]\n- w" in got[8]["prompt"] and keys(8) == []
    assert got[9]["mode"] == "document_qa+web" and got[10]["mode"] == "document_qa"  # a doc_id alone lets the search through
    assert got[11]["mode"] == "general" and got[12]["answer"] == I.NOT_FOUND_KO.replace("%s", "big.pdf")
    assert got[13]["mode"] == "document_qa" and keys(13) == [21] and got[13]["confidence"] == 0.75
    assert got[14]["mode"] == "ocr_extract" and got[14]["answer"] == I.NOT_FOUND_EN.replace("%s", "blank.png") and keys(14) == [40]


def test_strong_hit_by_plain_python(spark):
    r = random.Random(1)
    vocabulary = ["a", "bb", "cc", "d-1", "ee", "x_y", "v2.0", "zz"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 4))), r.choice([None, "d"]), " ".join(r.choices(vocabulary, k=3))) for i in range(80)]
    q = spark.createDataFrame([(i, t, d) for i, t, d, _ in rows], "query_id long, text string, doc_id string")
    c = spark.createDataFrame([(i, t) for i, _, _, t in rows], "chunk_key long, text string")
    got = {x["query_id"]: x["strong"] for x in R.strong_hit(q, q.select("query_id", F.col("query_id").alias("chunk_key")), c).collect()}
    for i, t, d, said in rows:
        tokens = [w for w in t.split() if len(w) >= 2]
        hits = [w for w in tokens if w in said.split()]
        want = bool(hits) and (any(any(ch.isdigit() or ch in "-_" for ch in w) for w in hits) or bool(d) or len(hits) >= min(len(tokens), 2))
        assert got[i] == want, (t, said, d)
    assert len({*itertools.chain(got.values())}) == 2
