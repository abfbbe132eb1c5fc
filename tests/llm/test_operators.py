"""Each operator against a brute-force version, over nulls, empties, ties, repeats, a long text and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import arrays, chat, common, fingerprints, licenses, mixing, neardup, packing, pii, quality, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, n_words long, size long"
W = re.compile(r"[^ \x09-\x0D]+")


def corpus():
    r = random.Random(3)
    vocabulary = ["the", "of", "and"] + ["".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, base, out = text(60), text(200).split(), []
    for i in range(40):
        out.append((i, text(r.randint(1, 150)) + (" " + passage if i % 7 == 0 else ""), "en", "s%d" % (i % 3)))
    for i in range(40, 60):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w), "fr", "hot"))
    out += [(60, None, None, None), (61, "", "en", "s1"), (62, "  \t\n", "en", "s1"), (63, "one", "xx", "s2"), (64, "One", "xx", "s2"), (65, text(9000), "en", "hot"), (66, out[3][1], "en", "hot"), (None, text(80), "en", None)]
    out += [(67, "a b " * 60, "en", "s0"), (67, "a b " * 60, "en", "s0"), (68, "\n".join(["same line"] * 40 + ["x"]), "de", "s1")]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, 0, None, 5, 7, 9) for x in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return W.findall(t or "")


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_empty_tables(spark, empty):
    for f in (pii.report, neardup.report, fingerprints.report, packing.report, substrings.report, mixing.report, licenses.report, quality.judge):
        assert f(empty).count() == 0, f
    assert chat.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii():
    r = random.Random(1)
    pieces = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "256.1.1.1", "001.02.3.4", "4337166598464399", "4337 1665-98464399", "+1 (988) 555-2485", "+", "é", " ", "-", "12", "@d.e", "a", "999999999999999"]
    for _ in range(3000):
        t = "".join(r.choices(pieces, k=r.randint(0, 12)))
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == plain_spans(t), t
    assert [s[0] for s in pii.find("pay to IBAN DE89 3704 0044 0532 0130 00 now")] == ["iban"]
    assert not pii.find("code DE88 3704 0044 0532 0130 00") and not pii.find("part 123-45-6789")
    assert pii.find("social security 123-45-6789")[0][0] == "national"
    assert pii.mask("to a@b.c, 1.2.3.4", pii.find("to a@b.c, 1.2.3.4")) == "to [EMAIL], [IP]"
    pii.find("a" * 300_000 + "@" + "1" * 300_000 + "@." * 100_000)  # in linear time


def test_pii_iban_among_words_in_upper_case():
    de, spaced, gb = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    for t, want in (
        (f"IBAN {spaced} BIC COBADEFFXXX", [spaced]), (f"IBAN {de} BIC COBADEFF", [de]), (f"{de} I paid", [de]), (f"{de} IS MINE", [de]), (f"A {gb} A B C D E F", [gb]),
        (f"{spaced} {gb} {de}", [spaced, gb, de]), (f"REF AB12 {spaced} OK", [spaced]), (f"XX12 3456 {de}", [de]), (f"{de}X", []), ("DE88370400440532013000 BIC", []), (f"X{de} I", []),
    ):
        found = [t[a:b] for kind, a, b, _ in pii.find(t) if kind == "iban"]
        assert found == want, t
    # of all pairs of letters that may follow, some make a longer checksum hold
    assert {t[a:b] for x in range(26**2) for t in [f"{de} {chr(65 + x // 26)}{chr(65 + x % 26)}"] for kind, a, b, _ in pii.find(t) if kind == "iban"} == {de}
    assert pii.mask(f"IBAN {spaced} BIC COBADEFFXXX", pii.find(f"IBAN {spaced} BIC COBADEFFXXX")) == "IBAN [IBAN] BIC COBADEFFXXX"
    pii.find("AB12 " * 200_000)  # in linear time


def test_near_duplicates(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.setdefault(i, []).append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(root), 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = Counter((i, len(sets[i][0]), find(i) if i is not None else None, i is not None and find(i) == i) for i, *_ in rows)
    assert bag(neardup.report(docs)) == want


def test_neardup_of_a_group_whose_members_are_not_all_linked(spark, monkeypatch):
    """Copies drift from one another, so stars miss links; small stars and limits make the rare branches run."""
    monkeypatch.setattr(neardup, "STAR", 16)
    monkeypatch.setattr(common, "HOT", 20)
    r = random.Random(8)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(120)], []
    for i in range(160):
        w = list(base)
        for k in r.sample(range(120), r.randint(3, 9)):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [set(itertools.pairwise(t.split())) for _, t in rows]
    least = list(range(160))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(range(160), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = sorted((find(i), find(j)))
            least[y] = x
    want = Counter((i, len(sets[i]), find(i), find(i) == i) for i in range(160))
    assert 5 < sum(find(i) == i for i in range(160)) < 155
    assert bag(neardup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_neardup_of_a_doc_id_with_several_texts(spark):
    """Such rows are one document for linking, and join what each of them is linked with."""
    r = random.Random(6)
    a, b, c, d = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(9, a), (9, b), (3, b), (5, a + " x"), (12, c), (12, None), (8, c), (14, d), (14, d), (15, "y z"), (15, "v w"), (None, a), (None, c)]
    got = bag(neardup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id", "kept"))
    comp = {9: 3, 3: 3, 5: 3, 12: 8, 8: 8, 14: 14, 15: 15, None: None}
    assert got == Counter((i, comp[i], i is not None and comp[i] == i) for i, _ in rows)


def plain_substrings(rows):
    seen = Counter(tuple(words(t)[k : k + 35]) for _, t, *_ in rows for k in range(len(words(t)) - 34))
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()] += 1
    return want


def test_substrings(docs, rows):
    assert bag(substrings.report(docs)) == plain_substrings(rows)


def test_substrings_of_a_doc_id_that_a_third_of_the_rows_share(spark):
    """Its rows are documents of their own, and some passages are found under that id alone."""
    r = random.Random(7)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = [text(50) for _ in range(3)]
    rows = [(1 if i % 3 == 0 else i, f"{text(20)} {shared[i % 3] if i % 4 == 0 else text(40)} {text(20)}") for i in range(150)] + [(1, None), (1, "short")]
    want = plain_substrings(rows)
    assert 20 < sum(n for (_, _, gone, _), n in want.items() if gone) < 60
    assert bag(substrings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_substrings_with_a_small_sketch_and_many_groups(docs):
    """Counters too few, so that nearly all windows are grouped; parts and groups many."""
    want = bag(substrings.report(docs))
    for options in ({"width": 1 << 6, "per_cell": 64, "group_bytes": 1 << 10}, {"width": 1 << 12, "group_bytes": 1 << 14}):
        assert bag(substrings.remove(docs.repartition(4), **options)) == want
    assert substrings.parts_for(0) == 1 and substrings.parts_for(10**12) * substrings.PART * 4 >= 10**12


def test_quality(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        t, w = t or "", words(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        rep = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if W.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    got = quality.judge(docs).cache()
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    assert not got.where("kept and base_failed").count()


def test_mixing(docs, rows):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, fixed, left = {}, set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in fixed]
        goal |= {s: (left * weight[s] / sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if goal[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * size[s]
            left -= goal[s]
        fixed |= set(over)
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows) and Counter(map(tuple, mixing.report(docs).collect())) == Counter(map(tuple, mixing.report(docs.repartition(5)).collect()))
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(9000, 0.1 * goal[s])


def plain_likeness(a, b):
    """From the texts themselves: the part of the longer one that common stretches at the grids' lengths cover."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    longest = lambda grid, same: max((g for g in grid if same(g)), default=0)
    first = longest([g for g in fingerprints.GRID if g <= min(len(a), len(b))], lambda g: a[:g] == b[:g])
    last = longest([g for g in fingerprints.GRID if g <= min(len(a), len(b))], lambda g: a[-g:] == b[-g:])
    one, two = {*range(first), *range(len(a) - last, len(a))}, {*range(first), *range(len(b) - last, len(b))}
    n = fingerprints.SPAN
    anchors = [dict(zip(*map(list, fingerprints.anchors_of(fingerprints.span_hashes(fingerprints.Prefixes(fingerprints.points(t))))))) if len(t) >= n else {} for t in (a, b)]
    for v in anchors[0].keys() & anchors[1].keys():
        p, q = int(anchors[0][v]), int(anchors[1][v])
        after = max(n, longest([g for g in fingerprints.REACH if p + g <= len(a) and q + g <= len(b)], lambda g: a[p : p + g] == b[q : q + g]))
        before = max(n, longest([g for g in fingerprints.REACH if g <= p + n and g <= q + n], lambda g: a[p + n - g : p + n] == b[q + n - g : q + n]))
        one |= set(range(p + n - before, p + after))
        two |= set(range(q + n - before, q + after))
    return round(min(len(one), len(two)) / max(len(a), len(b)), 6)


def in_order(spark, rows):
    """(doc_id, text) by (doc_id, hash of the text, text), null ids first."""
    hashed = spark.createDataFrame([(x[0], x[1] or "") for x in rows], "i long, t string").selectExpr("i", "t", "xxhash64(t) as h").collect()
    return sorted(((r["i"], r["t"], r["h"]) for r in hashed), key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))


def test_fingerprints(spark, docs, rows):
    order = in_order(spark, rows)
    want = Counter()
    for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        marks = [fingerprints.fingerprint(fingerprints.points(x)) for x in (t, edited)]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *marks, plain_likeness(t, edited), plain_likeness(t, n)] += 1
    got = fingerprints.report(docs).cache()
    assert bag(got) == want
    assert got.where("near_edited < 0.6 and n_chars > 100 or near_edited > 1").count() == 0
    a, b = fingerprints.points("xxhello world"), fingerprints.points("yhello there")
    assert fingerprints.Prefixes(a).common_extension(2, fingerprints.Prefixes(b), 1) == len("hello ")


def test_fingerprints_of_moved_and_edited_passages():
    r = random.Random(12)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    near = lambda a, b: fingerprints.likeness(*[fingerprints.fingerprint(fingerprints.points(x)) for x in (a, b)])
    for _ in range(60):
        a, b, c = text(r.randint(1, 900)), text(r.randint(1, 900)), text(r.randint(0, 300))
        for x, y in ((a + b, b + a), (a + c + b, a + b), (c + a, a), (a, b), (a + b, a + c), (a, "")):
            assert near(x, y) == near(y, x) == plain_likeness(x, y)
    assert near("x" * 500 + text(2000), "y" * 700) == 0.0
    passage = text(3000)
    assert near(text(500) + passage + text(500), text(700) + passage + text(300)) > 0.3


def test_fingerprints_of_one_row_and_of_many_rows_without_an_id(spark):
    one = fingerprints.report(spark.createDataFrame([(4, "only text")], "doc_id long, text string")).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(9, 1.0)]
    rows = [(None if i % 3 else i, f"text {i}") for i in range(300)]
    order = in_order(spark, rows)
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for (i, t, _), (_, n, _) in zip(order, order[1:] + order[:1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bag(fingerprints.report(df).select("doc_id", "edited_sha256")) == want
    assert max(r["count"] for r in fingerprints.with_next(df).where("__own").groupBy("__b").count().collect()) < 150


def test_ranges_do_not_depend_on_how_the_input_is_split(spark):
    r = random.Random(9)
    ids = [r.randrange(-(10**6), 10**15) for _ in range(4000)] + list(range(3000)) + [7] * 2000 + [None] * 1500 + [(1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(i,) for i in ids], "v long").withColumn("t", F.xxhash64(F.monotonically_increasing_id()))
    df = spark.createDataFrame(df.collect(), "v long, t long")
    found = [common.bounds(df.repartition(k), "v", "t", 16) for k in (1, 5)]
    assert found[0] == found[1] == sorted(set(found[0]))
    sizes = [x["count"] for x in df.groupBy(common.placed(F.col("v"), F.col("t"), found[0]).alias("k")).count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 2 * len(ids) / 16 and len(sizes) <= 48
    assert common.bounds(df.limit(0), "v", "t", 16) == [] and common.bounds(df.where("v = 7").limit(1), "v", "t", 4) == []


def test_packing(docs, rows):
    for lengths, k in (([1, 2, 3, 10, 11, 50], 3), ([5, 9, 9, 30, 31, 32, 80], 4), ([3], 2), ([], 2)):
        x, c = sorted(set(lengths)), Counter(lengths)
        cost = lambda ends: sum(c[v] * (min(e for e in ends if e >= v) - v) for v in x)
        best = min((cost((*e, x[-1])) for n in range(k) for e in itertools.combinations(x[:-1], n)), default=0) if x else 0
        ends = packing.boundaries(x, [c[v] for v in x], k)
        assert (cost(ends) if x else 0) == best and len(ends) <= k
    got = packing.report(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    batches = defaultdict(list)
    for r in got:
        batches[r["bucket"], r["batch"]].append(r)
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0]["padded_to"] <= packing.BUDGET
        assert sorted(r["slot"] for r in b) == list(range(len(b)))


def test_packing_pads_to_the_longest_document(spark):
    lengths = [0, 3, 500, 16384, 16385, 17001, 18111, 20020, 20021, 25003, 31007, 40009, 40010]
    got = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long").withColumn("text", F.lit("")), length=F.col("n"), extra=["n"]).collect()
    longest = defaultdict(int)
    for x in got:
        longest[x["bucket"]] = max(longest[x["bucket"]], x["length"])
    assert len(got) == len(lengths) and all(x["padded_to"] == longest[x["bucket"]] for x in got)


def legal_cost(roles):
    """Least cost by trying every choice."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for x in range(3):
                change = 0 if x == r else chat.RELABEL
                ways = [change] * (x in chat.NEXT[s]) + [change + chat.MERGE] * (x == s) + [change + chat.INSERT for y in chat.NEXT[s] if x in chat.NEXT[y]]
                for w in ways:
                    new[x] = min(new.get(x, 1 << 30), c + w)
        best = new
    return min(c + chat.INSERT * (chat.END - s) for s, c in best.items())


def test_chat(spark, monkeypatch):
    r = random.Random(2)
    talks = {i: [r.choice(["user", "assistant", "system", " User", "bot", None]) for _ in range(r.randint(1, 9))] for i in range(60)} | {99: [r.choice(["user", "assistant"]) for _ in range(2500)]}
    df = spark.createDataFrame([(i, t, x, None if t == 3 else f"m{t}", 1) for i, s in talks.items() for t, x in enumerate(s)], "conv_id long, turn long, role string, text string, block long")
    got = defaultdict(list)
    for x in chat.repair(df).collect():
        got[x["conv_id"]].append(x)
    for i, s in talks.items():
        out = sorted(got[i], key=lambda x: x["turn"])
        assert len(out) == len(s) and sum(x["cost"] for x in out) == legal_cost([chat.code(x) for x in s])
        heads = re.findall(r"<\|(system|user|assistant)\|>", "".join(x["piece"] for x in out))
        heads = heads[1:] if heads[0] == "system" else heads
        assert heads == ["user", "assistant"] * (len(heads) // 2)


def test_licenses(spark):
    t = licenses.TEMPLATES
    filler = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(i, f"{filler} {x} {filler}") for i, x in enumerate(t.values())] + [(50, filler), (51, None), (52, "the MIT License"), (53, t["MIT"].upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.report(df).collect()}
    assert all(name in got[i].split(",") for i, name in enumerate(t)) and (got[50], got[51], got[52], got[53]) == ("", "", "", "MIT")


def test_licenses_in_many_contexts_and_offsets(spark):
    """Whole notices and the shortest parts that count, each of which stands whole in a window, against exact containment."""
    templates = licenses.TEMPLATES | {f"K{i}": f"notice of kind number {i}" for i in range(24)}
    r, rows, want = random.Random(5), [], {}
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    for name, t in templates.items():
        w = re.findall("[A-Za-z0-9]+", t)
        part = " ".join(w[: -(-licenses.PERCENT * (len(w) - 4) // 100) + (4 if len(w) < 60 else 12)])  # in whole texts some shingles repeat
        for k in range(300 if len(w) < 60 else 40):
            want[len(rows)] = name
            rows.append((len(rows), f"{text(8 + k % 64)} {part if k % 2 else t} {text(40)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: {m["license"] for m in x["matches"]} for x in licenses.scan(df, templates).collect()}
    assert Counter(want[i] for i in want if want[i] not in got[i]) == Counter()


def test_warc(spark):
    big = "é" * 700
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, None, "x"), (4, "u", "x"), (5, "u", None), (6, "u", big + "1"), (2, "http://b/", big), (None, "n", big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, __url string")
    folder = warc.write(df, roll_bytes=200)
    rows = warc.read(spark, folder).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows) == Counter([(1, "revisit", 2, 1400), (2, "response", None, 1400), (2, "revisit", 2, 1400), (3, "response", None, 1), (4, "response", None, 1), (5, "response", None, 0), (6, "response", None, 1401), (None, "response", None, 1400)])
    assert all(r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest() for r in rows if r["payload"] is not None)
    again = warc.write(df.repartition(5), roll_bytes=200)
    files = lambda f: sorted(map(tuple, spark.read.parquet(f"{f}/manifest.parquet").collect()))
    assert files(folder) == files(again) and len(files(folder)) > 2


def test_word_spans():
    raw = "a b c\x0bd".encode()
    s, e, w = arrays.word_spans(__import__("numpy").frombuffer(raw, "u1"), __import__("numpy").array([0, 1, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(s, e)] == ["a", "b c", "d"] and w.tolist() == [0, 1, 3]


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES[:-1]:
        frame = stage(spark, frame, "").cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = Counter(r["doc_id"] for r in frame.collect())
    assert 0 < len(ids) and max(ids.values()) <= 2
    assert bag(p.STAGES[-1][1](spark, frame, "").select("doc_id")) == Counter({(k,): v for k, v in ids.items()})


def test_pipeline_decides_by_row(spark):
    """Rows that share a null or repeated doc_id are kept, dropped and copied each on its own."""
    import corpus_pipeline as p

    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcde", k=r.randint(2, 7))) for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    good = [(i, text(60 + k), "en", "s%d" % (k % 3), k) for k, i in enumerate([None] * 20 + [7] * 20)]
    bad = [(i, t, "en", "s1", 0) for i in (None, 7) for t in ("too short", None, "again " * 80)]
    docs = spark.createDataFrame(good + bad, schema).repartition(3)
    kept = p.quality_rules(spark, docs, "")
    assert bag(kept) == Counter(good) and kept.columns == docs.columns
    x = spark.createDataFrame(good, schema).repartition(3)
    want = Counter({(m["doc_id"], m["text"], m["source"]): m["copies"] for m in mixing.mix(x, extra=["text"]).collect() if m["copies"]})
    assert len(set(want.values())) > 1
    assert bag(p.mix_sources(spark, x, "").select("doc_id", "text", "source")) == want
