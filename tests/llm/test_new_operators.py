"""URL filters, prefix trie and structure repair against SQL and plain Python, with edges."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb

from quillspark.llm import oracles, structure, trie, urls

CONV = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- 11


def test_urls_parts_and_rules(spark):
    cases = [
        ("http://A.Example.ORG/en/1x?q", "a.example.org", "/en/1x", "example.org/en/1"), ("https://example.org/es/#a", "example.org", "/es/", "example.org/es/"), ("x://y.com/fr/a", "y.com", "/fr/a", "com/fr/"),
        ("http://com/de/", "com", "/de/", "com/de/"), ("http://xcom/de/", "xcom", "/de/", None), ("http://b.org", "b.org", "", None), ("http://b.org/", "b.org", "/", "org/"), ("http://b.org?x://c.com/fr/", "b.org", "", None),
        ("a.com/fr/", "", "", None), (None, "", "", None), ("", "", "", None), ("http://ÀB.org:80/é", "Àb.org:80", "/é", None), ("://", "", "", None), ("http:///fr/", "", "/fr/", None), ("a\nb://c.org/\n?", "c.org", "/\n", "org/"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)] + [(None, "http://b.org/", "y"), (0, cases[0][0], "x")], "page_id long, url string, host string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad boolean"))
    want = Counter((i, h, p, r) for i, (_, h, p, r) in enumerate(cases)) + Counter([(None, "b.org", "/", "org/"), (0, *cases[0][1:])])
    assert bag(got, "page_id", "host", "path", "rule") == want
    assert all(r["verdict"] == dict((rule, v) for v, rule in urls.RULES).get(r["rule"], "allow") for r in got.collect())


def test_urls_levels(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com.": ("example.com", "com"), "u@z.net:81": ("z.net", "net"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "local": ("local", "local"), "": ("", "")}
    domain, suffix = urls.levels(spark.range(1)["id"].cast("string"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = urls.levels(rows["host"])
    assert {r[0]: (r[1], r[2]) for r in rows.select("host", domain, suffix).collect()} == hosts


def test_urls_against_sql(spark):
    r = random.Random(4)
    hosts = [f"{a}.{b}.{s}" for a in "xyz" for b in ("good", "bad", "mixed") for s in ("com", "net", "co.uk")]
    pages, labels = [], []
    for i in range(900):
        h = hosts[0] if i % 3 == 0 else r.choice(hosts)
        pages.append((i, r.choice(["http://", "HTTPS://"]) + h.upper() + r.choice(["/fr/a", "/de/b", "/en/1", "", "?q", "/x#y"])))
        if r.random() < 0.7:
            bad = r.random() < (0.9 if "bad" in h else 0.05 if "good" in h else 0.5)
            labels.append((i, None if r.random() < 0.05 else int(not bad), None if r.random() < 0.05 else 0))
    pages += [(5, None), (None, "http://x.bad.net/"), (5, pages[5][1])]
    labels += [(5, 0, 0), (5, 1, 0), (None, 0, 1)]
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge(p.repartition(3), urls.outcomes(lab))
    con = duckdb.connect()
    con.sql("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", pages)
    con.sql("create table labels(doc_id bigint, quality int, toxic int)")
    con.executemany("insert into labels values (?, ?, ?)", labels)
    want = con.sql(oracles.ORACLES["op11_urls"])
    assert bag(got, *want.columns) == Counter(want.fetchall())
    verdicts = {(x["host"], x["verdict"]) for x in got.where("rule is null").collect()}
    assert ("x.bad.net", "block") in verdicts and ("x.good.net", "allow") in verdicts
    assert urls.judge(p.where("false"), urls.outcomes(lab)).count() == 0


def test_urls_shrink_by_domain(spark):
    """A host without labels goes by its domain where hosts are like their domain."""
    rows = [(f"h{i}.bad.com", 1000, 950) for i in range(20)] + [(f"h{i}.ok{i}.com", 1000, 20) for i in range(60)] + [("new.bad.com", 0, 0), ("new.com", 0, 0)]
    got = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, n long, bad long")).collect()}
    assert got["new.bad.com"]["bound"] > urls.MAX_BAD > got["new.com"]["bound"] and math.isclose(got["h3.bad.com"]["bad_rate"], 0.95, abs_tol=0.01)


# --- 12


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32], x))
    for c in own:
        own[c].sort(key=lambda k: k[:4])
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(math.fmod(c, 5)), [])
        whole[c] = [(k[2], k[4]) for k in base[:h] + turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = Counter(v[:-1] for v in members if v)
    leaves, saved = Counter(), Counter()
    for v, m in members.items():
        gain = (len(m) - 1) * len(v[-1][1].encode()) if v else 0
        for d in range(len(v) + 1):
            leaves[v[:d]] += v not in children
            saved[v[:d]] += gain
    return Counter((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), children[v], leaves[v], saved[v], hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()) for v, m in members.items())


def test_trie_of_random_conversations(spark):
    r = random.Random(8)
    for ids in (range(60), range(-30, 30), (7,)):
        rows = []
        for c in ids:
            for t in range(r.randint(1, 12)):
                rows.append((c, r.choice((t, t, t, 3, None)), r.choice(("user", "assistant", None)), r.choice(("é" * r.randint(0, 2), "b", "c", None))))
        rows += [(None, 1, "user", "x"), rows[0], rows[0]]
        df = spark.createDataFrame([(*x, "z") for x in rows], CONV + ", depth string").repartition(3)
        assert bag(trie.report(df), *trie.report(df).columns) == brute_trie(rows)
    assert trie.report(df.where("false")).count() == 0


def test_trie_of_copies_and_long_conversations(spark):
    """A third of all conversations are copies, spread over shards; others share hundreds of turns over several segments, also whole segments, and end inside and at their edges."""
    r = random.Random(9)
    text = [f"t{i}" for i in range(900)]
    rows = [(c, t, "user", f"same{t}") for c in range(0, 400, 5) for t in range(3)]
    for c, n, until in ((1000, 700, 700), (1005, 700, 650), (1010, 512, 512), (1015, 256, 256), (1020, 800, 300), (1025, 257, 257), (1030, 700, 700), (1035, 513, 512), (1040, 520, 3)):
        rows += [(c, t, "user", text[t] if t < until else f"x{c}-{t}") for t in range(n)]
    rows += [(c, t, "user", r.choice("ab")) for c in range(2000, 2100) for t in range(r.randint(1, 9))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CONV).repartition(5)
    got, want = bag(trie.report(df), *trie.report(df).columns), brute_trie(rows)
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])


def test_turns_of_hot_blocks_have_their_place(spark):
    """Thousands of turns with one number, and some without."""
    rows = [(5, 1, "user", f"x{i % 3000}") for i in range(5000)] + [(5, None, "user", f"n{i}") for i in range(100)] + [(5, -2, "user", "first")] + [(6, 2, "a", "b")]
    got = defaultdict(list)
    for x in trie.turns(spark.createDataFrame(rows, CONV).repartition(3)).collect():
        got[x["conv_id"]].append((x["pos"], x["digest"]))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
    for c in (5, 6):
        want = [k[-1] for k in sorted((t is not None, t or 0, r, digest(r, x)) for i, t, r, x in rows if i == c)]
        assert [p for p, _ in sorted(got[c])] == list(range(len(want))) and [d for _, d in sorted(got[c])] == want


# --- 13

FORM = re.compile(r"(s?(ua)+)?")


def after_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        out[c] += [] if k == 0 else [(t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, repaired) by the least pair of cost and audit from the end on, each way tried."""
    found, n = faults(rows), len(rows)
    back = [{} for _ in range(n + 1)]
    nexts = {0: "ua"[0], 1: "u", 2: "a", 3: "u"}
    state = {"s": 1, "u": 2, "a": 3}
    names = {"u": "user", "a": "assistant"}

    def ways(i, q, left):
        x = nexts[q]
        if left:
            yield from ((2 + c, "I" + a, [f"{names[x]}:", *lines]) for c, a, lines in [best(i, state[x], left - 1)])
        if i == n:
            if q in (0, 3):
                yield 0, "", []
            return
        _, role, text = rows[i]
        cut = found[i] == "truncated"
        if found[i] not in ("blank", "duplicate"):
            p = role[:1]
            if (p == "s" and q == 0) or (p == "u" and q != 2) or (p == "a" and q == 2):
                c, a, lines = best(i + 1, state[p], 3)
                yield c + cut, "K" + a, [f"{role}:{text}", *lines]
            c, a, lines = best(i + 1, state[x], 3)
            yield 2 + cut + c, "R" + a, [f"{names[x]}:{text}", *lines]
        c, a, lines = best(i + 1, q, 3)
        yield 3 + c, "D" + a, lines

    def best(i, q, left):
        if (q, left) not in back[i]:
            back[i][q, left] = min(ways(i, q, left), key=lambda w: (w[0], w[1]), default=(10**9, "", []))
        return back[i][q, left]

    for i in range(n, -1, -1):
        for left in range(4):
            for q in range(4):
                best(i, q, left)
    return best(0, 0, 3)


def brute_structure(rows):
    damaged, out = after_damage(rows), Counter()
    for c in {x[0] for x in rows}:
        d = sorted(damaged[c], key=lambda x: (x[0] is not None, x[0] or 0))
        n = Counter(faults(d))
        turns = {t for t, *_ in d if t is not None}
        initials = [role[:1] for _, role, _ in d]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(d)
        out[c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()] += 1
    return out


def test_structure_of_random_conversations(spark):
    r = random.Random(3)
    texts = ["a.", "b!", "c? ", "cut", "\t ", "", None, "d .\n", "e.x"]
    rows = []
    for c in [*range(150), None]:
        for t in sorted(r.sample(range(40), r.randint(1, 14))):
            rows.append((c, None if t == 0 else t, r.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None)), r.choice(texts)))
    df = spark.createDataFrame([(*x, 1) for x in rows], CONV + ", cost int").repartition(3)
    assert bag(structure.report(df), *structure.report(df).columns) == brute_structure(rows)
    assert structure.report(df.where("false")).count() == 0


def test_structure_is_least_among_all_edits():
    """The integer programme against every edit string, by enumeration."""
    r = random.Random(6)

    @functools.cache
    def every(codes, q, left):
        found = [(0, "")] if not codes and q in (0, 3) else []
        if left:
            found += [(2 + c, "I" + a) for c, a in every(codes, structure.following(q), left - 1)]
        if codes:
            initial, fault = divmod(ord(codes[0]) - 65, 4)
            found += [(3 + c, "D" + a) for c, a in every(codes[1:], q, 2)]
            if fault not in (1, 2):
                cut = fault == 3
                if (initial, q) in ((0, 0), (1, 0), (1, 1), (1, 3), (2, 2)):
                    found += [(cut + c, "K" + a) for c, a in every(codes[1:], initial + 1, 2)]
                found += [(2 + cut + c, "R" + a) for c, a in every(codes[1:], structure.following(q), 2)]
        return tuple(found)

    for _ in range(150):
        codes = "".join(chr(65 + r.randrange(16)) for _ in range(r.randint(0, 5)))
        cost, told = structure.solved([codes] if codes else [])
        assert (cost, "".join(a for _, a in told)) == min(every(codes, 0, 2)), codes
        cut = sorted(r.sample(range(1, len(codes)), min(2, len(codes) - 1))) if len(codes) > 1 else []
        pieces = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)], strict=True)] if codes else []
        other, parts = structure.solved(pieces)
        assert (other, "".join(a for _, a in parts)) == (cost, "".join(a for _, a in told))


def test_structure_of_a_long_conversation(spark):
    """Several blocks and pieces, rows of one turn by the thousand, a text of megabytes, and all rows dropped."""
    r = random.Random(12)
    rows = [(1, t, r.choice(("user", "assistant", "system")), r.choice((f"t{t}.", "cut", f"x{t % 7}!", " "))) for t in range(-1500, 2500)]
    rows += [(1, None, "user", "first.")] + [(2, 7, "user", "hot.") for _ in range(4500)] + [(2, 8, "assistant", "yes.")] + [(3, 1, "user", "é" * 3_000_000)]
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "a."))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, CONV).repartition(4)
    got, want = bag(structure.report(df), *structure.report(df).columns), brute_structure(rows)
    assert got == want and (gone, 0, 0, 0, 0, 0, 0, "", EMPTY) in got
