"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping in each kind; a match that its
check refuses is dropped and not tried again. Beyond these, an IBAN counts when its mod-97 checksum holds: words in upper
case may follow it, so it ends where its country's length says, or else with the last group at which the checksum holds; where it holds
at none, the search goes on at the next character. A
national number in the form 3-2-4 digits when words nearby call for it. Secrets are cloud and service keys by their prefix, signed tokens
whose first part decodes to a header, private-key blocks, and values given to names such as password or token when they mix
letters and digits with enough entropy (the value is the span); of secrets that overlap the first counts.

Nulls and edges: a null text is empty and has no spans. Texts are searched whole, in time linear in their length.
Repeated rows are searched each on its own. An empty table gives an empty result; extra columns pass through
``scan`` untouched only when asked for by name. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_LENGTH = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,250})(?![A-Za-z0-9])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}")
ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})", re.I)
NAMES = ("passw", "pwd", "secret", "token", "key")
BEGIN = re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----")
#: Bits a character that the value of a secret has at least.
ENTROPY = 2.5

#: Score before and after words nearby are looked at; a span counts from THRESHOLD up.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.4, "secret": 0.8}
NEAR = {
    "email": ("mail", "contact", "correo", "courriel"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "fax"), "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"), "national": ("ssn", "social", "security", "national"), "secret": ("key", "secret", "token", "password"),
}
AGAINST = {"ip": ("version", "release", "section"), "card": ("order", "isbn", "serial"), "national": ("order", "part", "serial"), "secret": ("example", "sample")}
REACH, BONUS, THRESHOLD = 40, 0.2, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    m = IBAN.search(text)
    while m:
        start, ends, size = m.start(), {}, 0
        for group in re.finditer("[A-Z0-9]+", m[0]):
            size += len(group[0])
            if size >= 15 and mod97(m[0][: group.end()]):
                ends[size] = start + group.end()
        end = ends.get(IBAN_LENGTH.get(m[0][:2]), max(ends.values(), default=None))
        if end:
            yield start, end
        m = IBAN.search(text, end or start + 1)


def entropy(value: str) -> float:
    """Bits a character, from the value's own characters."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def header(part: str) -> bool:
    """Whether the first part of a signed token is base64 of a JSON object that names its algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False


def secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for m in KEY.finditer(text)]
    if "eyJ" in text:
        found += [m.span() for m in SIGNED.finditer(text) if header(m[1])]
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [m.span(1) for m in ASSIGNED.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]) and entropy(m[1]) >= ENTROPY]
    at, open_ = 0, set()
    for m in BEGIN.finditer(text):
        end = f"-----END {m[1]}PRIVATE KEY-----"
        if m.start() < at or end in open_:
            continue
        stop = text.find(end, m.end())
        if stop >= 0:
            at = stop + len(end)
            found.append((m.start(), at))
        else:
            open_.add(end)  # none follows any later start either
    at = 0
    for start, end in sorted(found):
        if start >= at:
            yield start, end
            at = end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain, and the run of local characters before it as far as the last match or @: what the pattern finds, without its retries."""
    low = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        low = max(low, text.rfind("@", low, at) + 1)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at:
            yield start, m.end()
            low = m.end()
        else:
            low = at + 1


def confidence(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()
    near = re.findall(r"[a-z]+", around)
    score = PRIOR[kind] + BONUS * any(w in near for w in NEAR[kind]) - BONUS * any(w in near for w in AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, score), by kind as in KINDS, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    runs = [m.span() for m in CARD.finditer(text)]
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for a, b in runs:
        if b - a >= 16:
            digits = text[a:b].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", a, b))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    if runs:
        found += [("iban", a, b) for a, b in ibans(text)]
        found += [("national", *m.span()) for m in NATIONAL.finditer(text)]
    found += [("secret", a, b) for a, b in secrets(text)]
    scored = [(*s, confidence(s[0], text, s[1], s[2])) for s in found]
    return [s for s in scored if s[0] in BASE or s[3] >= THRESHOLD]


def mask(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def scan(docs: DataFrame, keep: list[str] = ("doc_id",), redact: bool = False) -> DataFrame:
    """The columns ``keep`` (not text) and ``spans``; with ``redact`` also ``text``, masked (a null stays null)."""
    picked = docs.select(*[docs[c].alias(f"__k{i}") for i, c in enumerate(keep)], docs["text"].cast("string").alias("__text"))
    kept = [f for f in picked.schema if f.name != "__text"]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = [find(t) if t else [] for t in texts]
                columns = [*part.columns[:-1], pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in f] for f in found], span)]
                names = [*part.schema.names[:-1], "spans"]
                if redact:
                    columns, names = [*columns, pa.array([t and mask(t, f) for t, f in zip(texts, found, strict=True)], pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + f", spans {SPAN}" + (", text string" if redact else "")
    out = picked.mapInArrow(work, schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "spans", *(["text"] if redact else []))


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of the base spans, and all spans, one row per document."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(s).alias("spans"), count("secret"), F.size(s).cast("long").alias("n_spans"))
