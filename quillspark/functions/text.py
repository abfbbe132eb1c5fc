"""Text and page-quality rules as Column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9._-]+|[가-힣]+"
#: Fixed value: characters that count as readable.
READABLE = r"A-Za-z0-9\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F.,:;!?()\[\]{}%/\-_=+\'\"@#&*"
#: White space as texts have it, no-break and wide spaces among it: the characters, and as a class of Java's and RE2's patterns.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same classes for Java's patterns alone: a first part in one or two ranges turns most characters away, so that a pass costs a fraction.
SPACE = r"[\x00-\x20\x7F-\uFFFF&&[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"
_ASCII = "".join(c if c.isalnum() else f"\\x{ord(c):02X}" for c in map(chr, range(128)) if c.isalnum() or c in ".,:;!?()[]{}%/-_=+'\"@#&*")
UNREADABLE = rf"[[^{_ASCII}]&&[^\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F]]"
MIN_CHARS, HYBRID_CHARS, GARBLED = 80, 150, 0.35
#: Confidence by extraction method, and for any other.
METHOD_CONFIDENCE, OTHER_CONFIDENCE = {"marker_pdf": 0.95, "text": 0.92, "vlm": 0.78, "ocr": 0.72, "ocr_image": 0.72}, 0.70


def tokens(text: Column) -> Column:
    """Lower-cased keyword tokens, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def bare(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def real_chars(text: Column) -> Column:
    return F.length(bare(text))


def garble(text: Column) -> Column:
    """Share of non-space characters that are not readable; 1 for blank text."""
    return let(bare(text), garble_of_bare)


def garble_of_bare(t: Column) -> Column:
    return garble_of(F.length(t), F.length(F.regexp_replace(t, UNREADABLE + "+", "")))


def garble_of(chars: Column, readable: Column) -> Column:
    return F.when(chars == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - readable / chars))


def gibberish_ratio(text: Column) -> Column:
    """``garble`` to three decimals."""
    return F.round(garble(text), 3)


def language(text: Column) -> Column:
    """``ko`` where over 30 % of letters are Hangul; else ``unknown`` (a provider may refine it). Text without any Hangul is not counted."""
    hangul = F.length(F.regexp_replace(text, r"[^가-힣ᄀ-ᇿ㄰-㆏]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z가-힣]+", ""))
    return F.when(F.rlike(text, F.lit("[가-힣ᄀ-ᇿ㄰-㆏]")) & (F.length(strip(text)) >= 10) & (letters > 0) & (hangul / letters > 0.3), "ko").otherwise("unknown")


def quality_flags(chars: Column, gibberish: Column, lang: Column) -> Column:
    return F.concat_ws(",", F.when(chars < MIN_CHARS, "low_text_yield"), F.when(gibberish > GARBLED, "garbled_text"), F.when((lang == "unknown") & (chars >= 40), "language_uncertain"))


def extraction_confidence(method: Column, chars: Column, gibberish: Column) -> Column:
    base = F.coalesce(*[F.when(method == m, F.lit(c)) for m, c in METHOD_CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE))
    raw = base - F.when(chars < 120, 0.08).otherwise(0.0) - F.when(chars < 40, 0.15).otherwise(0.0) - 0.6 * F.least(gibberish, F.lit(0.5))
    return F.round(F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.99)), 2)


def needs_fallback(kind: Column, chars: Column, gibberish: Column) -> Column:
    return (kind == "scanned") | (gibberish > GARBLED) | F.when(kind == "hybrid", chars < HYBRID_CHARS).otherwise(chars < MIN_CHARS)


def routing_reason(kind: Column, chars: Column, gibberish: Column) -> Column:
    parts = F.concat_ws("+", F.when(kind != "digital", kind), F.when(chars < MIN_CHARS, "low_text_yield"), F.when(gibberish > GARBLED, "garbled_text"))
    return F.when(parts == "", "quality_gate").otherwise(parts)


def candidate_score(method: Column, hint: Column, chars: Column, gibberish: Column, confidence: Column) -> Column:
    bonus = F.when(method == "text", F.when(hint == "digital", 45.0).otherwise(25.0)).when((method == "vlm") & hint.isin("scanned", "hybrid"), 20.0).when(method.startswith("ocr") & (hint == "scanned"), 10.0).otherwise(0.0)
    return F.round(chars * F.greatest(F.lit(0.2), 1 - F.least(gibberish, F.lit(0.7))) + 120 * confidence + bonus, 2)


def normalized(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), SPACES + "+", " "))


def keyword_count(text: Column, keyword: Column) -> Column:
    """Non-overlapping, case-folded; an empty keyword counts between all characters."""
    low, key = F.lower(text), F.lower(keyword)
    return F.when(F.length(key) == 0, F.length(low) + 1).otherwise(((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("long")).cast("long")


def context_header(source: Column, section: Column, page: Column, lang: Column) -> Column:
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    parts = F.concat_ws(" | ", F.concat(F.lit("Document: "), F.coalesce(some(source), F.lit("unknown"))), F.concat(F.lit("Section: "), some(section)), F.concat(F.lit("Page: "), F.coalesce(page.cast("string"), F.lit("?"))), F.concat(F.lit("Lang: "), F.when(lang != "unknown", some(lang))))
    return F.concat(F.lit("["), parts, F.lit("]"))


def without_header(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)\A\[Document:.*?\]\n", ""))


def without_images(text: Column) -> Column:
    """Markdown without image references and with one blank line in a row at most."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), "\n{3,}", "\n\n"))


def box(values: Column) -> Column:
    """Comma list of a bounding box, one decimal each; empty if there is none."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.format_string("%.1f", v)), ","), F.lit(""))
