"""License notices: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are words in lower case without ASCII punctuation; shingles are five words. For each template length class there
are windows of twice as many words that start every half of them, so any notice lies whole in a window. Retrieval compares
least values under one hash per band: a template's are fixed, so for each band the chance is known that none of a window's other shingles is
less. Each template has as many bands as it takes until a window that holds just 80 % of it, the rest of it unlike, disagrees in all
with a chance of ``MISS`` at most: of a thousand million pairs that count, one may not be retrieved. A retrieved pair counts if at
least 80 % of the template's shingles are in the window.

Nulls and edges: a null or short text has no window with a shingle and no match. Every row gets a result, repeated rows the
same. An empty table gives an empty result; extra columns are ignored. Templates are a parameter of bounded size: short notices as they stand
in texts, and whole texts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import LOWER, grams, mix, runs, word_hashes, word_spans
from quillspark.llm.common import text_of
from quillspark.llm.license_texts import WHOLE

SHINGLE, PERCENT = 5, 80
#: Bound on the chance that a template is not retrieved for a window that holds enough of it.
MISS = 1e-9
#: Short notices as they stand in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | WHOLE
MARKS = np.zeros(256, bool)
MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def seeds(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def signature(g: np.ndarray, window: int, percent: int) -> np.ndarray:
    """The least value of a template's shingles under each of its bands' hashes, for windows of at most so many shingles."""
    common, n = max(1, -(-percent * len(g) // 100)), 64
    while True:
        least = np.array([mix(g * k).min() for k in seeds(n)])
        agree = common / len(g) * (1 - least / 2.0**64) ** max(0, window - common)
        enough = np.flatnonzero(np.cumprod(1 - agree) <= MISS)
        if len(enough):
            return least[: enough[0] + 1]
        n *= 2


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle at each word, starts, ends, place of each text's first word); marks count as space, so that "BY-NC" is two words."""
    plain = np.where(MARKS[raw], np.uint8(32), raw)
    s, e, w = word_spans(plain, offsets)
    return grams(word_hashes(plain, s, e, LOWER), SHINGLE), s, e, w


def prepared(templates: dict[str, str], percent: int = PERCENT) -> dict[int, list[tuple[str, np.ndarray, np.ndarray]]]:
    """By window length: (name, sorted distinct shingles, their least value under each hash)."""
    out: dict[int, list] = {}
    for name, text in templates.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        g, s, *_ = shingles(raw, np.array([0, len(raw)]))
        if not len(g):
            raise ValueError(f"{name}: a template needs {SHINGLE} words")
        half = 1 << max(3, (len(s) - 1).bit_length())
        g = np.unique(g)
        out.setdefault(2 * half, []).append((name, g, signature(g, 2 * half - SHINGLE + 1, percent)))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, ``matches``: array of (license, start, end, containment in percent), for each notice, its best window, the first in a tie; notices of one license do not overlap. Places are words of the text."""
    by_width = prepared(TEMPLATES if templates is None else templates, percent)
    every = [t for own in by_width.values() for t in own]
    rivals = {n: [m for m, y, _ in every if m != n and 2 * np.isin(x, y).sum() >= max(len(x), len(y))] for n, x, _ in every}

    def find(g: np.ndarray, w: np.ndarray) -> list[list[dict]]:
        found: list[dict[str, list]] = [{} for _ in range(len(w) - 1)]
        for width, own in by_width.items():
            step, first, last, text = width // 2, [], [], []
            keys = seeds(max(len(t[2]) for t in own))
            for i, (a, b) in enumerate(zip(w[:-1].tolist(), w[1:].tolist(), strict=True)):
                if b - a >= SHINGLE:
                    at = np.arange(a, max(a + 1, b - step), step)
                    first.append(at)
                    last.append(np.minimum(at + width, b) - SHINGLE + 1)
                    text.append(np.full(len(at), i))
            if not first:
                continue
            first, last, text = map(np.concatenate, (first, last, text))
            last = np.maximum(last, first + 1)
            # only a window that holds some template's least shingle can agree with it in a band
            wanted = np.unique(np.concatenate([t[1] for t in own]))
            place = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
            hits = np.concatenate([[0], np.cumsum(wanted[place] == g)])
            for k in np.flatnonzero(hits[last] > hits[first]).tolist():
                x = np.unique(g[first[k] : last[k]])
                least = None
                for name, t, fixed in own:
                    if least is None:
                        with np.errstate(over="ignore"):
                            least = mix(x[None, :] * keys[:, None]).min(1)
                    if not (least[: len(fixed)] == fixed).any():
                        continue
                    share = 100 * np.isin(t, x, assume_unique=True).sum() // len(t)
                    if share >= percent:
                        a = int(first[k] - w[text[k]])
                        found[text[k]].setdefault(name, []).append((a, int(last[k] - first[k]) + SHINGLE - 1 + a, int(share)))
        return [[{"license": n, "start": a, "end": b, "percent": p} for n, a, b, p in settled(f)] for f in found]

    def settled(found: dict[str, list]) -> list[tuple]:
        """Of overlapping notices of one license the best; of templates much alike, such as two versions, the one that fits better where they overlap."""
        best = []
        for name, spans in found.items():
            kept = []
            for a, b, p in sorted(spans, key=lambda x: (-x[2], x[0])):
                at = bisect_left(kept, (a, b, p))
                if not (at and kept[at - 1][1] > a) and not (at < len(kept) and kept[at][0] < b):
                    kept.insert(at, (a, b, p))
            best += [(name, *k) for k in kept]
        if not any(m in found for n in found for m in rivals[n]):
            return sorted(best)
        best.sort(key=lambda x: x[1])
        out, longest = [], max(b - a for _, a, b, _ in best)
        starts = [a for _, a, _, _ in best]
        for n, a, b, p in best:
            near = best[bisect_left(starts, a - longest) : bisect_left(starts, b)]
            if not any(m in rivals[n] and q > p and c < b and a < d for m, c, d, q in near):
                out.append((n, a, b, p))
        return sorted(out)

    match = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("percent", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, raw, at in runs(b.column(1)):
                g, _, _, w = shingles(raw, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(find(g, w), match)], ["doc_id", "matches"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))
    return d.mapInArrow(work, "doc_id long, matches array<struct<license:string,start:long,end:long,percent:long>>")


def report(docs: DataFrame) -> DataFrame:
    m = F.col("matches")
    names = F.array_distinct(F.transform(m, lambda x: x["license"]))
    return scan(docs).select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], x["percent"])), ",").alias("spans"))
