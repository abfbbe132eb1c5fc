"""Passes over whole texts in Arrow batches, where patterns cost several times as much: characters counted by a table of kinds, white space squeezed."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import READABLE, WHITE

#: Bytes of texts that are counted at a time (or one text), so that what a pass holds does not grow with its batch.
SLICE = 1 << 18
#: Without any of these a text has nothing to squeeze but its ends.
UNEVEN = ("  ", " \n", "\n ", "\n\n\n", *sorted(set(WHITE) - {" ", "\n"}))


@cache
def kinds() -> np.ndarray:
    """By code point: 0 white space, 1 readable, 2 any other, as the last one stands for all beyond."""
    found = np.full(0x10001, 2, np.uint8)
    found[[ord(c) for c in re.findall(f"[{READABLE}]", "".join(map(chr, range(0x10000))))]] = 1
    found[[ord(c) for c in WHITE]] = 0
    return found


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each text are no white space, and how many are readable; 0 of a null."""
    chars, readable, i = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), 0
    _, places, held = texts.cast(pa.large_string()).buffers() if len(texts) else (None, b"", b"")
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(held or b"", np.uint8)
    while i < len(texts):
        j = max(int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1, i + 1)
        part, at = held[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        if len(part) and part.max() > 127:
            at = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[at]  # characters, not bytes
            part = np.minimum(np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32), 0x10000)
        kind = kinds()[part]
        for told, fits in ((chars, kind > 0), (readable, kind == 1)):
            told[i:j] = np.diff(np.concatenate([[0], np.cumsum(fits)])[at])
        i = j
    return chars, readable


def squeeze(text: str | None) -> str | None:
    """White space inside lines becomes one space, lines are stripped, at most one blank line in a row stays."""
    if text is not None and any(c in text for c in UNEVEN):
        text = re.sub("\n{3,}", "\n\n", "\n".join([" ".join(line.split()) for line in text.splitlines()]))
    return text and text.strip()


def _counted(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(n) for n in counts(texts)], ["chars", "readable"])


def _squeezed(texts: pa.Array) -> pa.Array:
    return pa.array((squeeze(t.as_py()) for t in texts), pa.string(), size=len(texts))


def counted(text: Column) -> Column:
    """Struct of chars, those that are no white space, and of readable ones; not for use in a lambda."""
    return F.arrow_udf(_counted, "struct<chars:int,readable:int>")(F.make_valid_utf8(text))


def squeezed(text: Column) -> Column:
    """As ``layout.squeezed``, of whole texts; not for use in a lambda."""
    return F.arrow_udf(_squeezed, "string")(F.make_valid_utf8(text))
