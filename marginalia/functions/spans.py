"""The tokens of ``text.tokens`` for whole Arrow arrays at once, by arithmetic on bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

LETTER, DIGIT, LOW_LINE = 1, 2, 4
#: Translations of bytes, which are faster than indexing by them.
_KINDS, _LOW = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_KINDS[ord("a") : ord("z") + 1], _KINDS[ord("0") : ord("9") + 1], _KINDS[ord("_")] = LETTER, DIGIT, LOW_LINE
_LOW[ord("A") : ord("Z") + 1] += 32
#: Letters, digits and low lines of a word.
WORD = 21
#: Bytes of text that are cut at once; a longer text is cut alone.
CHUNK = 1 << 21
_LAST = 0x1FFFF
#: The characters beyond ASCII whose lower case holds ASCII letters.
LOWER = {"\u0130": "i\u0307", "\u212a": "k"}


def digits(spark: SparkSession) -> np.ndarray:
    """The characters beyond ASCII that the JVM takes for digits, in order; asked for once for each application."""
    sc = spark.sparkContext
    if not hasattr(sc, "_marginalia_digits"):
        some = "".join(chr(i) for i in range(0x80, _LAST + 1) if not 0xD800 <= i < 0xE000)
        sc._marginalia_digits = np.array(sorted(map(ord, sc._jvm.java.util.regex.Pattern.compile(r"(?U)\D+").matcher(some).replaceAll(""))), np.int64)
    return sc._marginalia_digits


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of parts of about ``CHUNK`` bytes."""
    ends, at = _bytes(texts)[1][1:], 0
    while at < len(ends):
        begun = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begun + CHUNK, "right")))
        yield at, to
        at = to


def lowered(texts: pa.Array) -> pa.Array:
    """Texts whose tokens are those of the lower-case texts; characters beyond ASCII stay as they are where that makes no other tokens."""
    data, offsets = _bytes(texts)
    held = data.tobytes()
    if found := [c for c in LOWER if c.encode() in held]:
        for c in found:
            texts = pc.replace_substring(texts, c, LOWER[c])
        data, offsets = _bytes(texts)
        held = data.tobytes()
    held = pa.py_buffer(held.translate(_LOW.tobytes()))
    kind = pa.LargeStringArray if pa.types.is_large_string(texts.type) else pa.StringArray
    return kind.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64 if kind is pa.LargeStringArray else np.int32)), held)


def tokens(low: pa.Array, other_digits: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of lower-case texts and the row of each; those of a row are in the order of ``text.tokens``."""
    data, offsets = _bytes(low)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    kinds = np.frombuffer(data.tobytes().translate(_KINDS.tobytes()), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # where texts begin, or end
    ideographs = _points(data, np.flatnonzero(data - 0xE4 <= 5))
    at = ideographs[0][(ideographs[1] >= 0x4E00) & (ideographs[1] <= 0x9FFF)]
    found = [(at, at + 3), _words(kinds, first), _runs(_numerals(data, kinds, other_digits), first)]
    rows = [np.repeat(np.arange(len(low)), np.diff(np.searchsorted(starts, offsets))) for starts, _ in found]
    return pa.concat_arrays([_cut(data, *f) for f in found]), np.concatenate(rows)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each begins in them, with the end."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)), ends - ends[0]


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of marked bytes that no beginning of a text divides."""
    edge = np.empty(len(inside) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = inside[1:] != inside[:-1]
    at = np.flatnonzero(edge | first)
    held = inside[at[:-1]]
    return at[:-1][held], at[1:][held]


def _words(kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = _runs(kinds > 0, first)
    letters = None
    out = []
    while len(starts):
        # A word begins at the first letter of what is left of its run.
        other = np.flatnonzero(kinds[starts] != LETTER)
        if len(other):
            starts, other = _onwards(kinds, starts, ends, other)
        if len(other):
            letters = np.flatnonzero(kinds == LETTER) if letters is None else letters
            place = np.searchsorted(letters, starts[other])
            starts[other] = np.where(place < len(letters), letters[np.minimum(place, len(letters) - 1)] if len(letters) else 0, len(kinds))
        keep = starts < ends
        if not keep.all():
            starts, ends = starts[keep], ends[keep]
        to = np.minimum(starts + WORD, ends)
        out.append((starts, to))
        more = to < ends
        starts, ends = to[more], ends[more]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(out) == 1:
        return out[0]
    starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _onwards(kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The starts moved on to the first letters or the ends, as far as a few steps go, and the places of those that are at neither."""
    starts = starts.copy()
    for _ in range(steps):
        starts[other] += 1
        at = starts[other]
        other = other[at < ends[other]]
        other = other[kinds[starts[other]] != LETTER]
        if not len(other):
            break
    return starts, other


def _numerals(data: np.ndarray, kinds: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which bytes are those of digits."""
    inside = kinds == DIGIT
    leads = np.zeros(256, bool)
    leads[np.where(other < 0x800, 0xC0 | other >> 6, np.where(other < 0x10000, 0xE0 | other >> 12, 0xF0 | other >> 18))] = True
    at = np.flatnonzero(np.frombuffer(data.tobytes().translate(leads.tobytes()), bool))
    if len(at):
        at, points = _points(data, at)
        table = np.zeros(_LAST + 2, bool)
        table[other] = True
        hit = table[np.minimum(points, _LAST + 1)]
        for a, size in zip(*(x.tolist() for x in (at[hit], _sizes(data[at[hit]]))), strict=True):
            inside[a : a + size] = True
    return inside


def _sizes(lead: np.ndarray) -> np.ndarray:
    return 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)


def _points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of characters beyond ASCII that begin there."""
    if not len(at):
        return at, at
    size = _sizes(data[at])
    at, size = at[at + size <= len(data)], size[at + size <= len(data)]
    rest = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 63).astype(np.int64)
    two, three = (data[at] & 31).astype(np.int64) << 6 | rest(1), (data[at] & 15).astype(np.int64) << 12 | rest(1) << 6 | rest(2)
    four = (data[at] & 7).astype(np.int64) << 18 | rest(1) << 12 | rest(2) << 6 | rest(3)
    return at, np.where(size == 2, two, np.where(size == 3, three, four))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from starts to ends, which don't overlap, as texts."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    if offsets[-1] < len(data) // 8:
        held = data[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    else:
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        held = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(held))
