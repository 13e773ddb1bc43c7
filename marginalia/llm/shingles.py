"""Words and word shingles as 64-bit hashes, for whole texts at once with numpy.

A word is a run of ASCII letters, digits and underscores and of all characters beyond ASCII; ASCII letters count without case. Characters from U+3000
to U+9FFF, of scripts that put no spaces between words, are words by themselves. A shingle is five
words in a row. A text of one to four words has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
PIECE = 4 << 20
#: Bytes of short texts that are gone through at once.
RUN = 1 << 15
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_kinds = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum() or _b == 95:
        _kinds[_b] = _b + 32 if 65 <= _b <= 90 else _b
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grown(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text, and where each begins and ends in bytes."""
    if len(raw) > PIECE:
        parts, at = [], 0
        while at < len(raw):
            stop = at + PIECE
            while stop < len(raw) and _kinds[raw[stop]] and not 0xE3 <= raw[stop] <= 0xE9:
                stop += 1
            h, s, e = _words(raw[at:stop])
            parts.append((h, s + at, e + at))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return _words(raw)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    kinds = _kinds[data]
    inside = np.zeros(len(kinds) + 2, np.int8)
    inside[1:-1] = kinds != 0
    step = np.diff(inside)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))  # first of the three bytes of such a character
    if len(alone):
        after = alone + 3
        begins, ends = np.union1d(begins, np.concatenate([alone, after[inside[1:][after] == 1]])), np.union1d(ends, np.concatenate([alone[inside[alone] == 1], after]))
    _grown(len(kinds) + 1)
    total = np.zeros(len(kinds) + 1, _U)
    np.cumsum(kinds * _powers[0][: len(kinds)], out=total[1:])
    return mix((total[ends] - total[begins]) * _powers[1][begins] + (ends - begins).astype(_U)), begins, ends


def words_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of each text; short texts are gone through together."""
    out: list = []
    run, size = [], 0

    def flush() -> None:
        h, b, e = words(b"\n".join(run))
        starts = np.cumsum([0] + [len(r) + 1 for r in run])
        cuts = np.searchsorted(b, starts)
        for i in range(len(run)):
            own = slice(cuts[i], cuts[i + 1])
            out.append((h[own], b[own] - starts[i], e[own] - starts[i]))

    for raw in (t.encode("utf-8") for t in texts):
        run.append(raw)
        size += len(raw)
        if size > RUN:
            flush()
            run, size = [], 0
    if run:
        flush()
    return out


def shingles(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order of place."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    out = np.full(n - k + 1, k, _U)
    for i in range(k):
        out = mix(out * _U(0xD6E8FEB86659FD93) + hashes[i : n - k + 1 + i])
    return out


def shingle_set(text: str, size: int = SIZE) -> np.ndarray:
    """The different shingles of a text, sorted."""
    return np.unique(shingles(words(text.encode("utf-8"))[0], size))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    return [np.unique(shingles(w[0], size)) for w in words_of(texts)]
