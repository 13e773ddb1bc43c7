"""Substring dedup by compact windows.

A text is a sequence of shingles of five words. For each of HASHES hash functions the Cartesian tree over the shingles' hash values, as far as its
intervals hold LEAST shingles, gives the compact windows (left, centre, right): all subsequences that lie in the window and span the centre have
the centre's shingle as their min-hash, so a window stands for all of them at once. Windows of different texts with the same hash function and
min-hash hold subsequences that share a signature. Each window is also keyed by the min-hashes of the shingles right, and left, of its centre;
a passage of LEAST shingles reaches half of LEAST to one side at least, so an exact repetition agrees in one of the two keys for sure.

In each group of a key the smallest document leads. The interval join merges the windows that a text and a leader share over all hash functions
into one pair of regions, whose passages are then verified on the words: maximal runs of shared shingles in which at least 8 of 9 are shared, and
a Jaccard similarity of THRESHOLD at least with the leader's passage. Members that the leader doesn't explain are compared in blocks by the
shingles around their centres, and verified with the nearest earlier member. Neither step emits the pairs of a group.

Results: null counts as empty; texts of less than 50 words have no passages; texts with the same words are copies, whose whole text repeats that
of the smallest doc_id; repetitions within one document and rows that repeat one doc_id are left alone; ties take the smallest doc_id; an empty
table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.chosen_path import groups, shared_counts, signature
from marginalia.llm.common import BROADCAST_ROWS, bucketed, discard, join_bucketed, join_hot, process_state, saved, sieved, table, text_of, unused, without
from marginalia.llm.shingles import SIZE, mix, shingles, words, words_of

WORDS, HASHES, THRESHOLD, BLOCK = 50, 4, 0.8, 512
LEAST = WORDS - SIZE + 1
HALF = LEAST // 2
LAST = (1 << 63) - 1
#: Texts are windowed in pieces of so many shingles, which overlap by OVERLAP.
PIECE, OVERLAP = 1 << 14, 1 << 10
_U = np.uint64
_KEYS = mix(np.arange(1, 33, dtype=_U) * _U(0xE7037ED1A0B428DB))


def windows(values: np.ndarray, ties: bool, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Compact windows (left, centre, right) of at least ``least`` places. Of equal minima the one nearest the middle is the centre, so that
    texts of few different words keep a flat tree; ``ties`` tells whether values repeat."""
    out, stack = [], [(0, len(values))]
    while stack:
        a, z = stack.pop()
        part = values[a:z]
        i = int(part.argmin())
        if ties:
            same = np.flatnonzero(part == part[i])
            i = int(same[np.abs(same - (z - a) // 2).argmin()])
        c = a + i
        out.append((a, c, z - 1))
        if i >= least:
            stack.append((a, c))
        if z - c > least:
            stack.append((c + 1, z))
    return out


def contexts(tokens: np.ndarray, keys: np.ndarray = _KEYS[-2:], half: int = HALF) -> np.ndarray:
    """At each place a hash of min-hashes (by default two) of the ``half`` shingles that begin there, as far as the text goes. The minimum of a run is that of
    two runs of half its length."""
    out = np.zeros(len(tokens), _U)
    for k in keys:
        g, size = np.concatenate([mix(tokens ^ k), np.full(half - 1, ~_U(0), _U)]), 1
        while size < half:
            step = min(size, half - size)
            g = np.minimum(g[:-step], g[step:])
            size += step
        out = mix(out + g)
    return out


def described(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Per row: doc_id, sig (of the word sequence), n_words, n_chars, and windows: array of struct(key, span, near). A span packs the centre and
    the distances of both ends from it, near packs the keys of the centre's right and left side."""
    kinds = [("key", pa.int64()), ("span", pa.int64()), ("near", pa.int64())]

    def of(w: np.ndarray) -> list[np.ndarray]:
        if len(w) < WORDS:
            return [np.zeros(0, np.int64)] * 3
        s = shingles(w)
        ties = bool((np.diff(np.sort(s)) == 0).any())
        right = contexts(s)
        left = right[np.maximum(0, np.arange(len(s)) - HALF + 1)]
        rows, keys = [], []
        for at in range(0, max(1, len(s) - OVERLAP), PIECE - OVERLAP):
            part = s[at : at + PIECE]
            for k in _KEYS[:hashes]:
                own = np.array(windows(mix(part ^ k), ties), np.int64) + at
                rows.append(own)
                keys.append(mix(s[own[:, 1]] + k))
        lcr, key = np.concatenate(rows), np.concatenate(keys)
        c = lcr[:, 1]
        span = c << 28 | (c - lcr[:, 0]) << 14 | lcr[:, 2] - c
        # A side that the text ends on cannot be the long one of a passage, and gets no key.
        one = np.where(c + HALF <= len(s), right[c] >> _U(32) | _U(1), _U(0))
        two = np.where(c >= HALF - 1, left[c] >> _U(32) | _U(1), _U(0))
        return [key.view(np.int64), span, (one << _U(32) | two).view(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_state("windows")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            all_words = [w[0] for w in words_of(texts)]
            got = [of(w) for w in all_words]
            sizes = np.concatenate(([0], np.cumsum([len(g[0]) for g in got]))).astype(np.int32)
            fields = [pa.array(np.concatenate([g[i] for g in got]) if got else [], kind) for i, (_, kind) in enumerate(kinds)]
            found = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(fields, names=[n for n, _ in kinds]))
            sigs = [sequence_signature(w) for w in all_words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array([len(w) for w in all_words], pa.int32()), pa.array(list(map(len, texts)), pa.int32()), found], names=["doc_id", "sig", "n_words", "n_chars", "windows"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, sig binary, n_words int, n_chars int, windows array<struct<key long, span long, near long>>")


def sequence_signature(w: np.ndarray) -> bytes:
    """128 bits of a sequence of words."""
    return signature(mix(w + mix(np.arange(len(w), dtype=_U))))


def text_signature(text: str) -> bytes:
    return sequence_signature(words(text.encode("utf-8"))[0])


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, text) of the wanted units (doc_id, uid)."""
    few = wanted.count() <= BROADCAST_ROWS
    ids = wanted.select(F.col("doc_id").alias("_want")).distinct()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.length("text") > 0)
    own = own.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [sequence_signature(w[0]) for w in words_of(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), batch.column(1)], names=["doc_id", "sig", "text"])

    named = own.mapInArrow(run, "doc_id long, sig binary, text string").select(F.xxhash64("doc_id", "sig").alias("uid"), "text")
    units = wanted.select("uid")
    return named.join(F.broadcast(units) if few else units, "uid", "left_semi")


class Prepared:
    """A text with its words and shingles, and the shingles in order of value."""

    def __init__(self, text: str):
        self.raw = text.encode("utf-8")
        self.words, self.begins, self.ends = words(self.raw)
        self.shingles = shingles(self.words)
        self.chars = None

    @cached_property
    def wholes(self) -> np.ndarray:
        return run_hashes(self.shingles)

    def char(self, byte: int) -> int:
        if self.chars is None:
            self.chars = np.concatenate(([0], np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)))
        return int(self.chars[byte])


def run_hashes(s: np.ndarray, size: int = LEAST) -> np.ndarray:
    """Hashes of all runs of ``size`` shingles, made from those of runs of half the length."""
    if len(s) < size:
        return np.zeros(0, _U)
    if size == 1:
        return s
    half = run_hashes(s, size // 2)
    n = len(s) - size + 1
    out = mix(half[:n] * _U(0xD6E8FEB86659FD93) + half[size // 2 : size // 2 + n])
    return mix(out * _U(0xD6E8FEB86659FD93) + s[size - 1 :]) if size % 2 else out


def passages(own: Prepared, other: Prepared, region: tuple[int, int], other_region: tuple[int, int], threshold: float = THRESHOLD) -> list[tuple]:
    """Passages of ``own`` that repeat one of ``other`` within the regions of shingles: (start, end, first, last, words, similarity), the first
    two in characters, the next in shingles. A stretch that is not like the other's first places is compared along each diagonal that many shared
    shingles lie on, and what repeats exactly is a passage in any case."""
    s, p = own.shingles, other.shingles
    a, z = max(0, region[0]), min(len(s), region[1] + 1)
    pa_, pz = max(0, other_region[0]), min(len(p), other_region[1] + 1)
    x, y = s[a:z], p[pa_:pz]
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    at = np.searchsorted(ranked, x)
    place = order[np.minimum(at, len(y) - 1)] if len(y) else at
    hit = (y[place] == x) if len(y) else np.zeros(len(x), bool)
    out, done = [], []

    def found(i: int, j: int, alike: float) -> None:
        done.append((i, j))
        first, last = a + i, a + j - 1
        stop = min(len(own.words), last + SIZE) - 1
        out.append((own.char(own.begins[first]), own.char(own.ends[stop]), first, last, stop - first + 1, float(alike)))

    known = lambda i, j: j - i < LEAST or any(a0 <= i and j <= z0 for a0, z0 in done)
    # Stretches with misses come first; shared runs that none of them covers stand by themselves.
    pure = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2).tolist()
    for i, j in runs(hit):
        if known(i, j):
            continue
        alike = likeness(x, y, place, hit, i, j)
        if alike >= threshold:
            found(i, j, alike)
            continue
        for d, near in diagonals(x, ranked, order, at, hit, i, j, done):
            on = np.zeros(len(x), bool)
            on[i:j] = hit[i:j] & (np.abs(near - np.arange(i, j) - d) <= max(2, (j - i) // 10))
            own_place = place.copy()
            own_place[i:j] = near
            for i2, j2 in runs(on):
                if not known(i2, j2) and (alike := likeness(x, y, own_place, on, i2, j2)) >= threshold:
                    found(i2, j2, alike)
    for i, j in pure:
        if not known(i, j) and (alike := likeness(x, y, place, hit, i, j)) >= threshold:
            found(i, j, alike)
    if all(known(i, j) for i, j in pure):
        return out  # no exact repetition lies outside what is found
    exact = np.isin(own.wholes[a : max(a, z - LEAST + 1)], other.wholes[pa_ : max(pa_, pz - LEAST + 1)])
    for i, j in np.flatnonzero(np.diff(np.concatenate(([0], exact.view(np.int8), [0])))).reshape(-1, 2).tolist():
        if not known(i, j + LEAST - 1):
            found(i, j + LEAST - 1, 1.0)
    return out


def diagonals(x: np.ndarray, ranked: np.ndarray, order: np.ndarray, at: np.ndarray, hit: np.ndarray, i: int, j: int, done: list[tuple[int, int]], most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """Shifts on which at least HALF of the shared shingles x[i:j] lie, those with the most first, and the places nearest to each shift. The rarest
    shingles vote, with all their places, up to ``most`` votes; those in stretches that are ``done`` meanwhile vote no more."""
    k = np.flatnonzero(hit[i:j]) + i
    n = np.searchsorted(ranked, x[k], "right") - at[k]
    voters = np.argsort(n, kind="stable")
    voters = voters[: max(1, int(np.searchsorted(np.cumsum(n[voters]), most, "right")))]
    each = n[voters]
    which = np.repeat(k[voters], each)
    step = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    shift = order[at[which] + step] - which
    size = len(ranked) + 1
    keys = np.searchsorted(ranked, ranked, "left") * size + order
    left = np.ones(len(shift), bool)
    slack = max(2, LEAST // 10)
    while left.sum() >= HALF:
        base = int(shift[left].min())
        votes = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(shift[left] - base, minlength=1))))
        ends = np.minimum(np.arange(len(votes) - 1) + 2 * slack + 1, len(votes) - 1)
        total = votes[ends] - votes[:-1]
        best = int(total.argmax())
        if total[best] < HALF:
            return
        own = left & (shift - base >= best) & (shift - base <= best + 2 * slack)
        d = int(np.median(shift[own]))
        want = at[i:j] * size + np.clip(np.arange(i, j) + d, 0, size - 2)
        after = np.searchsorted(keys, want)
        lo, hi = np.maximum(after - 1, 0), np.minimum(after, len(keys) - 1)
        same = lambda q: keys[q] // size == at[i:j]
        far = lambda q: np.where(same(q), np.abs(keys[q] - want), 2 * size)
        yield d, order[np.where(far(lo) <= far(hi), lo, hi)]
        left &= ~own
        for a0, z0 in done:
            left &= (which < a0) | (which >= z0)


def likeness(x: np.ndarray, y: np.ndarray, place: np.ndarray, hit: np.ndarray, i: int, j: int) -> float:
    """Jaccard similarity of x[i:j] with the stretch of y where its shared shingles are, those far off the usual shift left out."""
    diag = int(np.median(place[i:j][hit[i:j]] - np.arange(i, j)[hit[i:j]]))
    slack = max(2, (j - i) // 10)
    near = place[i:j][hit[i:j]]
    near = near[(near >= i + diag - slack) & (near < j + diag + slack)]
    if hit[i:j].all() and (np.diff(place[i:j]) == 1).all() or not len(near):
        return float(len(near) > 0)
    one, two = np.unique(x[i:j]), np.unique(y[near.min() : near.max() + 1])
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (len(one) + len(two) - both)


def runs(hit: np.ndarray, cost: int = 8, gap: int = 2 * SIZE) -> list[tuple[int, int]]:
    """Stretches from a shared shingle to a shared one, as long as they can be with at least ``cost`` shared ones for each miss and at most ``gap``
    misses in a row, longest first within each part between longer gaps."""
    place = np.flatnonzero(hit)
    if not len(place):
        return []
    out = []
    breaks = np.flatnonzero(np.diff(place) > gap + 1)
    stack = [(int(place[i]), int(place[j]) + 1) for i, j in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(place) - 1])), strict=True)]
    while stack:
        a, z = stack.pop()
        if z - a < LEAST:
            continue
        total = np.concatenate(([0], np.cumsum(np.where(hit[a:z], 1, -cost))))
        # For each begin the last end whose sum is not below it: the largest sum from there on falls with the end.
        best_after = np.maximum.accumulate(total[::-1])
        end = len(total) - 1 - np.searchsorted(best_after, total, "left")
        i = int(np.argmax(end - np.arange(len(total))))
        inside = np.flatnonzero(hit[a + i : a + int(end[i])])
        if not len(inside):
            continue
        first, last = a + i + int(inside[0]), a + i + int(inside[-1]) + 1
        out.append((first, last))
        stack += [(a, first), (last, z)]
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (uid, lead, start, end, first, last, words, similarity) from pairs (uid, lead, l, r, lead_l, lead_r), a scratch table."""
    lead_text = texts.select(F.col("uid").alias("lead"), F.col("text").alias("lead_text"))
    both = join_bucketed(pairs, lead_text, "lead").join(texts, "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared: dict[int, Prepared] = {}

        def of(uid: int, text: pa.Scalar) -> Prepared:
            got = prepared.pop(uid, None) or Prepared(text.as_py())
            prepared[uid] = got  # the last used comes last
            while len(prepared) > 2 and sum(len(p.raw) for p in prepared.values()) > 1 << 22:
                del prepared[next(iter(prepared))]
            return got

        for batch in batches:
            out = []
            for uid, lead, l, r, ll, lr, mine, other in zip(*(c.to_pylist() for c in batch.columns[:6]), *batch.columns[6:], strict=True):  # noqa: E741
                out += [(uid, lead, *found) for found in passages(of(uid, mine), of(lead, other), (l, r), (ll, lr))]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "lead", "start", "end", "first", "last", "words", "similarity"])

    return both.select("uid", "lead", "l", "r", "lead_l", "lead_r", "text", "lead_text").mapInArrow(run, "uid long, lead long, start int, end int, first int, last int, words int, similarity double")


def nearest(rows: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For members (band, side, uid, doc, c, open) that no leader explained, the open ones, of all earlier members of their band the one whose
    shingles around the centre are most alike, if half of LEAST are the same, and those whose exact repetition around the centre reaches farthest
    to the left and to the right: (uid, lead, l, r, lead_l, lead_r).

    Blocks of about ``block`` members meet pairwise, those of open members with all others. Each text is read once for all its members.
    """
    if "open" not in rows.columns:
        rows = rows.withColumn("open", F.lit(True))
    sizes = saved(rows.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("open").alias("any")).filter("_n > 1 and any").select("band", "_n"), "sizes")
    per_text = join_hot(rows, sizes.select("band"), "band", "inner", counts=sizes).groupBy("uid").agg(F.min("doc").alias("doc"), F.collect_list(F.struct("band", "side", "c", "open")).alias("at")).join(texts, "uid")
    kinds = [("band", pa.int64()), ("uid", pa.int64()), ("doc", pa.int64()), ("c", pa.int32()), ("open", pa.bool_()), ("near", pa.binary())]

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for uid, doc, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Half of each hash is enough to choose by; what is chosen is verified on the words.
                s = (shingles(words(text.encode("utf-8"))[0]) >> _U(32)).astype(np.uint32)
                seen: dict[int, bytes] = {}
                for x in at:
                    c = x["c"]
                    if c not in seen:
                        seen[c] = s[max(0, c - LEAST) : c + LEAST].tobytes()
                    out.append((x["band"], uid, doc, c, x["open"], seen[c]))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    near = saved(per_text.select("uid", "doc", "at", "text").mapInArrow(around, "band long, uid long, doc long, c int, open boolean, near binary"), "near")
    sizes = near.groupBy("band").agg(F.count_if("open").alias("m"), F.count_if(~F.col("open")).alias("n")).filter("m > 0 and m + n > 1")
    sizes = sizes.select("band", *(F.ceil(F.col(x) / F.lit(block)).cast("int").alias(f"{x}b") for x in ("m", "n")))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = join_hot(near, sizes, "band", "inner").withColumn("own", F.when(F.col("open"), spread("mb")).otherwise(F.col("mb") + spread("nb")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.col("mb") + F.col("nb")).otherwise(F.col("mb")) - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "doc", "c", "open", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_of in _chunks(groups(batches)):
            out = []
            for _, members in batch_of:
                members.sort(key=lambda m: (m[1], m[0], m[2]))
                uid, _, c, is_open, lists = zip(*members, strict=True)
                lists = [np.frombuffer(x, np.uint32) for x in lists]
                may = np.tril(np.array(uid)[:, None] != np.array(uid)[None, :], -1) & np.array(is_open)[:, None]
                if not may.any():
                    continue
                common = np.where(may, shared_counts([np.unique(x) for x in lists]), 0)
                left, right = reach(lists, c, may)
                exact = left + right >= LEAST
                for score in (np.where(common >= HALF, common, 0), np.where(exact, left + 1, 0), np.where(exact, right + 1, 0)):
                    best = score.argmax(1)
                    out += [(uid[k], uid[b], c[k] - LEAST, c[k] + LEAST, c[b] - LEAST, c[b] + LEAST) for k, b in enumerate(best.tolist()) if score[k, b]]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4, strict=True)], names=["uid", "lead", "l", "r", "lead_l", "lead_r"])

    found = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "uid long, lead long, l int, r int, lead_l int, lead_r int")
    # A wider look around the two centres, so that long passages are found whole.
    wide = [F.min("l").alias("l"), F.max("r").alias("r"), F.min("lead_l").alias("lead_l"), F.max("lead_r").alias("lead_r")]
    return found.groupBy("uid", "lead").agg(*wide).select("uid", "lead", *((F.col(x) + s * 4 * LEAST).alias(x) for x, s in (("l", -1), ("r", 1), ("lead_l", -1), ("lead_r", 1))))


def reach(lists: list[np.ndarray], centres: tuple[int, ...], may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each pair that ``may`` be are the same in a row up to the centres (themselves left out), and from the centres on."""
    n = len(lists)
    around = np.zeros((n, 2 * LEAST), lists[0].dtype)
    there = np.zeros((n, 2 * LEAST), bool)
    for k, (s, c) in enumerate(zip(lists, centres, strict=True)):
        at = LEAST - min(c, LEAST)
        around[k, at : at + len(s)], there[k, at : at + len(s)] = s, True
    out = []
    for steps in (range(LEAST - 1, -1, -1), range(LEAST, 2 * LEAST)):
        alive, count = may, np.zeros((n, n), np.int32)
        for t in steps:
            alive = alive & (around[:, None, t] == around[None, :, t]) & there[:, None, t] & there[None, :, t]
            if not alive.any():
                break
            count += alive
        out.append(count)
    return out[0], out[1]


def _chunks(items: Iterator, size: int = 256) -> Iterator[list]:
    run = []
    for x in items:
        run.append(x)
        if len(run) == size:
            yield run
            run = []
    if run:
        yield run


def repeated_passages(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """One row per passage of a document that repeats one of an earlier document: doc_id, start, end (characters, end exclusive), n_words,
source_doc_id, similarity, whole (the text is a copy), sig (of the word sequence). Passages of one document that overlap are merged; the row names the source of the longest."""
    rows = saved(described(docs, hashes), "windows")
    id_or_last = F.coalesce("doc_id", F.lit(LAST))
    whole = rows.filter(F.col("n_words") >= WORDS)
    classes = saved(whole.groupBy("sig").agg(F.min(id_or_last).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n_chars").alias("n_chars")), "classes")
    several = classes.filter("copies > 1").drop("n_chars")
    named = F.when(F.col("first_id") < LAST, F.col("first_id"))
    units = classes.select(named.alias("doc_id"), F.xxhash64(named, "sig").alias("uid"), "sig", "n_chars")
    # Copies are told apart by a join of ids alone; the windows of the others stay where they are.
    copies = saved(join_hot(whole.select("doc_id", "sig", "n_words", "n_chars"), several, "sig", "inner").filter(id_or_last > F.col("first_id")), "copies")
    keyed = whole.select("doc_id", "sig", F.xxhash64("doc_id", "sig").alias("uid"), "windows")
    leads = without(keyed, copies.select(F.xxhash64("doc_id", "sig").alias("uid")).distinct(), "uid")
    spread = leads.select("uid", F.explode("windows").alias("w")).select("uid", "w.*")
    # Few keys come twice, so the others need not travel with their windows.
    again = saved(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "again")
    shared = saved(sieved(spread, again, "key").join(again, "key"), "shared")
    discard(rows, again)  # the largest table goes before the next ones are written
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("near", 32).alias("near")), F.struct(F.lit(2).alias("side"), F.col("near").bitwiseAND(0xFFFFFFFF).alias("near")))).alias("x")
    banded = shared.select("uid", "key", "span", sides).filter("x.near <> 0").select(F.xxhash64("key", "x.side", "x.near").alias("band"), "x.side", "uid", "span")
    # The smallest document leads, so bands need the documents' order.
    order = units.select("uid", F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    banded = saved(banded.join(order.join(shared.select("uid").distinct(), "uid", "left_semi"), "uid"), "banded")
    discard(shared)
    lead = F.min(F.struct("doc", F.col("uid").alias("lead"), F.col("span").alias("lead_span"))).alias("x")
    leaders = banded.groupBy("band").agg(lead, F.max("uid").alias("u2"), F.min("uid").alias("u1"), F.count(F.lit(1)).alias("_n")).filter("u1 <> u2").select("band", "x.lead", "x.lead_span", "_n")
    leaders = saved(leaders, "leaders")
    centre = lambda c: F.shiftright(c, 28)
    left = lambda c: (centre(c) - F.shiftright(c, 14).bitwiseAND(0x3FFF)).cast("int")
    right = lambda c: (centre(c) + F.col(c).bitwiseAND(0x3FFF)).cast("int")
    ends = [left("span").alias("l"), centre("span").cast("int").alias("c"), right("span").alias("r"), left("lead_span").alias("lead_l"), right("lead_span").alias("lead_r")]
    met = saved(join_hot(banded, leaders.drop("_n"), "band", "inner", counts=leaders.select("band", "_n")).filter("uid <> lead").select("band", "side", "uid", "doc", "lead", *ends), "met")
    discard(banded)
    # Interval join: the windows that a text and a leader share over all hash functions and keys, as one pair of regions.
    regions = met.groupBy("uid", "lead").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("lead_l").alias("lead_l"), F.max("lead_r").alias("lead_r"))
    regions = saved(regions, "regions")
    needed = met.select("uid").union(met.select("lead")).distinct()
    wanted = saved(units.join(needed, "uid", "left_semi"), "wanted")
    texts = bucketed(texts_of(docs, wanted), "uid", wanted.agg(F.sum(F.col("n_chars").cast("long"))).first()[0] or 0)
    first = saved(verified(regions, texts), "first")
    # Members in a passage already found are not open, but may be the source of others.
    covered = first.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("covers"))
    explained = F.exists("covers", lambda x: F.col("c").between(x["first"], x["last"]))
    members = met.join(covered, "uid", "left").select("band", "side", "uid", "doc", "c", (~F.coalesce(explained, F.lit(False))).alias("open"))
    members = saved(members, "members")
    discard(met)
    second = verified(saved(nearest(members, texts), "nearest"), texts)
    every = first.unionByName(second)
    names = units.select(F.col("uid").alias("lead"), F.col("doc_id").alias("source_doc_id"))
    listed = every.join(units, "uid").join(names, "lead").select("doc_id", "uid", "sig", "start", "end", F.col("words").alias("n_words"), "source_doc_id", "similarity")
    found = saved(merged(listed), "passages")
    discard(texts, members)
    return found.select("doc_id", "start", "end", "n_words", "source_doc_id", "similarity", F.lit(False).alias("whole"), "sig").unionByName(
        copies.select("doc_id", F.lit(0).alias("start"), F.col("n_chars").alias("end"), "n_words", F.col("first_id").alias("source_doc_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("whole"), "sig")
    )


def merged(found: DataFrame) -> DataFrame:
    """Overlapping passages of a document as one. A document's passages are bounded by its length over LEAST times its leaders."""
    from pyspark.sql import Window

    order = Window.partitionBy("uid").orderBy("start", F.desc("end"), "source_doc_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    numbered = found.withColumn("new", new).withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("n_words", "similarity", (-F.col("source_doc_id")).alias("s"), "source_doc_id")).alias("best")
    return numbered.groupBy("uid", "no").agg(F.first("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.min("start").alias("start"), F.max("end").alias("end"), best).select("doc_id", "sig", "start", "end", "best.n_words", "best.source_doc_id", "best.similarity")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("sig")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; where one is cut inside, a line feed stands."""
    out, at = [], 0
    for a, z in sorted(spans):
        out.append(text[at : max(at, a)].strip())
        at = max(at, z)
    out.append(text[at:].strip())
    return "\n".join(x for x in out if x)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages, and n_chars to match where there is such a column. A document of which no word is left goes;
    documents without repeated passages stay as they are."""
    found = repeated_passages(docs)
    spans = found.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))

    @F.pandas_udf("binary")
    def sig_of(texts: pd.Series) -> pd.Series:
        return texts.map(text_signature)

    @F.pandas_udf("string")
    def without_spans(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, lists, strict=True)])

    # Texts are found again by a built-in hash, so that no stage of Spark's runs two Python workers for a task.
    key, own, cuts, new = (unused(docs, c) for c in ("_key", "_id", "_cuts", "_new"))
    keys = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), sig_of(text_of()).alias("sig")), "keys")
    spans = keys.distinct().join(spans, keys["doc_id"].eqNullSafe(spans["doc_id"]) & (keys["sig"] == spans["sig"])).select(keys["doc_id"].alias("own_id"), F.col("key").alias("own_key"), F.col("_spans").alias(cuts))
    spans = saved(spans, "spans")
    few = spans.count() <= BROADCAST_ROWS
    held = docs.withColumn(key, F.xxhash64(text_of())).withColumn(own, F.col("doc_id").cast("long"))
    joined = held.join(F.broadcast(spans) if few else spans, held[own].eqNullSafe(spans["own_id"]) & (held[key] == spans["own_key"]), "left").drop(spans["own_id"], spans["own_key"])
    made = joined.withColumn(new, without_spans(text_of(), F.col(cuts))).filter(F.col(cuts).isNull() | F.col(new).rlike("[A-Za-z0-9_\\x{80}-\\x{10FFFF}]"))
    changed = F.col(cuts).isNotNull()
    values = {"text": F.col(new), "n_chars": F.length(new)}
    return made.select(*(F.when(changed, values[c].cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in docs.columns))
