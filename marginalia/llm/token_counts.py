"""Token counts by offset-mapped attribution.

A document's fields are rendered into one string, which is encoded once. Each token covers a span of characters; these spans are joined by
interval with the spans of the sections (heading fields and the lines of the text). A token that crosses a boundary is allocated by an explicit
rule: "start" gives it to the section of its first character, "majority" to the section with most of its characters (the first of equals), and
"share" in proportion to characters. Whole counts sum to the document's count under the first two rules, shares under the third.

Results: null fields are empty; a document without text has one empty section with no tokens; repeated rows give repeated rows; an empty table
gives no rows. Only doc_id, source, lang and text are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import process_state, table, text_of

RULES = ("start", "majority", "share")
#: Longer runs without white space go to the library that merges them in n log n.
LONG_RUN = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids and the byte length of each token."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.ranks = ranks
        self.long = regex.compile(r"[^\s]{%d,}|\s{%d,}" % (LONG_RUN, LONG_RUN))
        self.words = regex.compile(public_tokenizers.PATTERN)

    def lengths(self, text: str) -> np.ndarray:
        """Byte lengths of the tokens in order."""
        if not self.long.search(text):
            return self.size[self.encode(text)]
        out = []
        for m in self.words.finditer(text):
            w = m.group()
            out += self._merged(w.encode("utf-8")) if len(w) >= LONG_RUN else self.size[self.encode(w)].tolist()
        return np.array(out, np.int64)

    def _merged(self, word: bytes) -> list[int]:
        """Byte lengths of the tokens of one long word, by merging lowest ranks first from a heap."""
        import heapq

        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank = lambda i: self.ranks.get(word[i : end[end[i]]]) if end[i] < n else None
        heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or rank(i) != r:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            for k in (i, before[i]):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, end[end[k]]))
        return [end[i] - i for i in range(n) if alive[i]]


def encoder(path: str) -> Encoder:
    return process_state(f"tokens {path}", lambda: Encoder(path))


def char_starts(text: str, sizes: np.ndarray) -> np.ndarray:
    """Where the tokens begin in characters, and the end: the character of a token's first byte."""
    at = np.concatenate(([0], np.cumsum(sizes)))
    if text.isascii():
        return at
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    first = np.concatenate((np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]))
    return first[at]


def attribute(starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section, whole counts by "start" and "majority" and shares, from token starts (with the end) and section bounds (with the end).

    The interval join is a search: a token meets the sections from that of its first to that of its last character. Empty sections get nothing.
    """
    n = len(bounds) - 1
    a, z = starts[:-1], np.maximum(starts[1:], starts[:-1] + 1)
    # A section is the last one that begins at or before a character, so an empty section is never found.
    low, high = np.searchsorted(bounds[:-1], a, "right") - 1, np.searchsorted(bounds[:-1], z - 1, "right") - 1
    by_start = np.bincount(low, minlength=n)
    by_most, share = np.bincount(low[low == high], minlength=n), np.bincount(low[low == high], minlength=n).astype(float)
    for t in np.flatnonzero(low != high):
        parts = np.arange(low[t], high[t] + 1)
        cover = np.minimum(z[t], bounds[parts + 1]) - np.maximum(a[t], bounds[parts])
        by_most[parts[int(np.argmax(cover))]] += 1
        share[parts] += cover / cover.sum()
    return by_start, by_most, share


def sections(fields: list[tuple[str, str]], text: str) -> tuple[str, list[str], list[int]]:
    """The rendered document, section names, and bounds. A line keeps its line feed."""
    names, parts = [], []
    for name, value in fields:
        names.append(name)
        parts.append(f"{name}: {value}\n")
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    if not lines[-1] and len(lines) > 1:
        lines.pop()
    for i, line in enumerate(lines):
        names.append(f"line {i}")
        parts.append(line)
    bounds = [0]
    for p in parts:
        bounds.append(bounds[-1] + len(p))
    return "".join(parts), names, bounds


def count_tokens(docs: DataFrame, path: str | None = None, fields: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document and section: doc_id, section_no, section, start_char, end_char, tokens_start, tokens_majority, tokens_share, doc_tokens."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            size = 0
            for doc, *values, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, names, bounds = sections(list(zip(fields, values, strict=True)), text)
                starts = char_starts(whole, enc.lengths(whole))
                a, m, s = attribute(starts, np.array(bounds))
                k = len(names)
                for o, v in zip(out, ([doc] * k, range(k), names, bounds[:-1], bounds[1:], a.tolist(), m.tolist(), s.round(9).tolist(), [len(starts) - 1] * k), strict=True):
                    o.extend(v)
                size += k
                if size > 50_000:
                    yield made(out)
                    out, size = [[] for _ in range(9)], 0
            yield made(out)

    read = [F.col("doc_id").cast("long"), *(text_of(f).alias(f) for f in fields), text_of().alias("text")]
    return docs.select(*read).mapInArrow(run, "doc_id long, section_no int, section string, start_char long, end_char long, tokens_start long, tokens_majority long, tokens_share double, doc_tokens long")


def made(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    names = ["doc_id", "section_no", "section", "start_char", "end_char", "tokens_start", "tokens_majority", "tokens_share", "doc_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
