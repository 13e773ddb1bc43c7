"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into its longest vocabulary entries. That proposal equals the result of merging exactly when every entry can
arise on its own and no merge would ever reach across the border of two neighbours; the second condition is tested for all distinct new pairs
of a batch at once with numpy. Only words that fail are merged in rank order. Words are encoded once and kept in a bounded cache.

Results: null and empty texts have no tokens; special tokens in a text become their ids, as in the library; equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import process_state, table, text_of

END = "</w>"
NEVER = (1 << 60, -1)
#: Code points below this are stable under NFC and are handled without the library's normaliser, except those of which ``_is_plain`` says no.
PLAIN = 0x250
#: Chunks between white space that a process keeps; beyond them it keeps a fifth as many for a while.
CACHED_WORDS = 700_000
CACHED_IDS = 1 << 24


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte, the published byte-level convention."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _plain_pattern() -> re.Pattern:
    """The word pattern over code points below PLAIN, with explicit classes."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "P": []}
    space = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
    for c in range(PLAIN):
        if c not in space:
            kinds[k if (k := unicodedata.category(chr(c))[0]) in "LN" else "P"].append(re.escape(chr(c)))
    letters, numbers, others = ("".join(kinds[k]) for k in "LNP")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{others}]+")


def _is_plain(c: int) -> bool:
    """Whether a code point below PLAIN and its lower case are one letter that the word pattern knows. Capitals such as U+018F have their small
    letter beyond PLAIN, that of U+0130 is two code points, and the separators U+001C to U+001F are white space to Python alone."""
    low = chr(c).lower()
    return c > 0 and not 0x1C <= c <= 0x1F and len(low) == 1 and ord(low) < PLAIN


class Index(dict):
    """Table rows of chunks; a chunk that is met first gets the next row and waits in ``pending`` to be encoded."""

    def __init__(self):
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, chunk: str) -> int:
        row = self[chunk] = len(self)
        self.pending.append(chunk)
        return row


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, kind: type):
        self.flat, self.start, self.rows, self.end = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, rows: list) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        new = np.frombuffer(b"".join(rows), np.uint8) if self.flat.dtype == np.uint8 else np.fromiter(chain.from_iterable(rows), self.flat.dtype, int(sizes.sum()))
        if self.end + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.end], np.zeros(max(len(self.flat), len(new)) + self.end // 4, self.flat.dtype)])
        if self.rows + len(rows) >= len(self.start):
            self.start = np.concatenate([self.start[: self.rows + 1], np.zeros(len(self.start) + len(rows), np.int64)])
        self.flat[self.end : self.end + len(new)] = new
        self.start[self.rows + 1 : self.rows + len(rows) + 1] = self.end + np.cumsum(sizes)
        self.rows += len(rows)
        self.end += len(new)

    def cut(self, rows: int) -> None:
        self.rows, self.end = rows, int(self.start[rows])

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i + 1]]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The named rows one after the other, and where each ends."""
        first = self.start[rows]
        sizes = self.start[rows + 1] - first
        ends = np.cumsum(sizes)
        if not len(ends):
            return self.flat[:0], ends
        at = np.arange(ends[-1])
        at += np.repeat(first - (ends - sizes), sizes)
        return self.flat[at], ends


class WordBPE:
    def __init__(self, path: str, room: int | None = None):
        self.room = room or CACHED_WORDS
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.vocab = vocab
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a = np.fromiter((vocab[x] for x, _ in pairs), np.int64, len(pairs))
        b = np.fromiter((vocab[y] for _, y in pairs), np.int64, len(pairs))
        made = np.fromiter((vocab[x + y] for x, y in pairs), np.int64, len(pairs))
        #: time[t]: when t is merged, -1 for single bytes; first[t], last[t]: the two parts of t, t itself for single bytes.
        self.time = np.full(size, -1, np.int64)
        self.first, self.last = np.arange(size), np.arange(size)
        for table_, part in ((self.time, np.arange(len(pairs))), (self.first, a), (self.last, b)):
            table_[made[::-1]] = part[::-1]
        self.ranks = {(int(x), int(y)): (r, int(m)) for r, (x, y, m) in enumerate(zip(a, b, made, strict=True))}
        keys = a << 32 | b
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order
        #: The longest entry that starts with these two characters.
        self.reach: dict[str, int] = {}
        for t in vocab:
            bare = t.removesuffix(END)
            self.reach[bare[:2]] = max(self.reach.get(bare[:2], 1), len(bare))
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.bytes_of = _byte_chars()
        self.to_chars = {b: c for b, c in enumerate(self.bytes_of)}
        self.plain = _plain_pattern()
        self.is_plain = re.compile("[" + "".join(re.escape(chr(c)) for c in range(PLAIN) if _is_plain(c)) + "]*")
        self.path = path
        self.sound: dict[int, bool] = {}
        self.index, self.order, self.base = Index(), [], None
        self.ids, self.said = Ragged(self.width.type), None
        self.token_bytes = [t.encode("utf-8") + b" " for t in self.tokens]
        self._library = None
        self.speculated = self.merged = 0

    # Speculation

    def _chars(self, word: str) -> str:
        return "".join(map(self.bytes_of.__getitem__, word.encode("utf-8")))

    def _greedy(self, chars: str) -> list[int]:
        out, at, n, get, reach = [], 0, len(chars), self.vocab.get, self.reach.get
        while at < n:
            stop = at + reach(chars[at : at + 2], 1)
            if stop >= n:
                stop = n
                t = get(chars[at:] + END)
            else:
                t = get(chars[at:stop])
            while t is None:
                stop -= 1
                t = get(chars[at:stop])
            out.append(t)
            at = stop
        return out

    def _arises(self, token: int) -> bool:
        """Whether merging the characters of a token gives that token."""
        known = self.sound.get(token)
        if known is None:
            t = self.tokens[token]
            known = self.sound[token] = self._merge(t.removesuffix(END), t.endswith(END)) == [token]
        return known

    # Verification

    def _merge_time(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of merging x with y, or a number beyond all ranks."""
        want = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_rank[at], 1 << 40)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joined characters keeps the border between them.

        Going back in time, the token that was formed later is replaced by its part at the border. At each step a merge across the border
        must not come before the merge that ended this state; of equal ranks the leftmost comes first.
        """
        good = np.ones(len(left), bool)
        live = np.arange(len(left))
        x, y = left.astype(np.int64), right.astype(np.int64)
        x_until, y_until = np.full(len(x), 1 << 39), np.full(len(y), 1 << 39)
        while len(live):
            across = self._merge_time(x, y)
            bad = (across < x_until) & (across <= y_until)
            good[live[bad]] = False
            tx, ty = self.time[x], self.time[y]
            on = ~bad & ((tx >= 0) | (ty >= 0))
            live, x, y, x_until, y_until, tx, ty = (v[on] for v in (live, x, y, x_until, y_until, tx, ty))
            back_x = tx > ty
            x_until, y_until = np.where(back_x, tx, x_until), np.where(back_x, y_until, ty)
            x, y = np.where(back_x, self.last[x], x), np.where(back_x, y, self.first[y])
        return good

    # Exact merging

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.ranks.get
        found = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) is not NEVER:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge(self, chars: str, end: bool = True) -> list[int]:
        ids = [self.vocab[c] for c in chars]
        if end:
            ids[-1] = self.vocab[chars[-1] + END]
        if len(ids) <= 32:
            return self._merge_short(ids)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, i) for i in range(n - 1) if (r := self.ranks.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.ranks.get((ids[i], ids[j])) != (rank, made):
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := self.ranks.get((made, ids[k])):
                    heapq.heappush(heap, (r[0], i, r[1]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((ids[h], made))):
                heapq.heappush(heap, (r[0], h, r[1]))
        return [t for t in ids if t >= 0]

    # Words of a batch

    def learn(self, words: list[str], as_chars: bool = False) -> list[list[int]]:
        """Ids of each word: proposals, one test of all their adjacent pairs, and exact merging of the words that fail."""
        if not words:
            return []
        chars = words if as_chars else [self._chars(w) for w in words]
        proposals = [self._greedy(c) for c in chars]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        good = np.ones(len(flat), bool)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        pairs, which = np.unique(flat[at] << 32 | flat[at + 1], return_inverse=True)
        good[at] = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]
        used, which = np.unique(flat, return_inverse=True)
        good &= np.fromiter(map(self._arises, used.tolist()), bool, len(used))[which]
        kept = np.logical_and.reduceat(good, ends - sizes)
        self.speculated += int(kept.sum())
        self.merged += int((~kept).sum())
        return [p if ok else self._merge(c) for p, c, ok in zip(proposals, chars, kept.tolist(), strict=True)]

    def _learned(self, keys: list[str]) -> Iterator[list[int]]:
        """Ids of each new chunk. Chunks with a leading zero character are byte-level strings, with two special tokens."""
        pieces = [[] if k[:2] == "\x00\x00" else [k[1:]] if k[:1] == "\x00" else self.plain.findall(k) for k in keys]
        words = {(w, k[:1] == "\x00") for k, p in zip(keys, pieces, strict=True) for w in p}
        ids: dict[tuple[str, bool], list[int]] = {}
        for as_chars in (False, True):
            own = [w for w, kind in words if kind == as_chars]
            ids.update(zip([(w, as_chars) for w in own], self.learn(own, as_chars), strict=True))
        for k, p in zip(keys, pieces, strict=True):
            kind = k[:1] == "\x00"
            yield [t for w in p for t in ids[w, kind]] if p else [self.special[k[2:]]]

    def _fill(self) -> None:
        """Put the chunks that were met first just now into the tables."""
        new, self.index.pending = self.index.pending, []
        if not new:
            return
        try:
            got = list(self._learned(new))
        except BaseException:
            # No chunk may keep a row that was never filled.
            for k in new:
                del self.index[k]
            raise
        self.ids.add(got)
        if self.said is not None:
            tokens = self.token_bytes
            self.said.add([b"".join([tokens[t] for t in own]) for own in got])
        self.order += new
        if self.base is None and (len(self.order) >= self.room or self.ids.end > CACHED_IDS):
            self.base = len(self.order)

    def _shed(self) -> None:
        """Forget the chunks that came after the tables were full."""
        if self.base is not None and (len(self.order) - self.base > self.room // 5 or self.ids.end - self.ids.start[self.base] > CACHED_IDS):
            for k in self.order[self.base :]:
                del self.index[k]
            del self.order[self.base :]
            for t in (self.ids, self.said):
                if t is not None:
                    t.cut(self.base)

    def _keys(self, text: str) -> list[str]:
        """Chunks of a text. No word crosses white space, so a chunk between white space is encoded on its own."""
        if "<|" not in text and self.is_plain.fullmatch(text):
            return text.lower().split()
        keys: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                keys.append("\x00\x00" + part)
            elif self.is_plain.fullmatch(part):
                keys += part.lower().split()
            else:
                if self._library is None:
                    from tokenizers import Tokenizer

                    self._library = Tokenizer.from_file(self.path)
                norm = self._library.normalizer.normalize_str(part)
                keys += ["\x00" + w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(norm)]
        return keys

    def _found(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Table rows of all chunks of the texts, and how many each text has."""
        self._shed()
        keys = [self._keys(t) for t in texts]
        sizes = list(map(len, keys))
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(keys)), np.int64, sum(sizes))
        self._fill()
        return rows, sizes

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text (without the decoded text)."""
        rows, sizes = self._found(texts)
        flat, ends = self.ids.gather(rows)
        at = 0
        for stop in np.concatenate(([0], ends))[np.cumsum(sizes)].tolist() if len(sizes) else ():
            yield flat[at:stop]
            at = stop

    def encode_decode_many(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        if self.said is None:
            self.said = Ragged(np.uint8)
            self.said.add([b"".join([self.token_bytes[t] for t in self.ids.row(i)]) for i in range(len(self.order))])
        rows, sizes = self._found(texts)
        flat, ends = self.ids.gather(rows)
        said, said_ends = self.said.gather(rows)
        last, at, said_at = np.cumsum(sizes), 0, 0
        stops, said_stops = (np.concatenate(([0], e))[last].tolist() for e in (ends, said_ends))
        for stop, said_stop in zip(stops, said_stops, strict=True):
            yield flat[at:stop].astype("<u4").tobytes(), said[said_at : max(said_at, said_stop - 1)].tobytes()
            at, said_at = stop, said_stop

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text])).astype("<u4").tobytes()

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        ids, said = next(self.encode_decode_many([text]))
        return ids, said.decode("utf-8")

    def decode(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4")])


def slices(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about so many characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def load(path: str) -> WordBPE:
    """One encoder for each process and file."""
    return process_state(f"bpe {path}", lambda: WordBPE(path))


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids (binary) and the decoded text.

    Only doc_id and text are read, so other columns cannot clash. A null text counts as empty; repeated rows give repeated rows.
    """
    path = path or default_path()
    more = ", ids binary, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for run_of in slices(batch.column(1).to_pylist()):
                for ids, said in bpe.encode_decode_many(run_of):
                    for out, v in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest(), *((ids, said.decode("utf-8")) if keep_ids else ())), strict=False):
                        out.append(v)
            columns = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            if keep_ids:
                columns += [pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
