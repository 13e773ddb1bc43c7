"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. In every round (window) a source gets a quantum in proportion to its target share; what is less than a whole
token is carried to its next round, so after r rounds it has sent floor(r * quantum) tokens. That closed form is the whole state of the
round-robin: any task can tell from a token's place in its queue in which round it leaves and where it lands in the one output stream, which is
then cut every 4096 tokens. Queue places come from prefix sums over tasks and queues; documents themselves are never shuffled or sorted, and a
hot source is split over the tasks that read it. A source that runs dry sends its rest and leaves the round; the others go on.

Results: null and empty texts are the end token alone; a null source is a queue of its own; repeated rows are packed as often as they occur;
an empty table gives no rows. Beyond MAX_QUEUES sources, those with a target and the MAX_QUEUES with the most text are queues of their own, and
the others share as many queues by hash. Only doc_id, text and source are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, process_state, saved, table, text_of
from marginalia.llm.word_bpe import WordBPE, default_path, slices

LENGTH, END_ID, MAX_QUEUES = 4096, 2, 256
#: Chunks of text whose ids a Python worker keeps; ROOM_BESIDE where other operators share the worker's memory.
ROOM, ROOM_BESIDE = 700_000, 250_000
#: Tokens of one round of the queues: one sequence, so that each holds the mixture.
WINDOW = LENGTH


@dataclass
class Phase:
    """Rounds in which the same queues take part. ``before``: tokens each queue has sent earlier; ``at``: where the phase begins in the stream."""

    at: int
    before: dict[str, int]
    parts: dict[str, int]
    whole: int
    rounds: int
    flush: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Schedule:
    total: int
    window: int
    phases: list[Phase]

    def __post_init__(self):
        self._rounds: dict[tuple[int, int], tuple[int, dict[str, int]]] = {}

    def _round(self, k: int, r: int) -> dict[str, int]:
        """Where each queue's tokens of round r of phase k begin in the stream."""
        known = self._rounds.get((k, r))
        if known is None:
            if len(self._rounds) > 4096:
                self._rounds.clear()
            p, known = self.phases[k], {}
            at = p.at + sum(r * a * self.window // p.whole for a in p.parts.values())
            for q, a in p.parts.items():
                known[q] = at
                at += (r + 1) * a * self.window // p.whole - r * a * self.window // p.whole
            self._rounds[k, r] = known
        return known

    def runs(self, queue: str, first: int, n: int) -> Iterator[tuple[int, int]]:
        """Stream places of a queue's tokens ``first`` to ``first + n``, as (place, count)."""
        for k, p in enumerate(self.phases):
            if not n:
                return
            if queue not in p.parts:
                continue
            a, y = p.parts[queue] * self.window, first - p.before[queue]
            sent = p.rounds * a // p.whole
            while n and y < sent:
                r = ((y + 1) * p.whole - 1) // a
                begin, end = r * a // p.whole, (r + 1) * a // p.whole
                m = min(n, end - y)
                yield self._round(k, r)[queue] + y - begin, m
                y, first, n = y + m, first + m, n - m
            for q, at, rest in p.flush:
                if n and q == queue:
                    m = min(n, sent + rest - y)
                    yield at + y - sent, m
                    first, n = first + m, n - m


def schedule(totals: dict[str, int], targets: dict[str, int] | None = None, window: int = WINDOW) -> Schedule:
    """Phases of the round-robin over queues with so many tokens. ``targets``: whole-number weights; queues without one, or all by default,
    weigh as many tokens as they hold, so that all run dry together. A weight below one counts as one."""
    left = {q: n for q, n in sorted(totals.items()) if n}
    weight = {q: max(1, int((targets or totals).get(q, totals[q]))) for q in left}
    before, at, phases = dict.fromkeys(left, 0), 0, []
    while left:
        whole = sum(weight[q] for q in left)
        rounds = min(left[q] * whole // (weight[q] * window) for q in left)
        phase = Phase(at, {q: before[q] for q in left}, {q: weight[q] for q in left}, whole, rounds)
        at += sum(rounds * weight[q] * window // whole for q in left)
        for q in list(left):
            sent = rounds * weight[q] * window // whole
            before[q] += sent
            left[q] -= sent
        for q in list(left):
            if left[q] < (rounds + 1) * weight[q] * window // whole - rounds * weight[q] * window // whole or left[q] * whole < weight[q] * window:
                phase.flush.append((q, at, left[q]))
                at += left[q]
                del left[q]
        phases.append(phase)
    return Schedule(at, window, phases)


def sequence_of(place: int, total: int, length: int = LENGTH) -> tuple[int, int, int]:
    """Sequence, offset there and sequence length of a place in the stream. What does not fill a whole sequence at the end is cut into
    powers of two, which need no padding."""
    full, rest = divmod(total, length)
    if place < full * length:
        return place // length, place % length, length
    place -= full * length
    for i in range(length.bit_length() - 1, -1, -1):
        if rest >> i & 1:
            if place < 1 << i:
                return full, place, 1 << i
            place -= 1 << i
            full += 1
    raise ValueError("beyond the stream")


def cut(sched: Schedule, queue: str, first: int, n: int, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of a document: start, count, sequence, offset. Runs that meet in the stream are one piece."""
    start, place, count = 0, -1, 0
    runs = list(sched.runs(queue, first, n))
    for i, (p, m) in enumerate(runs):
        if place + count == p and count:
            count += m
        else:
            place, count = p, m
        if i + 1 < len(runs) and runs[i + 1][0] == place + count:
            continue
        while count:
            seq, off, size = sequence_of(place, sched.total, length)
            k = min(count, size - off)
            yield start, k, seq, off
            start, place, count = start + k, place + k, count - k
        place, count = -1, 0


class LibraryWords(WordBPE):
    """Ids by the tokenizers library: chunks between white space that were not met yet are encoded by the library in one call."""

    def __init__(self, path: str, room: int):
        from tokenizers import Tokenizer

        super().__init__(path, room)
        self._tokenizer = Tokenizer.from_file(path)

    def _learned(self, keys: list[str]) -> list[list[int]]:
        plain = [k for k in keys if k[0] != "\x00" and "<|" not in k]
        got = self._tokenizer.encode(" ".join(plain), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        ids = got.ids
        begins = np.fromiter(map(itemgetter(0), got.offsets), np.int64, len(ids))
        stops = np.searchsorted(begins, ends).tolist()
        found = [ids[a:z] for a, z in zip([0, *stops], stops, strict=False)]
        if len(plain) == len(keys):
            return found
        rest = iter(found)
        return [next(rest) if k[0] != "\x00" and "<|" not in k else self._special(k) for k in keys]

    def _special(self, key: str) -> list[int]:
        """Ids of a special token, of byte-level characters, or of a chunk that may have become a special token by lower case."""
        if key[:2] == "\x00\x00":
            return [self.special[key[2:]]]
        words = [key[1:]] if key[0] == "\x00" else [self._chars(w) for w in self.plain.findall(key)]
        return [t.id for w in words for t in self._tokenizer.model.tokenize(w)]


def by_library(path: str, room: int = ROOM) -> LibraryWords:
    return process_state(f"ids {path} {room}", lambda: LibraryWords(path, room))


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, room: int = ROOM, own: Iterable = ()) -> DataFrame:
    """Rows part, doc_id, queue, n, before (the queue's tokens of this part ahead of the row), ids (16 bits each where the vocabulary allows).
    Sources in ``own`` have queues of their own in any case."""
    few = docs.select("source").distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES
    named = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("null"))
    queue = named
    if not few:
        largest = docs.groupBy(named.alias("queue")).agg(F.sum(F.length(text_of()) + F.lit(1)).alias("n")).orderBy(F.desc("n"), "queue").limit(MAX_QUEUES)
        alone = sorted({r["queue"] for r in largest.collect()} | {f"s:{k}" for k in own})
        queue = F.when(named.isin(alone), named).otherwise(F.concat(F.lit("h:"), F.pmod(F.xxhash64(named), F.lit(MAX_QUEUES)).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, sent = by_library(path, room), TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, n, before = [], [], []
            queues = batch.column(2).to_pylist()
            for run_of in slices(batch.column(1).to_pylist()):
                for raw in bpe.encode_many(run_of):
                    q = queues[len(n)]
                    ids.append(np.append(raw, raw.dtype.type(end_id)).astype(bpe.width).tobytes())
                    n.append(len(raw) + 1)
                    before.append(sent.get(q, 0))
                    sent[q] = before[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "queue", "n", "before", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), queue.alias("queue")).mapInArrow(run, "part int, doc_id long, queue string, n long, before long, ids binary")


def pack(docs: DataFrame, path: str | None = None, targets: dict[str, int] | None = None, length: int = LENGTH, window: int = WINDOW, keep_ids: bool = False, room: int = ROOM) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, and with ``keep_ids`` the ids (32 bits each).

    ``targets`` maps a source to a whole-number weight. The tokenized table is written once to the shared scratch folder, so every task that
    is repeated after a loss sees the same parts and places.
    """
    path = path or default_path()
    rows = saved(tokenized(docs, path, room=room, own=targets or ()), "tokenized")
    sums = saved(rows.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # at most twice MAX_QUEUES rows and the targets
    sched = schedule(totals, {f"s:{k}": v for k, v in targets.items()} if targets else None, window)
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "queue", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = rows.join(base, ["part", "queue"]).select("doc_id", "queue", "n", (F.col("base") + F.col("before")).alias("first"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, lengths, sums, seqs, offs, texts, counts = [], [], [], [], [], [], []
            for queue, n, first, raw in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                before = len(starts)
                for start, k, seq, off in cut(sched, queue, first, n, length):
                    piece = ids[4 * start : 4 * (start + k)]
                    starts.append(start)
                    lengths.append(k)
                    sums.append(zlib.crc32(piece))
                    seqs.append(seq)
                    offs.append(off)
                    if keep_ids:
                        texts.append(piece)
                counts.append(len(starts) - before)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            doc, queue, n = (batch.column(c).take(at) for c in range(3))
            long = lambda v: pa.array(np.array(v, np.int64))
            ids = pa.array(texts, pa.binary()) if keep_ids else pa.nulls(len(starts), pa.binary())
            yield pa.RecordBatch.from_arrays([doc, long(starts), long(lengths), long(sums), n, long(seqs), long(offs), queue, ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"])

    got = placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary")
    return got if keep_ids else got.drop("ids")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, room=ROOM_BESIDE)
