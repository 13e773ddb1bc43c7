"""N-gram Jaccard join by chosen paths.

Texts are sets of shingles of five words. Texts with equal sets form a class, so copies are joined once. In each of RUNS runs a set chooses
tokens by a hash that all sets share, about BRANCH of them for each set whatever its size; sets that choose the same token meet in its bucket.
Sets that are similar meet more often than others, by the ratio of their intersection to the larger set. A bucket of more than SMALL sets is
split again: each member chooses from its own pool of tokens with a hash of the path so far, up to DEPTH levels. Buckets with the same members
are kept once. In the buckets left, pairs are first compared on the pools (a shared-threshold sample of both sets), and only sets that pass with
some partner are compared in full, so links are exact. A pair that meets in several buckets counts in the smallest.

RUNS is what the target recall takes: two sets at the threshold share a first choice in a run with probability 1 - exp(-0.8 BRANCH) at least, and
deeper levels with SPLIT choices keep 0.8 of it, so a pair escapes all runs with a probability below 1e-4.

No pair leaves a task: a bucket gives each member's number of links and the edges of a spanning forest. Buckets of more than BLOCK members are
compared block against block in different tasks.

Results: null counts as empty; a text without words is linked with nothing; ties take the smallest doc_id (null last); repeated rows count as
copies; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import components, join_hot, process_state, saved, table, text_of, unused, without
from marginalia.llm.shingles import mix, shingle_sets

THRESHOLD, RUNS, BRANCH, SPLIT, DEPTH = 0.8, 12, 1.5, 2.5, 2
POOL, SMALL, BLOCK = 64, 192, 512
#: Share of the expected common tokens of two pools at the threshold that a pair must have to be compared in full.
SIEVE = 0.4
LAST = (1 << 63) - 1
_U = np.uint64
_RUN_KEYS = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F))


def signature(tokens: np.ndarray) -> bytes:
    """128 bits of a set: two sums over its tokens, mixed in two ways, and its size."""
    one, two = mix(tokens), mix(tokens ^ _U(0x5851F42D4C957F2D))
    return np.array([one.sum(dtype=_U) ^ _U(len(tokens)), two.sum(dtype=_U)], _U).tobytes()


def chosen(tokens: np.ndarray, runs: int, branch: float) -> np.ndarray:
    """Paths of one token that a set chooses in all runs."""
    limit = _U(min((1 << 64) - 1, int(branch / len(tokens) * (1 << 64))))
    out = [mix(picked ^ k) for k in _RUN_KEYS[:runs] for picked in (tokens[mix(tokens + k) <= limit],) if len(picked)]
    return np.concatenate(out) if out else tokens[:0]


def pool(tokens: np.ndarray, size: int) -> np.ndarray:
    """A sample by a threshold on a hash that all sets share: about ``size`` tokens, all of a smaller set."""
    if len(tokens) <= size:
        return tokens
    return tokens[mix(tokens ^ _U(0x2545F4914F6CDD1D)) <= _U(int(size / len(tokens) * (1 << 64)))]


def longs(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def described(docs: DataFrame, runs: int = RUNS, branch: float = BRANCH, pool_size: int = POOL) -> DataFrame:
    """Per row: doc_id, sig (null without words), n, paths, pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_state("sets")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for s in shingle_sets(batch.column(1).to_pylist()):
                for o, v in zip(out, (signature(s), len(s), longs(chosen(s, runs, branch)), longs(pool(s, pool_size))) if len(s) else (None, 0, [], []), strict=True):
                    o.append(v)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], lists), pa.array(out[3], lists)], names=["doc_id", "sig", "n", "paths", "pool"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, sig binary, n int, paths array<long>, pool array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """sig and the sorted shingles as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "tokens"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "sig binary, tokens binary").filter("sig is not null")


def leaves(classes: DataFrame, small: int = SMALL, split: float = SPLIT, depth: int = DEPTH) -> DataFrame:
    """Buckets (path, sig) of at least two classes: small ones of any level, and those of the last level."""
    rows = classes.select("sig", F.explode("paths").alias("path"), F.array().cast("array<long>").alias("used"))
    found = []
    for level in range(1, depth + 1):
        counts = saved(rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), f"counts{level}")
        met = saved(join_hot(rows, counts, "path", "inner", counts=counts.select("path", F.col("m").alias("_n"))), f"met{level}")
        found.append(met.filter(F.col("m") <= small if level < depth else F.lit(True)).select("path", "sig"))
        large = met.filter(F.col("m") > small)
        if level == depth or large.isEmpty():
            break
        # A member chooses about ``split`` tokens of its pool, by a hash of the path and the token.
        rate = F.lit(int(split * (1 << 32))) / F.greatest(F.lit(1), F.size("pool"))
        picks = F.filter("pool", lambda t: (F.pmod(F.xxhash64("path", t), F.lit(1 << 32)) < F.col("rate")) & ~F.array_contains("used", t))
        rows = large.join(classes.select("sig", "pool"), "sig").withColumn("rate", rate).select("sig", "path", "used", F.explode(picks).alias("token"))
        rows = saved(rows.select("sig", F.xxhash64("path", "token", F.lit(level)).alias("path"), F.concat("used", F.array("token")).alias("used")), f"rows{level}")
    every = reduce(DataFrame.unionByName, found)
    same = every.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "sig")).alias("x"))
    once = same.groupBy("m", "s", "x").agg(F.min("path").alias("path")).select("path", "m")
    return every.join(once, "path")


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of a bucket of m, dealt so that any two meet in one group (path, i, j): by itself if small, else each pair of blocks."""
    nb = F.ceil(F.col("m") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("sig"), nb).cast("int")
    dealt = rows.withColumn("nb", nb).withColumn("own", F.when(F.col("nb") == 1, F.lit(0)).otherwise(own)).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "n", "paths", "tokens")


def incidence(lists: list[np.ndarray]) -> np.ndarray:
    """0/1 matrix of the members' tokens that at least two members have."""
    sizes = [len(x) for x in lists]
    values, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    out = np.zeros((len(lists), int(shared.sum())), np.float32)
    out[np.repeat(np.arange(len(lists)), sizes)[keep], place[column[keep]]] = 1
    return out


def shared_counts(lists: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """Sizes of the intersections of all members; the tokens are taken in strips, so that no matrix has many more than ``cells`` cells."""
    strips = 1 + len(lists) * sum(map(len, lists)) // cells
    if strips == 1:
        x = incidence(lists)
        return x @ x.T
    out = np.zeros((len(lists), len(lists)), np.float32)
    for k in range(strips):
        x = incidence([t[(t % t.dtype.type(strips)) == k] for t in lists])
        out += x @ x.T
    return out


def linked(path: int, diagonal: bool, own: np.ndarray, n: np.ndarray, paths: list[np.ndarray], tokens: list[np.ndarray], pools: bool, threshold: float, pool_size: int) -> np.ndarray:
    """Which members are linked by this group: similar, and not together in a smaller bucket."""
    common = shared_counts(tokens)
    needed = threshold / (1 + threshold) * (n[:, None] + n[None, :])
    if pools:
        needed = needed * SIEVE * np.minimum(1.0, pool_size / np.maximum(n[:, None], n[None, :]))
    out = common >= needed - 1e-6
    np.fill_diagonal(out, False)
    if not diagonal:
        out &= own[:, None] != own[None, :]
    rows = np.flatnonzero(out.any(1))
    if len(rows):
        lower = incidence([paths[i][paths[i] < path] for i in rows]) if any((paths[i] < path).any() for i in rows) else None
        if lower is not None:
            out[np.ix_(rows, rows)] &= (lower @ lower.T) == 0
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of each (path, i, j), which follow one another."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != at:
                if len(rows) > 1:
                    yield at, rows
                at, rows = row[:3], []
            rows.append(row[3:])
    if len(rows) > 1:
        yield at, rows


def compared(rows: DataFrame, pools: bool, threshold: float, pool_size: int) -> DataFrame:
    """With ``pools``: rows (path, sig) of members that may be linked in the bucket. Else rows (sig, other, links): a member's number of links,
    and edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (path, i, j), members in groups(batches):
            own, sig, n, paths, tokens = zip(*members, strict=True)
            links = linked(path, i == j, np.array(own), np.array(n, float), [np.array(p, np.int64) for p in paths], [np.frombuffer(t, _U) for t in tokens], pools, threshold, pool_size)
            if pools:
                out += [(path, sig[k]) for k in np.flatnonzero(links.any(1))]
            else:
                out += [(sig[k], None, c) for k, c in enumerate(links.sum(1).tolist()) if c]
                out += [(sig[a], sig[b], 0) for a, b in forest(links)]
            if len(out) > 20_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [("path", pa.int64()), ("sig", pa.binary())] if pools else [("sig", pa.binary()), ("other", pa.binary()), ("links", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])

    dealt = rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return dealt.mapInArrow(run, "path long, sig binary" if pools else "sig binary, other binary, links long")


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, fewer than members: breadth first, a row at a time."""
    out, new = [], links.any(1)
    while new.any():
        front = [int(np.argmax(new))]
        new[front[0]] = False
        while front:
            a = front.pop()
            for b in np.flatnonzero(links[a] & new).tolist():
                new[b] = False
                out.append((a, b))
                front.append(b)
    return out


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, pool_size: int = POOL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its component of links), set_id (smallest doc_id with the same shingles),
    n_links (classes of other texts linked with its class), n_copies (documents with the same shingles), kept (one document of each component)."""
    rows = saved(described(docs, runs, BRANCH, pool_size), "described")
    id_or_last = F.coalesce("doc_id", F.lit(LAST))
    first = F.min(F.struct(id_or_last.alias("set_id"), "n", "paths", "pool")).alias("f")
    classes = saved(rows.filter("sig is not null").groupBy("sig").agg(first, F.count(F.lit(1)).alias("n_copies")).select("sig", "n_copies", "f.*"), "classes")
    buckets = saved(leaves(classes, small), "leaves")
    lists = buckets.groupBy("sig").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    members = lists.join(classes.select("sig", "n", "pool"), "sig")
    # Pools travel as bytes, like full sets.
    as_bytes = saved(pool_bytes(members), "members")
    maybe = saved(compared(blocked(buckets.join(as_bytes, "sig"), block), True, threshold, pool_size).distinct(), "maybe")
    sizes = maybe.groupBy("path").agg(F.count(F.lit(1)).alias("m"))
    active = maybe.select("sig").distinct()
    ids = classes.join(active, "sig", "left_semi").select(F.when(F.col("set_id") < LAST, F.col("set_id")).alias("_want")).distinct()
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sets = full_sets(keep.join(ids, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi")).join(active, "sig", "left_semi").dropDuplicates(["sig"])
    exact = maybe.join(sizes, "path").join(sets, "sig").join(as_bytes.drop("tokens"), "sig")
    found = saved(compared(blocked(exact, block), False, threshold, pool_size), "links")
    counted = found.filter("other is null").groupBy("sig").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("other is not null").select(F.col("sig").alias("a"), F.col("other").alias("b")))
    placed = classes.select("sig", "set_id", "n_copies").join(roots.withColumnRenamed("node", "sig"), "sig", "left").join(counted, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    lowest = placed.groupBy("root").agg(F.min("set_id").alias("class_id"))
    result = saved(join_hot(placed, lowest, "root", "inner").select("sig", "set_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "result")
    joined = join_hot(rows.filter("sig is not null").select("doc_id", "sig"), result, "sig", "inner").drop("sig")
    alone = rows.filter("sig is null").select("doc_id", id_or_last.alias("set_id"), id_or_last.alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    own = lambda c: F.when(F.col(c) < LAST, F.col(c)).alias(c)
    return joined.unionByName(alone).select("doc_id", own("class_id"), own("set_id"), "n_links", "n_copies", (id_or_last == F.col("class_id")).alias("kept"))


def pool_bytes(members: DataFrame) -> DataFrame:
    """Pools as binary, little-endian 64-bit tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(p, np.int64).tobytes() for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["sig", "paths", "n", "tokens"])

    return members.select("sig", "paths", "n", "pool").mapInArrow(run, "sig binary, paths array<long>, n int, tokens binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, with all its columns."""
    own = unused(docs, "_gone")
    gone = saved(jaccard_links(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(own)).distinct(), "gone")
    return without(docs.withColumn(own, F.col("doc_id").cast("long")), gone, own).drop(own)
