"""Exact dedup by Patricia-trie owners.

Each reading task inserts the full bytes of its normalised texts into a compressed radix trie whose terminal nodes keep the smallest identifier
and a count; a trie beyond its byte budget sends its largest subtree on and forgets it (spill by subtree). So a text leaves a task about once,
however many copies it has. The terminals are dealt by length and content hash, sorted by them, and inserted into the owner's trie of that
length and hash, which settles smallest identifier and group size. Members find their owner through the terminal of their own task, so the rows
of a large group stay spread over the tasks that read them.

Results: null counts as empty; of equal texts the row with the smallest doc_id stays (null last; of repeated rows with one doc_id, one row);
an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import process_state, saved, table, text_of, unused, without

#: Bytes of edge labels that a trie holds before it spills a subtree.
BUDGET = 24 << 20
LAST = (1 << 63) - 1


def common(a: bytes, b: bytes, at: int) -> int:
    """How many leading bytes of a equal those of b from ``at`` on; by halving, so that bytes are compared in runs."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


class RadixTrie:
    """Byte strings to values."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def node(self, key: bytes) -> Node:
        """The node of a key, made where missing."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + 200
                return child
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = common(child.label, key, at)
            upper = Node(child.label[:n])
            child.label = child.label[n:]
            upper.children[child.label[0]] = child
            node.children[upper.label[0]] = upper
            self.size += 200
            node, at = upper, at + n
        return node

    @staticmethod
    def terminals(node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            n, p = stack.pop()
            p += n.label
            if n.value is not None:
                yield p, n.value
            stack += [(c, p) for c in n.children.values()]

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            total += len(n.label) + 200
            stack += n.children.values()
        return total

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Take the largest subtree out: along the heaviest path, the first node without a child that holds most of it."""
        above, prefix, node = None, b"", self.root
        while node.children:
            heavy = max(node.children.values(), key=self.weight)
            if above is not None and self.weight(heavy) < self.size // 2:
                break
            above, prefix, node = node, prefix + node.label, heavy
        if above is None:
            return
        del above.children[node.label[0]]
        self.size -= self.weight(node)
        yield from self.terminals(node, prefix)


TERMINAL = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("terminal", pa.int64()), ("key", pa.binary()), ("best_id", pa.int64()), ("best_rid", pa.int64()), ("n", pa.int64())])


def local_owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Member rows (doc_id, rid, terminal) and, at a spill or the end, rows of terminals (terminal, key, best_id, best_rid, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_state("tries")
        rid, trie = TaskContext.get().partitionId() << 40, RadixTrie()

        def sent(found: Iterator) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for key, (first, best, best_rid, n) in found:
                rows.append((None, None, first, key, best, best_rid, n))
                size += len(key)
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        for batch in batches:
            members = []
            for doc, key in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                node, rank = trie.node(key.as_py()), LAST if doc is None else doc
                if node.value is None:
                    node.value = [rid, rank, rid, 0]
                v = node.value
                v[3] += 1
                if rank < v[1]:
                    v[1], v[2] = rank, rid
                members.append((doc, rid, v[0], None, None, None, None))
                rid += 1
                if trie.size > budget:
                    yield from sent(trie.spill())
            if members:
                yield batch_of(members)
        yield from sent(trie.terminals(trie.root))

    # Runs of white space become one space; a single space is left as it is.
    norm = F.regexp_replace(text_of(), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    return docs.select(F.col("doc_id").cast("long"), norm.cast("binary").alias("key")).mapInArrow(run, "doc_id long, rid long, terminal long, key binary, best_id long, best_rid long, n long")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TERMINAL, strict=True)], schema=TERMINAL)


def owners(terminals: DataFrame) -> DataFrame:
    """For each terminal of a reading task the group's keep_id, keep_rid, group_size and the text's SHA-256. Only one length and hash is in
    memory at a time; sorting by them, and spilling that, is Spark's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trie, out = None, RadixTrie(), []

        def settled() -> None:
            for key, (best, best_rid, n, members) in trie.terminals(trie.root):
                digest = hashlib.sha256(key).digest()
                out.extend((m, best, best_rid, n, digest) for m in members)

        def shown() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["terminal", "keep_id", "keep_rid", "group_size", "digest"])
            out.clear()
            return got

        for batch in batches:
            for size, digest, key, terminal, best, best_rid, n in zip(*batch.columns, strict=True):
                if at != (here := (size.as_py(), digest.as_py())):
                    settled()
                    at, trie = here, RadixTrie()
                node, best, best_rid = trie.node(key.as_py()), best.as_py(), best_rid.as_py()
                if node.value is None:
                    node.value = [best, best_rid, 0, []]
                v = node.value
                if (best, best_rid) < (v[0], v[1]):
                    v[0], v[1] = best, best_rid
                v[2] += n.as_py()
                v[3].append(terminal.as_py())
            if len(out) > 5000:
                yield shown()
        settled()
        if out:
            yield shown()

    keyed = terminals.select(F.length("key").alias("size"), F.xxhash64("key").alias("hash"), "key", "terminal", "best_id", "best_rid", "n")
    return keyed.repartition("size", "hash").sortWithinPartitions("size", "hash", "best_id", "best_rid").mapInArrow(run, "terminal long, keep_id long, keep_rid long, group_size long, digest binary")


def exact_groups(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    local = saved(local_owners(docs, budget), "local_owners")
    found = owners(local.filter(F.col("key").isNotNull()))
    members = local.filter(F.col("rid").isNotNull()).select("doc_id", "rid", "terminal")
    return members.join(found, "terminal").select(
        "doc_id", F.when(F.col("keep_id") < LAST, F.col("keep_id")).alias("keep_id"), "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat one doc_id and text, one."""
    same = F.struct("doc_id", "text_sha256")
    found = saved(exact_groups(docs), "groups")
    each = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    own = unused(docs, "_same")
    gone = each.filter(~F.col("kept")).select(same.alias(own))
    twice = each.filter("kept and n > 1").select(same.alias(own))
    norm = F.regexp_replace(text_of(), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    held = docs.withColumn(own, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(norm.cast("binary"), 256).alias("text_sha256")))
    left = without(held, gone, own)
    if not twice.isEmpty():
        left = without(left, twice, own).unionByName(left.join(twice, own, "left_semi").dropDuplicates([own]))
    return left.drop(own)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
