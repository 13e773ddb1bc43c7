"""Line dedup: fuzzy lines by MinHash.

Lines (trimmed, without case) that are equal are one line before anything else. A line's shingles are all its runs of WIDTH characters, whatever
its length. BANDS bands of ROWS min-hashes each bring lines together; two lines at the threshold of 0.8 miss each other with a probability of
0.5 %, at 0.9 of 0.01 %. The smallest line of a band leads; its members are verified against it by the exact Jaccard similarity of the shingles,
and members that no path of such links joins to it are compared with all other members in blocks. The links go through distributed union-find, and the first line of each
component stays.

Shingles are hashed and compared with numpy for many lines at once; in built-in functions that takes more CPU time by itself than the whole
operator may (README, "Check figures"). All joins, groups and the union-find are DataFrame operations. Only texts of lines that met another one
travel, and each block of a band holds BLOCK lines and BLOCK_CHARS characters at most, but for one line longer than that.

Results: null counts as empty; blank lines stay and are not compared; a line shorter than a shingle is filled up with spaces to one; rows that
repeat a doc_id get the same decisions; null doc_ids come last; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.chosen_path import forest, shared_counts
from marginalia.llm.common import components, discard, join_hot, process_state, saved, sieved, table, text_of
from marginalia.llm.shingles import mix

THRESHOLD, BANDS, ROWS, WIDTH = 0.8, 10, 4, 8
BLOCK, BLOCK_CHARS = 256, 1 << 19
#: Characters that are hashed at once, and lines whose hash a task remembers, to sign most repeated lines once.
RUN, SEEN = 1 << 15, 1 << 18
SPACE = " \t\r\x0b\x0c"
LAST = (1 << 63) - 1
_U = np.uint64
_STEPS = mix(np.arange(1, 4, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)
_KEYS = mix(np.arange(1, 65, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of the runs of WIDTH characters at all places of a text, by runs of twice the length."""
    h, size = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1), 1
    for step in _STEPS:
        h = h[:-size] * step + h[size:]
        size *= 2
    return mix(h)


def filled(line: str) -> str:
    return line.ljust(WIDTH)


def min_hashes(lines: list[str], orders: int) -> np.ndarray:
    """A row for each order: the smallest value of each line's shingles."""
    keys = _KEYS[:orders]
    out = np.empty((len(keys), len(lines)), _U)
    run, size, first = [], 0, 0

    def flush() -> None:
        h = np.append(shingle_hashes("".join(run)), ~_U(0))
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))
        begins = np.concatenate(([0], ends[:-1]))
        places = np.stack([begins, ends - WIDTH + 1], 1).reshape(-1)
        for k, key in enumerate(keys):
            out[k, first : first + len(run)] = np.minimum.reduceat(h * key, places)[::2]

    for i, line in enumerate(map(filled, lines)):
        if run and size + len(line) > RUN:
            flush()
            run, size, first = [], 0, i
        if len(line) > 2 * RUN:
            # A very long line goes by in pieces that overlap by a shingle but one character.
            pieces = (shingle_hashes(line[at : at + RUN + WIDTH - 1]) for at in range(0, len(line) - WIDTH + 1, RUN))
            out[:, i] = np.minimum.reduce([[(h * key).min() for key in keys] for h in pieces])
            first = i + 1
        else:
            run.append(line)
            size += len(line)
    if run:
        flush()
    return out


def band_keys(lines: list[str], bands: int, rows: int) -> np.ndarray:
    """A row for each band: its key for each line."""
    m = min_hashes(lines, bands * rows)
    out = np.empty((bands, len(lines)), _U)
    for b in range(bands):
        key = np.full(len(lines), b + 1, _U)
        for r in range(rows):
            key = mix(key * _U(0x9FB21C651E98DF25) + m[b * rows + r])
        out[b] = key
    return out.view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each line: doc_id, line_no, oid (128 bits of the normalised line, null for blank ones); the keys b0, b1, ... of its bands and the
    normalised line itself stand at least once for each different line."""
    names = ["doc_id", "line_no", "oid", *(f"b{i}" for i in range(bands)), "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_state("lines")
        seen: set[bytes] = set()

        def lot(ids: list, numbers: list, oids: list, new: list[tuple[int, str]]) -> pa.RecordBatch:
            at = np.fromiter((i for i, _ in new), np.int64, len(new))
            lines = [x for _, x in new]
            first = np.ones(len(ids), bool)
            first[at] = False
            columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(oids, pa.binary())]
            for key in band_keys(lines, bands, rows):
                full = np.zeros(len(ids), np.int64)
                full[at] = key
                columns.append(pa.array(full, mask=first))
            texts = [None] * len(ids)
            for i, x in new:
                texts[i] = x
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=names)

        ids, numbers, oids, new, size = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for no, line in enumerate(text.as_py().split("\n")):
                    line, oid = line.strip(SPACE).lower(), None
                    if line:
                        oid = blake2b(line.encode(), digest_size=16).digest()
                        if oid not in seen:
                            if len(seen) < SEEN:
                                seen.add(oid)
                            new.append((len(ids), line))
                            size += len(line)
                    ids.append(doc)
                    numbers.append(no)
                    oids.append(oid)
                    if size > 1 << 20 or len(ids) > 20_000:
                        yield lot(ids, numbers, oids, new)
                        ids, numbers, oids, new, size = [], [], [], [], 0
        yield lot(ids, numbers, oids, new)

    keys = "".join(f"b{i} long, " for i in range(bands))
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, f"doc_id long, line_no int, oid binary, {keys}line string")


def sets_of(lines: list[str]) -> list[np.ndarray]:
    """The different shingles of each line, sorted."""
    return [np.unique(shingle_hashes(filled(x))) for x in lines]


def alike(pairs: DataFrame) -> DataFrame:
    """The pairs (code, lead, line, lead_line) whose lines are similar, as (code, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            keep = []
            for i, (lead, line, lead_line) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if lead != last:
                    last, (last_set,) = lead, sets_of([lead_line.as_py()])
                (own,) = sets_of([line.as_py()])
                least, most = sorted((len(own), len(last_set)))
                if least >= THRESHOLD * most:
                    at = np.minimum(np.searchsorted(last_set, own), len(last_set) - 1)
                    both = int((last_set[at] == own).sum())
                    if both >= THRESHOLD * (least + most - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["code", "lead"])

    return pairs.select("code", "lead", "line", "lead_line").mapInArrow(run, "code long, lead long")


def differing(members: DataFrame) -> DataFrame:
    """(band) of the bands with open members and members of more than one component, one of those with the same members."""
    seen = [F.bit_xor(F.xxhash64(F.lit(k), "code", "open")).alias(f"f{k}") for k in (1, 2)]
    each = members.groupBy("band").agg(F.bool_or("open").alias("any"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("m"), *seen)
    return each.filter("any and r1 <> r2").groupBy("m", "f1", "f2").agg(F.min("band").alias("band")).select("band")


def among(members: DataFrame, texts: DataFrame, block: int = BLOCK, chars: int = BLOCK_CHARS) -> DataFrame:
    """Links (a, b) of the open members (code, band, open, root) of a band, which are not in its leader's component, with all members of other
    components; without columns ``open`` and ``root`` each is open and a component. Blocks meet pairwise, but those of members that are not open don't meet
    each other; a pair of blocks gives the edges of a spanning forest of its links."""
    if "open" not in members.columns:
        members = members.withColumn("open", F.lit(True)).withColumn("root", F.col("code"))
    sized = members.join(texts.select("code", F.length("line").cast("long").alias("n")), "code")
    parts = sized.groupBy("band", "open").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / chars)).cast("int").alias("parts"))
    sizes = parts.groupBy("band").agg(*(F.coalesce(F.max(F.when(F.col("open") == is_open, F.col("parts"))), F.lit(0)).alias(c) for c, is_open in (("mb", True), ("nb", False))))
    spread = lambda n: F.pmod(F.xxhash64("code"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = join_hot(members, sizes, "band", "inner").withColumn("own", F.when(F.col("open"), spread("mb")).otherwise(F.col("mb") + spread("nb")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("open"), F.col("mb") + F.col("nb")).otherwise(F.col("mb")) - 1)))
    dealt = dealt.join(texts, "code").select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "code", "root", "own", "open", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for code, root, own, is_open, line in gathered(batches):
            root, own, is_open = np.array(root), np.array(own), np.array(is_open)
            may = (root[:, None] != root) & (is_open[:, None] | is_open)
            if (own != own[0]).any():
                may &= own[:, None] != own
            if may.any():
                sets = sets_of(line)
                n = np.fromiter(map(len, sets), float, len(sets))
                both = shared_counts(sets)
                links = may & (both >= THRESHOLD / (1 + THRESHOLD) * (n[:, None] + n) - 1e-6)
                out += [(code[a], code[b]) for a, b in forest(links)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long").distinct()


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Columns code, root, own, open, line of each pair of blocks (band, i, j), whose rows follow one another. A pair of two blocks is compared
    across them alone: members of one block meet where it is paired with itself."""
    at, rows = None, []

    def done() -> Iterator[tuple]:
        if len(rows) > 1:
            yield tuple(zip(*rows, strict=True))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != at:
                yield from done()
                at, rows = row[:3], []
            rows.append(row[3:])
    yield from done()


def kept_lines(docs: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """One row per line: doc_id, line_no (from 0), keep_doc_id, keep_line_no (first line of its component), kept."""
    rows = saved(signed(docs, bands, per_band), "lines")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "line_no")
    keys = [f"b{i}" for i in range(bands)]
    first = rows.filter("oid is not null").groupBy("oid").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("place"), *(F.max(b).alias(b) for b in keys))
    # Different lines get a number, which is fixed by writing it down.
    once = saved(first.withColumn("id", F.monotonically_increasing_id()), "once")
    banded = once.select(F.col("id").alias("code"), F.explode(F.array(*keys)).alias("band"))
    leaders = banded.groupBy("band").agg(F.min("code").alias("lead"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    leaders = saved(leaders, "leaders")
    met = saved(join_hot(banded, leaders.drop("_n"), "band", "inner", counts=leaders.select("band", "_n")).filter("code <> lead").select("code", "band", "lead"), "met")
    # The texts of the lines that met another one.
    codes = met.select("code").union(met.select("lead")).distinct().join(once.select(F.col("id").alias("code"), "oid"), "code")
    codes = saved(codes, "codes")
    texts = sieved(rows.filter("line is not null").select("oid", "line"), codes, "oid").join(codes, "oid").select("code", "line")
    texts = saved(texts.groupBy("code").agg(F.any_value("line").alias("line")), "texts")
    lead_lines = texts.select(F.col("code").alias("lead"), F.col("line").alias("lead_line"))
    pairs = saved(met.select("code", "lead").distinct(), "pairs")
    links = saved(alike(join_hot(pairs, lead_lines, "lead", "inner").join(texts, "code")), "links")
    # Members that no path of links joins to their leader meet all others of the band.
    edges = links.select(F.col("code").alias("a"), F.col("lead").alias("b"))
    known = saved(components(edges), "known")
    root = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    told = join_hot(met, root("lead"), "lead").join(root("code"), "code", "left").select("code", "band", F.coalesce("code_root", "code").alias("root"), F.coalesce("lead_root", "lead").alias("lead_root"))
    told = saved(told.select("code", "band", "root", (F.col("root") != F.col("lead_root")).alias("open")), "told")
    discard(met)
    more = saved(among(saved(told.join(differing(told), "band", "left_semi"), "rest"), texts), "more")
    roots = components(edges.unionByName(more)).withColumnRenamed("node", "id")
    placed = once.select("id", "oid", "m", "place").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = placed.groupBy("root").agg(F.min("place").alias("keep"))
    owner = saved(join_hot(placed.select("oid", "root"), lowest, "root", "inner").select("oid", "keep"), "owner")
    joined = join_hot(rows.filter("oid is not null").select("doc_id", "line_no", "oid"), owner, "oid", "inner", counts=once.select("oid", F.col("m").alias("_n")))
    blank = rows.filter("oid is null").select("doc_id", "line_no", place.alias("keep"))
    return joined.select("doc_id", "line_no", "keep").unionByName(blank).select(
        "doc_id", "line_no", F.when(F.col("keep.doc") < LAST, F.col("keep.doc")).alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), (place == F.col("keep")).alias("kept")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_lines(table(spark, sf_dir, "documents"))
