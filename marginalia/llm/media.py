"""Media columns: interleaved document sequences.

HTML is parsed into an ordered list of structs, each a text or a media reference with its position and caption. A reference names its payload by
digest. Payloads are stored once in content-addressed form, as 8-bit grey PGM images 64 samples wide, and are read back, checked and described;
a join on the digest then attaches them to the references, so positions and captions stay with their payload. Only digests and features travel
through the join, and digests that very many references share are joined by broadcast.

Rows go to and from Python in lots of about LOT bytes, whatever the number of rows, so that memory is bounded by the longest payload.

Results: null texts and HTML count as empty; an unknown digest leaves the media fields null; repeated rows give repeated rows; an empty table
gives no rows. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import join_hot, saved, table, text_of

WIDTH = 64
SCHEME = "sha256:"
#: Bytes of payloads that a task holds before it gives them on.
LOT = 2 << 20
SKIPPED = {"script", "style", "template", "noscript", "head"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "section", "article", "figure", "figcaption", "nav", "header", "footer", "blockquote", "pre", "body", "html"}


class Interleaver(HTMLParser):
    """Ordered items (kind, text, ref, caption). A caption is the figcaption of the figure around a medium, else its alt text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append(["text", text, None, None])
        self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed") and not self.skip:
            own = dict(attrs)
            if own.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append(["media", None, own["src"], own.get("alt") or None])

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure or ():
                self.items[i][3] = text
            if not self.figure and text:
                self.items.append(["text", text, None, None])
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str) -> list[list]:
    p = Interleaver()
    p.feed(html)
    p.close()
    p.flush()
    return p.items


ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``items``: array of struct(position, kind, text, ref, caption) in reading order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(ITEM.names, (i, *item), strict=True)) for i, item in enumerate(parse(h))] for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(ITEM))], names=[key, "items"])

    return pages.select(F.col(key).cast("long").alias(key), text_of(html).alias(html)).mapInArrow(run, f"{key} long, items array<struct<position int, kind string, text string, ref string, caption string>>")


def payload_of(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(media: bytes) -> tuple[int, int, bytes]:
    magic, size, top, rest = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit grey image")
    return width, height, rest


def feature_of(width: int, height: int, samples: bytes) -> str:
    """Size, mean, deviation, and a 64-bit difference hash over an 8 by 9 grid of block means, of the samples read back."""
    image = np.frombuffer(samples, np.uint8)
    n = len(image)
    levels, counts = np.arange(256), np.bincount(image, minlength=256)
    total, squares = int(counts @ levels), int(counts @ levels**2)
    edges = np.arange(73) * n // 72
    # Empty cells, which images of less than 72 samples have, count as 0.
    sizes = edges[1:] - edges[:-1]
    sums = np.zeros(72, np.int64)
    sums[sizes > 0] = np.add.reduceat(image, edges[:-1][sizes > 0], dtype=np.int64)
    cells = sums * 1000 // np.maximum(1, sizes)
    grid = cells.reshape(8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).reshape(-1)
    dhash = int("".join("1" if b else "0" for b in bits), 2)
    return f"{width}x{height};mean={total * 1000 // n};var={(squares * n - total * total) * 100 // (n * n)};dhash={dhash:016x}"


def store(texts: DataFrame, name: str = "media") -> DataFrame:
    """The media table (digest, n_bytes, media), written to the shared folder: payloads of the texts, once for each digest and reading task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lot(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], names=["digest", "n_bytes", "media"])

        seen: set[bytes] = set()
        for batch in batches:
            rows, size = [], 0
            for text in batch.column(0):
                raw = text.as_py().encode("utf-8")
                digest = hashlib.sha256(raw).digest()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest.hex(), len(raw), to_pgm(payload_of(raw))))
                    size += len(raw)
                if size >= LOT:
                    yield lot(rows)
                    rows, size = [], 0
            yield lot(rows)

    return saved(texts.select(text_of().alias("text")).mapInArrow(run, "digest string, n_bytes long, media binary"), name)


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """One row for each digest, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, raw in zip(*batch.columns, strict=True):
                raw = raw.as_py()
                width, height, samples = from_pgm(raw)
                if hashlib.sha256(samples[: n.as_py()]).hexdigest() != digest.as_py():
                    raise ValueError("stored media differ from their digest")
                rows.append((digest.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature_of(width, height, samples)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def sequences(pages: DataFrame, features: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``items`` of each page in reading order, with the features of every payload beside its reference: array of struct(position, kind,
    text, ref, caption, payload_sha256, media_bytes, feature), the last three null for texts and for references that no payload answers. Rows
    that repeat a page keep a sequence each."""
    found = saved(interleave(pages, key, html).withColumn("_row", F.monotonically_increasing_id()), "sequences")
    own = ["payload_sha256", "media_bytes", "feature"]
    payloads = resolve(found.drop(key).withColumnRenamed("_row", key), features, key).select(F.col(key).alias("_row"), F.struct("position", *own).alias("m"))
    by_page = payloads.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("m.position", "m"))).alias("_media"))
    at = lambda i, name: F.try_element_at("_media", i["position"])[name].alias(name)
    whole = F.transform("items", lambda i: F.struct(*(i[n].alias(n) for n in ITEM.names), *(at(i, n) for n in own)))
    return found.join(by_page, "_row", "left").select(key, whole.alias("items"))


def resolve(sequences: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """One row per media reference: ``key``, position, ref, caption and the features of its payload, null where the digest is unknown."""
    refs = sequences.select(key, F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("item")).select(
        key, F.col("item.position").alias("position"), F.col("item.ref").alias("ref"), F.col("item.caption").alias("caption"), F.when(F.col("item.ref").startswith(SCHEME), F.substring("item.ref", len(SCHEME) + 1, 64)).alias("digest")
    )
    return join_hot(refs, features, "digest")


def as_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page whose figure refers to the document's text by digest."""
    digest = F.sha2(text_of().cast("binary"), 256)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("unnamed"))
    page = F.concat(F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="sha256:'), digest, F.lit('"><figcaption>Text of document '), name, F.lit("</figcaption></figure><p>End.</p></article>"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), page.alias("html"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = saved(interleave(as_pages(docs), "doc_id"), "sequences")
    return resolve(found, saved(described(store(docs)), "features"), "doc_id").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
