"""A knowledge base as one object: notes, keyword index and vectors in a folder, and the commands on them.

Every change writes a new snapshot of the tables it touches and then moves one pointer file, so readers see either the old or the new state, and a
change that fails leaves the old one. Commands give DataFrames; ``marginalia.sinks.formats.render`` turns them into text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia import admin
from marginalia.functions.text import bm25_text, default_title, vector_text, wiki_links
from marginalia.operators import bm25, graph, links, maintain, search, suggest, vectors
from marginalia.schema import NOTE_TYPES, NOTES
from marginalia.scratch import saved
from marginalia.sinks import formats
from marginalia.sources import git_log, markdown, tables
from marginalia.streaming import indexer

POINTER = "CURRENT"
PARTS = ("notes", "postings", "docs", "terms", "corpus", "vectors")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[list[str]], np.ndarray] = vectors.hashed_bag, dimension: int = vectors.DIMENSION):
        self.spark, self.path, self.encoder, self.dimension = spark, path.rstrip("/"), encoder, dimension
        self.last_import: dict | None = None
        if not self._parts():
            self._commit(spark.createDataFrame([], NOTES))

    # Snapshots

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _parts(self) -> dict[str, str]:
        fs, p = self._fs(f"{self.path}/{POINTER}")
        if not fs.exists(p):
            return {}
        rows = self.spark.read.text(f"{self.path}/{POINTER}").collect()
        return dict(r["value"].split("\t") for r in rows if r["value"])

    def _point(self, parts: dict[str, str]) -> None:
        text = "".join(f"{k}\t{v}\n" for k, v in sorted(parts.items()))
        fs, new = self._fs(f"{self.path}/{POINTER}.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        context.rename(new, self._fs(f"{self.path}/{POINTER}")[1], over)

    def _commit(self, notes: DataFrame | None = None, index: bm25.Index | None = None, table: DataFrame | None = None) -> None:
        """Write what changed. Notes alone give both indexes anew."""
        parts, folder = self._parts(), f"{self.path}/snapshots/{uuid.uuid4().hex}"

        def put(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            parts[name] = f"{folder}/{name}"
            return self.spark.read.parquet(parts[name])

        if notes is not None:
            notes = put("notes", notes.select(NOTES.names))
            if index is None:
                index, table = self._indexed(notes), self._encoded(notes)
        if index is not None:
            for name in PARTS[1:5]:
                put(name, getattr(index, name))
            index.release()
        if table is not None:
            put("vectors", table)
        self._point(parts)

    def _indexed(self, notes: DataFrame) -> bm25.Index:
        # Ids are times, so their order is that of insertion.
        return bm25.build(self._texts(notes.orderBy("id")))

    @staticmethod
    def _texts(notes: DataFrame) -> DataFrame:
        return notes.select("id", F.monotonically_increasing_id().alias("ord"), bm25_text(F.col("title"), F.col("content")).alias("text"))

    def _change(self, notes: DataFrame, ids: DataFrame) -> None:
        """Commit notes of which only some have other texts; both indexes take in those alone."""
        own = notes.join(ids.select("id"), "id", "left_semi")
        self._commit(notes, bm25.upsert(self.index, self._texts(own)), vectors.upsert(self.vectors, self._encoded(own)))

    def _encoded(self, notes: DataFrame) -> DataFrame:
        from marginalia.session import ship

        ship(self.spark)
        text = notes.select("id", "title", "type", "tags", vector_text(F.col("title"), F.col("content")).alias("text"))
        return vectors.encode(text, self.encoder, dimension=self.dimension).drop("text")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._parts()[name])

    @property
    def notes(self) -> DataFrame:
        return self._table("notes")

    @property
    def index(self) -> bm25.Index:
        return bm25.Index(*(self._table(n) for n in PARTS[1:5]))

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")

    # Changes

    def add_many(self, rows: DataFrame, note_type: str = "permanent", at: datetime | None = None) -> int:
        """Import rows (title, content, tags) as notes and index them in the same change; the number of notes. Rows with neither title nor content
        are left out; ``last_import`` counts them."""
        at, began = at or datetime.now(), datetime.now()
        rows, total = rows.filter("title is not null or content is not null"), rows.count()
        new = maintain.import_notes(rows, at.strftime("%Y-%m-%d %H:%M:%S"), note_type).withColumn("filepath", F.lit(None).cast("string"))
        self._change(maintain.upsert(self.notes, new.select(NOTES.names)), new)
        done = new.count()
        self.last_import = {"total": total, "imported": done, "failed": total - done, "seconds": (datetime.now() - began).total_seconds()}
        return done

    def add(self, content: str, title: str | None = None, note_type: str = "fleeting", tags: list[str] | None = None, source: str | None = None, template: str | None = None, templates: admin.Templates | None = None, at: datetime | None = None) -> tuple[str, list[str]]:
        """One note; its wiki links become links, and backlinks follow. Gives the id and the link texts without a note."""
        at = at or datetime.now()
        tags = list(tags or [])
        if template:
            made = (templates or admin.Templates()).render(template, {"title": title or "", "content": content, "source": source or ""}, at)
            title, content, note_type = made["title"], made["content"], made["note_type"]
            tags += [t for t in made["tags"] if t not in tags]
        if note_type not in NOTE_TYPES:
            raise ValueError(f"type {note_type}; one of {', '.join(NOTE_TYPES)}")
        taken = {r["id"] for r in self.notes.filter(F.startswith("id", F.lit(f"{at:%Y%m%d%H%M%S}"))).select("id").collect()}  # notes of one second
        note_id = next(i for n in range(10_000) if (i := f"{at:%Y%m%d%H%M%S}{n:04}") not in taken)
        one = self.spark.createDataFrame([(content,)], "content string").select("content", wiki_links(F.col("content")).alias("texts"), default_title(F.col("content")).alias("title")).first()
        asked = self.spark.createDataFrame([(t,) for t in one["texts"]], "link string")
        targets = {r["link"]: r["target"] for r in links.resolve(asked, self.notes).collect()}
        row = (note_id, title or one["title"], content, note_type, at, at, tags, [targets[t] for t in one["texts"] if t in targets], [], source, None)
        unresolved = [t for t in one["texts"] if t not in targets]
        one = self.spark.createDataFrame([row], NOTES)
        self._change(maintain.with_backlinks(maintain.upsert(self.notes, one)), one)
        return note_id, unresolved

    def edit(self, note_id: str, **fields) -> None:
        """Change title, content, tags, type or source of a note; new content gives new links and backlinks."""
        if not fields or set(fields) - {"title", "content", "tags", "type", "source"}:
            raise ValueError("nothing to change, or unknown fields")
        if self.notes.filter(F.col("id") == note_id).isEmpty():
            raise KeyError(note_id)
        if fields.get("type", NOTE_TYPES[0]) not in NOTE_TYPES:
            raise ValueError(fields["type"])
        kinds = {"tags": "array<string>"}
        if "content" in fields:
            texts = self.spark.createDataFrame([(fields["content"],)], "t string").select(wiki_links(F.col("t")).alias("l")).first()["l"]
            found = {r["link"]: r["target"] for r in links.resolve(self.spark.createDataFrame([(t,) for t in texts], "link string"), self.notes).collect()}
            fields, kinds = {**fields, "links": [found[t] for t in texts if t in found]}, {**kinds, "links": "array<string>"}
        schema = "id string, " + ", ".join(f"{k} {kinds.get(k, 'string')}" for k in fields)
        changes = self.spark.createDataFrame([(note_id, *fields.values())], schema)
        self._change(maintain.edit(self.notes, changes), changes)

    def delete(self, ids: list[str]) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self._commit(maintain.delete(self.notes, gone), bm25.remove(self.index, gone), vectors.remove(self.vectors, gone))

    def reindex(self) -> None:
        self._commit(self.notes)

    def reindex_keywords(self) -> None:
        """Build the keyword index alone anew."""
        self._commit(index=self._indexed(self.notes))

    def clear_indexes(self) -> None:
        """Empty both indexes; ``reindex`` fills them again."""
        self._commit(index=bm25.clear(self.index), table=vectors.clear(self.vectors))

    def check(self, folder: str, clean: bool = False) -> tuple[DataFrame, list[str]]:
        """Files of a folder that are empty or corrupt, (filepath, issue, size), and the paths of those that ``clean`` has deleted."""
        gone = markdown.delete_empty(self.spark, folder) if clean else []
        return markdown.checked(self.spark, folder).orderBy("filepath"), gone

    # Watching

    def apply_changes(self, upserts: DataFrame, deletes: DataFrame) -> dict:
        """Take in changed note files (id, path) and drop deleted notes (id), in one change; counts of both and the problems of files."""
        paths = [r["path"] for r in upserts.select("path").collect()]  # those of one batch of changes
        paths = [p for p in paths if (lambda fs, q: fs.exists(q))(*self._fs(p))]
        gone = deletes.select("id").distinct()
        notes, index, table, problems, n = self.notes, self.index, self.vectors, [], 0
        if not gone.isEmpty():
            notes, index, table = maintain.delete(notes, gone), bm25.remove(index, gone), vectors.remove(table, gone)
        if paths:
            parsed = saved(markdown.notes(markdown.files(self.spark, paths)))
            problems = [f"{r['filepath']}: {r['problem']}" for r in markdown.invalid(parsed).collect()]
            new = maintain.last_wins(markdown.valid(parsed), "id", "filepath")
            n = new.count()
            notes = maintain.with_backlinks(maintain.upsert(notes, new.select(NOTES.names)))
            index, table = bm25.upsert(index, self._texts(new)), vectors.upsert(table, self._encoded(new))
        removed = gone.count()
        if n or removed:
            self._commit(notes, index, table)
        return {"indexed": n, "deleted": removed, "errors": problems}

    def watch(self, events: str, checkpoint: str, callback: Callable[[str, str], None] | None = None, gap: str = indexer.DEBOUNCE, available_now: bool = False) -> tuple[StreamingQuery, indexer.IndexStats]:
        """Keep notes and indexes current from a folder of change events (``folder.FolderWatcher`` writes them). The callback gets a kind of event
        ("indexed", "deleted" or "error") and a message; the counters are those of this run. A batch that comes again gives the same notes."""
        stats = indexer.IndexStats()
        say = callback or (lambda kind, message: None)

        def apply(upserts: DataFrame, deletes: DataFrame, number: int) -> None:
            stats.pending_changes = upserts.count() + deletes.count()
            try:
                done = self.apply_changes(upserts, deletes)
            except Exception as e:
                stats.errors.append(f"batch {number}: {e}")
                say("error", stats.errors[-1])
                raise
            stats.pending_changes = 0
            stats.total_indexed += done["indexed"]
            stats.total_deleted += done["deleted"]
            stats.last_indexed = datetime.now()
            stats.errors += done["errors"]
            for kind, many in (("indexed", done["indexed"]), ("deleted", done["deleted"])):
                if many:
                    say(kind, f"{many} notes")
            for problem in done["errors"]:
                say("error", problem)

        return indexer.watch(indexer.events(self.spark, events), apply, checkpoint, gap, available_now), stats

    def import_json(self, path: str, note_type: str = "permanent") -> int:
        return self.add_many(tables.from_json(self.spark, path), note_type)

    def import_git_log(self, repo: str, limit: int = 50) -> int:
        name = repo.rstrip("/").rsplit("/", 1)[-1]
        return self.add_many(git_log.as_notes(git_log.read(self.spark, repo, limit), name))

    def import_markdown(self, folder: str) -> DataFrame:
        """Take the notes of a folder in, those of the same id in place of the old; (filepath, problem) of the files that are left out."""
        parsed = markdown.notes(markdown.files(self.spark, folder))
        new = maintain.last_wins(markdown.valid(parsed), "id", "filepath")
        self._change(maintain.upsert(self.notes, new), new)
        return markdown.invalid(parsed)

    def export_markdown(self, folder: str) -> int:
        return formats.export_markdown(self.notes, folder).count()

    # Questions

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = [(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(texts, self.encoder(texts), strict=True))]
        return self.spark.createDataFrame(rows, "query_id int, text string, vector array<float>")

    def search(self, texts: str | list[str], k: int = 5, mode: str = "hybrid", note_type: str | None = None, tags: list[str] | None = None) -> DataFrame:
        """Hits of one or many texts with title, type, tags and a preview."""
        asked = self._queries([texts] if isinstance(texts, str) else texts)
        hits = search.search(mode, self.index, self.vectors, asked, k, notes=self.notes, note_type=note_type, tags=tags)
        return search.hydrate(hits, self.notes).orderBy("query_id", "rank")

    def query(self, text: str, k: int = 5, depth: int = 2) -> DataFrame:
        """Hits with what is around them in the graph."""
        return graph.enrich(self.search(text, k), self.notes, self.edges(), depth).orderBy("rank")

    def edges(self) -> DataFrame:
        return links.edges(self.notes)

    def list(self, note_type: str | None = None, tags: list[str] | None = None, limit: int | None = 10) -> DataFrame:
        return maintain.listed(maintain.metadata(self.notes), note_type, tags, limit)

    def show(self, name: str) -> DataFrame:
        """The note of an id, a title, or a part of a title."""
        found = links.resolve(self.spark.createDataFrame([(name,)], "link string"), self.notes)
        return self.notes.join(F.broadcast(found.select(F.col("target").alias("id"))), "id", "left_semi")

    def refs(self, name: str | None = None, part: str | None = None) -> DataFrame:
        if name is not None:
            return links.refs_of(self.notes, self.show(name).select("id"))
        return links.refs(links.find(self.notes, part) if part is not None else self.notes)

    def daily(self, day: str) -> DataFrame:
        return maintain.daily(self.notes, day)

    def inbox(self, limit: int = 20) -> DataFrame:
        return maintain.inbox(self.notes, limit)

    def status(self) -> DataFrame:
        return maintain.status(self.notes)

    def graph_stats(self) -> DataFrame:
        return graph.stats(self.notes, self.edges())

    def hubs(self, top: int = 10) -> DataFrame:
        return graph.hubs(self.notes, self.edges(), top)

    def orphans(self) -> DataFrame:
        return graph.orphans(self.notes, self.edges()).select("id", "title")

    def broken_links(self) -> DataFrame:
        return links.broken(self.notes)

    def related(self, name: str, depth: int = 2) -> DataFrame:
        return graph.related(self.edges(), self.show(name).select("id"), depth)

    def draw(self, name: str, depth: int = 2) -> str:
        return graph.draw(self.notes, self.edges(), self.show(name).select("id"), depth)

    def suggest(self, text: str, k: int = 5, threshold: float = 0.6, exclude: list[str] | None = None) -> DataFrame:
        asked = self._queries([text])
        near = vectors.search(self.vectors, asked, 2 * k)
        out = self.spark.createDataFrame([(i,) for i in exclude or []], "id string")
        return suggest.suggest(asked.select("query_id", "text"), self.notes, near, k, threshold, out).orderBy("rank")

    def verify(self) -> DataFrame:
        """One row: files, indexed, missing, orphaned, healthy; both indexes must hold a note."""
        held = self.vectors.select("id").join(self.index.docs.select("id"), "id", "left_semi")
        return maintain.verify_counts(self.notes.select(F.col("id").alias("stem")), held)

    def index_status(self) -> DataFrame:
        return self.index.stats().crossJoin(self.vectors.agg(F.count(F.lit(1)).alias("vectors")))  # one row each
