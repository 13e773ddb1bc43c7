"""The commands of a knowledge base, as ``python -m marginalia``. Each prints what a method of ``KnowledgeBase`` gives."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from marginalia import admin
from marginalia.operators import metrics
from marginalia.schema import NOTE_TYPES
from marginalia.settings import Home, Settings
from marginalia.sinks import formats
from marginalia.sources import markdown

KINDS = ("json", "table", "csv", "yaml", "paths", "tree")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marginalia", description=__doc__)
    top.add_argument("--home", help="folder of the installation")
    top.add_argument("--kb", help="knowledge base")
    top.add_argument("--format", choices=KINDS, default="table")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, /, **arguments: dict) -> argparse.ArgumentParser:
        own = sub.add_parser(name)
        for key, options in arguments.items():
            options = dict(options)
            flag = options.pop("flag", False)
            own.add_argument(f"--{key.replace('_', '-')}" if flag else key, **options)
        return own

    opt = lambda **o: {"flag": True, **o}
    yes = opt(action="store_true")
    tags = opt(action="append", default=[])
    kind = opt(choices=NOTE_TYPES)
    whole = lambda n: opt(type=int, default=n)
    command("init", name={"nargs": "?", "default": "default"}, path=opt(), desc=opt(), default=yes)
    command("add", content={"nargs": "?"}, title=opt(), type=kind, tag=tags, source=opt(), template=opt(), content_file=opt())
    command("search", text={}, top=whole(5), type=kind, tag=tags, mode=opt(choices=("hybrid", "semantic", "keyword"), default="hybrid"))
    command("query", text={}, top=whole(5), depth=whole(2))
    command("list", type=kind, tag=tags, limit=whole(10))
    command("show", note={})
    command("refs", note=opt(), search=opt())
    command("edit", note={}, title=opt(), content=opt(), content_file=opt(), tag=opt(action="append"), type=kind, source=opt())
    command("delete", notes={"nargs": "+"})
    command("graph", note=opt(), depth=whole(2), stats=yes, orphans=yes)
    command("daily", date=opt(default=None))
    command("inbox", limit=whole(20))
    command("suggest-links", content={}, top=whole(5), threshold=opt(type=float, default=0.6))
    command("index", action={"choices": ("status", "rebuild", "verify", "rebuild-bm25", "bm25-status", "clear")})
    command("bulk-import", file={}, type=opt(choices=NOTE_TYPES, default="permanent"))
    command("ingest-log", repo={}, limit=whole(50))
    command("import-notes", folder={})
    command("export-notes", folder={})
    command("check", folder={}, clean=yes)
    command("status")
    command("config", action={"choices": ("set", "show")}, key={"nargs": "?"}, value={"nargs": "?"})
    command("kb", action={"choices": ("list", "create", "switch", "use", "remove", "delete", "info", "current", "rename")}, name={"nargs": "?"}, new_name={"nargs": "?"}, path=opt(), desc=opt(), default=yes, data=yes)
    command("template", action={"choices": ("list", "show", "create", "edit", "remove")}, name={"nargs": "?"}, desc=opt(), type=kind, title_format=opt(), content=opt(), content_file=opt(), tag=opt(action="append"), force=yes)
    command("perf", action={"choices": ("report", "clear-cache")})
    return top


def text_of(a: argparse.Namespace) -> str | None:
    """The text of an argument, of a file or, for "-", of the standard input."""
    if a.content_file is None:
        return a.content
    raw = sys.stdin.read() if a.content_file == "-" else Path(a.content_file).read_text(encoding="utf-8")
    return markdown.strip_front_matter(raw)


def uri(path: str) -> str:
    return path if "://" in path else f"file://{Path(path).expanduser().absolute()}"


class Commands:
    """One method for each command; it gives a table, a text, or an object to show as JSON."""

    def __init__(self, spark, home: Home, a: argparse.Namespace):
        self.spark, self.home, self.a = spark, home, a

    def run(self) -> str:
        got = getattr(self, self.a.command.replace("-", "_"))()
        if hasattr(got, "columns"):
            return formats.render(got, self.a.format)
        return got if isinstance(got, str) else json.dumps(got, ensure_ascii=False, default=str, indent=2)

    @property
    def base(self):
        from marginalia.knowledge_base import KnowledgeBase

        own = self.home.base(self.a.kb)
        return KnowledgeBase(self.spark, f"{uri(own['path'])}/data", dimension=self.home.settings(own).embedding_dimension)

    def init(self):
        return self.home.create(self.a.name, self.a.path, self.a.desc, self.a.default)

    def add(self):
        a, content = self.a, text_of(self.a)
        if not content and not a.template:
            raise ValueError("no content")
        note, missing = self.base.add(content or "", a.title, a.type or "fleeting", a.tag, a.source, a.template, self.home.templates)
        return {"id": note, "unresolved": missing}

    def search(self):
        a = self.a
        hits = self.base.search(a.text, a.top, a.mode, a.type, a.tag)
        return hits if a.format != "paths" else hits.join(self.base.notes.select("id", "filepath"), "id")

    def query(self):
        return self.base.query(self.a.text, self.a.top, self.a.depth)

    def list(self):
        return self.base.list(self.a.type, self.a.tag, self.a.limit)

    def show(self):
        found = self.base.show(self.a.note)
        if found.isEmpty():
            raise KeyError(f"no note {self.a.note}")
        return found

    def refs(self):
        return self.base.refs(self.a.note, self.a.search)

    def _id(self, name: str) -> str:
        if (row := self.base.show(name).select("id").first()) is None:
            raise KeyError(f"no note {name}")
        return row["id"]

    def edit(self):
        a = self.a
        given = {"title": a.title, "content": text_of(a), "tags": a.tag, "type": a.type, "source": a.source}
        note = self._id(a.note)
        self.base.edit(note, **{k: v for k, v in given.items() if v is not None})
        return {"id": note, "changed": sorted(k for k, v in given.items() if v is not None)}

    def delete(self):
        ids = [self._id(n) for n in self.a.notes]
        self.base.delete(ids)
        return {"deleted": ids}

    def graph(self):
        a, base = self.a, self.base
        return base.orphans() if a.orphans else base.draw(a.note, a.depth) if a.note and not a.stats else base.graph_stats()

    def daily(self):
        return self.base.daily(self.a.date or date.today().isoformat())

    def inbox(self):
        return self.base.inbox(self.a.limit)

    def suggest_links(self):
        return self.base.suggest(self.a.content, self.a.top, self.a.threshold)

    def index(self):
        base, action = self.base, self.a.action
        if action == "verify":
            return base.verify()
        if change := {"rebuild": base.reindex, "rebuild-bm25": base.reindex_keywords, "clear": base.clear_indexes}.get(action):
            change()
        return base.index.stats() if action == "bm25-status" else base.index_status()

    def bulk_import(self):
        base = self.base
        base.import_json(uri(self.a.file), self.a.type)
        return base.last_import

    def ingest_log(self):
        base = self.base
        base.import_git_log(self.a.repo, self.a.limit)
        return base.last_import

    def import_notes(self):
        return self.base.import_markdown(uri(self.a.folder))

    def export_notes(self):
        return {"exported": self.base.export_markdown(uri(self.a.folder))}

    def check(self):
        issues, gone = self.base.check(uri(self.a.folder), self.a.clean)
        if gone:
            print("\n".join(f"deleted {p}" for p in gone), file=sys.stderr)
        return issues

    def status(self):
        return self.base.status()

    def config(self):
        a, own = self.a, self.home.base(self.a.kb)
        settings = self.home.settings(own)
        if a.action == "set":
            settings.set(a.key, a.value or "")
            settings.save(self.home.settings_file(own))
        return {f: getattr(settings, f) for f in Settings.__dataclass_fields__}

    def kb(self):
        a, home = self.a, self.home
        if a.action == "create":
            return home.create(a.name, a.path, a.desc, a.default)
        if a.action in ("remove", "delete"):
            return home.remove(a.name, a.data)
        if a.action == "rename":
            home.registry.rename(a.name, a.new_name)
            home.save()
            return home.registry.bases[a.new_name]
        if a.action in ("switch", "use"):
            home.registry.use(a.name)
            home.save()
            return home.base(a.name)
        current = home.base(a.name or a.kb)
        if a.action == "list":
            return home.registry.table(self.spark).orderBy("name")
        if a.action == "info":
            a.kb = current["name"]
            return current | {"notes": {r["type"] or "total": r["notes"] for r in self.base.status().collect()}}
        return current

    def template(self):
        a, own = self.a, self.home.templates
        if a.action == "list":
            return own.table(self.spark).select("name", "description", "note_type", "is_builtin")
        if a.action == "remove":
            own.remove(a.name)
            return {"removed": a.name}
        given = {"description": a.desc, "note_type": a.type, "title_format": a.title_format, "content": text_of(a), "tags": a.tag}
        given = {k: v for k, v in given.items() if v is not None}
        if a.action == "create":
            own.create(a.name, {"description": "", "note_type": "fleeting", "title_format": "{{title}}", "content": "{{content}}", "tags": []} | given, a.force)
        elif a.action == "edit":
            own.create(a.name, own.all[a.name] | given, True)
        if a.name not in own.all:
            raise KeyError(f"no template {a.name}")
        return {"name": a.name} | own.all[a.name] | {"is_builtin": own.all[a.name] is admin.BUILTIN.get(a.name)}

    def perf(self):
        if self.a.action == "clear-cache":
            self.home.perf.unlink(missing_ok=True)
        if not self.home.perf.exists():
            return "(No data)"
        return metrics.report(self.spark.read.schema(metrics.SCHEMA).json(uri(str(self.home.perf))))


def main(arguments: list[str] | None = None, spark=None) -> int:
    """Run one command: 0 if it is done, 1 with a message if it can't be."""
    a = parser().parse_args(arguments)
    if spark is None:
        from marginalia.session import session

        spark = session("marginalia", **{"spark_ui_enabled": "false"})
        spark.sparkContext.setLogLevel("ERROR")
    home, recorder = Home(a.home), metrics.Recorder()
    try:
        with recorder.timed(a.command):
            print(Commands(spark, home, a).run())
        return 0
    except (KeyError, ValueError, OSError) as e:
        print(f"marginalia: {e.args[0] if isinstance(e, KeyError) and e.args else e}", file=sys.stderr)
        return 1
    finally:
        if a.command != "perf":
            home.recorded(recorder)
