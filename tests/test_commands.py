import json
import os
import time
from datetime import datetime, timedelta

import pytest
import yaml

from marginalia import cli
from marginalia.knowledge_base import KnowledgeBase
from marginalia.operators import metrics
from marginalia.settings import Home, Settings, TemplateFolder
from marginalia.streaming import folder


@pytest.fixture
def run(spark, tmp_path, capsys):
    def call(*arguments, ok=True, kind="json"):
        code = cli.main(["--home", str(tmp_path / "home"), "--format", kind, *arguments], spark)
        out, err = capsys.readouterr()
        assert (code == 0) == ok, err
        return (json.loads(out) if kind == "json" and out.lstrip()[:1] in "[{" else out) if ok else err

    return call


def test_commands_of_notes(run, tmp_path):
    assert run("init", "work", "--desc", "d")["name"] == "work"
    one = run("add", "Spark plans queries", "--title", "Spark", "--type", "permanent", "--tag", "engine")["id"]
    (tmp_path / "body.md").write_text("---\nx: 1\n---\n\n# Head\nGraphs of notes, see [[Spark]] and [[nothing]]")
    two = run("add", "--title", "Graphs", "--content-file", str(tmp_path / "body.md"))
    assert two["unresolved"] == ["nothing"]
    assert {r["id"] for r in run("list")} == {one, two["id"]} and run("list", "--tag", "engine")[0]["id"] == one
    assert run("search", "queries", "--mode", "keyword", "--top", "1")[0]["id"] == one
    assert run("search", "graphs notes")[0]["id"] == two["id"] and run("query", "graphs notes", "--depth", "1")[0]["neighbors"] == 1
    assert run("show", "Graphs")[0]["links"] == [one] and run("refs", "--note", "Spark")[0]["other"] == two["id"]
    assert run("refs", "--search", "spa")[0]["incoming"] == 1
    assert run("graph")[0]["edges"] == 1 and "Graphs" in run("graph", "--note", "Spark", kind="table") and run("graph", "--orphans") == []
    assert run("inbox")[0]["id"] == two["id"] and len(run("daily")) == 2 and run("suggest-links", "spark queries plans")
    assert run("edit", "Graphs", "--title", "Trees", "--tag", "t")["changed"] == ["tags", "title"] and run("show", "Trees")[0]["tags"] == ["t"]
    assert run("index", "verify")[0]["healthy"] is True and run("index", "status")[0]["vectors"] == 2
    assert run("index", "clear")[0]["documents"] == 0 and run("index", "verify")[0]["missing"] == 2
    assert run("index", "rebuild")[0]["documents"] == 2 and run("index", "rebuild-bm25") and run("index", "bm25-status")[0]["documents"] == 2
    (tmp_path / "in.json").write_text(json.dumps([{"title": "t", "content": "bulk words", "tags": ["x"]}, {"title": None, "content": None}]))
    got = run("bulk-import", str(tmp_path / "in.json"))
    assert (got["total"], got["imported"], got["failed"]) == (2, 1, 1)
    assert {r["type"]: r["notes"] for r in run("status")}[None] == 3
    assert run("export-notes", str(tmp_path / "out"))["exported"] == 3
    (tmp_path / "out" / "empty.md").write_text("")
    assert [r["issue"] for r in run("check", str(tmp_path / "out"))] == ["empty"] and run("check", str(tmp_path / "out"), "--clean") == []
    assert run("--kb", "work", "delete", "Trees")["deleted"] == [two["id"]]
    for kind in cli.KINDS:
        assert run("list", kind=kind) is not None
    assert "no note" in run("show", "absent", ok=False) and run("perf", "report")[0]["count"] >= 1
    assert "No data" in run("perf", "clear-cache", kind="table")


def test_commands_of_bases(run, tmp_path, monkeypatch):
    run("kb", "create", "zeta", "--desc", "first")
    run("kb", "create", "alpha")
    run("kb", "create", "beta")
    home = Home(str(tmp_path / "home"))
    assert home.registry.default == "zeta" and [r["name"] for r in run("kb", "list")] == ["alpha", "beta", "zeta"]
    run("--kb", "alpha", "add", "only here")
    assert run("kb", "info", "alpha")["notes"] == {"fleeting": 1, "total": 1}
    monkeypatch.setenv("MARGINALIA_KB", "alpha")
    assert run("kb", "current")["name"] == "alpha" and len(run("list")) == 1 and run("--kb", "zeta", "list") == []
    monkeypatch.delenv("MARGINALIA_KB")
    assert run("kb", "use", "beta")["name"] == "beta" and run("kb", "rename", "beta", "gamma")["name"] == "gamma"
    gone = run("kb", "remove", "gamma", "--data")
    assert os.path.isdir(gone["path"])  # the data of the default base stay
    assert Home(str(tmp_path / "home")).registry.default == "zeta"  # the first of those that are left
    gone = run("kb", "delete", "alpha", "--data")
    assert not os.path.exists(gone["path"])
    assert "last" in run("kb", "remove", "zeta", ok=False) and "outside" in run("kb", "create", "x", "--path", "/elsewhere", ok=False)
    assert "no knowledge base" in run("--kb", "absent", "list", ok=False)
    assert run("config", "set", "batch_size", "64")["batch_size"] == 64 and run("config", "show")["batch_size"] == 64
    assert "batch_size" in run("config", "set", "batch_size", "x", ok=False) and "one of" in run("config", "set", "other", "1", ok=False)
    assert yaml.safe_load((tmp_path / "home" / "zeta" / "config.yaml").read_text())["batch_size"] == 64


def test_commands_of_templates(run, tmp_path):
    assert [t["name"] for t in run("template", "list")] == ["literature", "meeting", "quick"]
    assert run("template", "show", "quick")["is_builtin"] is True
    run("template", "create", "mine", "--title-format", "T {{title}}", "--content", "C {{content}}", "--type", "permanent", "--tag", "a")
    assert "exists" in run("template", "create", "mine", ok=False)
    assert run("template", "edit", "mine", "--content", "D {{content}}")["content"] == "D {{content}}"
    note = run("add", "text", "--title", "x", "--template", "mine", "--tag", "b")["id"]
    (row,) = run("show", note)
    assert (row["title"], row["content"], row["type"], row["tags"]) == ("T x", "D text", "permanent", ["b", "a"])
    (tmp_path / "home" / "templates" / "bad.yaml").write_text("- not\n- a template")
    assert "mine" in TemplateFolder(tmp_path / "home" / "templates").all
    run("template", "remove", "mine")
    assert "no template" in run("template", "show", "mine", ok=False) and "built in" in run("template", "remove", "quick", ok=False)


def test_settings_file(tmp_path):
    path = tmp_path / "config.yaml"
    assert Settings.load(path) == Settings()
    path.write_text("device: cpu\nunknown: 1\n")
    assert Settings.load(path) == Settings(device="cpu")


def test_recorder(spark):
    r = metrics.Recorder()
    for d in (0.5, 0.3, 0.7):
        r.record("op", d)
    with pytest.raises(ZeroDivisionError), r.timed("fails"):
        1 / 0
    got = {x["op"]: x for x in metrics.report(r.table(spark)).collect()}
    assert got["op"]["count"] == 3 and abs(got["op"]["total"] - 1.5) < 1e-9 and got["op"]["min"] == 0.3 and got["fails"]["count"] == 1
    r.clear()
    assert r.table(spark).count() == 0


def write(path, note, title, body):
    path.write_text(f"---\nid: '{note}'\ntitle: {title}\ntype: permanent\ntags: []\nlinks: []\nbacklinks: []\n---\n\n{body}\n")


def test_watched_folder(spark, tmp_path):
    files = tmp_path / "notes"
    files.mkdir()
    one, two = files / "202604281000000001-a.md", files / "202604281000000002-b.md"
    write(one, "202604281000000001", "A", "alpha words")
    write(two, "202604281000000002", "B", "beta words")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    watcher = folder.FolderWatcher(spark, f"file://{files}", f"file://{tmp_path}/events", f"file://{tmp_path}/state")
    said = []

    def later(seconds):  # an event of another time lets the watermark pass the runs before it
        (tmp_path / "events" / f"later{seconds}.json").write_text(json.dumps({"path": "x.md", "ts": (datetime.now() + timedelta(seconds=seconds)).isoformat(), "op": "modified"}))

    def settle():
        query, stats = kb.watch(f"file://{tmp_path}/events", f"file://{tmp_path}/checkpoint", lambda *x: said.append(x), available_now=True)
        assert query.awaitTermination(120)
        return stats

    assert watcher.poll() == 2 and watcher.poll() == 0
    later(3600)
    stats = settle()
    assert stats.total_indexed == 2 and not stats.errors and stats.last_indexed and {r["id"] for r in kb.notes.collect()} == {"202604281000000001", "202604281000000002"}
    assert kb.search("alpha", mode="keyword").first()["id"] == "202604281000000001" and kb.verify().first()["healthy"]
    write(one, "202604281000000001", "A", "omega words of another length")
    os.utime(one, (time.time() + 7200, time.time() + 7200))
    bad = files / "202604281000000003-c.md"
    bad.write_text("no front matter")
    os.utime(bad, (time.time() + 7200, time.time() + 7200))
    assert watcher.poll() == 2
    later(14400)
    stats = settle()
    assert stats.total_indexed == 1 and len(stats.errors) == 1 and kb.index.postings.filter("term = 'omega'").first()["id"] == "202604281000000001"
    done = kb.apply_changes(spark.createDataFrame([], "id string, path string"), spark.createDataFrame([("202604281000000002",)], "id string"))
    assert done == {"indexed": 0, "deleted": 1, "errors": []} and kb.notes.count() == 1 and kb.index.docs.count() == kb.vectors.count() == 1
    assert {k for k, _ in said} == {"indexed", "error"}


def test_changes_between_listings(spark):
    at = datetime(2026, 1, 1)
    old = spark.createDataFrame([("a.md", at, 1), ("b.md", at, 1), ("c.md", at, 1)], folder.LISTING)
    new = spark.createDataFrame([("a.md", at, 1), ("b.md", at, 2), ("d.md", at, 1)], folder.LISTING)
    assert {(r["path"], r["op"]) for r in folder.changes(old, new).collect()} == {("b.md", "modified"), ("c.md", "deleted"), ("d.md", "created")}
    assert folder.changes(new, new).count() == 0
