import json

from pyspark.sql import functions as F

from marginalia import admin
from marginalia.operators import maintain, metrics
from marginalia.sinks import formats
from marginalia.sources import git_log, markdown, tables
from marginalia.streaming import indexer


def note_file(i, **more):
    lines = "".join(f"{k}: {v}\n" for k, v in more.items())
    return f"---\nid: {i}\ntitle: T{i}\n{lines}---\n\n# T{i}\n\nBody {i}\n"


def test_markdown(spark, tmp_path):
    top = tmp_path / "notes" / "permanent"
    top.mkdir(parents=True)
    (top / "202604120150293323-good.md").write_text(note_file("202604120150293323", type="permanent", tags="[a, b]", links="null"), encoding="utf-8")
    (top / "bad.md").write_text("no front matter")
    (top / "type.md").write_text(note_file("1", type="other"))
    (top / "bytes.md").write_bytes(b"\xff\xfe---")
    (top / "mark.md").write_bytes("﻿".encode() + note_file("2", type="permanent").encode())
    (top / "empty.md").write_text("")
    (top / "ignored.txt").write_text("x")
    files = markdown.files(spark, str(tmp_path))
    good = markdown.valid(markdown.notes(files)).collect()
    assert [(r["id"], r["title"], r["content"], r["tags"], r["links"]) for r in good] == [("202604120150293323", "T202604120150293323", "Body 202604120150293323", ["a", "b"], [])]
    assert markdown.invalid(markdown.notes(files)).count() == 4
    assert markdown.valid(markdown.notes(files, with_body=False)).count() == 2
    issues = {r["filepath"].rsplit("/", 1)[1]: r["issue"] for r in markdown.checked(spark, str(tmp_path)).collect()}
    assert issues == {"empty.md": "empty", "bad.md": "corrupt", "type.md": "corrupt", "bytes.md": "corrupt", "mark.md": "corrupt"}
    assert len(markdown.delete_empty(spark, str(tmp_path))) == 1 and not (top / "empty.md").exists() and (top / "bad.md").exists()


def test_export_and_read(spark, tmp_path):
    rows = [("202604120150293323", "A title", "One\n\nTwo", "permanent", ["x"], ["1"], [], "src"), ("202604120150293324", "快速", "c", "fleeting", [], [], ["2"], None)]
    n = spark.createDataFrame(rows, "id string, title string, content string, type string, tags array<string>, links array<string>, backlinks array<string>, source string")
    n = n.withColumn("created", F.to_timestamp_ntz(F.lit("2026-04-28 10:00:00"))).withColumn("updated", F.col("created"))
    assert formats.export_markdown(n, f"file://{tmp_path}/kb").count() == 2
    assert sorted(p.name for p in (tmp_path / "kb").rglob("*.*")) == ["20260412-0150293324.md", "202604120150293323-a-title.md"]
    back = markdown.valid(markdown.notes(markdown.files(spark, str(tmp_path / "kb"))))
    cols = ["id", "title", "content", "type", "tags", "links", "backlinks", "source", "created"]
    assert {str(r) for r in back.select(cols).collect()} == {str(r) for r in n.select(cols).collect()}


def test_content_files():
    assert markdown.strip_front_matter("﻿---\nid: 1\n---\n\n# T\n\nbody\n") == "body"
    assert markdown.strip_front_matter("plain") == "plain"


def test_git_log(spark):
    raw = f"Hash: abcdef123\nSubject: s: one\nAuthor: me\nDate: 2026-01-01\n\nline 1\nline 2\n\nCo-authored-by: x\nline 3\n{git_log.DELIMITER}\nSubject: no hash\n{git_log.DELIMITER}\nHash: 77\nSubject: two\n"
    found = git_log.commits(spark.createDataFrame([(raw,), ("",)], "raw string"))
    assert [(r["hash"], r["subject"], r["body"]) for r in found.orderBy(F.desc("hash")).collect()] == [("abcdef123", "s: one", "line 1\nline 2\n\nCo-authored-by: x\nline 3"), ("77", "two", "")]
    note = git_log.as_notes(found, "demo").filter("title = 's: one'").first()
    assert note["content"] == "Commit: abcdef1\nAuthor: me\nDate: 2026-01-01\n\nline 1\nline 2\nline 3" and note["tags"] == ["source:demo", "source:git-log"]


def test_git_repository(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=me", "-c", "user.email=me@example.org", *a], check=True, capture_output=True)
    git("init")
    for i in range(3):
        git("commit", "--allow-empty", "-m", f"commit {i}\n\nbody {i}")
    got = git_log.read(spark, str(tmp_path), 2).collect()
    assert [(r["subject"], r["body"]) for r in got] == [("commit 2", "body 2"), ("commit 1", "body 1")]


def test_json_and_import(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "a", "content": "x", "tags": ["t"]}, {"content": "y"}]))
    n = maintain.import_notes(tables.from_json(spark, str(tmp_path / "a.json")), "2026-04-28 10:00:00")
    assert n.count() == 2 and n.select("id").distinct().count() == 2 and {r["title"] for r in n.collect()} == {"a", "Untitled"}
    assert all(r["id"].startswith("20260428100000") for r in n.collect())


def test_import_ids_differ(spark):
    rows = spark.range(25_000, numPartitions=3).select(F.col("id").cast("string").alias("title"), F.lit("x").alias("content"), F.array(F.lit("t")).alias("tags"))
    ids = {r["id"] for r in maintain.import_notes(rows, "2026-04-28 23:59:59").select("id").collect()}
    assert len(ids) == 25_000 and all(len(i) == 18 and i.isdigit() for i in ids)
    assert min(ids) == "202604282359590000" and max(ids) == "202604290000014999"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("1", "One", "b", ["x", "y"], "/a"), ("2", "Two, too", "a", [], None)], "id string, title string, type string, tags array<string>, filepath string").coalesce(1)
    assert json.loads(formats.render(df, "json"))[1]["title"] == "Two, too"
    assert formats.render(df, "csv", headers=["id", "title", "tags", "nope"]).splitlines()[1] == '1,One,"[""x"", ""y""]",'
    assert "title: One" in formats.render(df, "yaml") and formats.render(df, "paths") == "/a"
    assert formats.render(df, "tree") == "notes/\n  a/\n    Two, too (2)\n  b/\n    One (1)"
    assert formats.render(df, "table").splitlines()[0].startswith("id | title")
    assert formats.render(df.limit(0), "csv") == "" and formats.render(df.limit(0), "table") == "(No data)"
    formats.write_csv(df, str(tmp_path / "c"))
    formats.write_json(df, str(tmp_path / "j"))
    formats.write_paths(df, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 1 and spark.read.json(str(tmp_path / "j")).count() == 2


def test_verify(spark):
    files = spark.createDataFrame([("202604120150293323-slug",), ("20260412-0150293324",), ("readme",)], "stem string")
    same = spark.createDataFrame([("202604120150293323",), ("202604120150293324",)], "id string")
    assert maintain.verify_counts(files, same).first().asDict() == {"files": 2, "indexed": 2, "missing": 0, "orphaned": 0, "healthy": True}
    other = spark.createDataFrame([("202604120150293323",), ("5",)], "id string")
    assert {tuple(r) for r in maintain.verify(files, other).collect()} == {("202604120150293324", "missing"), ("5", "orphaned")}


def test_listing(spark):
    n = spark.createDataFrame([("3", "permanent", ["a"]), ("9", "permanent", ["a", "b"]), ("1", "fleeting", ["a"])], "id string, type string, tags array<string>")
    assert [r["id"] for r in maintain.listed(n).collect()] == ["1", "9", "3"]
    assert [r["id"] for r in maintain.listed(n, "permanent", ["a"], 1).collect()] == ["9"]
    assert [r["id"] for r in maintain.listed(n, limit=0).collect()] == ["1", "9", "3"]


def test_metrics(spark):
    df = spark.createDataFrame([("x", 0.5), ("x", 0.3), ("x", 0.7)], "op string, duration double")
    r = metrics.report(df).first()
    assert (r["count"], round(r["total"], 6), round(r["avg"], 6), r["min"], r["max"]) == (3, 1.5, 0.5, 0.3, 0.7)


def test_registry(spark):
    r = admin.Registry("/kb")
    r.create("a")
    r.create("b", make_default=True)
    for bad in (("a",), ("notes",), ("c", "/other"), ("d", "/kb/a"), ("e", "/kb/../x")):
        try:
            r.create(*bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    r.rename("b", "z")
    assert r.default == "z" and admin.Registry.from_json(r.to_json()) == r
    r.remove("z")
    assert r.default == "a" and r.table(spark).first()["is_current"]
    try:
        r.remove("a")
    except ValueError:
        return
    raise AssertionError


def test_templates(spark):
    from datetime import datetime

    t = admin.Templates()
    got = t.render("quick", {"title": "X", "content": "body"}, datetime(2026, 4, 28, 9, 5))
    assert got["title"] == "2026-04-28-X" and "2026-04-28 09:05" in got["content"] and got["tags"] == ["fleeting"]
    assert "None" not in t.render("literature", {"title": "X"})["content"]
    t.create("own", {"description": "", "note_type": "permanent", "title_format": "{{title}}", "content": "{{ content }}", "tags": []})
    assert [r["name"] for r in t.table(spark).collect()] == ["literature", "meeting", "own", "quick"]
    try:
        t.remove("quick")
    except ValueError:
        return
    raise AssertionError


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = "/kb/202604120150293323-x.md", "/kb/20260412-0150293324.md"
    rows = [(a, "10:00:00.0", "created"), (a, "10:00:00.5", "modified"), (a, "10:00:05.0", "deleted"), (b, "10:00:01.0", "created"), ("/kb/x.txt", "10:00:01.0", "created"), (b, "10:09:00.0", "modified")]
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"path": p, "ts": f"2026-04-28T{t}Z", "op": o}) + "\n" for p, t, o in rows))
    seen: list = []

    def apply(upserts, deletes, batch):
        seen.extend(("up", r["id"]) for r in upserts.collect())
        seen.extend(("gone", r["id"]) for r in deletes.collect())

    q = indexer.watch(indexer.events(spark, str(tmp_path / "in")), apply, str(tmp_path / "state"), available_now=True)
    q.awaitTermination(120)
    assert set(seen) == {("gone", "202604120150293323"), ("up", "202604120150293324")}
    table = spark.read.schema(indexer.EVENTS).json(str(tmp_path / "in"))
    assert indexer.settled(table).count() == 4


def test_batches(spark):
    from marginalia.operators import batch
    from marginalia.session import ship

    ship(spark)

    def half(row):
        if row["n"] % 2:
            raise ValueError("odd")
        return {"h": row["n"] // 2}

    done = batch.each(spark.createDataFrame([(i,) for i in range(5)], "n long"), half, "h long")
    assert sorted(r["h"] for r in batch.good(done).collect()) == [0, 1, 2]
    assert tuple(batch.counts(done).first()) == (5, 3, 2)
