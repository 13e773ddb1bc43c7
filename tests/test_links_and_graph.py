import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph, links, maintain

S = "id string, title string, content string, links array<string>, backlinks array<string>"


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(
        [("1", "Alpha", "see [[Beta]] and [[3]]", ["2", "9"], []), ("2", "Beta", "[[alph]] [[none such]] [[]]", [], ["1"]), ("3", "Gamma", "[[gamma]]", ["1"], []), ("4", "Alone", None, [], [])], S
    )


def test_resolution_and_edges(spark, notes):
    got = {(r["link"], r["target"], r["tier"]) for r in links.resolve(links.extract(notes), notes).collect()}
    assert got == {("Beta", "2", 2), ("3", "3", 1), ("alph", "1", 3), ("gamma", "3", 2)}
    assert {tuple(r) for r in links.edges(notes).collect()} == {("1", "2", "links"), ("1", "3", "wiki_link"), ("2", "1", "wiki_link"), ("3", "1", "links"), ("3", "3", "wiki_link")}


def test_resolution_by_characters(spark, notes, monkeypatch):
    few = {tuple(r) for r in links.resolve(links.extract(notes), notes).collect()}
    monkeypatch.setattr(links, "FEW_LINKS", 0)
    assert {tuple(r) for r in links.resolve(links.extract(notes), notes).collect()} == few


def test_links(spark, notes):
    assert {r["id"]: r["backlinks"] for r in links.backlinks(notes).collect()} == {"1": ["3"], "2": ["1"]}
    assert {r["id"]: r["missing"] for r in links.broken(notes).collect()} == {"1": ["9"]}
    assert [tuple(r) for r in links.refs_of(notes, notes.filter("id = '1'")).collect()] == [("1", "forward", 0, "2", "Beta")]
    new = notes.filter("id = '1'").withColumn("links", F.array(F.lit("2"), F.lit("3")))
    d = links.diff(notes, new).first()
    assert d["added"] == ["3"] and d["removed"] == ["9"]
    changed = maintain.edit(notes.withColumn("updated", F.localtimestamp()), new.select("id", "links"))
    assert {r["id"]: r["backlinks"] for r in changed.collect()}["3"] == ["1"]


def test_two_linked_notes(spark):
    e = spark.createDataFrame([("2", "1", "links")], "src string, dst string, type string")
    v = spark.createDataFrame([("1",), ("2",)], "id string")
    assert graph.stats(v, e).first().asDict() == {"nodes": 2, "edges": 1, "avg_degree": 1.0, "isolated": 0, "clusters": 1}
    assert graph.orphans(v, e).count() == 0
    assert [tuple(r) for r in graph.related(e, v.filter("id = '2'"), 1).collect()] == [("2", 1, "1")]
    assert graph.neighbors(e, v.filter("id = '1'"), "out").count() == 0 and graph.neighbors(e, v.filter("id = '1'"), "in").count() == 1


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string, type string")
    v = spark.createDataFrame([], "id string")
    assert graph.stats(v, e).first().asDict() == {"nodes": 0, "edges": 0, "avg_degree": 0.0, "isolated": 0, "clusters": 0}


def test_against_plain_python(spark):
    rng = random.Random(5)
    pairs = sorted({(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(45)})
    e = spark.createDataFrame([(a, b, "links") for a, b in pairs], "src string, dst string, type string")
    near, out = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
        out.setdefault(a, set()).add(b)

    def bfs(step, seed, depth):
        seen, front = {seed: 0}, {seed}
        for d in range(1, depth + 1):
            front = {y for x in front for y in step.get(x, ())} - set(seen)
            seen |= dict.fromkeys(front, d)
        return seen

    seeds = ["0", "7", "31"]
    got = {(r["seed"], r["id"]): r["depth"] for r in graph.related(e, spark.createDataFrame([(s,) for s in seeds], "id string"), 3).collect()}
    assert got == {(s, i): d for s in seeds for i, d in bfs(near, s, 3).items() if d}
    groups: dict = {}
    for r in graph.clusters(e).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    want = {frozenset(bfs(near, i, 99)) for i in near}
    assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1} and all(min(g) == c for c, g in groups.items())
    asked = [(s, str(t)) for s in seeds for t in range(40)]
    paths = {(r["src"], r["dst"]): r for r in graph.shortest_path(e, spark.createDataFrame(asked, "src string, dst string"), 3).collect()}
    for s in seeds:
        reach = bfs(out, s, 3)
        for t in map(str, range(40)):
            assert (paths[s, t]["length"] if (s, t) in paths else None) == reach.get(t)
            if (s, t) in paths:
                p = paths[s, t]["path"]
                assert p[0] == s and p[-1] == t and all(b in out[a] for a, b in zip(p, p[1:], strict=False))


def test_paths_of_all_with_all(spark, monkeypatch):
    rng = random.Random(8)
    e = spark.createDataFrame(sorted({(f"{rng.randrange(60):02}", f"{rng.randrange(60):02}", "links") for _ in range(110)}), "src string, dst string, type string")
    ids = spark.createDataFrame([(f"{i:02}",) for i in range(60)], "id string")
    pairs = ids.select(F.col("id").alias("src")).crossJoin(ids.select(F.col("id").alias("dst")))
    want = {(r["src"], r["dst"]): (r["path"], r["length"]) for r in graph.shortest_path(e, pairs, 3).collect()}
    rows = []
    monkeypatch.setattr(graph, "saved", lambda df, keep=graph.saved: rows.append((out := keep(df)).count()) or out)
    got = {(r["src"], r["dst"]): (r["path"], r["length"]) for r in graph.shortest_paths(e, ids, ids, 3).collect()}
    assert got == want and max(rows) < 60 * 60 / 2  # what is written follows the walks, not sources times targets
    rows.clear()
    one = spark.createDataFrame([("00", f"{i:02}") for i in range(60)], "src string, dst string")
    assert {(r["src"], r["dst"]): (r["path"], r["length"]) for r in graph.shortest_path(e, one, 3).collect()} == {k: v for k, v in want.items() if k[0] == "00"}


def test_long_chain(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}", "links") for i in range(200)], "src string, dst string, type string")
    assert [tuple(r) for r in graph.cluster_sizes(e).collect()] == [("000", 201)]


def test_drawing(spark, notes):
    text = graph.draw(notes, links.edges(notes), notes.filter("id = '1'"))
    assert text.splitlines()[0].startswith("Alpha (1)") and "Beta (2)" in text


def test_enrich_resolves_edges_once(spark, notes):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = links.edges(notes)
    rows = e.collect()
    counted = spark.createDataFrame(rows, e.schema).mapInArrow(count, e.schema)
    hits = spark.createDataFrame([(1, "1", 1), (1, "3", 2), (2, "4", 1)], "query_id int, id string, rank int")
    got = {r["id"]: (r["neighbors"], r["related"] and [(x["depth"], x["other"]) for x in r["related"]]) for r in graph.enrich(hits, notes, counted).collect()}
    assert got == {"1": (2, [(1, "2"), (1, "3")]), "3": (2, [(1, "1"), (2, "2")]), "4": (0, None)}
    assert seen.value == 2 * len(rows)  # once for each end
