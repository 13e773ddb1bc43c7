import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import bm25, search, suggest, vectors


def index(spark, texts):
    return bm25.build(spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(texts)], "id string, ord long, text string"))


def ask(spark, ix, text, k=5, **o):
    got = bm25.search(ix, spark.createDataFrame([(1, text)], "query_id int, text string"), k, **o).orderBy("rank").collect()
    return [(r["id"], round(r["score"], 6)) for r in got]


def test_scores(spark):
    ix = index(spark, [("note1", "Python Python Python programming"), ("note2", "Python programming guide"), ("note3", "Java programming")])
    assert ask(spark, ix, "Python") == [("note3", 0.0), ("note2", -0.089693), ("note1", -0.137989)]
    ix = index(spark, [("id1", "machine learning algorithm"), ("id2", "deep learning neural network"), ("id3", "natural language processing")])
    assert ask(spark, ix, "machine learning") == [("id1", 0.638903), ("id2", 0.091126), ("id3", 0.0)]
    assert ask(spark, index(spark, [("a", "alpha beta")]), "alpha") == [("a", -0.274653)]
    assert ask(spark, index(spark, [("a", "alpha beta")]), "gamma") == [("a", 0.0)]
    assert ask(spark, index(spark, [("a", "alpha beta")]), "gamma", match_only=True) == []


def test_maintenance(spark):
    ix = index(spark, [("a", "alpha beta"), ("b", "beta gamma"), ("c", "delta"), ("e", "")])
    assert ix.docs.count() == 3
    assert "b" not in [i for i, _ in ask(spark, bm25.remove(ix, spark.createDataFrame([("b",)], "id string")), "gamma")]
    new = spark.createDataFrame([("a", 0, "first"), ("a", 1, "omega"), ("z", 2, "alpha")], "id string, ord long, text string")
    up = bm25.upsert(ix, new)
    assert ask(spark, up, "omega", match_only=True)[0][0] == "a" and ask(spark, up, "first", match_only=True) == []
    assert [r["id"] for r in up.docs.orderBy("ord").collect()] == ["b", "c", "a", "z"]


def test_segments(spark, monkeypatch):
    texts = [(str(i), f"common w{i % 7} w{i % 7} x{i}") for i in range(40)]
    docs = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(texts)], "id string, ord long, text string").repartition(3)
    plans = []
    monkeypatch.setattr(bm25, "saved", lambda df, keep=bm25.saved: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    ix = bm25.build(docs.coalesce(3))
    assert "ENSURE_REQUIREMENTS" not in plans[0] and "rangepartitioning" not in plans[0]  # postings stay with the task that counted them
    want = {(i, n, *c) for n, (i, t) in enumerate(texts) for c in Counter(re.findall("[a-z][a-z0-9]*", t) + re.findall("[0-9]+", t)).items()}
    assert {(r["id"], r["ord"], r["term"], r["tf"]) for r in ix.postings.collect()} == want
    gone = spark.createDataFrame([("3",), ("3",), ("9",)], "id string")
    few = sorted(map(tuple, bm25.remove(ix, gone).postings.collect()))
    monkeypatch.setattr(bm25, "FEW_IDS", 0)
    assert sorted(map(tuple, bm25.remove(ix, gone).postings.collect())) == few and {r[0] for r in few} == {i for i, _ in texts} - {"3", "9"}


def test_rows_of_segments(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), i, f"common x{i} x{i}") for i in range(60)] + [("none", 60, None)], "id string, ord long, text string").coalesce(1)
    monkeypatch.setattr(bm25, "SEGMENT", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    kept = []
    monkeypatch.setattr(bm25, "saved", lambda df, keep=bm25.saved: kept.append(keep(df)) or kept[-1])
    ix = bm25.build(docs)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    common = kept[0].filter("term = 'common'")
    assert 1 < common.count() < 10 and common.agg(F.sum("n")).first()[0] == 60  # a row for each segment, not for each document
    assert ix.postings.count() == 60 * 3 and {(r["id"], r["dl"]) for r in ix.docs.collect()} == {(str(i), 5) for i in range(60)}
    for gone in (ix.postings.filter("ord < 20").select("id"), ix.docs.filter("ord = 3").select("id")):
        less, want = bm25.remove(ix, gone), bm25.build(docs.join(gone.distinct(), "id", "left_anti"))
        assert sorted(map(tuple, less.postings.collect())) == sorted(map(tuple, want.postings.collect()))
        idf = lambda i: {r["term"]: (r["df"], round(r["idf"], 9)) for r in i.terms.collect()}
        assert idf(less) == idf(want) and [round(x, 9) for x in less.corpus.first()] == [round(x, 9) for x in want.corpus.first()]


def test_batches_of_a_segment(spark, monkeypatch):
    low = pa.array([f"w{i % 7} x{i} common" if i % 5 else "" for i in range(50)])
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(50)]), pa.array(range(50)), low], names=["id", "ord", "low"])
    monkeypatch.setattr(bm25.spans, "CHUNK", 60)
    out = []
    for most in (7, 10**6):
        monkeypatch.setattr(bm25, "BATCH_OUT", most)
        parts = [bm25._counted(rows.slice(a, b - a), bm25.spans.digits(spark)) for a, b in bm25.spans.chunks(low)]
        assert len(parts) > 5
        batches = list(bm25._segment(parts))
        out.append([r for b in batches for r in b.to_pylist()])
        assert (len(batches) > 5) == (most == 7)
    assert out[0] == out[1] and [r["term"] for r in out[0]][1:] == sorted(r["term"] for r in out[0][1:]) and all(r["n"] == len(r["held"]) for r in out[0])


def test_a_posting_is_one_integer(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SEGMENT", 20)
    docs = spark.createDataFrame([(str(i), i, f"common x{i % 9}" + " again" * i) for i in range(40)] + [("none", 40, "")], "id string, ord long, text string").coalesce(2)
    ix = bm25.build(docs)
    assert dict(bm25.segments_of(docs).dtypes)["held"] == "array<bigint>" and ix.numbered.count() == ix.numbered.select("no").distinct().count() == 40
    want = sorted(map(tuple, ix.postings.collect()))
    monkeypatch.setattr(bm25, "BITS", 0)
    monkeypatch.setattr(bm25, "FEW_DOCS", 0)
    assert sorted(map(tuple, bm25.build(docs).postings.collect())) == want
    # The greatest numbers go and are not given again.
    less = bm25.remove(ix, docs.filter("ord > 30").select("id"))
    more = bm25.upsert(less, docs.filter("ord in (3, 30, 35)").withColumn("text", F.lit("new common")))
    fresh = bm25.build(more.docs.select("id", "ord").join(docs.select("id", "text"), "id").withColumn("text", F.expr("if(id in ('3', '30', '35'), 'new common', text)")))
    for name in ("postings", "docs"):
        assert sorted(map(tuple, getattr(more, name).collect())) == sorted(map(tuple, getattr(fresh, name).collect()))
    for text in ("common new", "x3 again", "x8"):
        assert ask(spark, more, text, 40) == ask(spark, fresh, text, 40)


def test_terms_are_counted_once_after_all_changes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(bm25, "saved", lambda df, keep=bm25.saved: made.append(df.columns) or keep(df))
    ix = index(spark, [(str(i), f"common x{i % 9} y{i}") for i in range(40)])
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    less = bm25.remove(bm25.remove(ix, gone("3", "4", "3")), gone("4", "5", "none"))
    more = bm25.upsert(less, spark.createDataFrame([("7", 0, "common again"), ("3", 1, "common back")], "id string, ord long, text string"))
    assert not [c for c in made if c in (["term", "df"], ["n", "avgdl", "avg_idf"])]
    own = ask(spark, more, "common back x7", 40)
    assert made.count(["term", "df"]) == made.count(["n", "avgdl", "avg_idf"]) == 1
    left = [(str(i), f"common x{i % 9} y{i}") for i in range(40) if i not in (3, 4, 5, 7)]
    fresh = index(spark, [*left, ("7", "common again"), ("3", "common back")])
    assert own == ask(spark, fresh, "common back x7", 40) and more.size == more.docs.count() == 38
    assert {tuple(r) for r in more.terms.select("term", "df").collect()} == {tuple(r) for r in fresh.terms.select("term", "df").collect()}


def test_equal_queries_are_searched_once(spark, monkeypatch):
    ix = index(spark, [(str(n), f"alpha w{n}") for n in range(9)])
    asked = spark.createDataFrame([(n, ("w3 alpha", "ALPHA w3!", "w5")[n % 3]) for n in range(30)] + [(77, "w3"), (77, "alpha")], "query_id int, text string")
    seen = []
    monkeypatch.setattr(bm25, "scores", lambda index, queries, f=bm25.scores: seen.append(queries.count()) or f(index, queries))
    got: dict = {}
    for r in bm25.search(ix, asked, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
    assert seen == [2] and len(got) == 31
    assert len({tuple(sorted(v)) for q, v in got.items() if q == 77 or q % 3 < 2}) == 1 and sorted(got[2])[0][1] == "5" and sorted(got[77])[0][1] == "3"


def test_empty_corpus(spark):
    ix = index(spark, [("a", "")])
    assert ask(spark, ix, "alpha") == []


def test_index_on_disk(spark, tmp_path):
    ix = index(spark, [("a", "alpha beta"), ("b", "beta gamma")])
    ix.write(str(tmp_path))
    again = bm25.Index.read(spark, str(tmp_path))
    assert ask(spark, again, "gamma") == ask(spark, ix, "gamma")
    assert again.stats().first()["documents"] == 2


def arms(spark, sem, key):
    s = "query_id int, id string, score double, rank int"
    return spark.createDataFrame([(1, i, v, n + 1) for n, (i, v) in enumerate(sem)], s), spark.createDataFrame([(1, i, v, n + 1) for n, (i, v) in enumerate(key)], s)


def test_fusion(spark):
    got = search.fuse(*arms(spark, [("n1", 0.9), ("n2", 0.8)], [("n2", 5.0), ("n3", 4.0)]), 5).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6), r["search_mode"]) for r in got] == [("n2", round(1 / 62 + 1 / 61, 6), "hybrid"), ("n1", round(1 / 61, 6), "hybrid"), ("n3", round(1 / 62, 6), "hybrid")]


def test_fallbacks(spark):
    assert [(r["id"], r["score"], r["search_mode"]) for r in search.fuse(*arms(spark, [], [("a", 2.0)]), 5).collect()] == [("a", 2.0, "keyword")]
    assert [(r["id"], r["score"], r["search_mode"]) for r in search.fuse(*arms(spark, [("a", 0.5)], []), 5).collect()] == [("a", 0.5, "semantic")]
    assert search.fuse(*arms(spark, [], []), 5).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x", ["t"]), ("b", [0.0, 2.0], "y", ["t", "u"]), ("c", [0.0, 0.0], "y", [])], "id string, embedding array<float>, type string, tags array<string>")
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, vector array<float>")
    got = vectors.search(v, q, 5).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("a", round(math.sqrt(0.5), 6)), ("b", round(math.sqrt(0.5), 6)), ("c", 0.0)]
    assert [r["id"] for r in vectors.search(v, q, 5, "y", ["u"]).collect()] == ["b"]
    with pytest.raises(Exception, match="vector of size"):
        vectors.require_dimension(v, 3).collect()
    up = vectors.upsert(v, v.filter("id = 'a'").withColumn("type", F.lit("z")))
    assert up.count() == 3 and up.filter("type = 'z'").count() == 1
    assert vectors.remove(v, v.filter("id = 'a'")).count() == 2


def test_vectors_by_matrices(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 6)), 1).tolist()
    v[50:90] = [v[50]] * 40  # copies, of which the smallest ids count
    v[7], v[8], v[9], v[10] = [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], None
    table = spark.createDataFrame([(f"{i:03}", x) for i, x in enumerate(v)], "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v[i]) for i in (0, 7, 8, 9, 10, 50, 51, 120)], "query_id int, vector array<double>")
    got = [tuple(r) for r in vectors.search(table, asked, 8).select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]
    pairs = table.withColumn("u", vectors.unit(F.col("embedding"))).crossJoin(asked.withColumn("a", vectors.unit(F.col("vector")))).withColumn("score", vectors.dot(F.col("u"), F.col("a")))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 8")
    assert got == [tuple(r) for r in want.select("query_id", "rank", "id", "score").orderBy("query_id", "rank").collect()]
    plan = vectors.search(table, asked.filter("query_id in (0, 50)"), 8)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("NestedLoopJoin") == 1  # only odd vectors are compared one by one


def test_units(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(200, 9)) * 10.0 ** rng.integers(-8, 8, size=(200, 1))).tolist() + [[0.0] * 9, [1e-200] * 9, [1e200] * 9]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v array<double>").select("id", vectors.unit(F.col("v")).alias("u"))
    assert [r["u"] for r in rows.orderBy("id").collect()] == vectors._units(np.array(v)).tolist()
    kept = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[1.0], [2.0]])], names=["id", "v"])
    assert [(i.to_pylist(), x.to_pylist()) for i, x in vectors._lots(iter([kept, kept.slice(0, 0), kept]))] == [([1, 2] * 2, [[1.0], [2.0]] * 2)]
    # The length of a vector is not looked for again in each of its dimensions.
    plan = rows.select("u")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt") == 1


def test_encoder(spark):
    from marginalia.session import ship

    ship(spark)
    df = spark.createDataFrame([("hello world",), ("hello world",), (None,)], "text string")
    a, b, c = [r["embedding"] for r in vectors.encode(df).collect()]
    assert a == b and len(a) == 384 and set(c) == {0.0}

    def fails(texts):
        raise RuntimeError

    assert set(vectors.encode(df, fails, dimension=3).first()["embedding"]) == {0.0}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "the graph Graph spark and the spark graph 学习 机器 机器")], "query_id int, text string")
    assert [(r["keyword"], r["count"]) for r in suggest.keywords(df).orderBy("rank").collect()] == [("graph", 3), ("spark", 2), ("机器", 2)]


def test_suggest(spark):
    notes = spark.createDataFrame([("1", "Graph theory", "spark graph", ["x"]), ("2", "Cooking", "soup", []), ("3", "Spark", "spark", [])], "id string, title string, content string, tags array<string>")
    texts = spark.createDataFrame([(1, "graph spark graph")], "query_id int, text string")
    near = spark.createDataFrame([(1, "2", 0.95, 1), (1, "1", 0.2, 2)], "query_id int, id string, score double, rank int")
    got = suggest.suggest(texts, notes, near).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["match_type"]) for r in got] == [("2", 0.95, "semantic"), ("1", 0.6, "keyword"), ("3", 0.45, "keyword")]
    out = spark.createDataFrame([("2",)], "id string")
    assert [r["id"] for r in suggest.suggest(texts, notes, near, 1, 0.6, out).collect()] == ["1"]


def test_suggestions_of_many_notes(spark, monkeypatch):
    rng = random.Random(4)
    some = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["机器学习", "学习"]
    notes = spark.createDataFrame([(str(i), " ".join(rng.choices(some, k=2)), " ".join(rng.choices(some, k=4)), []) for i in range(150)] + [("x", None, None, None)], "id string, title string, content string, tags array<string>")
    texts = spark.createDataFrame([(i, " ".join(rng.choices(some, k=i % 7))) for i in range(40)], "query_id int, text string")
    near = spark.createDataFrame([(i, str(j), 0.9 - j / 100, j + 1) for i in range(0, 40, 3) for j in range(7)], "query_id int, id string, score double, rank int")
    monkeypatch.setattr(suggest, "FIRST_NOTES", 30)
    text = {r["id"]: r["t"] for r in notes.select("id", suggest.match_text(F.col("title"), F.col("tags"), F.col("content")).alias("t")).collect()}
    words: dict = {}
    for r in suggest.keywords(texts).orderBy("query_id", "rank").collect():
        words.setdefault(r["query_id"], []).append(r["keyword"])
    for least in (0.6, 0.9):  # one keyword is enough; several are wanted
        got: dict = {}
        for r in suggest.suggest(texts, notes, near, 5, least).filter("match_type = 'keyword'").collect():
            got.setdefault(r["query_id"], {})[r["id"]] = (r["score"], r["matched_keywords"])
        for q, own in words.items():
            close = {str(j) for j in range(7) if q % 3 == 0 and 0.9 - j / 100 >= least}
            held = {i: [w for w in own if w in t] for i, t in text.items() if i not in close}
            raw = {i: 0.3 + 0.3 * len(m) / len(own) for i, m in held.items() if m and 0.3 + 0.3 * len(m) / len(own) >= least * 0.5}
            first = sorted(raw)[: 10 - len(close)]
            best = sorted(first, key=lambda i: (-round(raw[i], 3), i))[: max(0, 5 - len(close))]
            assert got.get(q, {}) == {i: (round(raw[i], 3), held[i]) for i in best}
