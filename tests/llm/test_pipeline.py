import pytest

import corpus_pipeline
from marginalia.llm import quality
from marginalia.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    last = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, last, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / str(i)))
        new = spark.read.parquet(str(tmp_path / str(i)))
        assert 0 < new.count() <= last.count() and new.join(last, "doc_id", "left_anti").count() == 0
        last = new
    pieces = corpus_pipeline.STAGES[-1][1](spark, last, small)
    assert pieces.select("doc_id").distinct().count() == last.count()
    assert pieces.agg({"length": "sum"}).first()[0] == pieces.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]
    assert corpus_pipeline.run(spark, small).count() == pieces.count()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None), (None, "a b"), (2, "")]])
def test_empty_and_null_documents(spark, small, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score string"
    spark.createDataFrame([(i, t, None, None, None, "clash") for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) <= len(rows) and {r["doc_id"] for r in got} <= {i for i, _ in rows} and all(r["length"] == r["doc_tokens"] - r["start"] for r in got)
    last = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = stage(spark, last, str(tmp_path))
        assert last.columns == ["doc_id", "text", "lang", "source", "n_chars", "_score"]
        assert last.count() <= len(rows)


def test_clean_documents_stay(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.stage(spark, docs, small)
    good = docs.join(labels.filter("quality = 1"), "doc_id")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_exact_dedup_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    name = "op5_patricia_dedup"
    got = QUERIES[name](spark, small)
    want = con.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
