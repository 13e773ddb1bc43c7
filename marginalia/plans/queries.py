"""The catalogue: one query per operator over the sample tables, and DuckDB SQL with the same results.

Notes, links and texts are derived from the tables by the same arithmetic on both sides. Doubles are rounded to six places, lists are joined into
text, and every order has a unique last key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import admin
from marginalia.functions import text as T
from marginalia.operators import bm25, graph, links, maintain, metrics, search, suggest, vectors
from marginalia.scratch import saved
from marginalia.sinks import formats
from marginalia.sources import git_log
from marginalia.sources.tables import sample_notes, sample_vectors, turn_edges
from marginalia.streaming import indexer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 10
#: Texts that searches by keyword ask for, in turn; the last has no token of the corpus.
SEARCHES = ("The thon and reatin of the anen", "und der die keit ung", "zzzqqq")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _d(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _joined(c: str, by: str = ","):
    return F.array_join(c, by).alias(c)


# SQL that several queries begin with.

NOTES = """
notes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, 'Doc ' || doc_id AS title,
    text || chr(10) || 'See [[Doc ' || ((doc_id * 3 + 1) % (SELECT count(*) + count(*) // 2 FROM documents)) || ']], [[' || ((doc_id * 11 + 7) % (SELECT count(*) + count(*) // 2 FROM documents)) || ']] and [[ doc ' || ((doc_id * 13 + 5) % (SELECT count(*) + count(*) // 2 FROM documents)) || ' ]].' AS content,
    CASE doc_id % 3 WHEN 0 THEN 'fleeting' WHEN 1 THEN 'literature' ELSE 'permanent' END AS type,
    lang, source, CAST((doc_id * 7 + 3) % (SELECT count(*) + count(*) // 2 FROM documents) AS VARCHAR) AS link1, CAST((doc_id * 5 + 1) % (SELECT count(*) + count(*) // 2 FROM documents) AS VARCHAR) AS link2
  FROM documents)"""

_TOKENS = r"list_concat(list_concat(regexp_extract_all(lower({0}), '[一-鿿]'), regexp_extract_all(lower({0}), '[a-z][a-z0-9_]{{0,20}}')), regexp_extract_all(lower({0}), '\d+'))"

BM25 = (
    NOTES
    + f""",
searches AS (SELECT CAST(vec_id AS INTEGER) AS query_id, CASE vec_id // 50 % 3 WHEN 0 THEN '{SEARCHES[0]}' WHEN 1 THEN '{SEARCHES[1]}' ELSE '{SEARCHES[2]}' END AS q FROM embeddings WHERE vec_id % 50 = 0),
cut AS (SELECT id, ord, {_TOKENS.format("(title || ' ' || content)")} AS tokens FROM notes),
docs AS (SELECT id, ord, len(tokens) AS dl FROM cut WHERE len(tokens) > 0),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM cut) GROUP BY id, term),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM corpus) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
wanted AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format("q")}) AS term FROM searches) GROUP BY query_id, term),
hits AS (
  SELECT query_id, p.id, d.ord, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM corpus))))) AS score
  FROM wanted JOIN terms USING (term) JOIN postings p USING (term) JOIN docs d ON d.id = p.id GROUP BY query_id, p.id, d.ord),
filled AS (
  SELECT s.query_id, d.id, d.ord, coalesce(h.score, 0) AS score FROM searches s CROSS JOIN docs d LEFT JOIN hits h ON h.query_id = s.query_id AND h.id = d.id)"""
)


def ranked(source: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM {source}) WHERE rank <= {k} AND score > -10)"


COSINE = """
vecs AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
wantedv AS (SELECT CAST(id AS INTEGER) AS query_id, e AS q FROM vecs WHERE CAST(id AS BIGINT) % 50 = 0),
near AS (SELECT query_id, id, label, list_cosine_similarity(e, q) AS score FROM vecs, wantedv)"""


def near_ranked(k: int, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near WHERE {where}) WHERE rank <= {k})"


def searches(spark: SparkSession, d: str) -> DataFrame:
    """A query for every vector whose number is divisible by 50, with its text and its vector."""
    v = sample_vectors(spark, d).filter("ord % 50 = 0")
    text = F.element_at(F.array(*map(F.lit, SEARCHES)), (F.floor(F.col("ord") / 50) % 3 + 1).cast("int"))
    return v.select(F.col("ord").cast("int").alias("query_id"), text.alias("text"), F.col("embedding").alias("vector"))


def seeds_of(notes: DataFrame) -> DataFrame:
    """The notes that graph queries start from."""
    return notes.filter("ord % 50 = 0").select("id")


def index_of(spark: SparkSession, d: str) -> bm25.Index:
    n = sample_notes(spark, d)
    return bm25.build(n.select("id", "ord", T.bm25_text(F.col("title"), F.col("content")).alias("text")))


def hits_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("query_id").cast("int").alias("query_id"), "id", _d("score"), F.col("rank").cast("long").alias("rank"), *more)


# Text


@query("tokenize_counts", f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(
    "text_projections",
    f"""WITH {NOTES}
SELECT id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS summary,
  CASE WHEN length(content) > 50 THEN left(content, 50) || '...' ELSE content END AS default_title,
  CASE WHEN content <> '' THEN left(content, 150) || '...' ELSE '' END AS suggestion,
  regexp_replace(left(replace(lower(title), ' ', '-'), 50), '[^\\w\\-]', '', 'g') AS slug,
  CASE WHEN type = 'fleeting' THEN left('20260428' || lpad(id, 10, '0'), 8) || '-' || substr('20260428' || lpad(id, 10, '0'), 9) || '.md' ELSE '20260428' || lpad(id, 10, '0') || '-' || regexp_replace(left(replace(lower(title), ' ', '-'), 50), '[^\\w\\-]', '', 'g') || '.md' END AS file_name,
  lower(title || ' ' || lang || ' ' || source || ' ' || left(content, 500)) AS match_text
FROM notes""",
)
def _(spark, d):
    n = sample_notes(spark, d).withColumn("nid", F.concat(F.lit("20260428"), F.lpad("id", 10, "0")))
    c = F.col
    return n.select("id", T.preview(c("content"), 200).alias("summary"), T.default_title(c("content")).alias("default_title"), T.preview(c("content"), 150, True).alias("suggestion"), T.slug(c("title")).alias("slug"), T.file_name(c("nid"), c("type"), c("title")).alias("file_name"), T.match_text(c("title"), c("tags"), c("content")).alias("match_text"))


@query(
    "filename_to_id",
    r"""WITH s AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '20260412-' || lpad(CAST(doc_id AS VARCHAR), 10, '0') WHEN 1 THEN lpad(CAST(doc_id AS VARCHAR), 18, '2') || '-a-slug' WHEN 2 THEN lpad(CAST(doc_id AS VARCHAR), 18, '2') WHEN 3 THEN lpad(CAST(doc_id AS VARCHAR), 17, '2') ELSE 'readme' END AS stem FROM documents)
SELECT doc_id, stem, CASE WHEN regexp_full_match(stem, '\d{8}-\d{10}') THEN replace(stem, '-', '') WHEN regexp_full_match(stem, '\d{18}(-.*)?') THEN left(stem, 18) END AS note_id FROM s""",
)
def _(spark, d):
    n = F.col("doc_id").cast("string")
    stem = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("20260412-"), F.lpad(n, 10, "0"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lpad(n, 18, "2"), F.lit("-a-slug"))).when(F.col("doc_id") % 5 == 2, F.lpad(n, 18, "2")).when(F.col("doc_id") % 5 == 3, F.lpad(n, 17, "2")).otherwise("readme")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", stem.alias("stem"))
    return docs.select("doc_id", "stem", T.id_of_stem(F.col("stem")).alias("note_id"))


@query("note_ids", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS note_id FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", T.note_id(F.col("ts"), F.col("event_id") % 10000).alias("note_id"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
KEYWORDS = f"""
found AS (SELECT doc_id AS query_id, unnest(k) AS keyword, unnest(range(len(k))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[一-鿿]{{2,10}}|[a-zA-Z][a-zA-Z0-9_]{{1,15}}') AS k FROM documents)),
counted AS (SELECT query_id, keyword, count(*) AS count, min(pos) AS first FROM found WHERE keyword NOT IN ({_STOPS}) GROUP BY query_id, keyword),
keywords AS (SELECT * FROM (SELECT query_id, keyword, count, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, first) AS rank FROM counted) WHERE rank <= 10)"""


@query("extract_keywords", f"WITH {KEYWORDS} SELECT query_id, keyword, count, rank FROM keywords")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("query_id"), "text")
    return suggest.keywords(docs).withColumn("rank", F.col("rank").cast("long"))


# Search


@query("bm25_term_stats", f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def _(spark, d):
    return index_of(spark, d).terms.select("term", "df", _d("idf"))


@query("bm25_corpus_stats", f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT round(avg(raw), 6) FROM raw) AS avg_idf FROM corpus")
def _(spark, d):
    return index_of(spark, d).corpus.select("n", _d("avgdl"), _d("avg_idf"))


@query("bm25_topk", f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM {ranked('filled', K)}")
def _(spark, d):
    return hits_out(bm25.search(index_of(spark, d), searches(spark, d), K))


@query("bm25_match_only", f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM {ranked('hits', K)}")
def _(spark, d):
    return hits_out(bm25.search(index_of(spark, d), searches(spark, d), K, match_only=True))


@query(
    "keyword_tag_filter",
    f"WITH {BM25}, picked AS (SELECT f.* FROM filled f JOIN notes n ON n.id = f.id WHERE n.lang = 'en' AND n.source = 'src1' AND n.type = 'literature') SELECT query_id, id, round(score, 6) AS score, rank FROM {ranked('picked', K)}",
)
def _(spark, d):
    return hits_out(search.keyword(index_of(spark, d), searches(spark, d), K, sample_notes(spark, d), "literature", ["en", "src1"]))


@query("semantic_topk", f"WITH {COSINE} SELECT query_id, id, round(1 - score, 6) AS distance, round(score, 6) AS score, rank FROM {near_ranked(K)}")
def _(spark, d):
    found = vectors.search(vectors.require_dimension(sample_vectors(spark, d), 64), searches(spark, d), K)
    return hits_out(found, _d("distance"))


@query("semantic_filtered", f"WITH {COSINE} SELECT query_id, id, round(score, 6) AS score, rank FROM {near_ranked(K, 'label IN (1, 3)')}")
def _(spark, d):
    v = sample_vectors(spark, d).filter("label IN (1, 3)")
    return hits_out(vectors.search(v, searches(spark, d), K))


@query(
    "semantic_type_and_tags",
    f"WITH {COSINE}, {NOTES.strip()}, picked AS (SELECT n.query_id, n.id, n.score FROM near n JOIN notes USING (id) WHERE type = 'permanent' AND lang = 'en') SELECT query_id, id, round(score, 6) AS score, rank FROM {near_ranked(K).replace('FROM near', 'FROM picked')}",
)
def _(spark, d):
    v = sample_vectors(spark, d).join(sample_notes(spark, d).select("id", "type", "tags"), "id")
    return hits_out(vectors.search(v, searches(spark, d), K, "permanent", ["en"]))


@query(
    "knn_join_batch",
    f"WITH vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS rank FROM vecs a, vecs b WHERE a.vec_id % 50 = 0) WHERE rank <= 5",
)
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors.search(v, queries, 5).select("query_id", "id", _d("score"), F.col("rank").cast("long").alias("rank"))


def _rrf(sem: str, key: str, depth: int, where: str = "true") -> str:
    return f"""
a AS (SELECT query_id, id, score AS sem_score, rank AS sem_rank FROM {sem}),
b AS (SELECT query_id, id, score AS key_score, rank AS key_rank FROM {key}),
c AS (SELECT query_id, id, sem_score, sem_rank, key_score, key_rank, count(sem_rank) OVER w AS n_sem, count(key_rank) OVER w AS n_key FROM a FULL JOIN b USING (query_id, id) WINDOW w AS (PARTITION BY query_id)),
e AS (SELECT *, CASE WHEN n_sem = 0 THEN key_score WHEN n_key = 0 THEN sem_score ELSE coalesce(1.0 / (60 + sem_rank), 0) + coalesce(1.0 / (60 + key_rank), 0) END AS score, CASE WHEN n_sem = 0 THEN 'keyword' WHEN n_key = 0 THEN 'semantic' ELSE 'hybrid' END AS search_mode FROM c),
fused AS (SELECT * FROM (SELECT query_id, id, CAST(score AS DOUBLE) AS score, search_mode, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, sem_rank ASC NULLS LAST, key_rank ASC NULLS LAST) AS rank FROM e) WHERE rank <= {depth})"""


HYBRID = f"WITH {BM25}, {COSINE}, {_rrf(near_ranked(20), ranked('filled', 20), K)}"


@query("hybrid_rrf", f"{HYBRID} SELECT query_id, id, round(score, 6) AS score, search_mode, rank FROM fused")
def _(spark, d):
    return hits_out(search.hybrid(index_of(spark, d), sample_vectors(spark, d), searches(spark, d), K), "search_mode")


@query("hybrid_fallback_keyword", f"WITH {BM25}, {COSINE}, {_rrf(near_ranked(20, 'label > 1000'), ranked('filled', 20), K)} SELECT query_id, id, round(score, 6) AS score, search_mode, rank FROM fused")
def _(spark, d):
    return hits_out(search.hybrid(index_of(spark, d), sample_vectors(spark, d).filter("label > 1000"), searches(spark, d), K), "search_mode")


@query("hybrid_fallback_semantic", f"WITH {COSINE} SELECT query_id, id, round(score, 6) AS score, 'semantic' AS search_mode, rank FROM {near_ranked(K)}")
def _(spark, d):
    none = bm25.build(sample_notes(spark, d).select("id", "ord", F.lit("").alias("text")))
    return hits_out(search.hybrid(none, sample_vectors(spark, d), searches(spark, d), K), "search_mode")


@query(
    "search_hits_hydrated",
    f"{HYBRID} SELECT query_id, id, title, type, lang || ',' || source AS tags, CASE WHEN length(content) > 300 THEN left(content, 300) || '...' ELSE content END AS document, round(score, 6) AS score, search_mode, rank FROM fused JOIN notes USING (id)",
)
def _(spark, d):
    hits = search.search("hybrid", index_of(spark, d), sample_vectors(spark, d), searches(spark, d), K)
    return hits_out(search.hydrate(hits, sample_notes(spark, d)), "title", "type", _joined("tags"), "document", "search_mode")


@query("csv_hits", f"{HYBRID} SELECT id, title, type, round(score, 6) AS score, search_mode FROM fused JOIN notes USING (id)")
def _(spark, d):
    hits = search.search("hybrid", index_of(spark, d), sample_vectors(spark, d), searches(spark, d), K)
    return formats.flat(formats.hit_rows(search.hydrate(hits, sample_notes(spark, d)).withColumn("score", F.round("score", 6))))


@query(
    "bm25_upsert",
    BM25.replace("\nnotes AS (", "\nnotes0 AS (", 1).replace("searches AS (", "notes AS (SELECT id, ord, title, content FROM notes0 WHERE ord % 10 NOT IN (0, 5) UNION ALL SELECT id, ord + (SELECT max(ord) + 1 FROM notes0 WHERE ord % 10 <> 5) AS ord, 'Again', content FROM notes0 WHERE ord % 10 = 0),\nsearches AS (", 1).join(("WITH ", f" SELECT query_id, id, round(score, 6) AS score, rank FROM {ranked('hits', K)}")),
)
def _(spark, d):
    n = sample_notes(spark, d)
    index = bm25.remove(index_of(spark, d), n.filter("ord % 10 = 5").select("id"))
    again = n.filter("ord % 10 = 0").select("id", "ord", T.bm25_text(F.lit("Again"), F.col("content")).alias("text"))
    return hits_out(bm25.search(bm25.upsert(index, again), searches(spark, d), K, match_only=True))


_SUGGEST = f"""
texts AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0),
found AS (SELECT query_id, unnest(k) AS keyword, unnest(range(len(k))) AS pos FROM (SELECT query_id, regexp_extract_all(lower(text), '[一-鿿]{{2,10}}|[a-zA-Z][a-zA-Z0-9_]{{1,15}}') AS k FROM texts)),
counted AS (SELECT query_id, keyword, count(*) AS count, min(pos) AS first FROM found WHERE keyword NOT IN ({_STOPS}) GROUP BY query_id, keyword),
words AS (SELECT * FROM (SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY count DESC, first) AS r FROM counted) WHERE r <= 10),
sizes AS (SELECT query_id, count(*) AS size FROM words GROUP BY query_id),
sem AS (SELECT query_id, id, round(score, 3) AS score, rank AS place FROM {near_ranked(10)} WHERE score >= 0.6 AND id <> '5'),
texts2 AS (SELECT id, lower(title || ' ' || lang || ' ' || source || ' ' || left(content, 500)) AS t FROM notes WHERE id <> '5'),
kw AS (SELECT query_id, id, count(*) AS m, string_agg(keyword, ',' ORDER BY r) AS matched_keywords FROM words JOIN texts2 ON contains(t, keyword) GROUP BY query_id, id),
passed AS (SELECT kw.*, 0.3 + 0.3 * m / size AS raw FROM kw JOIN sizes USING (query_id) WHERE 0.3 + 0.3 * m / size >= 0.3 AND NOT EXISTS (SELECT 1 FROM sem s WHERE s.query_id = kw.query_id AND s.id = kw.id)),
taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM passed) p WHERE n <= 10 - coalesce((SELECT count(*) FROM sem s WHERE s.query_id = p.query_id), 0)),
every AS (SELECT query_id, id, score, 'semantic' AS match_type, '' AS matched_keywords, place FROM sem UNION ALL SELECT query_id, id, round(raw, 3), 'keyword', matched_keywords, n + 1000000 FROM taken),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM every)"""


@query(
    "suggest_links",
    "WITH "
    + NOTES
    + ", "
    + COSINE
    + ", "
    + _SUGGEST
    + " SELECT query_id, id, score, match_type, matched_keywords, rank, CASE WHEN content <> '' THEN left(content, 150) || '...' ELSE '' END AS preview FROM best JOIN notes USING (id) WHERE rank <= 5",
)
def _(spark, d):
    texts = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    v = sample_vectors(spark, d)
    q = v.filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("embedding").alias("vector"))
    out = spark.createDataFrame([("5",)], "id string")
    got = suggest.suggest(texts, sample_notes(spark, d), vectors.search(v, q, 10), 5, 0.6, out)
    return got.select("query_id", "id", "score", "match_type", F.coalesce(F.array_join("matched_keywords", ","), F.lit("")).alias("matched_keywords"), F.col("rank").cast("long").alias("rank"), "preview")


# Links and the graph

WIKI = r"""
wiki AS (SELECT id, CAST(pos AS BIGINT) AS pos, link FROM (SELECT id, unnest(l) AS link, unnest(range(len(l))) AS pos FROM (SELECT id, list_filter(list_transform(regexp_extract_all(content, '\[\[(.*?)\]\]', 1), lambda x: trim(x)), lambda x: x <> '') AS l FROM notes)))"""
RESOLVE = """
texts AS (SELECT DISTINCT link FROM wiki),
by_id AS (SELECT link, id AS target, 1 AS tier FROM texts JOIN notes ON id = link),
by_title AS (SELECT link, min(id) AS target, 2 AS tier FROM texts JOIN notes ON lower(title) = lower(link) WHERE link NOT IN (SELECT link FROM by_id) GROUP BY link),
by_part AS (SELECT link, min(id) AS target, 3 AS tier FROM texts JOIN notes ON contains(lower(title), lower(link)) WHERE link NOT IN (SELECT link FROM by_id) AND link NOT IN (SELECT link FROM by_title) GROUP BY link),
resolved AS (SELECT * FROM by_id UNION ALL SELECT * FROM by_title UNION ALL SELECT * FROM by_part)"""
EDGES = """
declared AS (SELECT id AS src, link1 AS dst FROM notes UNION ALL SELECT id, link2 FROM notes),
edges AS (SELECT src, dst, min(type) AS type FROM (SELECT src, dst, 'links' AS type FROM declared WHERE dst IN (SELECT id FROM notes) UNION ALL SELECT w.id, target, 'wiki_link' FROM wiki w JOIN resolved USING (link)) GROUP BY src, dst)"""
GRAPH = f"WITH RECURSIVE {NOTES}, {WIKI}, {RESOLVE}, {EDGES}"
BOTH = "both_ways AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges)"


@query("wiki_links_extract", f"WITH {NOTES}, {WIKI} SELECT id, pos, link FROM wiki")
def _(spark, d):
    return links.extract(sample_notes(spark, d)).select("id", F.col("pos").cast("long").alias("pos"), "link")


@query("resolve_links", f"WITH {NOTES}, {WIKI}, {RESOLVE} SELECT link, target, tier FROM resolved")
def _(spark, d):
    n = sample_notes(spark, d)
    return links.resolve(links.extract(n), n)


@query("graph_edges", f"{GRAPH} SELECT src, dst, type FROM edges")
def _(spark, d):
    return links.edges(sample_notes(spark, d))


@query("graph_degree_hubs", f"{GRAPH}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS degree FROM ends GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def _(spark, d):
    n = sample_notes(spark, d)
    return graph.hubs(n, links.edges(n))


@query(
    "graph_stats",
    "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), l AS (SELECT conv_id, turn FROM e UNION SELECT conv_id, turn + 1 FROM e), starts AS (SELECT conv_id, turn FROM e EXCEPT SELECT conv_id, turn + 1 FROM e) SELECT (SELECT count(*) FROM c) AS nodes, (SELECT count(*) FROM e) AS edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM c), 6) AS avg_degree, (SELECT count(*) FROM c) - (SELECT count(*) FROM l) AS isolated, (SELECT count(*) FROM starts) AS clusters",
)
def _(spark, d):
    v, e = turn_edges(spark, d)
    return graph.stats(v, e).withColumn("avg_degree", F.round("avg_degree", 6))


@query("graph_neighbors", f"{GRAPH}, {BOTH} SELECT id, other FROM both_ways WHERE CAST(id AS BIGINT) % 50 = 0")
def _(spark, d):
    n = sample_notes(spark, d)
    return graph.neighbors(links.edges(n), seeds_of(n))


BFS = f"{BOTH}, reached AS (SELECT id AS seed, id, 0 AS depth FROM notes WHERE CAST(id AS BIGINT) % 50 = 0 UNION SELECT r.seed, b.other, r.depth + 1 FROM reached r JOIN both_ways b ON b.id = r.id WHERE r.depth < 2), near AS (SELECT seed, id, min(depth) AS depth FROM reached GROUP BY seed, id HAVING min(depth) > 0)"


@query("graph_related_bfs", f"{GRAPH}, {BFS} SELECT seed, depth, id FROM near")
def _(spark, d):
    n = sample_notes(spark, d)
    return graph.related(links.edges(n), seeds_of(n), 2)


@query(
    "graph_shortest_path",
    f"{GRAPH}, walks AS (SELECT id AS src, id AS place, 0 AS steps FROM notes WHERE CAST(id AS BIGINT) % 50 = 0 UNION SELECT w.src, e.dst, w.steps + 1 FROM walks w JOIN edges e ON e.src = w.place AND e.src <> e.dst WHERE w.steps < 3) SELECT src, place AS dst, CAST(min(steps) AS INTEGER) AS length, true AS found FROM walks WHERE CAST(place AS BIGINT) % 50 = 7 GROUP BY src, place",
)
def _(spark, d):
    n = sample_notes(spark, d)
    # Every seed with every target.
    got = graph.shortest_paths(links.edges(n), seeds_of(n), n.filter("ord % 50 = 7"), 3)
    ok = (F.element_at("path", 1) == F.col("src")) & (F.element_at("path", -1) == F.col("dst")) & (F.size("path") == F.col("length") + 1)
    return got.select("src", "dst", "length", ok.alias("found"))


@query("graph_clusters", "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), g AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c) SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(min(turn) AS VARCHAR), 6, '0') AS cluster, count(*) AS size FROM g GROUP BY conv_id, run HAVING count(*) > 1")
def _(spark, d):
    return graph.cluster_sizes(turn_edges(spark, d)[1])


@query(
    "graph_note_clusters",
    f"{GRAPH}, {BOTH}, far AS (SELECT id, other FROM both_ways WHERE id <> other UNION SELECT f.id, b.other FROM far f JOIN both_ways b ON b.id = f.other) SELECT min(other) AS cluster, id FROM far GROUP BY id",
)
def _(spark, d):
    return graph.clusters(links.edges(sample_notes(spark, d)))


@query("graph_orphans", f"WITH {NOTES}, e AS (SELECT id AS src, link1 AS dst FROM notes UNION ALL SELECT id, link2 FROM notes) SELECT id FROM notes WHERE id NOT IN (SELECT dst FROM e) AND id NOT IN (SELECT src FROM e WHERE dst IN (SELECT id FROM notes))")
def _(spark, d):
    n = sample_notes(spark, d)
    return graph.orphans(n.select("id"), links.edges(n.withColumn("content", F.lit("")))).select("id")


@query("graph_broken_links", f"WITH {NOTES}, b AS (SELECT id, 0 AS pos, link1 AS l FROM notes UNION ALL SELECT id, 1, link2 FROM notes) SELECT id, string_agg(l, ',' ORDER BY pos) AS missing FROM b WHERE l NOT IN (SELECT id FROM notes) GROUP BY id")
def _(spark, d):
    return links.broken(sample_notes(spark, d)).select("id", _joined("missing"))


@query("graph_subgraph", f"{GRAPH}, {BFS}, inside AS (SELECT id FROM near UNION SELECT id FROM notes WHERE CAST(id AS BIGINT) % 50 = 0) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)")
def _(spark, d):
    n = sample_notes(spark, d)
    return graph.subgraph(links.edges(n), seeds_of(n), 2)[1].select("src", "dst", "type")


@query("backlinks", f"WITH {NOTES}, e AS (SELECT DISTINCT link AS id, src FROM (SELECT id AS src, link1 AS link FROM notes UNION ALL SELECT id, link2 FROM notes) WHERE link IN (SELECT id FROM notes)) SELECT id, string_agg(src, ',' ORDER BY src) AS backlinks FROM e GROUP BY id")
def _(spark, d):
    return links.backlinks(sample_notes(spark, d)).select("id", _joined("backlinks"))


_WITH_BACK = "e AS (SELECT DISTINCT link AS id, src FROM (SELECT id AS src, link1 AS link FROM notes UNION ALL SELECT id, link2 FROM notes) WHERE link IN (SELECT id FROM notes)), backs AS (SELECT id, count(*) AS m FROM e GROUP BY id)"


def full_notes(spark, d):
    return maintain.with_backlinks(sample_notes(spark, d).withColumn("backlinks", F.array().cast("array<string>")))


@query("refs_stats", f"WITH {NOTES}, {_WITH_BACK} SELECT n.id, title, CAST(2 AS INTEGER) AS outgoing, CAST(coalesce(m, 0) AS INTEGER) AS incoming FROM notes n LEFT JOIN backs ON backs.id = n.id")
def _(spark, d):
    return links.refs(full_notes(spark, d))


@query("refs_title_search", f"WITH {NOTES} SELECT 'part' AS how, id FROM notes WHERE contains(lower(title), 'oc 12') UNION ALL SELECT 'prefix', id FROM notes WHERE starts_with(lower(title), 'doc 99') UNION ALL SELECT 'exact', id FROM notes WHERE lower(title) = 'doc 7'")
def _(spark, d):
    n = sample_notes(spark, d)
    parts = [links.find(n, t, how).select(F.lit(how).alias("how"), "id") for how, t in (("part", "OC 12"), ("prefix", "DOC 99"), ("exact", "doc 7"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "refs_note",
    f"WITH {NOTES}, {_WITH_BACK}, f AS (SELECT id, 'forward' AS direction, 0 AS pos, link1 AS other FROM notes UNION ALL SELECT id, 'forward', 1, link2 FROM notes UNION ALL SELECT id, 'backward', row_number() OVER (PARTITION BY id ORDER BY src) - 1, src FROM e) SELECT f.id, direction, CAST(pos AS INTEGER) AS pos, other, title FROM f JOIN notes ON notes.id = other WHERE CAST(f.id AS BIGINT) % 50 = 0",
)
def _(spark, d):
    n = full_notes(spark, d)
    return links.refs_of(n, seeds_of(n))


@query(
    "query_with_graph",
    f"""{HYBRID.replace("WITH ", "WITH RECURSIVE ", 1)}, {WIKI}, {RESOLVE.replace("texts AS", "linktexts AS").replace("FROM texts", "FROM linktexts")}, {EDGES}, {BOTH},
seeds AS (SELECT DISTINCT id FROM fused),
reached AS (SELECT id AS seed, id, 0 AS depth FROM seeds UNION SELECT r.seed, b.other, r.depth + 1 FROM reached r JOIN both_ways b ON b.id = r.id WHERE r.depth < 2),
close AS (SELECT seed, id, min(depth) AS depth FROM reached GROUP BY seed, id HAVING min(depth) > 0),
few AS (SELECT *, row_number() OVER (PARTITION BY seed, depth ORDER BY id) AS n FROM close),
lists AS (SELECT seed, string_agg(depth || ':' || id, ',' ORDER BY depth, id) AS related FROM few WHERE n <= 3 GROUP BY seed),
many AS (SELECT id, count(DISTINCT other) AS neighbors FROM both_ways GROUP BY id)
SELECT query_id, fused.id, rank, coalesce(neighbors, 0) AS neighbors, related FROM fused LEFT JOIN lists ON seed = fused.id LEFT JOIN many ON many.id = fused.id""",
)
def _(spark, d):
    n = sample_notes(spark, d)
    hits = search.search("hybrid", index_of(spark, d), sample_vectors(spark, d), searches(spark, d), K)
    got = graph.enrich(hits, n, links.edges(n), 2)
    related = F.array_join(F.transform("related", lambda x: F.concat(x["depth"].cast("string"), F.lit(":"), x["other"])), ",")
    return got.select(F.col("query_id").cast("int").alias("query_id"), "id", F.col("rank").cast("long").alias("rank"), "neighbors", related.alias("related"))


@query("link_diff", f"WITH {NOTES}, n2 AS (SELECT *, CAST((ord * 7 + 3) % (SELECT count(*) + count(*) // 2 FROM documents) AS VARCHAR) AS new1, CAST((ord * 2 + 9) % (SELECT count(*) + count(*) // 2 FROM documents) AS VARCHAR) AS new2 FROM notes) SELECT id, array_to_string(list_sort(list_distinct(list_filter([new1, new2], lambda x: x <> link1 AND x <> link2))), ',') AS added, array_to_string(list_sort(list_distinct(list_filter([link1, link2], lambda x: x <> new1 AND x <> new2))), ',') AS removed FROM n2")
def _(spark, d):
    n = sample_notes(spark, d)
    size = n.count()
    new = n.select("id", F.array(F.element_at("links", 1), F.pmod(F.col("ord") * 2 + 9, F.lit(size + size // 2)).cast("string")).alias("links"))
    return links.diff(n, new).select("id", _joined("added"), _joined("removed"))


# Listing and maintenance


@query("list_notes", f"WITH {NOTES} SELECT id, type FROM notes WHERE lang = 'en' AND source = 'src1' ORDER BY CASE type WHEN 'fleeting' THEN 1 WHEN 'literature' THEN 2 ELSE 3 END, id DESC LIMIT 12")
def _(spark, d):
    return maintain.listed(maintain.metadata(sample_notes(spark, d)), None, ["en", "src1"], 12).select("id", "type")


@query("list_by_type", f"WITH {NOTES} SELECT id, title FROM notes WHERE type = 'permanent'")
def _(spark, d):
    return maintain.listed(sample_notes(spark, d), "permanent").select("id", "title")


@query("inbox", f"WITH {NOTES} SELECT id, title FROM notes WHERE type = 'fleeting' ORDER BY id DESC LIMIT 20")
def _(spark, d):
    return maintain.inbox(sample_notes(spark, d)).select("id", "title")


@query("daily", "WITH n AS (SELECT strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS id, event_type AS title FROM events) SELECT id, title FROM n WHERE starts_with(id, (SELECT strftime(min(ts), '%Y%m%d') FROM events))")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = e.select(T.note_id(F.col("ts"), F.col("event_id") % 10000).alias("id"), F.col("event_type").alias("title"))
    return maintain.daily(n, e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd")).first()[0])


@query("status_by_type", f"WITH {NOTES} SELECT type, count(*) AS notes FROM notes GROUP BY ROLLUP (type)")
def _(spark, d):
    return maintain.status(sample_notes(spark, d))


_FILES = "files AS (SELECT DISTINCT lpad(CAST(doc_id AS VARCHAR), 18, '2') AS id FROM documents WHERE doc_id % 7 <> 0), indexed AS (SELECT DISTINCT lpad(CAST(doc_id AS VARCHAR), 18, '2') AS id FROM documents WHERE doc_id % 11 <> 0)"


def _files(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 18, "2").alias("id"))
    return own.filter("doc_id % 7 <> 0").select(F.concat("id", F.lit("-slug")).alias("stem")), own.filter("doc_id % 11 <> 0").select("id")


@query("verify_index", f"WITH {_FILES} SELECT id, 'missing' AS problem FROM (SELECT id FROM files EXCEPT SELECT id FROM indexed) UNION ALL SELECT id, 'orphaned' FROM (SELECT id FROM indexed EXCEPT SELECT id FROM files)")
def _(spark, d):
    return maintain.verify(*_files(spark, d))


@query("verify_counts", f"WITH {_FILES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM indexed) AS indexed, (SELECT count(*) FROM (SELECT id FROM files EXCEPT SELECT id FROM indexed)) AS missing, (SELECT count(*) FROM (SELECT id FROM indexed EXCEPT SELECT id FROM files)) AS orphaned, false AS healthy")
def _(spark, d):
    return maintain.verify_counts(*_files(spark, d))


@query("upsert_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id")
    return maintain.last_wins(e, "user_id", "event_id")


@query("edit_and_delete", f"WITH {NOTES} SELECT id, CASE WHEN ord % 4 = 0 THEN 'New ' || id ELSE title END AS title, type FROM notes WHERE ord % 9 <> 0")
def _(spark, d):
    n = sample_notes(spark, d).withColumn("updated", F.localtimestamp())
    changes = n.filter("ord % 4 = 0").select("id", F.concat(F.lit("New "), "id").alias("title"))
    return maintain.delete(maintain.edit(n, changes), n.filter("ord % 9 = 0")).select("id", "title", "type")


@query("perf_report", "SELECT event_type AS op, count(value) AS count, round(sum(value), 6) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("op"), F.col("value").alias("duration"))
    return metrics.report(e).select("op", "count", _d("total"), _d("avg"), "min", "max")


@query(
    "debounce_sessions",
    "WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e) SELECT '/notes/' || user_id || '.md' AS path, max(ts) AS ts, count(*) AS events FROM g GROUP BY user_id, run",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("/notes/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), "ts", F.col("event_type").alias("op"))
    return indexer.settled(e, "3600 seconds").select("path", "ts", "events")


@query(
    "git_log_notes",
    "SELECT 'Subject ' || doc_id AS title, 'Commit: ' || left(md5(CAST(doc_id AS VARCHAR)), 7) || chr(10) || 'Author: ' || source || chr(10) || 'Date: 2026-01-01' || chr(10) || chr(10) || 'body ' || lang || chr(10) || 'second' AS content, 'source:demo,source:git-log' AS tags FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'Subject ' || doc_id, 'Commit: ' || left(md5(CAST(doc_id AS VARCHAR)), 7) || chr(10) || 'Author: ' || source || chr(10) || 'Date: 2026-01-01', 'source:demo,source:git-log' FROM documents WHERE doc_id % 2 = 1",
)
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n, end = F.col("doc_id").cast("string"), f"\n{git_log.DELIMITER}\n"
    head = F.concat(F.lit("Hash: "), F.md5(n.cast("binary")), F.lit("\nSubject: Subject "), n, F.lit("\nAuthor: "), "source", F.lit("\nDate: 2026-01-01\n\n"))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("body "), "lang", F.lit("\n\nCo-authored-by: someone\nsecond\n"))).otherwise("")
    logs = docs.select(F.concat(head, body, F.lit(end)).alias("raw"))
    return git_log.as_notes(git_log.commits(logs), "demo").select("title", "content", _joined("tags"))


@query("page_links", r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS INTEGER) AS n_links, array_to_string(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1), ' ') AS links FROM pages""")
def _(spark, d):
    found = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.size(found).alias("n_links"), F.array_join(found, " ").alias("links"))


@query("kb_stats", f"WITH {NOTES} SELECT source AS name, count(*) AS total, CAST(count_if(type = 'permanent') AS BIGINT) AS permanent FROM notes GROUP BY source")
def _(spark, d):
    n = sample_notes(spark, d).withColumn("kb", F.element_at("tags", 2))
    bases = n.select(F.col("kb").alias("name")).distinct()
    return admin.base_stats(bases, n).select("name", "total", F.coalesce(F.try_element_at("by_type", F.lit("permanent")), F.lit(0).cast("long")).alias("permanent"))


@query("template_render", f"WITH {NOTES} SELECT id, '2026-04-28-' || title AS title, '## 快速笔记' || chr(10) || chr(10) || '创建于 ' || chr(10) || chr(10) || content AS content FROM notes")
def _(spark, d):
    n = sample_notes(spark, d).select("id", "title", "content", F.lit("2026-04-28").alias("date"))
    return admin.rendered(n, admin.BUILTIN["quick"]).select("id", "title", "content")


# Beyond SQL: held by tests.


@query("markdown_roundtrip")
def _(spark, d):
    from marginalia.sources import markdown

    n = full_notes(spark, d).withColumn("created", F.to_timestamp_ntz(F.lit("2026-04-28 10:00:00"))).withColumn("updated", F.col("created")).withColumn("source", F.element_at("tags", 2)).withColumn("filepath", F.lit(None).cast("string"))
    files = formats.markdown(n).select("filepath", F.col("text").cast("binary").alias("raw"))
    return markdown.valid(markdown.notes(files)).select("id", "title", "type", "content", _joined("tags"), _joined("links"), _joined("backlinks"), "source")


@query("encode_text")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    from marginalia.session import ship

    ship(spark)
    e = F.col("embedding")
    return vectors.encode(docs).select("doc_id", F.size(e).alias("dimension"), F.round(vectors.dot(e, e), 4).alias("length"), F.transform(e, lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query(
    "bulk_import",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS no FROM documents)
SELECT strftime(TIMESTAMP '2026-04-28 10:00:00' + to_seconds(no // 10000), '%Y%m%d%H%M%S') || lpad(CAST(no % 10000 AS VARCHAR), 4, '0') AS id, 'Doc ' || doc_id AS title, md5(text) AS content_md5, 'permanent' AS type, lang AS tags, true AS indexed FROM n""",
)
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id")
    rows = docs.select(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.array("lang").alias("tags"))
    n = saved(maintain.import_notes(rows, "2026-04-28 10:00:00"))
    index = bm25.build(n.select("id", F.col("id").cast("long").alias("ord"), T.bm25_text(F.col("title"), F.col("content")).alias("text")))
    known = n.join(index.docs.select("id", F.lit(True).alias("indexed")), "id", "left")
    return known.select("id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"), "type", _joined("tags"), F.coalesce("indexed", F.lit(False)).alias("indexed"))
