"""Retrieval over documents, with the benchmark passages as queries, and over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import query_terms
from sondage.operators import ann, search
from sondage.sources.bindings import table

from .registry import query


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document_id"), F.col("lang").alias("workspace_id"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text"), 1 << 20).alias("terms"))


_STOP = "['a','an','and','are','as','at','by','for','from','how','in','is','it','of','on','or','that','the','this','to','was','were','what','which','with']"
_POSTINGS = r"""words AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
post AS (SELECT term, chunk_id, count(*) AS tf FROM words GROUP BY ALL), len AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY chunk_id), tot AS (SELECT count(*) AS n_all, avg(dl) AS avg_dl FROM len)"""
_ASKED = f"""raw AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS t FROM benchmark),
asked AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_filter(t, lambda x: NOT list_contains({_STOP}, x))) AS term FROM raw))"""
_BM25 = f"""{_POSTINGS}, {_ASKED}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
part AS (SELECT a.query_id, p.chunk_id, greatest(ln((n_all - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS part FROM asked a JOIN post p USING (term) JOIN df USING (term) JOIN len USING (chunk_id), tot),
scored AS (SELECT query_id, chunk_id, CAST(sum(CAST(part AS DECIMAL(28,10))) AS DOUBLE) AS score FROM part GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 24)"""


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def r2_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_stats(search.postings(_chunks(spark, sf_dir)))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM bm")
def r3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 24).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query(f"""WITH {_ASKED}, h AS (SELECT query_id, doc_id AS chunk_id, CAST(count(*) AS DOUBLE) AS score FROM documents JOIN asked ON contains(lower(text), term) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 24""")
def r4_substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring_search(_chunks(spark, sf_dir), _queries(spark, sf_dir), 24)


_VECTORS = """nv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), uv AS (SELECT vec_id, list_transform(v, lambda x: x / CASE WHEN list_dot_product(v, v) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) AS v FROM nv),
vs AS (SELECT q.vec_id AS query_id, d.vec_id AS chunk_id, round(list_dot_product(q.v, d.v), 6) AS score FROM uv q JOIN uv d ON q.vec_id % 20 = 0 WHERE round(list_dot_product(q.v, d.v), 6) >= 0.30),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs QUALIFY rank <= 24)"""


def _vector_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.vector_search(vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), 24)


@query(f"WITH {_VECTORS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM vr")
def r6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 20, against all vectors."""
    return _vector_lane(spark, sf_dir)


@query()
def r7_ann_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an inverted file; approximate, so tests hold its recall against the exact search."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return ann.ann_vector_search(queries, vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), 24, dims=64)


@query(f"""WITH {_BM25}, {_VECTORS}, b AS (SELECT query_id, chunk_id, 'lexical' AS lane, 1.25 / (60 + rank) AS part FROM bm UNION ALL SELECT query_id, chunk_id, 'vector', CAST(1.0 AS DOUBLE) / (60 + rank) FROM vr),
s AS (SELECT query_id, chunk_id, round(sum(CAST(part AS DOUBLE)), 8) AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS sources FROM b GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s""")
def r8_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rrf([("lexical", search.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 24), 1.25), ("vector", _vector_lane(spark, sf_dir), 1.0)])


@query(f"""WITH {_BM25}, r AS (SELECT b.*, source AS document_id, chunk_id // 10 AS slide_id FROM bm b JOIN documents d ON d.doc_id = b.chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS rd, row_number() OVER (PARTITION BY query_id, document_id, slide_id ORDER BY rank) AS rs, count(DISTINCT document_id) OVER (PARTITION BY query_id) > 1 AS many FROM r),
u AS (SELECT *, CASE WHEN rd = 1 AND many THEN 1 WHEN rs = 1 THEN 2 ELSE 3 END AS turn FROM t)
SELECT query_id, chunk_id, document_id, slide_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, rank) AS INTEGER) AS place FROM u QUALIFY place <= 12""")
def w16_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    ranked = search.bm25(chunks, _queries(spark, sf_dir), 24).join(chunks.select("chunk_id", "document_id"), "chunk_id").withColumn("slide_id", F.floor(F.col("chunk_id") / 10))
    return search.diversify(ranked, 12)


@query(f"""WITH {_BM25}, g AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
h AS (SELECT g.query_id, max(CASE WHEN bm.rank <= 5 THEN 1 ELSE 0 END) AS hit FROM g LEFT JOIN bm ON g.query_id = bm.query_id AND g.chunk_id = bm.chunk_id GROUP BY 1) SELECT count(*) AS n_queries, avg(hit) AS hit_rate FROM h""")
def a20_hit_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: the documents that hold a whole benchmark text."""
    chunks = _chunks(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return search.hit_at_k(search.bm25(chunks, _queries(spark, sf_dir), 24), search.holding(chunks, items), 5)


@query("""SELECT doc_id AS chunk_id, sha256(text) AS content_sha256 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND len(e.embedding) = 64 AND e.vec_id % 7 <> 0)""")
def s9_missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh embedding counts as one of another model."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 7 == 0, "old").otherwise("new").alias("model"), F.size("embedding").alias("dims")).join(chunks, "chunk_id")
    return search.missing_embeddings(chunks, have, "new", 64)


@query("""WITH b AS (SELECT lang AS workspace_id, doc_id // 4096 AS block, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS part FROM documents GROUP BY ALL)
SELECT workspace_id, sha256(string_agg(part, ',' ORDER BY block)) AS signature FROM b GROUP BY workspace_id""")
def s11_corpus_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus_signature(_chunks(spark, sf_dir).select("workspace_id", "chunk_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256")))


@query("""WITH a AS (SELECT DISTINCT item_id AS a_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS term FROM benchmark)
SELECT x.a_id, y.a_id AS b_id, count(*) AS shared FROM a x JOIN a y ON x.term = y.term WHERE NOT list_contains(""" + _STOP + """, x.term) GROUP BY ALL""")
def j10_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return search.token_overlap(items, items)


@query(f"""WITH {_BM25}, h AS (SELECT b.query_id, b.chunk_id, score, (SELECT count(*) FROM asked a WHERE a.query_id = b.query_id AND contains(lower(d.text), a.term)) AS c, (SELECT count(*) FROM asked a WHERE a.query_id = b.query_id AND contains(lower(string_split(d.text, chr(10))[1]), a.term)) AS t FROM bm b JOIN documents d ON d.doc_id = b.chunk_id),
s AS (SELECT query_id, chunk_id, CAST(round(CAST(score AS DECIMAL(28,10)) + 2 * c + t, 6) AS DOUBLE) AS score FROM h) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s""")
def r5_lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first line is its title."""
    chunks, queries = _chunks(spark, sf_dir).withColumn("title", F.get(F.split("content", "\n"), F.lit(0))), _queries(spark, sf_dir)
    return search.lexical_score(search.bm25(chunks, queries, 24), chunks, queries)


@query(f"""WITH {_BM25}, r AS (SELECT b.*, source AS document_id FROM scored b JOIN documents d ON d.doc_id = b.chunk_id), c AS (SELECT query_id, count(DISTINCT document_id) AS nd FROM r GROUP BY 1),
n AS (SELECT r.*, nd, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_id) AS rd FROM r JOIN c USING (query_id))
SELECT query_id, document_id, chunk_id, CASE WHEN rank <= 12 THEN 'global' ELSE 'document' END AS lane FROM n WHERE rank <= 12 OR rd <= greatest(4, least(8, 16 // nd + 2))""")
def r14_document_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    scored = search.bm25_scores(chunks, _queries(spark, sf_dir)).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return search.document_lanes(scored, 12)


@query(r"""WITH w AS (SELECT doc_id AS id, unnest(list_concat(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), flatten(list_transform(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]{2,}'), lambda r: list_transform(range(1, length(r)), lambda k: substr(r, CAST(k AS BIGINT), 2)))))) AS word FROM documents), f AS (SELECT id, word AS feature FROM w UNION ALL SELECT id, '#' || substr(word, CAST(k AS BIGINT), 3) FROM w, unnest(range(1, greatest(length(word) - 1, 1))) AS u(k) WHERE length(word) > 3),
n AS (SELECT id, feature, count(*) AS n, ('0x' || substr(md5(feature), 1, 15))::BIGINT AS h FROM f GROUP BY ALL)
SELECT id, h % 384 AS bucket, CAST(sum(CASE WHEN (h // 384) % 2 = 0 THEN n ELSE -n END) AS BIGINT) AS weight FROM n GROUP BY 1, 2 HAVING weight <> 0""")
def x17_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hash_embedding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
