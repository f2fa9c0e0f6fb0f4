"""Charts for requests about orders, lanes by mode, merged evidence, and expected terms of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import planning, search
from sondage.sources.bindings import QUARTERLY_SQL, YEARLY_SQL, quarterly_points, spread, table, yearly_points

from .registry import query
from .search_queries import _BM25, _VECTORS, _chunks, _queries, _vector_lane


def _charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two charts a region: bars of years, lines of quarters."""
    named = lambda df, tail, kind: df.select(F.concat("scope_id", F.lit(tail)).alias("scope_id"), "series_name", F.lit(kind).alias("family"), F.concat(F.lit(f"Revenue {kind} of "), "scope_id").alias("title"))
    both = named(yearly_points(spark, sf_dir), ":year", "bar").unionByName(named(quarterly_points(spark, sf_dir), ":quarter", "line"))
    return planning.chart_signatures(both, family=F.col("family"), title=F.col("title"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition


@query(rf"""WITH {YEARLY_SQL.replace("points AS", "yp AS")}, {QUARTERLY_SQL.replace("points AS", "qp AS")},
se AS (SELECT scope_id || ':year' AS scope_id, series_name, 'bar' AS family, 'Revenue bar of ' || scope_id AS title, count(*) AS length FROM yp GROUP BY ALL UNION ALL SELECT scope_id || ':quarter', series_name, 'line', 'Revenue line of ' || scope_id, count(*) FROM qp GROUP BY ALL),
ch AS (SELECT scope_id, family, count(*) AS n, list_distinct(flatten(list(regexp_extract_all(lower(title || ' ' || series_name), '[a-z0-9_]{{2,}}')))) AS tokens, list(regexp_extract_all(lower(series_name), '[a-z0-9_]{{2,}}')) AS names, list(length) AS lengths, CASE WHEN count(*) > 1 THEN count(*) ELSE max(length) END AS entities FROM se GROUP BY scope_id, family),
rq AS (SELECT o_orderkey AS request_id, list_distinct(regexp_extract_all(lower('Revenue of ' || c_mktsegment || ' in FY' || (year(o_orderdate) + 24) || ' for ' || r_name), '[a-z0-9_]{{2,}}')) AS asked, CASE WHEN o_custkey % 2 = 0 THEN 'bar' ELSE 'line' END AS wanted, CASE WHEN o_custkey % 3 = 0 THEN [5] ELSE [] END AS counts, CASE WHEN o_custkey % 5 = 0 THEN [5, 99] ELSE [] END AS points
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 20 = 0),
sc AS (SELECT request_id, scope_id, entities, len(list_intersect(asked, tokens)) + CASE WHEN n > 1 AND list_contains(counts, n) THEN 9 ELSE 0 END + CASE WHEN len(list_intersect(lengths, points)) > 0 THEN 7 ELSE 0 END + CASE WHEN wanted = family THEN 5 ELSE 0 END + 8 * len(list_filter(names, lambda x: len(list_intersect(x, asked)) = len(x)))
  - CASE WHEN len(counts) > 0 AND NOT (n > 1 AND list_contains(counts, n)) THEN 48 ELSE 0 END - CASE WHEN len(points) > 0 AND len(list_intersect(lengths, points)) = 0 THEN 48 ELSE 0 END AS score FROM rq JOIN ch ON len(list_intersect(asked, tokens)) > 0)
SELECT request_id, scope_id, CAST(score AS BIGINT) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, entities DESC, scope_id DESC) = 1 AND score > 0""")
def r17_choose_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: every twentieth order's segment, year and region, with a family, and for some numbers of series and points."""
    text = F.concat(F.lit("Revenue of "), "c_mktsegment", F.lit(" in FY"), (F.year("o_orderdate") + 24).cast("string"), F.lit(" for "), "r_name")
    numbers = lambda when, *n: F.when(when, F.array(*map(F.lit, n))).otherwise(F.array().cast("array<int>"))
    key = F.col("o_custkey")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)))
    requests = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("request_id"), tokens.alias("tokens"), F.array(F.when(key % 2 == 0, "bar").otherwise("line")).alias("families"), numbers(key % 3 == 0, 5).alias("series_counts"), numbers(key % 5 == 0, 5, 99).alias("point_counts"))
    return planning.choose_scope(requests, _charts(spark, sf_dir))


@query(f"""WITH {_BM25}, {_VECTORS}, rq AS (SELECT DISTINCT vec_id AS query_id, CASE vec_id % 3 WHEN 0 THEN 'fts' WHEN 1 THEN 'vector' ELSE 'hybrid' END AS mode FROM embeddings),
st AS (SELECT query_id, CASE WHEN mode = 'fts' THEN 'lexical' WHEN NOT v THEN 'lexical+vector_fallback' WHEN mode = 'vector' THEN 'vector' WHEN NOT l THEN 'vector+lexical_empty' ELSE 'hybrid_rrf' END AS label FROM (SELECT *, query_id IN (SELECT query_id FROM bm) AS l, query_id IN (SELECT query_id FROM vr) AS v FROM rq)),
fu AS (SELECT query_id, chunk_id, round(sum(part), 8) AS score FROM (SELECT query_id, chunk_id, CAST(1.25 / (60 + rank) AS DOUBLE) AS part FROM bm UNION ALL SELECT query_id, chunk_id, CAST(1.0::DOUBLE / (60 + rank) AS DOUBLE) FROM vr) GROUP BY ALL),
fk AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, label FROM st JOIN bm USING (query_id) WHERE label LIKE 'lexical%' UNION ALL SELECT query_id, chunk_id, CAST(rank AS INTEGER), label FROM st JOIN vr USING (query_id) WHERE label LIKE 'vector%' UNION ALL SELECT query_id, chunk_id, CAST(rank AS INTEGER), label FROM st JOIN fk USING (query_id) WHERE label = 'hybrid_rrf'""")
def r9_pick_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mode for each id of a vector; benchmark items with it are the lexical lane."""
    key = F.col("vec_id") % 3
    requests = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.when(key == 0, "fts").when(key == 1, "vector").otherwise("hybrid").alias("mode")).distinct()
    return planning.pick_lane(requests, search.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 24), _vector_lane(spark, sf_dir))


@query("""WITH c AS (SELECT l_orderkey AS query_id, l_linenumber AS place, CAST(l_suppkey AS BIGINT) AS slide_id, CASE WHEN l_linenumber % 2 = 0 THEN 'e' || l_partkey ELSE '' END AS element_id, CAST(l_partkey AS BIGINT) AS chunk_id, l_returnflag AS quote, 1 AS turn, 'calculation' AS source FROM lineitem WHERE l_linenumber <= 2),
r AS (SELECT l_orderkey AS query_id, l_linenumber AS place, CAST(l_suppkey AS BIGINT) AS slide_id, CASE WHEN l_linenumber % 2 = 0 THEN 'e' || l_partkey ELSE '' END AS element_id, CAST(l_partkey AS BIGINT) AS chunk_id, l_returnflag AS quote, 2 AS turn, 'retrieval' AS source FROM lineitem WHERE l_linenumber <> 1),
k AS (SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM r) QUALIFY row_number() OVER (PARTITION BY query_id, slide_id, COALESCE(nullif(element_id, ''), chunk_id::VARCHAR), quote ORDER BY turn, place) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY turn, place, chunk_id, slide_id, quote) AS INTEGER) AS place, slide_id, element_id, chunk_id, quote, source FROM k""")
def d6_merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of an order are calculated, all but the first retrieved."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").cast("long").alias("slide_id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("e"), "l_partkey")).otherwise("").alias("element_id"), F.col("l_partkey").cast("long").alias("chunk_id"), F.col("l_returnflag").alias("quote"))
    return planning.merge_evidence(lines.filter("place <= 2"), lines.filter("place <> 1"))


@query(f"""WITH {_BM25}, x AS (SELECT item_id AS query_id, lower(unnest(list_filter(list_distinct(string_split(text, ' ')), lambda w: length(w) >= 9))) AS term FROM benchmark), y AS (SELECT DISTINCT query_id, term FROM x),
h AS (SELECT y.query_id, term, COALESCE(bool_or(contains(lower(d.text), term)), false) AS held FROM y LEFT JOIN (SELECT * FROM bm WHERE rank <= 5) b USING (query_id) LEFT JOIN documents d ON d.doc_id = b.chunk_id GROUP BY ALL), q AS (SELECT query_id, bool_and(held) AS hit FROM h GROUP BY 1) SELECT count(*) AS n_queries, avg(hit::INT) AS hit_rate FROM q""")
def a20_expected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long words of a benchmark text are expected in its first five documents."""
    chunks = _chunks(spark, sf_dir)
    words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.length(w) >= 9)
    expected = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(words).alias("term"))
    return planning.expected_terms_hit(search.bm25(chunks, _queries(spark, sf_dir), 24), chunks, expected, 5)


def _bridge_rows() -> str:
    """The vocabularies as rows: words, kind, weight, bridge_no, han, turn, lane."""
    bridges = [(w, t, "vocabulary_bridge", 1.0) for w, t in planning.FIELD_WORDS] + [(w, t, "paraphrase_bridge", 1.05) for w, t in planning.PARAPHRASES]
    return ", ".join(f"('{'|'.join(words)}', '{kind}', {weight}, {n}, {str(han).lower()}, {turn}, '{lane}')" for n, (words, text, kind, weight) in enumerate(bridges) for han in (True, False) for turn, lane in enumerate(planning.bridge_lanes(text, han)))


_FOCUS = "'" + "','".join(planning.FOCUS_STOPWORDS) + "'"


@query(rf"""WITH q AS (SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN 'What is the revenue growth of ' || c_mktsegment || '?' WHEN 1 THEN c_mktsegment || '的风险和利润率变化如何' WHEN 2 THEN 'Summarize  performance, risk and margin with ' || c_name WHEN 3 THEN 'revenue' ELSE NULL END AS text FROM customer),
b AS (SELECT * FROM (VALUES {_bridge_rows()}) v(words, kind, weight, bridge_no, han, turn, lane)),
t AS (SELECT question_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM q WHERE text IS NOT NULL),
f AS (SELECT question_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9%_-]{{2,}}|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda w: NOT list_contains([{_FOCUS}], lower(w))), ' ') AS text FROM t),
v AS (SELECT question_id, 0 AS a, 0 AS b, text, 'literal' AS kind, 1.35 AS weight FROM t UNION ALL SELECT question_id, 1, 0, text, 'language_focus', 1.1 FROM f UNION ALL SELECT question_id, 2 + turn, bridge_no, lane, kind, weight FROM t JOIN b ON han = regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') AND regexp_matches(lower(text), words)
  UNION ALL SELECT question_id, 99, 0, 'Segment ' || (question_id % 3), 'document_terminology', 1.1 FROM t WHERE question_id % 2 = 0),
d AS (SELECT * FROM v WHERE text <> '' AND length(text) <= 300 QUALIFY row_number() OVER (PARTITION BY question_id, lower(text) ORDER BY a, b) = 1)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY a, b) AS INTEGER) AS variant_no, text, kind, CAST(weight AS DOUBLE) AS weight FROM d QUALIFY variant_no <= 14""")
def r19_query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of customers about their segment; every other one has names of a term."""
    customers, kind = spread(table(spark, sf_dir, "customer"), "c_custkey"), F.col("c_custkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("What is the revenue growth of "), "c_mktsegment", F.lit("?"))).when(kind == 1, F.concat("c_mktsegment", F.lit("的风险和利润率变化如何"))).when(kind == 2, F.concat(F.lit("Summarize  performance, risk and margin with "), "c_name")).when(kind == 3, "revenue")
    names = customers.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Segment "), (F.col("c_custkey") % 3).cast("string")).alias("text"))
    return planning.query_variants(customers.select(F.col("c_custkey").alias("question_id"), text.alias("text")), names)
