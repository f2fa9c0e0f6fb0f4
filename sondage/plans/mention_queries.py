"""Mentions: phrases of the benchmark in whole documents, terms of part questions, chart scopes of document lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import normal_key
from sondage.operators import mentions
from sondage.sources.bindings import YEARLY_SQL, spread, table, yearly_points

from .registry import query
from .search_queries import _STOP


@query(r"""WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), l AS (SELECT DISTINCT trim(w[i] || ' ' || w[i + 1]) AS label FROM w, unnest(range(1, len(w), 7)) AS u(i) WHERE i < len(w)),
k AS (SELECT label, regexp_matches(label, '^[a-z0-9][a-z0-9 .&/-]*$') AS b FROM l WHERE label <> ''), d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT label, doc_id AS chunk_id FROM k JOIN d ON contains(t, label) WHERE NOT b OR regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(label) || '($|[^a-z0-9])')""")
def j9_mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh pair of neighbouring words of each benchmark text, as a dictionary."""
    pair = F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: i % 7 == 0), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))
    words = table(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), " ").alias("w")).filter("size(w) > 1")
    labels = words.select(F.explode(pair).alias("label")).select(F.trim("label").alias("label")).distinct().select(F.col("label").alias("label_id"), "label")
    texts = spread(table(spark, sf_dir, "documents"), "doc_id", 2000).select(F.col("doc_id").alias("text_id"), "text")
    return mentions.mention_join(labels, texts).select(F.col("label_id").alias("label"), F.col("text_id").alias("chunk_id"))


_MARKERS = "(?:" + "|".join(mentions.DEFINITION_MARKERS) + ")"


@query(rf"""WITH q AS (SELECT p_partkey AS text_id, lower(CASE p_partkey % 4 WHEN 0 THEN 'What is a ' || p_name || '?' WHEN 1 THEN p_name || ': what does it do' WHEN 2 THEN 'Explain ' || p_name || ' of ' || p_brand ELSE 'Price of ' || p_name END) AS text FROM part),
g AS (SELECT DISTINCT 'T' || length(p_name) AS term, p_name AS alias FROM part UNION SELECT DISTINCT upper(p_brand), p_brand FROM part),
m AS (SELECT text_id, term, alias, regexp_extract(text, '^(.*?(?:^|[^a-z0-9]))' || regexp_escape(lower(alias)) || '(?:$|[^a-z0-9])', 1) AS pre, text FROM q JOIN g ON contains(text, lower(alias)) WHERE regexp_matches(text, '(^|[^a-z0-9])' || regexp_escape(lower(alias)) || '($|[^a-z0-9])') AND regexp_matches(text, '{_MARKERS}')),
s AS (SELECT text_id, term, length(alias) + CASE WHEN length(pre) <= 2 THEN 50 ELSE 0 END + CASE WHEN regexp_matches(pre, '{_MARKERS}[一下这个该\s]*$') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(substr(text, length(pre) + length(alias) + 1), '^[的在是指为叫做\s]*{_MARKERS}') THEN 30 ELSE 0 END AS score FROM m),
b AS (SELECT text_id, term, max(score) AS score FROM s GROUP BY ALL) SELECT text_id, term, CAST(score AS INTEGER) AS score FROM b WHERE score >= 30 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, term) = 1""")
def x25_find_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about parts; the glossary has a term for each length of part names and one for each brand."""
    parts = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("What is a "), "p_name", F.lit("?"))).when(kind == 1, F.concat("p_name", F.lit(": what does it do"))).when(kind == 2, F.concat(F.lit("Explain "), "p_name", F.lit(" of "), "p_brand")).otherwise(F.concat(F.lit("Price of "), "p_name"))
    glossary = parts.select(F.concat(F.lit("T"), F.length("p_name").cast("string")).alias("term"), F.col("p_name").alias("alias")).union(parts.select(F.upper("p_brand"), "p_brand")).distinct()
    return mentions.find_terms(glossary, parts.select(F.col("p_partkey").alias("text_id"), text.alias("text")))


@query(rf"""WITH {YEARLY_SQL}, q AS (SELECT o_orderkey AS question_id, 'Revenue of ' || c_mktsegment || ' in FY' || (year(o_orderdate) + 24) || ' for ' || r_name AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 20 = 0),
k AS (SELECT *, lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS key FROM q),
l AS (SELECT DISTINCT scope_id, 'series' AS kind, lower(series_name) AS label FROM points UNION SELECT DISTINCT scope_id, 'category', lower(category) FROM points),
t AS (SELECT DISTINCT scope_id, 1 AS title_no, 'Revenue of ' || scope_id AS title FROM points UNION SELECT DISTINCT scope_id, 2, scope_id FROM points),
a AS (SELECT question_id, scope_id, 8 * count(*) AS points FROM k JOIN l ON contains(key, label) GROUP BY ALL UNION ALL SELECT question_id, scope_id, 2 * count(*) FROM k JOIN t ON contains(key, lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]+', '', 'g'))) GROUP BY ALL
  UNION ALL SELECT question_id, scope_id, 2 * least(4, len(list_filter(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), regexp_extract_all(lower(title), '[a-z0-9_]{{2,}}')), lambda y: NOT list_contains({_STOP}, y)))) FROM k, t)
SELECT question_id, scope_id, CAST(sum(points) AS BIGINT) AS relevance FROM a GROUP BY ALL HAVING sum(points) > 0""")
def r18_cube_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions: every twentieth order's segment, year and region; scopes are the regions' charts."""
    points = yearly_points(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    text = F.concat(F.lit("Revenue of "), "c_mktsegment", F.lit(" in FY"), (F.year("o_orderdate") + 24).cast("string"), F.lit(" for "), "r_name")
    questions = rows.select(F.col("o_orderkey").alias("question_id"), text.alias("text"), normal_key(text).alias("key"))
    label = lambda kind, c: points.select("scope_id", F.lit(kind).alias("kind"), F.lower(c).alias("label")).distinct()
    scopes = points.select("scope_id").distinct()
    titles = scopes.select("scope_id", F.lit(1).alias("title_no"), F.concat(F.lit("Revenue of "), "scope_id").alias("title")).union(scopes.select("scope_id", F.lit(2), "scope_id"))
    return mentions.cube_relevance(label("series", "series_name").union(label("category", "category")), titles, questions)
