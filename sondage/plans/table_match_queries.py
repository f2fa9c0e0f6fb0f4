"""Requests of customers against tables of orders by nation and year, one table a region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.operators import table_match
from sondage.sources.bindings import table

from .cube_queries import _rounded
from .registry import query

_YEARS = (2022, 2023, 2024)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three years, the last year's share and a unit: a row per nation, and their total."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("table_id"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.year("o_orderdate") + 24).alias("year")).agg(F.count("*").alias("n")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(*(F.coalesce(F.sum(F.when(F.col("year") == y, F.col("n"))), F.lit(0)).alias(f"y{y}") for y in _YEARS))
    own = counts.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("table_id", F.col("n_name").alias("row_label"), *(f"y{y}" for y in _YEARS))
    own = own.withColumn("row_ix", F.row_number().over(Window.partitionBy("table_id").orderBy("row_label")).cast("long"))
    total = own.groupBy("table_id").agg(F.lit("合计").alias("row_label"), *(F.sum(f"y{y}").alias(f"y{y}") for y in _YEARS), (F.max("row_ix") + 1).alias("row_ix"))
    rows = own.unionByName(total).withColumn("all", F.max(f"y{_YEARS[-1]}").over(Window.partitionBy("table_id")))
    share = F.concat(F.call_function("div", 100 * F.col(f"y{_YEARS[-1]}"), F.greatest(F.col("all"), F.lit(1))).cast("string"), F.lit("%"))
    cell = lambda ix, header, raw: F.struct(F.lit(ix).cast("long").alias("col_ix"), F.lit(header).alias("header"), raw.alias("raw"))
    parts = [cell(k + 1, str(y), F.col(f"y{y}").cast("string")) for k, y in enumerate(_YEARS)]
    return rows.select("table_id", "row_ix", "row_label", F.explode(F.array(*parts, cell(4, "占比", share), cell(5, "单位", F.lit("单")))).alias("c")).select("table_id", "row_ix", "row_label", "c.*")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks about its nation, and a nation five on, in the table of its region."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("n"), F.col("r_name").alias("table_id"))
    other = nations.select(((F.col("n_nationkey") + 20) % 25).alias("n_nationkey"), F.col("n").alias("m"))
    names = F.broadcast(nations.join(F.broadcast(other), "n_nationkey"))
    t = lambda *parts: F.concat(*(F.col(p) if p in "nm" else F.lit(p) for p in parts))
    kinds = [t("n", "的2024是多少"), t("n", "和", "m", "的2024差多少"), t("n", "从2022到2024提高多少"), t("n", "占合计的比例，2024"), t("n", "的2023是", "m", "的多少倍"), t("表中", "n", "及", "m", "的占比变化了多少，合计是否达标")]
    question = kinds[-1]
    for k, text in enumerate(kinds[:-1]):
        question = F.when(F.col("c_custkey") % 6 == k, text).otherwise(question)
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("request_id"), "table_id", question.alias("question"))


_CELLS = """places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cnt AS (SELECT r_name AS table_id, n_name AS row_label, count(*) FILTER (year(o_orderdate) = 1998) AS a, count(*) FILTER (year(o_orderdate) = 1999) AS b, count(*) FILTER (year(o_orderdate) = 2000) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_label) AS row_ix FROM cnt),
rws AS (SELECT table_id, row_label, row_ix, a, b, c FROM num UNION ALL SELECT table_id, '合计', max(row_ix) + 1, CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT) FROM num GROUP BY table_id),
cells AS (SELECT table_id, row_ix, row_label, u.x.col_ix AS col_ix, u.x.header AS header, u.x.raw AS raw FROM (SELECT *, max(c) OVER (PARTITION BY table_id) AS tot FROM rws) r, unnest([{'col_ix': 1, 'header': '2022', 'raw': CAST(a AS VARCHAR)}, {'col_ix': 2, 'header': '2023', 'raw': CAST(b AS VARCHAR)}, {'col_ix': 3, 'header': '2024', 'raw': CAST(c AS VARCHAR)}, {'col_ix': 4, 'header': '占比', 'raw': CAST(100 * c // greatest(tot, 1) AS VARCHAR) || '%'}, {'col_ix': 5, 'header': '单位', 'raw': '单'}]) AS u(x))"""
_ASKED = """asked AS (SELECT c_custkey AS request_id, p.r_name AS table_id, CASE c_custkey % 6 WHEN 0 THEN p.n_name || '的2024是多少' WHEN 1 THEN p.n_name || '和' || o.n_name || '的2024差多少' WHEN 2 THEN p.n_name || '从2022到2024提高多少' WHEN 3 THEN p.n_name || '占合计的比例，2024' WHEN 4 THEN p.n_name || '的2023是' || o.n_name || '的多少倍'
  ELSE '表中' || p.n_name || '及' || o.n_name || '的占比变化了多少，合计是否达标' END AS question FROM customer JOIN places p ON c_nationkey = p.n_nationkey JOIN places o ON o.n_nationkey = (c_nationkey + 5) % 25)"""
#: Labels of nations are ASCII: a row is named where its key is not followed by a letter or digit; columns by header, year, or the words of change.
_NAMED = r"""keyed AS (SELECT *, regexp_replace(lower(question), '[^a-z0-9%\x{4e00}-\x{9fff}]', '', 'g') AS k FROM asked),
lab AS (SELECT DISTINCT table_id, row_ix, row_label, regexp_replace(lower(row_label), '[^a-z0-9%\x{4e00}-\x{9fff}]', '', 'g') AS rk FROM cells),
mrows AS (SELECT request_id, table_id, row_ix, row_label, strpos(lower(question), lower(row_label)) AS place FROM keyed JOIN lab USING (table_id) WHERE contains(k, rk) AND NOT (regexp_full_match(rk, '[\x00-\x7f]*') AND regexp_matches(substr(k, strpos(k, rk) + length(rk), 1), '[a-z0-9]'))),
heads AS (SELECT DISTINCT table_id, col_ix, header FROM cells),
mcols AS (SELECT request_id, table_id, col_ix, header FROM keyed JOIN heads USING (table_id) WHERE contains(k, header))"""
_ALL = f"WITH {_CELLS}, {_ASKED}, {_NAMED}"
_SIDES = ", rr AS (SELECT request_id, count(*) AS n, arg_min(row_ix, row_ix) AS first_row, list(row_ix ORDER BY place, row_ix) AS told FROM mrows GROUP BY request_id), cc AS (SELECT request_id, list(col_ix ORDER BY col_ix) AS cols, list(header ORDER BY col_ix) AS hs FROM mcols WHERE header <> '单位' GROUP BY request_id), j AS (SELECT * FROM asked JOIN rr USING (request_id) JOIN cc USING (request_id))"


@query(f"{_ALL} SELECT request_id, table_id, 'row' AS kind, row_label AS name, CAST(place AS INTEGER) AS place FROM mrows UNION ALL SELECT request_id, table_id, 'column', header, NULL FROM mcols")
def t3_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, cells = _asked(spark, sf_dir), _cells(spark, sf_dir)
    rows = table_match.match_rows(asked, cells).select("request_id", "table_id", F.lit("row").alias("kind"), F.col("row_label").alias("name"), "place")
    return rows.unionByName(table_match.match_columns(asked, cells).select("request_id", "table_id", F.lit("column").alias("kind"), F.col("header").alias("name"), F.lit(None).cast("int").alias("place")))


@query(f"""{_ALL}, r AS (SELECT request_id, count(*) AS n FROM mrows GROUP BY 1), c AS (SELECT request_id, count(*) AS n FROM mcols GROUP BY 1)
SELECT a.request_id, a.table_id, CAST(4 * coalesce(r.n, 0) + 3 * coalesce(c.n, 0) + CASE WHEN contains(question, '表') THEN 2 ELSE 0 END + CASE WHEN contains(question, '合计') THEN 2 ELSE 0 END AS BIGINT) AS relevance FROM asked a LEFT JOIN r USING (request_id) LEFT JOIN c USING (request_id) WHERE a.table_id IN (SELECT table_id FROM cells)""")
def t4_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    texts = table_match.table_texts(_grid(cells), cells.select("table_id", F.lit("").alias("sha256")).distinct())
    return table_match.relevance(_asked(spark, sf_dir), cells, texts.select("table_id", F.lit("国别").alias("corner"), F.lit("table").alias("chunk_type"), "content"))


def _grid(cells: DataFrame) -> DataFrame:
    """Cells with the header as row 0 and the labels as column 0."""
    labels = cells.select("table_id", "row_ix", F.lit(0).cast("long").alias("col_ix"), F.col("row_label").alias("raw")).distinct()
    heads = cells.select("table_id", F.lit(0).cast("long").alias("row_ix"), "col_ix", F.col("header").alias("raw")).distinct()
    corner = cells.select("table_id", F.lit(0).cast("long").alias("row_ix"), F.lit(0).cast("long").alias("col_ix"), F.lit("国别").alias("raw")).distinct()
    return cells.select("table_id", "row_ix", "col_ix", "raw").unionByName(labels).unionByName(heads).unionByName(corner)


@query(f"""WITH {_CELLS}, l AS (SELECT table_id, row_ix, row_label || ' | ' || string_agg(raw, ' | ' ORDER BY col_ix) AS line FROM cells GROUP BY table_id, row_ix, row_label UNION ALL SELECT DISTINCT table_id, 0, '国别 | 2022 | 2023 | 2024 | 占比 | 单位' FROM cells),
t AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row_ix) AS content FROM l GROUP BY table_id) SELECT table_id, content, sha256(content) AS sha256, table_id <> (SELECT min(table_id) FROM t) AS changed FROM t""")
def t2_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first region's text is known, the last one's has another hash, the others none."""
    grid = _grid(_cells(spark, sf_dir))
    ends = grid.agg(F.min("table_id").alias("first"), F.max("table_id").alias("last"))
    none = table_match.table_texts(grid, grid.select("table_id", F.lit("").alias("sha256")).limit(0))
    known = none.join(F.broadcast(ends)).filter("table_id in (first, last)").select("table_id", F.when(F.col("table_id") == F.col("first"), F.col("sha256")).otherwise("other").alias("sha256"))
    return table_match.table_texts(grid, known)


@query(f"""{_ALL}{_SIDES} SELECT request_id, j.table_id, row_label, header, CASE WHEN contains(raw, '%') THEN raw ELSE raw || ' 单' END AS value FROM j JOIN cells c ON c.table_id = j.table_id AND c.row_ix = j.first_row AND list_contains(j.cols, c.col_ix) WHERE n = 1""")
def t5_asked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_match.asked_values(_asked(spark, sf_dir), _cells(spark, sf_dir))


@query(f"""{_ALL}{_SIDES}, v AS (SELECT table_id, row_ix, col_ix, row_label, header, raw, TRY_CAST(replace(raw, '%', '') AS DOUBLE) AS v FROM cells WHERE header <> '单位'), q AS (SELECT * FROM j WHERE regexp_matches(question, '提高|差多少|变化了多少'))
SELECT request_id, q.table_id, a.row_label AS first, b.row_label AS second, a.v - b.v AS difference, false AS points FROM q JOIN v a ON a.table_id = q.table_id AND a.row_ix = told[1] AND a.col_ix = cols[1] JOIN v b ON b.table_id = q.table_id AND b.row_ix = told[2] AND b.col_ix = cols[1] WHERE n >= 2
UNION ALL SELECT request_id, q.table_id, a.header, b.header, b.v - a.v, false FROM q JOIN v a ON a.table_id = q.table_id AND a.row_ix = first_row AND a.header = '2022' JOIN v b ON b.table_id = q.table_id AND b.row_ix = first_row AND b.header = '2024' WHERE n = 1 AND len(hs) >= 2""")
def t6_asked_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table_match.asked_differences(_asked(spark, sf_dir), _cells(spark, sf_dir)))


@query(f"""{_ALL}{_SIDES}, v AS (SELECT table_id, row_ix, col_ix, row_label, header, TRY_CAST(replace(raw, '%', '') AS DOUBLE) AS v FROM cells WHERE header <> '单位'), q AS (SELECT *, CASE WHEN contains(question, '占') THEN 'share' ELSE 'multiple' END AS kind FROM j WHERE contains(question, '占') OR (contains(question, '多少倍') AND n >= 2)),
s AS (SELECT q.*, CASE WHEN kind = 'share' THEN first_row ELSE told[1] END AS ra, CASE WHEN kind = 'share' THEN (SELECT max(row_ix) FROM rws WHERE rws.table_id = q.table_id) ELSE told[2] END AS rb FROM q WHERE NOT (contains(question, '占比') AND len(cols) >= 2))
SELECT request_id, s.table_id, a.row_label AS first, b.row_label AS second, a.header, CASE WHEN kind = 'share' THEN round(a.v / b.v * 100, 1) ELSE round(a.v / b.v, 2) END AS ratio, kind FROM s JOIN v a ON a.table_id = s.table_id AND a.row_ix = ra AND a.col_ix = cols[1] JOIN v b ON b.table_id = s.table_id AND b.row_ix = rb AND b.col_ix = cols[1] WHERE b.v <> 0""")
def t7_asked_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_match.asked_ratios(_asked(spark, sf_dir), _cells(spark, sf_dir))


@query(f"""WITH {_CELLS}, s AS (SELECT table_id, header, sum(CAST(CASE WHEN row_label < 'NATION_15' THEN replace(raw, '%', '') END AS DOUBLE)) AS part, max(CAST(CASE WHEN row_label = '合计' THEN replace(raw, '%', '') END AS DOUBLE)) AS total FROM cells WHERE header <> '单位' GROUP BY ALL)
SELECT s.table_id, s.header, s.part, s.total, round(s.part / nullif(s.total, 0) * 100, 4) AS share_pct, p.part AS stated_pct FROM s JOIN s p ON s.table_id = p.table_id AND p.header = '占比' WHERE s.header <> '占比' AND s.part IS NOT NULL""")
def a15_stated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table_match.stated_share(_cells(spark, sf_dir), F.col("row_label") < "NATION_15"))
