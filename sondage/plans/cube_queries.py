"""Chart-point calculations over revenue by region, segment and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import cubes, layout
from sondage.sources.bindings import MONTHLY_SQL, QUARTERLY_SQL, YEARLY_SQL, monthly_points, quarterly_points, yearly_points

from .registry import query

_TEMPORAL = r"regexp_matches(trim(category), '^(?:(?:FY|CY)?20\d{2}[AEF]?|\d{2,4}[/.-]\d{1,2}|Q[1-4][ -]?(?:20)?\d{2}|(?:20)?\d{2}[ -]?Q[1-4])$', 'i')"


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


@query(f"""WITH {QUARTERLY_SQL} SELECT scope_id, series_name, category, CAST(point_order AS BIGINT) AS point_order, round(y_value, 4) AS y_value FROM points""")
def s2_chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quarterly_points(spark, sf_dir))


@query(f"""WITH {QUARTERLY_SQL}, r AS (SELECT *, lag(y_value) OVER w AS p, lag(category) OVER w AS pc, row_number() OVER (PARTITION BY scope_id, series_name ORDER BY point_order DESC) AS rn
FROM points WINDOW w AS (PARTITION BY scope_id, series_name ORDER BY point_order))
SELECT scope_id, series_name, pc AS start_category, category AS end_category, round(y_value - p, 4) AS change, round((y_value - p) / nullif(abs(p), 0) * 100, 4) AS change_pct FROM r WHERE rn = 1 AND p IS NOT NULL""")
def w3_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.period_change(quarterly_points(spark, sf_dir)))


@query(f"""WITH {MONTHLY_SQL}, c AS (SELECT *, point_order AS o, substr(category, 1, 4)::INT AS y, substr(category, 6) AS s FROM points),
t AS (SELECT *, max(y) OVER (PARTITION BY scope_id, series_name) AS top FROM c),
p AS (SELECT t.*, b.y_value AS bv, b.category AS bc, row_number() OVER (PARTITION BY t.scope_id, t.series_name ORDER BY t.o DESC) AS rn FROM t JOIN c b ON t.scope_id = b.scope_id AND t.series_name = b.series_name AND t.y = b.y + 1 AND t.s = b.s WHERE t.y = t.top)
SELECT scope_id, series_name, bc AS base_category, category AS target_category, round(y_value - bv, 4) AS change, round((y_value - bv) / nullif(abs(bv), 0) * 100, 4) AS change_pct FROM p WHERE rn = 1""")
def w4_yoy_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.yoy_pair(monthly_points(spark, sf_dir)))


_SUMMARY = f"""n AS (SELECT *, row_number() OVER u AS nth, row_number() OVER d AS back, lag(y_value) OVER u AS bef, lag(y_value, 12) OVER u AS yb FROM points
  WINDOW u AS (PARTITION BY scope_id, series_name ORDER BY point_order, category), d AS (PARTITION BY scope_id, series_name ORDER BY point_order DESC, category DESC)),
f AS (SELECT *, max(CASE WHEN bef IS NULL OR y_value >= bef THEN 1 ELSE 0 END) OVER (PARTITION BY scope_id, series_name ORDER BY point_order DESC, category DESC) AS rises FROM n),
g AS (SELECT scope_id, series_name, count(*) AS n, count(*) FILTER ({_TEMPORAL}) AS nt, arg_min(y_value, nth) AS start_value, arg_max(y_value, nth) AS latest_value, min(y_value) AS min_value, max(y_value) AS max_value,
  max(CASE WHEN back = 1 THEN yb END) AS yb, avg(CASE WHEN back <= 3 THEN y_value END) AS r3, avg(CASE WHEN back BETWEEN 4 AND 6 THEN y_value END) AS e3, count(*) FILTER (rises = 0) AS falls FROM f GROUP BY ALL HAVING count(*) >= 2),
h AS (SELECT g.*, (SELECT arg_min(f.category, f.nth) FROM f WHERE f.scope_id = g.scope_id AND f.series_name = g.series_name AND f.y_value = g.min_value) AS min_category,
  (SELECT arg_min(f.category, f.nth) FROM f WHERE f.scope_id = g.scope_id AND f.series_name = g.series_name AND f.y_value = g.max_value) AS max_category,
  (SELECT min(f.nth) FROM f WHERE f.scope_id = g.scope_id AND f.series_name = g.series_name AND f.y_value = g.max_value) AS max_nth, nt >= greatest(2, ceil(0.7 * n)) AS temporal FROM g),
summary AS (SELECT scope_id, series_name, n, start_value, latest_value, (latest_value - start_value) / nullif(abs(start_value), 0) * 100 AS total_change_pct, min_value, min_category, max_value, max_category, temporal,
  CASE WHEN temporal THEN (latest_value - max_value) / nullif(abs(max_value), 0) * 100 END AS drawdown_pct, CASE WHEN temporal THEN n - max_nth END AS periods_since_max,
  CASE WHEN temporal AND n >= 13 THEN (latest_value - yb) / nullif(abs(yb), 0) * 100 END AS yoy_pct, CASE WHEN temporal AND n >= 6 THEN (r3 - e3) / nullif(abs(e3), 0) * 100 END AS recent_change_pct, CASE WHEN temporal THEN falls ELSE 0 END AS trailing_declines FROM h)"""


@query(f"""WITH {MONTHLY_SQL}, {_SUMMARY} SELECT scope_id, series_name, n, round(start_value, 4) AS start_value, round(latest_value, 4) AS latest_value, round(total_change_pct, 4) AS total_change_pct, round(min_value, 4) AS min_value, min_category,
round(max_value, 4) AS max_value, max_category, temporal, round(drawdown_pct, 4) AS drawdown_pct, periods_since_max, round(yoy_pct, 4) AS yoy_pct, round(recent_change_pct, 4) AS recent_change_pct, trailing_declines FROM summary""")
def w12_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.series_summary(monthly_points(spark, sf_dir)))


@query(f"""WITH {QUARTERLY_SQL}, s AS (SELECT *, y_value - lag(y_value) OVER w AS step, row_number() OVER w AS nth FROM points WINDOW w AS (PARTITION BY scope_id, series_name ORDER BY point_order, category)),
k AS (SELECT *, row_number() OVER (PARTITION BY scope_id, series_name ORDER BY step, nth) AS lo, row_number() OVER (PARTITION BY scope_id, series_name ORDER BY step DESC, nth) AS hi FROM s WHERE step IS NOT NULL)
SELECT scope_id, series_name, count(*) AS steps, round(CAST(sum(CAST(step AS DECIMAL(28,4))) AS DOUBLE), 4) AS net_change, max(CASE WHEN lo = 1 AND step < 0 THEN category END) AS fall_category, round(max(CASE WHEN lo = 1 AND step < 0 THEN step END), 4) AS fall,
max(CASE WHEN hi = 1 AND step > 0 THEN category END) AS rise_category, round(max(CASE WHEN hi = 1 AND step > 0 THEN step END), 4) AS rise FROM k GROUP BY ALL""")
def w11_path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.path_steps(quarterly_points(spark, sf_dir)))


@query(f"""WITH {YEARLY_SQL}, d AS (SELECT b.scope_id, b.category, t.y_value - b.y_value AS change FROM points b JOIN points t ON b.scope_id = t.scope_id AND b.category = t.category WHERE b.series_name = 'FY2023' AND t.series_name = 'FY2024'),
n AS (SELECT *, SUM(change) OVER (PARTITION BY scope_id) AS net, COUNT(*) OVER (PARTITION BY scope_id) AS k FROM d), p AS (SELECT *, change / net * 100 AS share FROM n WHERE net > 0 AND k >= 2),
q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY scope_id ORDER BY change DESC, category) AS rn, COALESCE(SUM(share) OVER (PARTITION BY scope_id ORDER BY change DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_share FROM p)
SELECT scope_id, category, round(change, 2) AS change, round(net, 2) AS net, round(share, 2) AS share, (change > 0 AND rn <= 3 AND before_share < 80) AS is_primary FROM q""")
def w14_group_change_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.group_change_attribution(yearly_points(spark, sf_dir), "FY2023", "FY2024"), 2)


_COMMON = f"""t AS (SELECT scope_id, category, min(point_order) AS point_order, CAST(sum(CAST(y_value AS DECIMAL(28,4))) AS DOUBLE) AS total, count(DISTINCT series_name) AS ns FROM points GROUP BY ALL),
a AS (SELECT t.*, (SELECT count(DISTINCT p.series_name) FROM points p WHERE p.scope_id = t.scope_id) AS n_series FROM t), b AS (SELECT *, count(*) OVER (PARTITION BY scope_id) AS k, count(*) FILTER ({_TEMPORAL}) OVER (PARTITION BY scope_id) AS tt FROM a WHERE ns = n_series AND n_series >= 2),
common AS (SELECT scope_id, category, point_order, total FROM b WHERE k >= 2 AND tt >= 0.7 * k)"""


@query(f"WITH {MONTHLY_SQL}, {_COMMON} SELECT scope_id, category, CAST(point_order AS BIGINT) AS point_order, round(total, 4) AS total FROM common")
def a12_common_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.common_totals(monthly_points(spark, sf_dir)))


@query(f"""WITH {MONTHLY_SQL}, {_COMMON}, l AS (SELECT * FROM common QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY point_order DESC) = 1)
SELECT p.scope_id, p.series_name, p.category, round(coalesce(p.y_value / nullif(l.total, 0) * 100, 0), 4) AS share_pct FROM points p JOIN l ON p.scope_id = l.scope_id AND p.category = l.category""")
def a13_latest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.latest_share(monthly_points(spark, sf_dir)))


_TOTALS = """tot AS (SELECT *, CAST(sum(CAST(y_value AS DECIMAL(28,4))) OVER (PARTITION BY scope_id, series_name) AS DOUBLE) AS total, row_number() OVER (PARTITION BY scope_id, series_name ORDER BY y_value DESC, point_order) AS rn FROM points)"""


@query(f"WITH {YEARLY_SQL}, {_TOTALS} SELECT scope_id, series_name, category, round(y_value, 4) AS y_value, round(total, 4) AS total, round(y_value / nullif(total, 0) * 100, 4) AS share_pct, rn = 1 AS is_largest, abs(total - 100) <= 2 AS percent_scale FROM tot")
def a10_share_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.share_composition(yearly_points(spark, sf_dir)))


@query(f"WITH {YEARLY_SQL}, {_TOTALS} SELECT scope_id, series_name, category, round(total - y_value, 4) AS rest, round((total - y_value) / nullif(total, 0) * 100, 4) AS rest_pct FROM tot")
def a11_share_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.share_complement(yearly_points(spark, sf_dir)))


@query(f"WITH {MONTHLY_SQL} SELECT scope_id, count(DISTINCT series_name) AS series_count, count(DISTINCT category) AS category_count, count(y_value) AS point_count, count(DISTINCT series_name) AS entity_count FROM points GROUP BY scope_id")
def a21_cube_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.cube_shape(monthly_points(spark, sf_dir))


@query(f"""WITH {QUARTERLY_SQL} SELECT a.scope_id, a.category, CASE WHEN a.y_value > b.y_value THEN 'BUILDING' WHEN b.y_value > a.y_value THEN 'MACHINERY' END AS higher_series, round(abs(a.y_value - b.y_value), 4) AS difference
FROM points a JOIN points b USING (scope_id, category) WHERE a.series_name = 'BUILDING' AND b.series_name = 'MACHINERY'""")
def c4_compare_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.compare_series(quarterly_points(spark, sf_dir), "BUILDING", "MACHINERY"))


@query(f"""WITH {YEARLY_SQL} SELECT a.scope_id, a.category, round(b.y_value - a.y_value, 4) AS change, round((b.y_value - a.y_value) / nullif(abs(a.y_value), 0) * 100, 4) AS change_pct
FROM points a JOIN points b USING (scope_id, category) WHERE a.series_name = 'FY2020' AND b.series_name = 'FY2022'""")
def c5_cross_dimension_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.cross_dimension_change(yearly_points(spark, sf_dir), "FY2020", "FY2022"))


@query(f"""WITH {QUARTERLY_SQL} SELECT scope_id, series_name, category, round(y_value, 4) AS y_value FROM points WHERE (series_name, category) IN (('BUILDING', '2020Q1'), ('FURNITURE', '2021Q4'))""")
def c3_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("building", "2020 q1"), ("Furniture", "2021-Q4")], "series_name string, category string")
    return _rounded(cubes.point_lookup(quarterly_points(spark, sf_dir), wanted))


@query(f"""WITH {MONTHLY_SQL}, {_SUMMARY}, {_COMMON}, ct AS (SELECT scope_id, total, row_number() OVER (PARTITION BY scope_id ORDER BY point_order DESC) AS back, count(*) OVER (PARTITION BY scope_id) AS k FROM common),
r AS (SELECT scope_id, avg(CASE WHEN back <= 3 THEN total END) AS r3, avg(CASE WHEN back BETWEEN 4 AND 6 THEN total END) AS e3 FROM ct WHERE k >= 6 GROUP BY scope_id),
w AS (SELECT scope_id, string_agg(series_name, ',' ORDER BY series_name) AS weak_series, count(*) AS n_weak FROM summary WHERE recent_change_pct < 0 OR (drawdown_pct <= -3 AND periods_since_max <= 5 AND trailing_declines >= 2) GROUP BY scope_id)
SELECT r.scope_id, round((r3 - e3) / nullif(abs(e3), 0) * 100, 4) AS total_recent_pct, weak_series, n_weak FROM r JOIN w ON r.scope_id = w.scope_id WHERE (r3 - e3) / nullif(abs(e3), 0) * 100 > 0""")
def w13_recent_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cubes.divergence(monthly_points(spark, sf_dir)))


#: Whole charts, each series as a chart of its own, and each series in percent of its total as another.
@query(f"""WITH {YEARLY_SQL}, t AS (SELECT *, CAST(sum(CAST(y_value AS DECIMAL(28,4))) OVER (PARTITION BY scope_id, series_name) AS DOUBLE) AS total FROM points),
p AS (SELECT scope_id, series_name, category, y_value FROM points UNION ALL SELECT scope_id || '/' || series_name, series_name, category, y_value FROM points UNION ALL SELECT scope_id || '%' || series_name, series_name, category, y_value / total * 100 FROM t),
g AS (SELECT scope_id, count(DISTINCT series_name) AS groups, count(*) AS n, count(DISTINCT series_name) = 1 AND count(*) >= 2 AND min(y_value) >= 0 AND abs(sum(CAST(y_value AS DECIMAL(28,4))) - 100) <= 2 AS is_share, count(*) FILTER ({_TEMPORAL}) AS nt FROM p GROUP BY scope_id),
o AS (SELECT *, groups = 1 AND NOT is_share AND n >= 3 AND nt < greatest(2, ceil(0.7 * n)) AS is_ordered_categorical FROM g), e AS (SELECT *, CASE WHEN groups > 1 THEN groups WHEN is_share OR is_ordered_categorical THEN n ELSE 1 END AS entity_count FROM o)
SELECT scope_id, is_share, is_ordered_categorical, entity_count, entity_count >= 2 AND n >= 2 AS is_analyzable FROM e""")
def c6_structure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = yearly_points(spark, sf_dir).drop("point_order")
    alone = points.withColumn("scope_id", F.concat_ws("/", "scope_id", "series_name"))
    total = points.groupBy("scope_id", "series_name").agg(F.sum(F.col("y_value").cast("decimal(28,4)")).cast("double").alias("total"))
    shares = points.join(total, ["scope_id", "series_name"]).select(F.concat_ws("%", "scope_id", "series_name").alias("scope_id"), "series_name", "category", (F.col("y_value") / F.col("total") * 100).alias("y_value"))
    return cubes.structure_flags(points.unionByName(alone).unionByName(shares))


@query(f"""WITH {QUARTERLY_SQL} SELECT scope_id, string_agg(DISTINCT series_name, '|' ORDER BY series_name) AS series, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, count(*) AS n_points FROM points GROUP BY scope_id""")
def c9_calculation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cubes.calculation_scope(quarterly_points(spark, sf_dir))


@query(f"""WITH {YEARLY_SQL}, l AS (SELECT scope_id, series_name, series_name || ' | axis unspecified | unit unspecified | ' || string_agg(category || '=' || CAST(CAST(y_value AS DECIMAL(28,4)) AS VARCHAR), '; ' ORDER BY point_order) AS line FROM points GROUP BY scope_id, series_name)
SELECT scope_id, scope_id || chr(10) || string_agg(line, chr(10) ORDER BY series_name) AS content FROM l GROUP BY scope_id""")
def a23_chart_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.chart_text(yearly_points(spark, sf_dir))


@query(f"WITH {YEARLY_SQL} SELECT scope_id, count(DISTINCT series_name) AS n_series, count(*) AS n_points FROM points GROUP BY 1")
def a22_nest_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = layout.nest_charts(yearly_points(spark, sf_dir))
    points = F.aggregate("series", F.lit(0).cast("long"), lambda n, s: n + F.size(s["points"]))
    return nested.select("scope_id", F.size("series").cast("long").alias("n_series"), points.alias("n_points"))


@query(f"""WITH {QUARTERLY_SQL} SELECT a.scope_id, a.series_name, a.category AS start_category, b.category AS end_category, round(b.y_value - a.y_value, 4) AS change, round((b.y_value - a.y_value) / nullif(abs(a.y_value), 0) * 100, 4) AS change_pct
FROM points a JOIN points b ON a.scope_id = b.scope_id AND a.series_name = b.series_name AND b.point_order = a.point_order + 3""")
def w3_change_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quarter against the third one after it, in small letters with a blank."""
    points = quarterly_points(spark, sf_dir)
    told = lambda c: F.lower(F.replace(c, F.lit("Q"), F.lit(" q")))
    later = points.select("scope_id", "series_name", (F.col("point_order") - 3).alias("point_order"), told(F.col("category")).alias("end_category"))
    pairs = points.select("scope_id", "series_name", "point_order", told(F.col("category")).alias("start_category")).join(later, ["scope_id", "series_name", "point_order"])
    return _rounded(cubes.change_between(points, pairs))


_UNIT = "CASE WHEN point_order % 3 = 0 THEN 'General' WHEN series_name = 'BUILDING' THEN 'US$' WHEN point_order % 3 = 1 THEN 'us $' ELSE 'EUR' END"


@query(f"""WITH {QUARTERLY_SQL}, u AS (SELECT *, {_UNIT} AS unit FROM points) SELECT a.scope_id, a.category, CASE WHEN a.y_value > b.y_value THEN 'BUILDING' WHEN b.y_value > a.y_value THEN 'MACHINERY' END AS higher_series, round(abs(a.y_value - b.y_value), 4) AS difference, CASE WHEN a.unit = 'General' THEN NULL WHEN a.y_value >= b.y_value THEN a.unit ELSE b.unit END AS unit
FROM u a JOIN u b USING (scope_id, category) WHERE a.series_name = 'BUILDING' AND b.series_name = 'MACHINERY' AND b.unit <> 'EUR'""")
def c4_compare_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by quarter: none said, one spelt two ways, two that differ."""
    third = F.col("point_order") % 3
    unit = F.when(third == 0, "General").when(F.col("series_name") == "BUILDING", "US$").when(third == 1, "us $").otherwise("EUR")
    return _rounded(cubes.compare_measured(quarterly_points(spark, sf_dir).withColumn("unit", unit), "BUILDING", "MACHINERY"))


@query(f"""WITH {QUARTERLY_SQL}, s AS (SELECT scope_id, series_name, min((point_order, series_name)) AS k FROM points GROUP BY ALL), c AS (SELECT scope_id, category, min(point_order) AS k FROM points GROUP BY ALL)
SELECT scope_id, (SELECT string_agg(DISTINCT series_name || ':e', '|' ORDER BY series_name || ':e') FROM points q WHERE q.scope_id = p.scope_id AND series_name <> 'BUILDING') AS element_ids, (SELECT string_agg(series_name, '|' ORDER BY k) FROM s WHERE s.scope_id = p.scope_id) AS series, (SELECT string_agg(category, '|' ORDER BY k) FROM c WHERE c.scope_id = p.scope_id) AS categories, min((point_order % 7 + 1) / 8.0::DOUBLE) AS confidence, count(*) AS n_points FROM points p GROUP BY scope_id""")
def c9_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are elements, but for one that has none."""
    points = quarterly_points(spark, sf_dir).withColumns({"element_id": F.when(F.col("series_name") != "BUILDING", F.concat("series_name", F.lit(":e"))), "confidence": (F.col("point_order") % 7 + 1) / F.lit(8.0)})
    found = cubes.calculation_provenance(points)
    return found.withColumns({c: F.array_join(c, "|") for c in ("element_ids", "series", "categories")})


@query(f"""WITH {MONTHLY_SQL.replace("points AS", "every_point AS")}, points AS (SELECT * FROM every_point WHERE scope_id <> 'AFRICA' AND (scope_id = 'ASIA' OR series_name <> 'MACHINERY')), {_COMMON}
SELECT scope_id, category, CAST(point_order AS BIGINT) AS point_order, round(total, 4) AS total FROM common""")
def a12_bar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars alone in two regions, stacked in one of these; bars beside a line in the others."""
    alone = F.col("scope_id").isin("AFRICA", "ASIA")
    kind = F.when(~alone & (F.col("series_name") == "MACHINERY"), "lineMarker").otherwise("barClustered")
    points = monthly_points(spark, sf_dir).withColumns({"chart_type": kind, "grouping": F.when(F.col("scope_id") == "ASIA", "percentStacked")})
    return _rounded(cubes.bar_totals(points))
