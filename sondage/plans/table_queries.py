"""Table calculations over customers and balances of nations by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.operators import tables
from sondage.sources.bindings import CELLS_SQL, cells

from .cube_queries import _rounded
from .registry import query


@query(f"WITH {CELLS_SQL} SELECT table_id, row_label, header, round(value, 4) AS value FROM cells WHERE NOT regexp_matches(row_label, 'total|合计|总计', 'i')")
def f7_without_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cells(spark, sf_dir).filter(~tables.is_total(F.col("row_label"))).select("table_id", "row_label", "header", "value"))


@query(f"WITH {CELLS_SQL} SELECT table_id, row_label, round(value, 4) AS value, row_number() OVER (PARTITION BY table_id ORDER BY value DESC, row_label) AS rank FROM cells WHERE header = 'acctbal' AND row_label <> 'Total' QUALIFY rank <= 3")
def r16_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.top_rows(cells(spark, sf_dir), "acctbal", 3))


_EAST, _WEST = ["NATION_0", "NATION_10", "NATION_15"], ["NATION_1", "NATION_11", "NATION_16"]


@query(f"WITH {CELLS_SQL} SELECT CASE WHEN row_label IN ('NATION_0','NATION_10','NATION_15') THEN 'east' ELSE 'west' END AS \"group\", table_id, header, round(CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE), 4) AS total, count(*) AS n_rows FROM cells WHERE row_label IN ('NATION_0','NATION_10','NATION_15','NATION_1','NATION_11','NATION_16') GROUP BY ALL")
def a14_group_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.group_total(cells(spark, sf_dir), {"east": _EAST, "west": _WEST}))


@query(f"""WITH {CELLS_SQL}, g AS (SELECT table_id, header, CAST(sum(CASE WHEN row_label IN ('NATION_0','NATION_10','NATION_15') THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) AS a, CAST(sum(CASE WHEN row_label IN ('NATION_20','NATION_5') THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) AS b FROM cells GROUP BY table_id, header)
SELECT table_id, header, round(a, 4) AS a, round(b, 4) AS b, round(a - b, 4) AS difference, round(round(a / nullif(b, 0), 2), 4) AS multiple FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def t9_compare_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of rows of one table."""
    return _rounded(tables.compare_groups(cells(spark, sf_dir), _EAST, ["NATION_20", "NATION_5"]))


@query(f"""WITH {CELLS_SQL}, t AS (SELECT table_id, header, max(value) AS total FROM cells WHERE row_label = 'Total' GROUP BY ALL)
SELECT c.table_id, c.header, round(CAST(sum(CASE WHEN row_label < 'NATION_15' THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE), 4) AS part, round(max(total), 4) AS total, round(CAST(sum(CASE WHEN row_label < 'NATION_15' THEN CAST(value AS DECIMAL(28,4)) END) AS DOUBLE) / nullif(max(total), 0) * 100, 4) AS share_pct
FROM cells c JOIN t ON c.table_id = t.table_id AND c.header = t.header WHERE row_label <> 'Total' GROUP BY ALL""")
def a15_total_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.total_share(cells(spark, sf_dir), F.col("row_label") < "NATION_15"))


@query(f"""WITH {CELLS_SQL} SELECT c.table_id, c.row_label, c.header, round(c.value / nullif(t.value, 0) * 100, 1) AS ratio_pct FROM cells c JOIN cells t ON c.table_id = t.table_id AND c.header = t.header AND t.row_label = 'Total' WHERE c.row_label <> 'Total'""")
def t7_ratio_to_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ratio_to_total(cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT table_id, row_label, header, round(value, 4) AS value FROM cells WHERE row_label IN ('NATION_7', 'NATION_20') AND header = 'customers'")
def t5_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.lookup(cells(spark, sf_dir), ["Nation_7", "NATION_20"], ["Customers"]))


@query(f"WITH {CELLS_SQL} SELECT a.table_id, a.header, round(a.value - b.value, 4) AS difference FROM cells a JOIN cells b ON a.table_id = b.table_id AND a.header = b.header WHERE a.row_label = 'NATION_0' AND b.row_label = 'NATION_10'")
def t6_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tables.difference(cells(spark, sf_dir), "NATION_0", "NATION_10"))


@query(f"""WITH {CELLS_SQL}, w AS (SELECT table_id, row_label, max(CASE WHEN col_ix = 1 THEN value END) AS c, max(CASE WHEN col_ix = 2 THEN value END) AS b FROM cells GROUP BY ALL)
SELECT table_id, row_label, 'customers' AS header, CAST(CAST(c AS BIGINT) AS VARCHAR) AS raw, CAST(c AS DOUBLE) AS value FROM w UNION ALL SELECT table_id, row_label, 'balance', CAST(CAST(floor(b) AS BIGINT) AS VARCHAR), CAST(floor(b) AS DOUBLE) FROM w""")
def t1_parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = cells(spark, sf_dir).groupBy("table_id", "row_label").agg(F.max(F.when(F.col("col_ix") == 1, F.col("value"))).cast("long").alias("c"), F.floor(F.max(F.when(F.col("col_ix") == 2, F.col("value")))).alias("b"))
    lines = F.array_join(F.concat(F.array(F.lit("nation | customers | balance")), F.collect_list(F.concat_ws(" | ", "row_label", F.col("c").cast("string"), F.col("b").cast("string")))), "\n")
    chunks = wide.groupBy(F.col("table_id").alias("chunk_id")).agg(lines.alias("content"))
    return tables.parse_tables(chunks).select("table_id", "row_label", "header", "raw", "value")


@query(f"""WITH {CELLS_SQL}, r AS (SELECT table_id, row_label, CAST(CAST(value AS BIGINT) AS VARCHAR) AS current, CASE WHEN row_label < 'NATION_15' THEN '>= 50' ELSE '<60%' END AS condition, CASE WHEN row_label < 'NATION_15' THEN value >= 50 ELSE value < 60 END AS passes FROM cells WHERE header = 'customers' AND row_label <> 'Total')
SELECT *, bool_and(passes) OVER (PARTITION BY table_id) AS all_pass FROM r""")
def t8_threshold_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).filter("header = 'customers' and row_label <> 'Total'").select("table_id", "row_label", F.col("value").cast("long").cast("string").alias("current"), F.when(F.col("row_label") < "NATION_15", ">= 50").otherwise("<60%").alias("condition"))
    return tables.threshold_check(rows)


#: In each region the second source folds the last two nations of the alphabet into one label.
@query(f"""WITH {CELLS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_label DESC) AS rn FROM cells WHERE header = 'customers' AND row_label <> 'Total')
SELECT table_id AS source_a, 'chart:' || table_id AS source_b, 'customers' AS metric_a, 'customers' AS metric_b, max(CASE WHEN rn = 2 THEN row_label END) AS target_label, max(CASE WHEN rn = 1 THEN row_label END) AS folded,
  round(sum(CASE WHEN rn <= 2 THEN value END), 4) AS target_value, round(max(CASE WHEN rn = 1 THEN value END), 4) AS folded_value FROM f GROUP BY table_id""")
def x_rec_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).filter("header = 'customers' and row_label <> 'Total'").select(F.col("table_id").alias("source"), F.col("header").alias("metric"), F.col("row_label").alias("label"), "value")
    w = Window.partitionBy("source").orderBy(F.desc("label"))
    folded = rows.withColumns({"rn": F.row_number().over(w), "next": F.lag("value").over(w)}).filter("rn > 1")
    charts = folded.select(F.concat(F.lit("chart:"), "source").alias("source"), "metric", "label", F.when(F.col("rn") == 2, F.col("value") + F.col("next")).otherwise(F.col("value")).alias("value"))
    return _rounded(tables.reconcile(rows, charts))
