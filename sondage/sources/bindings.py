"""The shared tables in the roles that the operators read: chart points, table cells, chunks, messages, runs, scores.

Each role comes as a DataFrame and as the text of a common table expression, for the SQL twins. Years are shifted by 24 so that labels are of this century; money is summed as decimal, so that sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, per_task: int = 20_000) -> DataFrame:
    """``rows`` of a table that become long ones, dealt by their key into tasks of so many: a small file is one task otherwise, whatever its rows grow to."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), key)  # the count comes from the files' footers


def _revenue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    places = nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"])  # 25 and 5 rows by definition
    buyers = customers.join(F.broadcast(places), customers["c_nationkey"] == places["n_nationkey"])
    # orders are summed before the joins: one row per order instead of one per line
    sums = lines.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    return sums.join(orders, sums["l_orderkey"] == orders["o_orderkey"]).join(buyers, F.col("o_custkey") == buyers["c_custkey"])


def _points(spark: SparkSession, sf_dir: str, series: Column, category: Column, order: Column) -> DataFrame:
    rows = _revenue_rows(spark, sf_dir).groupBy(F.col("r_name").alias("scope_id"), series.alias("series_name"), category.alias("category"), order.cast("int").alias("point_order"))
    return rows.agg(F.sum("revenue").cast("double").alias("y_value"))


def quarterly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.floor((F.col("month") + 2) / 3).cast("int")
    return _points(spark, sf_dir, F.col("c_mktsegment"), F.concat((F.col("year") + 24).cast("string"), F.lit("Q"), quarter.cast("string")), (F.col("year") - 1995) * 4 + quarter)


def monthly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, F.col("c_mktsegment"), F.concat((F.col("year") + 24).cast("string"), F.lit("/"), F.lpad(F.col("month").cast("string"), 2, "0")), (F.col("year") - 1995) * 12 + F.col("month"))


def yearly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are fiscal years, categories segments in alphabetical order."""
    rank = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    return _points(spark, sf_dir, F.concat(F.lit("FY"), (F.col("year") + 24).cast("string")), F.col("c_mktsegment"), rank)


#: Fixed values of the shared customer table.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

_REVENUE = """FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL"""
_SUM = "CAST(SUM(CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS y_value"
QUARTERLY_SQL = f"""points AS (SELECT r_name AS scope_id, c_mktsegment AS series_name, concat(year(o_orderdate) + 24, 'Q', quarter(o_orderdate)) AS category,
  CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS point_order, {_SUM} {_REVENUE})"""
MONTHLY_SQL = f"""points AS (SELECT r_name AS scope_id, c_mktsegment AS series_name, concat(year(o_orderdate) + 24, '/', lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')) AS category,
  CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INTEGER) AS point_order, {_SUM} {_REVENUE})"""
YEARLY_SQL = f"""points AS (SELECT r_name AS scope_id, concat('FY', year(o_orderdate) + 24) AS series_name, c_mktsegment AS category,
  CAST(list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) AS INTEGER) AS point_order, {_SUM} {_REVENUE})"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per region: a row per nation and a Total, columns customers and acctbal."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    places = nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("bal"))
    own = rows.join(F.broadcast(places), rows["c_nationkey"] == places["n_nationkey"]).select(F.col("r_name").alias("table_id"), F.col("n_name").alias("row_label"), "n", "bal")
    total = own.groupBy("table_id").agg(F.lit("Total").alias("row_label"), F.sum("n").alias("n"), F.sum("bal").alias("bal"))
    both = own.unionByName(total)
    pair = F.array(F.struct(F.lit(1).alias("col_ix"), F.lit("customers").alias("header"), F.col("n").cast("double").alias("value")), F.struct(F.lit(2).alias("col_ix"), F.lit("acctbal").alias("header"), F.col("bal").cast("double").alias("value")))
    return both.select("table_id", "row_label", F.explode(pair).alias("c")).select("table_id", "row_label", "c.*")


CELLS_SQL = """own AS (SELECT r_name AS table_id, n_name AS row_label, COUNT(*) AS n, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
both_rows AS (SELECT * FROM own UNION ALL SELECT table_id, 'Total', SUM(n), SUM(bal) FROM own GROUP BY table_id),
cells AS (SELECT table_id, row_label, 1 AS col_ix, 'customers' AS header, CAST(n AS DOUBLE) AS value FROM both_rows
  UNION ALL SELECT table_id, row_label, 2, 'acctbal', CAST(bal AS DOUBLE) FROM both_rows)"""
