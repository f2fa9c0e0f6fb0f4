"""Calculations on table cells: table_id, row_label, col_ix, header, value (double; null where a cell is no number)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import normal_cell, normal_key, parse_number

from .cubes import percent


def is_total(label: Column) -> Column:
    return label.rlike("(?i)total|合计|总计")


def parse_tables(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """Cells of texts whose lines hold cells between bars: table_id, row_ix, row_label, col_ix, header, raw, value. Rows are cut or filled to the header's width; tables need two rows and two columns."""
    rows = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda line: F.transform(F.split(line, r"\|"), lambda c: F.trim(c))), lambda r: F.size(r) > 1)
    tables = chunks.select(F.col(id_col).alias("table_id"), rows.alias("grid")).filter(F.size("grid") >= 2)
    lines = tables.select("table_id", F.get("grid", 0).alias("head"), F.posexplode("grid").alias("row_ix", "cells")).filter("row_ix > 0")
    cells = lines.select("table_id", "row_ix", F.get("cells", 0).alias("row_label"), "cells", F.posexplode("head").alias("col_ix", "header")).filter("col_ix > 0")
    raw = F.coalesce(F.get("cells", F.col("col_ix")), F.lit(""))
    return cells.select("table_id", "row_ix", "row_label", "col_ix", "header", raw.alias("raw"), parse_number(raw).alias("value"))


def top_rows(cells: DataFrame, header: str, n: int, *, largest: bool = True) -> DataFrame:
    """The n extreme rows of a column in each table, totals and non-numbers left out."""
    order = F.desc("value") if largest else F.asc("value")
    rows = cells.filter((F.col("header") == header) & F.col("value").isNotNull() & ~is_total(F.col("row_label")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(order, "row_label"))).filter(F.col("rank") <= n).select("table_id", "row_label", "value", "rank")


def group_total(cells: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """table_id, group, header, total, n_rows: sums of named groups of rows per table and column, only where all rows of the group have a number."""
    label = reduce(lambda rest, g: F.when(F.col("row_label").isin(g[1]), g[0]).otherwise(rest), groups.items(), F.lit(None).cast("string"))
    rows = cells.withColumn("group", label).filter("group is not null").groupBy("table_id", "group", "header").agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"), F.count("*").alias("n_rows"), F.every(F.col("value").isNotNull()).alias("whole"))
    return rows.filter("whole").drop("whole")


def compare_groups(cells: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """Totals of two groups of rows per table and column, their difference and their ratio to two decimals."""
    sums = group_total(cells, {"a": first, "b": second})
    pair = sums.groupBy("table_id", "header").agg(F.max(F.when(F.col("group") == "a", F.col("total"))).alias("a"), F.max(F.when(F.col("group") == "b", F.col("total"))).alias("b")).filter("a is not null and b is not null")
    return pair.select("table_id", "header", "a", "b", (F.col("a") - F.col("b")).alias("difference"), F.round(F.try_divide("a", "b"), 2).alias("multiple"))


def with_total(cells: DataFrame) -> DataFrame:
    """Each cell that is not in the total row, with the total of its column."""
    total = cells.filter(is_total(F.col("row_label"))).groupBy("table_id", "header").agg(F.max("value").alias("total"))
    return cells.filter(~is_total(F.col("row_label"))).join(total, ["table_id", "header"])


def total_share(cells: DataFrame, condition: Column) -> DataFrame:
    """Sum of the rows that fit, and its share of the table's own total row."""
    rows = with_total(cells).groupBy("table_id", "header").agg(F.sum(F.when(condition, F.col("value").cast("decimal(28,4)"))).cast("double").alias("part"), F.max("total").alias("total"))
    return rows.select("table_id", "header", "part", "total", percent(F.col("part"), F.col("total")).alias("share_pct"))


def ratio_to_total(cells: DataFrame) -> DataFrame:
    """Each row in percent of the total, to one decimal."""
    return with_total(cells).select("table_id", "row_label", "header", F.round(percent(F.col("value"), F.col("total")), 1).alias("ratio_pct"))


def lookup(cells: DataFrame, rows: list[str], headers: list[str]) -> DataFrame:
    """Values of labelled rows and columns, without regard to case and marks."""
    among = lambda column, names: reduce(lambda found, n: found | (normal_cell(column) == normal_cell(F.lit(n))), names, F.lit(False))
    return cells.filter(among(F.col("row_label"), rows) & among(F.col("header"), headers)).select("table_id", "row_label", "header", "value")


def difference(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Difference of two rows of a table in each column."""
    side = lambda label, name: cells.filter(F.col("row_label") == label).select("table_id", "header", F.col("value").alias(name))
    return side(first, "a").join(side(second, "b"), ["table_id", "header"]).select("table_id", "header", (F.col("a") - F.col("b")).alias("difference"))


def condition_passes(current: Column, condition: Column) -> Column:
    """Does the number in ``current`` meet a condition like '<= 45%'? A condition without a sign asks for equality. Null where either lacks a number."""
    sign, limit, value = F.regexp_extract(condition, r"(>=|<=|≥|≤|>|<|=)", 1), parse_number(condition), parse_number(current)
    return F.when(sign.isin(">=", "≥"), value >= limit).when(sign.isin("<=", "≤"), value <= limit).when(sign == ">", value > limit).when(sign == "<", value < limit).otherwise(value == limit)


def threshold_check(rows: DataFrame) -> DataFrame:
    """table_id, row_label, current, condition -> passes, and whether all rows of the table that can be read pass; others are left out."""
    checked = rows.withColumn("passes", condition_passes(F.col("current"), F.col("condition"))).filter("passes is not null")
    return checked.withColumn("all_pass", F.every("passes").over(Window.partitionBy("table_id")))


def _bucket(total: Column, absolute: float, relative: float) -> Column:
    """A whole number for values about as far apart as their tolerance: linear while the absolute one holds, logarithmic beyond. Neighbours within the tolerance are in this or the next bucket."""
    edge = absolute / relative
    size = F.floor(F.log(F.abs(total) / edge) / (2.5 * relative)) + F.lit(int(edge / absolute) + 2)
    return F.when(F.abs(total) < edge, F.floor(total / (2 * absolute))).otherwise(F.signum(total).cast("long") * size).cast("long")


def table_projections(cells: DataFrame) -> DataFrame:
    """source, metric, label, value: numeric columns of tables with at least three members, totals left out; a label's first row counts. Labels are in normal form."""
    named = cells.filter(~is_total(F.col("row_label")) & F.col("value").isNotNull()).withColumn("label", normal_key(F.col("row_label"))).filter("label <> ''")
    order = [c for c in ("row_ix", "row_label") if c in cells.columns]
    own = named.withColumn("nth", F.row_number().over(Window.partitionBy("table_id", "header", "label").orderBy(*order))).filter("nth = 1")
    sized = own.withColumn("n", F.count("*").over(Window.partitionBy("table_id", "header"))).filter("n >= 3")
    return sized.select(F.col("table_id").alias("source"), F.col("header").alias("metric"), "label", "value")


def chart_projections(points: DataFrame) -> DataFrame:
    """source, metric, label, value of points (scope_id, series_name, category, y_value): each series over its categories, and each category over its series; at least two labels, all different in normal form."""
    rows = points.filter("y_value is not null")
    side = lambda metric, label: rows.select(F.col("scope_id").alias("source"), F.col(metric).alias("metric"), normal_key(F.col(label)).alias("label"), F.col("y_value").alias("value"), F.lit(metric == "category").alias("turned"))
    both = side("series_name", "category").unionByName(side("category", "series_name")).filter("label <> ''")
    whole = Window.partitionBy("source", "metric", "turned")
    # a label that comes twice makes the number of rows larger than that of labels
    twice = F.count("*").over(Window.partitionBy("source", "metric", "turned", "label"))
    sized = both.withColumn("twice", twice).withColumns({"n": F.count("*").over(whole), "most": F.max("twice").over(whole)}).filter("n >= 2 and most = 1")
    return sized.select("source", "metric", "label", "value", "turned")


def reconcile(first: DataFrame, second: DataFrame, *, least_common: int = 2, relative: float = 0.001, absolute: float = 0.5) -> DataFrame:
    """Sources of which the second folds some labels of the first into one: source, metric, label, value on both sides.

    A pair matches if it shares ``least_common`` labels, exactly one shared value differs, at least one is equal, no label is only in the second, and the differing label plus the labels only in the first equal the second's value, as do both totals. Gives source_a, source_b, metric_a, metric_b, target_label, folded (labels), target_value, folded_value.
    """
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    a = first.select(F.col("source").alias("source_a"), F.col("metric").alias("metric_a"), "label", F.col("value").alias("a"))
    b = second.select(F.col("source").alias("source_b"), F.col("metric").alias("metric_b"), "label", F.col("value").alias("b"))
    keys_a, keys_b = ["source_a", "metric_a"], ["source_b", "metric_b"]
    total_a = a.groupBy(*keys_a).agg(F.sum(F.col("a").cast("decimal(28,4)")).cast("double").alias("total_a"), F.count("*").alias("n_a"))
    total_b = b.groupBy(*keys_b).agg(F.sum(F.col("b").cast("decimal(28,4)")).cast("double").alias("total_b"), F.count("*").alias("n_b"))
    same = close(F.col("a"), F.col("b"))
    # all labels of b are a's, and the totals are close: pairs meet on b's rarest label and the bucket of the total, and only these are compared
    often = a.groupBy("label").agg(F.count("*").alias("often"))
    rare = b.join(often, "label").groupBy(*keys_b).agg(F.count("*").alias("known"), F.min_by("label", F.struct("often", "label")).alias("rare"))
    reach = F.greatest(F.lit(absolute), F.abs("total_b") * relative * (1 + 2 * relative))
    ends = F.array_distinct(F.array(*(_bucket(F.col("total_b") + k * reach, absolute, relative) for k in (-1, 0, 1))))
    wanted = total_b.join(rare, keys_b).filter("known = n_b").select(*keys_b, "n_b", "total_b", F.col("rare").alias("label"), F.explode(ends).alias("bucket"))
    offered = a.join(total_a, keys_a).select(*keys_a, "n_a", "total_a", "label", _bucket(F.col("total_a"), absolute, relative).alias("bucket"))
    met = offered.join(wanted, ["label", "bucket"]).filter((F.col("n_a") > F.col("n_b")) & close(F.col("total_a"), F.col("total_b"))).drop("label", "bucket").distinct()
    shared = met.join(b, keys_b).join(a, [*keys_a, "label"]).groupBy(*keys_a, *keys_b, "n_a", "n_b").agg(F.count("*").alias("n"), F.count_if(same).alias("stable"), F.max(F.when(~same, F.struct("label", "a", "b"))).alias("target"))
    pairs = shared.filter((F.col("n") >= least_common) & (F.col("n") - F.col("stable") == 1) & (F.col("stable") >= 1) & (F.col("n") == F.col("n_b")))
    both = [*keys_a, *keys_b]
    only = pairs.select(*both, "target").join(a, keys_a).join(b.select(*keys_b, "label", F.lit(True).alias("there")), [*keys_b, "label"], "left").filter("there is null")
    folded = only.groupBy(*both, "target").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("folded"), F.sum(F.col("a").cast("decimal(28,4)")).cast("double").alias("folded_value"))
    return folded.filter(close(F.col("target.a") + F.col("folded_value"), F.col("target.b"))).select(*both, F.col("target.label").alias("target_label"), "folded", F.col("target.b").alias("target_value"), "folded_value")
