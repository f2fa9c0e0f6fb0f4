"""Boxes on slides, and charts as nested rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_overlaps(boxes: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs a < b of boxes (slide_id, element_id, x0, y0, x1, y1) of a slide whose common area is at least ``least`` of the smaller one. A slide has few boxes."""
    side = lambda p: boxes.select("slide_id", *(F.col(c).alias(f"{p}_{c}") for c in ("element_id", "x0", "y0", "x1", "y1")))
    pairs = side("a").join(side("b"), "slide_id").filter("a_element_id < b_element_id")
    span = lambda d: F.greatest(F.lit(0.0), F.least(f"a_{d}1", f"b_{d}1") - F.greatest(f"a_{d}0", f"b_{d}0"))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    share = F.try_divide(span("x") * span("y"), F.least(area("a"), area("b")))
    return pairs.withColumn("overlap", share).filter(F.col("overlap") >= least).select("slide_id", F.col("a_element_id").alias("a"), F.col("b_element_id").alias("b"), "overlap")


def chart_scopes(boxes: DataFrame, least: float = 0.8) -> DataFrame:
    """slide_id, element_id, scope_id: the least element that a chain of overlaps reaches. Labels spread until none changes; chains are short."""
    links = box_overlaps(boxes, least)
    both = links.select("slide_id", "a", "b").unionByName(links.select("slide_id", F.col("b").alias("a"), F.col("a").alias("b")))
    scopes = boxes.select("slide_id", "element_id", F.col("element_id").alias("scope_id"))
    while True:
        near = both.join(scopes.withColumnRenamed("element_id", "b"), ["slide_id", "b"]).groupBy("slide_id", F.col("a").alias("element_id")).agg(F.min("scope_id").alias("near"))
        moved = scopes.join(near, ["slide_id", "element_id"], "left").select("slide_id", "element_id", F.col("scope_id").alias("old"), F.least("scope_id", "near").alias("scope_id")).checkpoint()
        scopes = moved.drop("old")
        if moved.filter("old <> scope_id").isEmpty():
            return scopes


def nest_charts(points: DataFrame) -> DataFrame:
    """scope_id, series: array of (series_name, points: array of (point_order, category, y_value)), each in order."""
    lines = points.groupBy("scope_id", "series_name").agg(F.array_sort(F.collect_list(F.struct("point_order", "category", "y_value"))).alias("points"))
    return lines.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("series_name", "points"))).alias("series"))


def chart_text(points: DataFrame) -> DataFrame:
    """One text per scope: its name, and a line per series with its axis, unit and values by category: "series | axis | unit | category=value; ...". Columns axis, unit and display (shown instead of the value) are used where there are such."""
    have = lambda c, default: F.coalesce(F.col(c), default) if c in points.columns else default
    value = have("display", F.col("y_value").cast("decimal(28,4)").cast("string"))
    lines = points.groupBy("scope_id", "series_name").agg(F.array_sort(F.collect_list(F.struct("point_order", "category", value.alias("v")))).alias("p"), F.max(have("axis", F.lit("axis unspecified"))).alias("axis"), F.max(have("unit", F.lit("unit unspecified"))).alias("unit"))
    values = F.array_join(F.transform("p", lambda x: F.concat(F.coalesce(x["category"], x["point_order"].cast("string")), F.lit("="), F.coalesce(x["v"], F.lit("None")))), "; ")
    lines = lines.select("scope_id", "series_name", F.concat_ws(" | ", "series_name", "axis", "unit", values).alias("line"))
    texts = lines.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("series_name", "line"))).alias("all"))
    return texts.select("scope_id", F.concat(F.col("scope_id"), F.lit("\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("content"))
