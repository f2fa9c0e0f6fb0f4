"""Calculations on chart points: scope_id, series_name, category, point_order, y_value. A null value is dropped first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import chart_family, normal_key

from .scope import unit_key

SERIES = ["scope_id", "series_name"]


def _known(points: DataFrame) -> DataFrame:
    return points.filter(F.col("y_value").isNotNull())


def percent(part: Column, whole: Column) -> Column:
    """part in percent of whole; null where whole is zero."""
    return F.try_divide(part, whole) * 100


def period_change(points: DataFrame) -> DataFrame:
    """Per series: the last two points, their difference and its percentage of the earlier one's size."""
    w = Window.partitionBy(*SERIES)
    o = w.orderBy("point_order", "category")
    rows = _known(points).withColumns({"previous": F.lag("y_value").over(o), "previous_category": F.lag("category").over(o), "rank": F.row_number().over(w.orderBy(F.desc("point_order"), F.desc("category")))})
    rows = rows.filter("rank = 1 and previous is not null")
    change = F.col("y_value") - F.col("previous")
    return rows.select(*SERIES, F.col("previous_category").alias("start_category"), F.col("category").alias("end_category"), change.alias("change"), percent(change, F.abs("previous")).alias("change_pct"))


def is_temporal(category: Column) -> Column:
    """FY or CY years (with A, E or F), pairs of numbers like 2024-05 and 25/12, and quarters with a year."""
    return F.trim(category).rlike(r"(?i)^(?:(?:FY|CY)?20\d{2}[AEF]?|\d{2,4}[/.-]\d{1,2}|Q[1-4][ -]?(?:20)?\d{2}|(?:20)?\d{2}[ -]?Q[1-4])$")


def period_coordinate(category: Column) -> Column:
    """struct(year, suffix): year 20xx and the period within it: Q1..Q4, M01..M12 or 'annual'. Null for labels without a year."""
    year = F.regexp_extract(category, r"(20\d{2})", 1)
    short = F.regexp_extract(category, r"^(\d{2})/(?:0?[1-9]|1[0-2])$", 1)
    full = F.when(year != "", year.cast("int")).when(short != "", short.cast("int") + 2000)
    quarter, month = F.regexp_extract(category, r"Q([1-4])", 1), F.regexp_extract(category, r"/(0?[1-9]|1[0-2])$", 1)
    suffix = F.when(quarter != "", F.concat(F.lit("Q"), quarter)).when(month != "", F.concat(F.lit("M"), F.lpad(month, 2, "0"))).otherwise("annual")
    return F.when(full.isNotNull(), F.struct(full.alias("year"), suffix.alias("suffix")))


def yoy_pair(points: DataFrame, target_year: int | None = None) -> DataFrame:
    """Per series: a point of the target year (default: the series' latest) and the same period a year before; of several the newest period."""
    rows = _known(points).withColumn("at", period_coordinate(F.col("category"))).filter("at is not null").select(*SERIES, "category", "point_order", "y_value", "at.year", "at.suffix")
    year = F.lit(target_year) if target_year else F.max("year").over(Window.partitionBy(*SERIES))
    before = rows.select(*SERIES, (F.col("year") + 1).alias("year"), "suffix", F.col("y_value").alias("before"), F.col("category").alias("base_category"))
    pairs = rows.withColumn("target", year).filter("year = target").join(before, [*SERIES, "year", "suffix"])
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("point_order"), F.desc("category")))
    change = F.col("y_value") - F.col("before")
    return pairs.withColumn("rank", newest).filter("rank = 1").select(*SERIES, "base_category", F.col("category").alias("target_category"), change.alias("change"), percent(change, F.abs("before")).alias("change_pct"))


def series_summary(points: DataFrame) -> DataFrame:
    """One row per series of at least two points: ends, extremes, drawdown, year-on-year by twelve points, change of the mean of the last three against the three before, length of the falling run at the end.

    The last four hold for temporal series only: those with at least max(2, 0.7 n) temporal labels; others have nulls, and no declines.
    """
    w = Window.partitionBy(*SERIES)
    up, down = w.orderBy("point_order", "category"), w.orderBy(F.desc("point_order"), F.desc("category"))
    rows = _known(points).withColumns({"nth": F.row_number().over(up), "back": F.row_number().over(down), "before": F.lag("y_value").over(up), "year_before": F.lag("y_value", 12).over(up)})
    rows = rows.withColumn("rises", F.max(F.when(F.coalesce(F.col("y_value") >= F.col("before"), F.lit(True)), 1).otherwise(0)).over(down))
    first_at = lambda by: F.min_by(F.struct("category", "nth", "y_value"), by)
    out = rows.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.count_if(is_temporal(F.col("category"))).alias("n_temporal"),
        F.min_by("y_value", "nth").alias("start_value"), F.max_by("y_value", "nth").alias("latest_value"),
        first_at(F.struct("y_value", "nth")).alias("lo"), first_at(F.struct(-F.col("y_value"), F.col("nth"))).alias("hi"),
        F.max_by("year_before", "nth").alias("year_before"), F.avg(F.when(F.col("back") <= 3, F.col("y_value"))).alias("recent"), F.avg(F.when(F.col("back").between(4, 6), F.col("y_value"))).alias("earlier"),
        F.count_if(F.col("rises") == 0).alias("falls"),
    ).filter("n >= 2")
    temporal = F.col("n_temporal") >= F.greatest(F.lit(2), F.ceil(0.7 * F.col("n")))
    when = lambda x, n=0: F.when(temporal & (F.col("n") >= n), x)
    latest = F.col("latest_value")
    return out.select(
        *SERIES, "n", "start_value", "latest_value", percent(latest - F.col("start_value"), F.abs("start_value")).alias("total_change_pct"),
        F.col("lo.y_value").alias("min_value"), F.col("lo.category").alias("min_category"), F.col("hi.y_value").alias("max_value"), F.col("hi.category").alias("max_category"), temporal.alias("temporal"),
        when(percent(latest - F.col("hi.y_value"), F.abs("hi.y_value"))).alias("drawdown_pct"), when(F.col("n") - F.col("hi.nth")).alias("periods_since_max"),
        when(percent(latest - F.col("year_before"), F.abs("year_before")), 13).alias("yoy_pct"), when(percent(F.col("recent") - F.col("earlier"), F.abs("earlier")), 6).alias("recent_change_pct"),
        F.coalesce(when(F.col("falls")), F.lit(0)).alias("trailing_declines"),
    )


def path_steps(points: DataFrame) -> DataFrame:
    """Per series: net change, and the largest fall and rise between neighbours; the first of equal ones. Null where nothing falls or rises."""
    o = Window.partitionBy(*SERIES).orderBy("point_order", "category")
    rows = _known(points).withColumns({"step": F.col("y_value") - F.lag("y_value").over(o), "nth": F.row_number().over(o)}).filter("step is not null")
    rows = rows.groupBy(*SERIES).agg(F.count("*").alias("steps"), F.sum(F.col("step").cast("decimal(28,4)")).cast("double").alias("net_change"), F.min_by(F.struct("category", "step"), F.struct("step", "nth")).alias("low"), F.min_by(F.struct("category", "step"), F.struct(-F.col("step"), "nth")).alias("high"))
    pick = lambda c, ok: (F.when(ok, F.col(f"{c}.category")), F.when(ok, F.col(f"{c}.step")))
    (fall_at, fall), (rise_at, rise) = pick("low", F.col("low.step") < 0), pick("high", F.col("high.step") > 0)
    return rows.select(*SERIES, "steps", "net_change", fall_at.alias("fall_category"), fall.alias("fall"), rise_at.alias("rise_category"), rise.alias("rise"))


def group_change_attribution(points: DataFrame, base: str, target: str, *, cover: float = 80.0, most: int = 3) -> DataFrame:
    """What each category adds to a scope's growth from series ``base`` to ``target``: change, net change, share in percent, is_primary.

    Only scopes that grow and share two categories or more. Primary are the largest rises, until those before cover ``cover`` percent, ``most`` at most.
    """
    side = lambda name, value: _known(points).filter(F.col("series_name") == name).select("scope_id", "category", F.col("y_value").alias(value))
    whole = Window.partitionBy("scope_id")
    rows = side(base, "before").join(side(target, "after"), ["scope_id", "category"]).select("scope_id", "category", (F.col("after") - F.col("before")).alias("change"))
    rows = rows.withColumns({"net": F.sum("change").over(whole), "k": F.count("*").over(whole)}).filter("net > 0 and k >= 2").withColumn("share", F.col("change") / F.col("net") * 100)
    by_size = whole.orderBy(F.desc("change"), "category")
    covered = F.coalesce(F.sum("share").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    primary = (F.col("change") > 0) & (F.row_number().over(by_size) <= most) & (covered < cover)
    return rows.select("scope_id", "category", "change", "net", "share", primary.alias("is_primary"))


def common_totals(points: DataFrame, least: int = 2) -> DataFrame:
    """scope_id, category, point_order, total over all series, at categories that every series of the scope has; scopes of ``least`` series and common categories, 70 % of them temporal."""
    rows = _known(points)
    n_series = rows.groupBy("scope_id").agg(F.countDistinct("series_name").alias("n_series"))
    sums = rows.groupBy("scope_id", "category").agg(F.min("point_order").alias("point_order"), F.sum(F.col("y_value").cast("decimal(28,4)")).cast("double").alias("total"), F.countDistinct("series_name").alias("n"))
    common = sums.join(n_series, "scope_id").filter(f"n = n_series and n_series >= {least}")
    w = Window.partitionBy("scope_id")
    common = common.withColumns({"k": F.count("*").over(w), "t": F.count_if(is_temporal(F.col("category"))).over(w)})
    return common.filter(f"k >= {least} and t >= 0.7 * k").select("scope_id", "category", "point_order", "total")


def latest_share(points: DataFrame) -> DataFrame:
    """Each series' share in percent of its scope's last common total; 0 where that is 0."""
    last = common_totals(points).groupBy("scope_id").agg(F.max_by(F.struct("category", "total"), "point_order").alias("last")).select("scope_id", "last.category", "last.total")
    return _known(points).join(last, ["scope_id", "category"]).select("scope_id", "series_name", "category", F.coalesce(percent(F.col("y_value"), F.col("total")), F.lit(0.0)).alias("share_pct"))


def share_composition(points: DataFrame) -> DataFrame:
    """Parts of each (scope, series): total, share in percent, whether it is the largest, and whether the total is a percent scale (100 +- 2). The last of repeated categories counts."""
    w = Window.partitionBy(*SERIES)
    rows = _known(points).withColumn("again", F.row_number().over(Window.partitionBy(*SERIES, "category").orderBy(F.desc("point_order")))).filter("again = 1")
    rows = rows.withColumns({"total": F.sum(F.col("y_value").cast("decimal(28,4)")).over(w).cast("double"), "rank": F.row_number().over(w.orderBy(F.desc("y_value"), "point_order"))})
    return rows.select(*SERIES, "category", "y_value", "total", percent(F.col("y_value"), F.col("total")).alias("share_pct"), (F.col("rank") == 1).alias("is_largest"), (F.abs(F.col("total") - 100) <= 2).alias("percent_scale"))


def share_complement(points: DataFrame) -> DataFrame:
    """What is left of the total without each part, and its share."""
    rest = F.col("total") - F.col("y_value")
    return share_composition(points).select(*SERIES, "category", rest.alias("rest"), percent(rest, F.col("total")).alias("rest_pct"))


def cube_shape(points: DataFrame) -> DataFrame:
    """Per scope: series, categories, points and entities."""
    shape = points.groupBy("scope_id").agg(F.countDistinct("series_name").alias("series_count"), F.countDistinct("category").alias("category_count"), F.count("y_value").alias("point_count"))
    return shape.join(structure_flags(points).select("scope_id", "entity_count"), "scope_id", "left")


def compare_series(points: DataFrame, first: str, second: str) -> DataFrame:
    """At each (scope, category): the higher of two series and the difference."""
    sides = _known(points).filter(F.col("series_name").isin(first, second)).groupBy("scope_id", "category").agg(F.max(F.when(F.col("series_name") == first, F.col("y_value"))).alias("a"), F.max(F.when(F.col("series_name") == second, F.col("y_value"))).alias("b")).filter("a is not null and b is not null")
    higher = F.when(F.col("a") > F.col("b"), first).when(F.col("b") > F.col("a"), second)
    return sides.select("scope_id", "category", higher.alias("higher_series"), F.abs(F.col("a") - F.col("b")).alias("difference"))


def cross_dimension_change(points: DataFrame, first: str, second: str) -> DataFrame:
    """Change and percentage from one series to another at each category, for charts whose series are periods."""
    side = lambda name, value: _known(points).filter(F.col("series_name") == name).select("scope_id", "category", F.col("y_value").alias(value))
    change = F.col("b") - F.col("a")
    return side(first, "a").join(side(second, "b"), ["scope_id", "category"]).select("scope_id", "category", change.alias("change"), percent(change, F.abs("a")).alias("change_pct"))


def point_lookup(points: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Values at the (series, category) of ``coordinates``, without regard to case and marks."""
    key = lambda df: df.withColumns({"series_key": normal_key(F.col("series_name")), "category_key": normal_key(F.col("category"))})
    wanted = key(coordinates).select("series_key", "category_key").distinct()
    return key(points).join(wanted, ["series_key", "category_key"]).select("scope_id", "series_name", "category", "y_value")


def divergence(points: DataFrame) -> DataFrame:
    """Scopes whose common total has risen lately while some series weaken: the weak series and their number.

    Weak: the recent change is negative, or the series is at least 3 % below a peak of at most five periods ago with two falls or more in a row.
    """
    totals = common_totals(points).select("scope_id", F.lit("total").alias("series_name"), "category", "point_order", F.col("total").alias("y_value"))
    rising = series_summary(totals).filter("recent_change_pct > 0").select("scope_id", F.col("recent_change_pct").alias("total_recent_pct"))
    weak = (F.col("recent_change_pct") < 0) | ((F.col("drawdown_pct") <= -3) & (F.col("periods_since_max") <= 5) & (F.col("trailing_declines") >= 2))
    rows = series_summary(points).filter(weak).groupBy("scope_id").agg(F.array_join(F.array_sort(F.collect_list("series_name")), ",").alias("weak_series"), F.count("*").alias("n_weak"))
    return rising.join(rows, "scope_id")


def structure_flags(points: DataFrame) -> DataFrame:
    """Per scope: is_share, is_ordered_categorical, entity_count, is_analyzable.

    Share: a chart of the share family (column chart_type, where there is one), or a single series of two values or more, none negative, that add to 100 +- 2. Ordered: a single series of three values or more that is no share and whose labels are not temporal. Entities: the series, or the values of a single share or ordered series, else one. A scope of two entities and points can be analysed.
    """
    rows = _known(points)
    family = F.max((chart_family(F.col("chart_type")) == "share").cast("int")) == 1 if "chart_type" in points.columns else F.lit(False)
    total = F.sum(F.col("y_value").cast("decimal(28,4)"))
    sums = rows.groupBy("scope_id").agg(F.countDistinct("series_name").alias("groups"), F.count("*").alias("n"), (family | ((F.countDistinct("series_name") == 1) & (F.count("*") >= 2) & (F.min("y_value") >= 0) & (F.abs(total - 100) <= 2))).alias("is_share"), F.count_if(is_temporal(F.col("category"))).alias("n_temporal"))
    ordered = (F.col("groups") == 1) & ~F.col("is_share") & (F.col("n") >= 3) & (F.col("n_temporal") < F.greatest(F.lit(2), F.ceil(0.7 * F.col("n"))))
    entities = F.when(F.col("groups") > 1, F.col("groups")).when(F.col("is_share") | ordered, F.col("n")).otherwise(F.lit(1).cast("long"))
    return sums.select("scope_id", "is_share", ordered.alias("is_ordered_categorical"), entities.alias("entity_count"), ((entities >= 2) & (F.col("n") >= 2)).alias("is_analyzable"))


def calculation_scope(points: DataFrame) -> DataFrame:
    """Provenance of a scope: its series and categories in order."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return points.groupBy("scope_id").agg(listed("series_name").alias("series"), listed("category").alias("categories"), F.count("*").alias("n_points"))


def change_between(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change of a series between two given categories (pairs: scope_id, series_name, start_category, end_category), without regard to case and marks: as ``period_change`` gives it for the last two. Categories that come twice count at their first point."""
    key = lambda c: normal_key(F.col(c))
    rows = _known(points).groupBy(*SERIES, key("category").alias("key")).agg(F.min_by(F.struct("category", "y_value"), F.struct("point_order", "category")).alias("p"))
    side = lambda name: rows.select(*SERIES, F.col("key").alias(f"{name}_key"), F.col("p").alias(name))
    wanted = pairs.select(*SERIES, key("start_category").alias("a_key"), key("end_category").alias("b_key")).distinct()
    both = wanted.join(side("a"), [*SERIES, "a_key"]).join(side("b"), [*SERIES, "b_key"])
    change = F.col("b.y_value") - F.col("a.y_value")
    return both.select(*SERIES, F.col("a.category").alias("start_category"), F.col("b.category").alias("end_category"), change.alias("change"), percent(change, F.abs("a.y_value")).alias("change_pct"))


def compare_measured(points: DataFrame, first: str, second: str) -> DataFrame:
    """``compare_series`` of points with a unit: only where the units of both, so far as they say something, are the same in normal form. unit: the higher point's, else the lower's."""
    side = lambda name: F.max_by(F.struct("y_value", "unit", unit_key(F.col("unit")).alias("key")), F.when(F.col("series_name") == name, F.col("y_value")))
    pairs = _known(points).filter(F.col("series_name").isin(first, second)).groupBy("scope_id", "category").agg(side(first).alias("a"), side(second).alias("b"), F.count_distinct("series_name").alias("n")).filter("n = 2")
    same = F.coalesce(F.col("a.key") == F.col("b.key"), F.lit(True))
    a_first = F.col("a.y_value") >= F.col("b.y_value")
    higher = F.when(F.col("a.y_value") > F.col("b.y_value"), first).when(F.col("b.y_value") > F.col("a.y_value"), second)
    units = [F.when(F.col(f"{c}.key").isNotNull(), F.col(f"{c}.unit")) for c in "ab"]
    return pairs.filter(same).select("scope_id", "category", higher.alias("higher_series"), F.abs(F.col("a.y_value") - F.col("b.y_value")).alias("difference"), F.when(a_first, F.coalesce(*units)).otherwise(F.coalesce(*units[::-1])).alias("unit"))


def calculation_provenance(points: DataFrame) -> DataFrame:
    """scope_id, element_ids (sorted), series and categories (each once, as they come), confidence (the least; null without any), n_points: what a calculation over a scope's points rests on. points: also element_id, confidence."""
    seen = lambda c: F.array_distinct(F.transform(F.col("told"), lambda p: F.coalesce(p[c], F.lit(""))))
    # a chart has few points
    rows = points.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("point_order", "series_name", "category"))).alias("told"), F.array_sort(F.collect_set(F.nullif(F.col("element_id").cast("string"), F.lit("")))).alias("element_ids"), F.min("confidence").alias("confidence"), F.count("*").alias("n_points"))
    return rows.select("scope_id", "element_ids", seen("series_name").alias("series"), seen("category").alias("categories"), "confidence", "n_points")


def bar_totals(points: DataFrame) -> DataFrame:
    """``common_totals`` of the bars of each scope that also has lines, or whose bars are stacked. points: also chart_type, grouping (null: not stacked)."""
    family = chart_family(F.col("chart_type"))
    stacked = F.coalesce(F.lower("grouping").isin("stacked", "percentstacked"), F.lit(False))
    scopes = points.groupBy("scope_id").agg(F.coalesce(F.bool_or(stacked | (family == "line")), F.lit(False)).alias("summed")).filter("summed").select("scope_id")
    return common_totals(points.filter(family == "bar").join(scopes, "scope_id", "left_semi"))
