"""Decks as tables: chunks with what they belong to, profiles, vocabulary, axes, boxes, and the conversations about a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_chunks(chunks: DataFrame, slides: DataFrame, versions: DataFrame, documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Active chunks of the active parser runs of documents that are not deleted, with slide_no, slide_title, document_id, document_title and the element's confidence (null without an element).

    chunks: chunk_id, slide_id, version_id, element_id, content, active; slides: slide_id, parser_run_id, slide_no, slide_title; versions: version_id, document_id, active_parser_run_id; documents: document_id, document_title, deleted; elements: element_id, confidence. Flags that are null count as false. One shuffle for each table that isn't small; chunks go last, so that theirs is on the slide, which is spread.
    """
    live = versions.select("version_id", "document_id", "active_parser_run_id").join(documents.filter(~F.coalesce("deleted", F.lit(False))).select("document_id", "document_title"), "document_id")
    own = slides.select("slide_id", "version_id", "parser_run_id", "slide_no", "slide_title").join(live, "version_id").filter("parser_run_id = active_parser_run_id").drop("parser_run_id", "active_parser_run_id")
    rows = chunks.filter(F.coalesce("active", F.lit(False))).select("chunk_id", "slide_id", "version_id", "element_id", "content").join(own, ["slide_id", "version_id"])
    return rows.join(elements.select("element_id", "confidence"), "element_id", "left").select("chunk_id", "content", "slide_no", "slide_title", "document_id", "document_title", "confidence")


def document_profile(documents: DataFrame, slides: DataFrame, elements: DataFrame, charts: DataFrame, series: DataFrame, points: DataFrame) -> DataFrame:
    """document_id, slides, elements, tables, charts, series, points. Each level is counted by its parent and summed upwards: no level is joined to the rows below it, so that nothing fans out. Ids that repeat count once. Documents without rows have zeros.

    slides: slide_id, document_id; elements: element_id, slide_id, element_type; charts: chart_id, element_id; series: series_id, chart_id; points: point_id, series_id.
    """

    def up(rows: DataFrame, key: str, parent: str, below: DataFrame | None, names: list[str], own: dict[str, Column]) -> DataFrame:
        rows = rows.dropDuplicates([key])
        if below is not None:
            rows = rows.join(below, key, "left")
        return rows.groupBy(parent).agg(*(F.sum(c).cast("long").alias(n) for n, c in own.items()), *(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names))

    one = F.lit(1)
    found = up(points.select("point_id", "series_id"), "point_id", "series_id", None, [], {"points": one})
    found = up(series.select("series_id", "chart_id"), "series_id", "chart_id", found, ["points"], {"series": one})
    found = up(charts.select("chart_id", "element_id"), "chart_id", "element_id", found, ["points", "series"], {"charts": one})
    found = up(elements.select("element_id", "slide_id", "element_type"), "element_id", "slide_id", found, ["points", "series", "charts"], {"elements": one, "tables": F.when(F.col("element_type") == "table", 1).otherwise(0)})
    names = ["points", "series", "charts", "elements", "tables"]
    found = up(slides.select("slide_id", "document_id"), "slide_id", "document_id", found, names, {"slides": one})
    return documents.select("document_id").join(found, "document_id", "left").select("document_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("slides", "elements", "tables", "charts", "series", "points")))


def document_vocabulary(titles: DataFrame, rows: int = 80, terms: int = 120) -> DataFrame:
    """workspace_id, place, term: the first ``terms`` different words of the titles of a workspace's first ``rows`` slides, in order of sight: ASCII words of 2 to 41 characters that begin with a letter, and runs of 2 to 16 CJK characters. titles: workspace_id, updated_at, slide_no, slide_id, document_title, slide_title; the latest documents come first, of equal ones the lower slide."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("updated_at"), "slide_no", "slide_id")
    first = titles.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows)
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9&/_-]{1,40}|[\x{4e00}-\x{9fff}]{2,16}"), F.lit(0))
    told = first.select("workspace_id", "nth", F.posexplode(F.concat(words("document_title"), words("slide_title"))).alias("at", "term"))
    seen = told.groupBy("workspace_id", "term").agg(F.min(F.struct("nth", "at")).alias("seen"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy("seen"))).filter(F.col("place") <= terms).select("workspace_id", "place", "term")


def related_conversations(conversations: DataFrame, citations: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """document_id, conversation_id: conversations whose scope names a document, or that cite one of its versions. conversations: conversation_id, workspace_id, document_ids (array); citations: conversation_id, version_id; documents: document_id, workspace_id; versions: version_id, document_id. Only those of the document's own workspace."""
    named = conversations.select("workspace_id", "conversation_id", F.explode("document_ids").alias("document_id"))
    cited = citations.select("conversation_id", "version_id").join(versions.select("version_id", "document_id"), "version_id").select("conversation_id", "document_id").distinct().join(conversations.select("conversation_id", "workspace_id"), "conversation_id")
    both = named.unionByName(cited.select("workspace_id", "conversation_id", "document_id"))
    return both.join(documents.select("document_id", "workspace_id"), ["document_id", "workspace_id"], "left_semi").select("document_id", "conversation_id").distinct()


#: Kinds of value axes, and sides of secondary and primary ones.
VALUE_AXES, SECONDARY_SIDES, PRIMARY_SIDES = ("valax", "value", "valueaxis"), ("r", "right", "t", "top"), ("l", "left", "b", "bottom")


def axis_resolution(series: DataFrame, axes: DataFrame) -> DataFrame:
    """chart_id, series_id, axis_id, role: the last value axis among a series' own axes, else the last of its axes (none: no row). Role by the axis' side; without a known side 'secondary' for the last of several value axes of the chart, else 'primary'. series: chart_id, series_id, axis_ids (array); axes: chart_id, axis_no, axis_id, axis_type, position."""
    kind = F.coalesce(F.lower("axis_type").isin(*VALUE_AXES), F.lit(False))
    chart = Window.partitionBy("chart_id")
    known = axes.withColumn("is_value", kind).withColumns({"n_value": F.count_if("is_value").over(chart), "last_value": F.max_by("axis_id", F.when(F.col("is_value"), F.col("axis_no"))).over(chart)})
    own = series.select("chart_id", "series_id", F.explode(F.array_distinct("axis_ids")).alias("axis_id")).join(known, ["chart_id", "axis_id"])
    best = own.groupBy("chart_id", "series_id").agg(F.max_by(F.struct("axis_id", F.lower(F.coalesce("position", F.lit(""))).alias("side"), "n_value", "last_value"), F.struct("is_value", "axis_no")).alias("a"))
    role = F.when(F.col("a.side").isin(*SECONDARY_SIDES), "secondary").when(F.col("a.side").isin(*PRIMARY_SIDES), "primary").when((F.col("a.n_value") > 1) & (F.col("a.last_value") == F.col("a.axis_id")), "secondary").otherwise("primary")
    return best.select("chart_id", "series_id", F.col("a.axis_id").alias("axis_id"), role.alias("role"))


#: The box of a chart that has none, as parts of its slide.
DEFAULT_BOX = {"x": 0.05, "y": 0.15, "w": 0.9, "h": 0.7}


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """struct(x, y, w, h) as parts of a slide of ``width`` and ``height``: of a box struct in the same measure; a missing corner is 0, a missing size the slide's, a missing box the default. Null for slides without a size."""
    part = lambda name, size, rest: F.try_divide(F.coalesce(box[name].cast("long"), rest).cast("double"), size)
    zero = F.lit(0).cast("long")
    own = F.struct(part("x", width, zero).alias("x"), part("y", height, zero).alias("y"), part("w", width, width).alias("w"), part("h", height, height).alias("h"))
    return F.when(box.isNull(), F.struct(*(F.lit(v).alias(n) for n, v in DEFAULT_BOX.items()))).otherwise(own)
