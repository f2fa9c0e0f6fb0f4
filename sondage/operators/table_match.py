"""Requests against tables: which rows and columns a request names, how well a table fits, and the value, difference or ratio it asks for.

Requests come with the tables they are offered (request_id, table_id, question), as retrieval gives them: all joins are on table_id. Cells: table_id, row_ix, row_label, col_ix, header, raw. A null question, label or header names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import normal_cell, parse_number

#: Headers of one meaning, in normal form.
HEADER_ALIASES = (
    ("vonb", "新业务价值"), ("anp",), ("margin", "利润率"), ("13m继续率", "13个月继续率", "persistency13m"), ("数字直通率", "电子投保率", "digitalstp"), ("转化率",), ("cac",), ("ape",), ("线索", "线索量"), ("签发", "签发量"), ("年度额", "年度金额", "金额"), ("占比",),
    ("预期roe",), ("流动性",), ("风险限额利用",), ("人均产能",), ("股东资本比率", "shareholdercapitalratio"), ("operatingroev", "营运roev"), ("evequity", "内含价值权益"), ("同比变化", "同比", "变化", "固定汇率", "cer"), ("当前", "当前值", "current", "currentvalue"), ("阈值", "threshold", "limit", "target"),
)
#: Words that ask for growth, terms that weigh where table and request have them, headers of states and limits, wording that asks for a verdict.
GROWTH_TERMS = ("同比", "每股", "增长", "固定汇率", "cer")
SHARED_TERMS = ("矩阵", "阈值", "闸门", "合计", "最高", "最低", "最大", "最小")
STATE_HEADERS, LIMIT_HEADERS = ("当前", "当前值", "current", "currentvalue"), ("阈值", "threshold", "limit", "target", "绿", "green")
EVALUATION = r"是否|能否|有没有|算不算|达标|满足|状态|闸门|风险|越线|突破|超出|合规|within\s+(?:the\s+)?(?:limit|threshold|target)|pass(?:es|ed)?|breach(?:es|ed)?|compliant|acceptable|material|risk"
DIFFERENCE_CUES, MULTIPLE_CUES = ("提高", "增加", "下降", "高多少", "低多少", "差多少", "变化了多少"), ("多少倍", "几倍")
UNIT_HEADER, OWN_UNITS = "单位", ("%", "$", "bn", "m")

_J = r"\x{4e00}-\x{9fff}"
_PAIR = ["request_id", "table_id"]


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(w.replace("$", r"\$") for w in words))


def _relaxed(key: Column) -> Column:
    """Without conjunctions between CJK characters."""
    return F.regexp_replace(key, f"(?<=[{_J}])[和与及](?=[{_J}])", "")


def _meanings(key: Column) -> Column:
    """Numbers of the alias groups that a key has a word of."""
    return F.filter(F.array(*(F.when(_any(key, group), n) for n, group in enumerate(HEADER_ALIASES))), lambda n: n.isNotNull())


def _keyed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    df = df.withColumn(f"{prefix}_key", F.coalesce(normal_cell(F.col(column)), F.lit("")))
    return df.withColumn(f"{prefix}_means", _meanings(F.col(f"{prefix}_key")))


def _means_header(header: str) -> Column:
    """A year of the header, a word of the same meaning, or a change that is asked for."""
    key, asked = F.col(f"{header}_key"), F.col("question_key")
    year = F.regexp_extract(key, r"20\d{2}", 0)
    return ((year != "") & F.contains(asked, year)) | F.arrays_overlap(f"{header}_means", "question_means") | (F.contains(key, F.lit("同比变化")) & _any(asked, GROWTH_TERMS))


def _stands(label: Column, question: Column) -> Column:
    """A label of two characters or more whose first occurrence, where it is ASCII, is not followed by an ASCII letter or digit."""
    after = F.substring(question, F.position(label, question) + F.length(label), F.lit(1))
    return (F.length(label) >= 2) & F.contains(question, label) & ~(label.rlike(r"^[\x00-\x7f]*$") & after.rlike("[a-z0-9]"))


def match_rows(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id, table_id, row_ix, row_label, place: rows whose label, or a part of it between ``/ ｜ | ·``, stands in the question, CJK conjunctions set aside, or whose label means what the question has. ``place`` is where the label is in the question, 0 where only a part or meaning is."""
    rows = _keyed(cells.select("table_id", "row_ix", "row_label").distinct(), "row_label", "row")
    parts = F.array_distinct(F.concat(F.array("row_label"), F.split("row_label", r"\s*(?:/|｜|\||·)\s*")))
    rows = rows.withColumn("parts", F.transform(parts, lambda p: F.struct(normal_cell(p).alias("key"), _relaxed(normal_cell(p)).alias("relaxed"))))
    pairs = _keyed(asked.select(*_PAIR, "question"), "question", "question").withColumn("question_relaxed", _relaxed(F.col("question_key"))).join(rows, "table_id")
    named = F.exists("parts", lambda p: F.when(F.contains(F.col("question_key"), p["key"]), _stands(p["key"], F.col("question_key"))).otherwise(_stands(p["relaxed"], F.col("question_relaxed"))))
    return pairs.filter(F.coalesce(named, F.lit(False)) | _means_header("row")).select(*_PAIR, "row_ix", "row_label", F.position(F.lower("row_label"), F.lower("question")).alias("place"))


def match_columns(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id, table_id, col_ix, header of the columns that a question names: by header, year or meaning."""
    heads = _keyed(cells.select("table_id", "col_ix", "header").distinct(), "header", "header")
    pairs = _keyed(asked.select(*_PAIR, "question"), "question", "question").join(heads, "table_id")
    named = (F.length("header_key") >= 2) & F.contains("question_key", F.col("header_key"))
    return pairs.filter(named | _means_header("header")).select(*_PAIR, "col_ix", "header")


def relevance(asked: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """request_id, table_id, relevance: 4 for each named row, 3 for each named column, 5 for the corner's header, 2 for the word table before a table chunk and for each shared term, 3 for states and limits where a verdict is asked for. tables: table_id, corner, chunk_type, content."""
    n_rows = match_rows(asked, cells).groupBy(*_PAIR).agg(F.count("*").alias("n_rows"))
    n_columns = match_columns(asked, cells).groupBy(*_PAIR).agg(F.count("*").alias("n_columns"))
    keys = F.collect_set(normal_cell(F.col("header")))
    heads = cells.groupBy("table_id").agg(keys.alias("keys"))
    has = lambda names: F.arrays_overlap(F.array_append("keys", normal_cell(F.col("corner"))), F.array(*map(F.lit, names)))
    pairs = asked.select(*_PAIR, "question").join(tables.select("table_id", "corner", "chunk_type", "content"), "table_id").join(heads, "table_id").join(n_rows, _PAIR, "left").join(n_columns, _PAIR, "left")
    corner = F.contains(normal_cell(F.col("question")), normal_cell(F.col("corner")))
    worth = [(corner, 5), (F.contains("question", F.lit("表")) & (F.col("chunk_type") == "table"), 2), *((F.contains("question", F.lit(t)) & F.contains("content", F.lit(t)), 2) for t in SHARED_TERMS), (has(STATE_HEADERS) & has(LIMIT_HEADERS) & F.col("question").rlike(f"(?i){EVALUATION}"), 3)]
    points = 4 * F.coalesce("n_rows", F.lit(0)) + 3 * F.coalesce("n_columns", F.lit(0))
    for condition, score in worth:
        points = points + F.when(condition, score).otherwise(0)
    return pairs.select(*_PAIR, points.cast("long").alias("relevance"))


def _named(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per request and table: the question, the named rows in table order and in that of the question, the named columns."""
    rows = match_rows(asked, cells).groupBy(*_PAIR).agg(F.array_sort(F.collect_list(F.struct("row_ix", "row_label"))).alias("rows"), F.array_sort(F.collect_list(F.struct("place", "row_ix", "row_label"))).alias("told"))
    columns = match_columns(asked, cells).filter(normal_cell(F.col("header")) != UNIT_HEADER).groupBy(*_PAIR).agg(F.array_sort(F.collect_list(F.struct("col_ix", "header"))).alias("columns"))
    return asked.select(*_PAIR, "question").join(columns, _PAIR).join(rows, _PAIR, "left")


def _cell(cells: DataFrame, name: str) -> DataFrame:
    """Cells under names of their own, to be joined on table, row and column."""
    return cells.select("table_id", F.col("row_ix").alias(f"{name}_row"), F.col("col_ix").alias(f"{name}_col"), F.col("row_label").alias(f"{name}_label"), F.col("header").alias(f"{name}_header"), F.col("raw").alias(f"{name}_raw"), parse_number(F.col("raw")).alias(f"{name}_value"))


def _totals(cells: DataFrame, words: str) -> DataFrame:
    """The first row of a table whose label has one of the words."""
    return cells.filter(F.col("row_label").rlike(words)).groupBy("table_id").agg(F.min("row_ix").alias("total_row"))


def asked_values(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id, table_id, row_label, header, value of requests that name exactly one row (or, naming none, the total): the cells of the named columns, with the row's unit where the cell has none of its own."""
    named = _named(asked, cells).join(_totals(cells, "合计"), "table_id", "left")
    total = F.when(F.contains("question", F.lit("合计")), F.col("total_row"))
    row = F.when(F.size(F.coalesce("rows", F.array().cast("array<struct<row_ix:bigint,row_label:string>>"))) == 0, total).when(F.size("rows") == 1, F.col("rows")[0]["row_ix"])
    wanted = named.select(*_PAIR, row.alias("a_row"), F.explode("columns.col_ix").alias("a_col")).filter("a_row is not null")
    units = cells.filter(normal_cell(F.col("header")) == UNIT_HEADER).groupBy("table_id", F.col("row_ix").alias("a_row")).agg(F.min_by("raw", "col_ix").alias("unit"))
    rows = wanted.join(_cell(cells, "a"), ["table_id", "a_row", "a_col"]).join(units, ["table_id", "a_row"], "left")
    bare = ~_any(F.col("a_raw"), OWN_UNITS) & (F.coalesce("unit", F.lit("")) != "")
    return rows.select(*_PAIR, F.col("a_label").alias("row_label"), F.col("a_header").alias("header"), F.when(bare, F.concat_ws(" ", "a_raw", "unit")).otherwise(F.col("a_raw")).alias("value"))


def asked_differences(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id, table_id, first, second, difference, points of requests that ask for one: the first two rows of the question in the first named column (first less second), or one row between its first and last named year (second less first). ``points``: the two years are percentages, and so the difference is percentage points. Cells that are no numbers give no row."""
    named = _named(asked, cells).filter(_any(F.col("question"), DIFFERENCE_CUES) & (F.size("rows") >= 1))
    years = F.filter("columns", lambda c: c["header"].rlike(r"20\d{2}"))
    place = lambda c: F.position(F.lower(c["header"]), F.lower("question"))
    told = F.array_sort(F.transform(years, lambda c: F.struct(F.when(place(c) > 0, place(c)).otherwise(10_000 + c["col_ix"]).alias("place"), c["col_ix"].alias("col_ix"))))
    two = F.size("rows") >= 2
    pick = named.withColumns({"two": two, "years": told}).filter(two | (F.size("years") >= 2))
    one_column = F.col("columns")[0]["col_ix"]
    wanted = pick.select(*_PAIR, "two", F.when(two, F.col("told")[0]["row_ix"]).otherwise(F.col("rows")[0]["row_ix"]).alias("a_row"), F.when(two, one_column).otherwise(F.get("years", F.lit(0))["col_ix"]).alias("a_col"), F.when(two, F.get("told", F.lit(1))["row_ix"]).otherwise(F.col("rows")[0]["row_ix"]).alias("b_row"), F.when(two, one_column).otherwise(F.element_at("years", -1)["col_ix"]).alias("b_col"))
    both = wanted.join(_cell(cells, "a"), ["table_id", "a_row", "a_col"]).join(_cell(cells, "b"), ["table_id", "b_row", "b_col"])
    difference = F.when(F.col("two"), F.col("a_value") - F.col("b_value")).otherwise(F.col("b_value") - F.col("a_value"))
    side = lambda s: F.when(F.col("two"), F.col(f"{s}_label")).otherwise(F.col(f"{s}_header"))
    return both.filter("a_value is not null and b_value is not null").select(*_PAIR, side("a").alias("first"), side("b").alias("second"), difference.alias("difference"), (~F.col("two") & (F.contains("a_raw", F.lit("%")) | F.contains("b_raw", F.lit("%")))).alias("points"))


def asked_ratios(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id, table_id, first, second, header, ratio, kind of requests that ask for one, in the first named column that has a number: 'share', the first named row in percent of the total row to one decimal; 'multiple', the first two rows of the question to two. Nothing where a number is missing or the divisor is zero, nor where a share column is asked for beside another."""
    numbers = cells.filter(parse_number(F.col("raw")).isNotNull()).select("table_id", "col_ix").distinct().groupBy("table_id").agg(F.collect_set("col_ix").alias("numeric"))
    named = _named(asked, cells).filter(F.size("rows") >= 1).join(numbers, "table_id").join(_totals(cells, "合计|总计"), "table_id", "left")
    question = F.col("question")
    stated = F.contains(question, F.lit("占比")) & (F.size("columns") >= 2) & ~_any(question, ("占合计", "比例约"))
    column = F.get(F.filter("columns", lambda c: F.array_contains("numeric", c["col_ix"])), F.lit(0))["col_ix"]
    share = F.contains(question, F.lit("占"))
    multiple = _any(question, MULTIPLE_CUES) & (F.size("rows") >= 2)
    kind = F.when(share, "share").when(multiple, "multiple")
    wanted = named.filter(~stated).select(*_PAIR, kind.alias("kind"), column.alias("a_col"), column.alias("b_col"), F.when(share, F.col("rows")[0]["row_ix"]).otherwise(F.col("told")[0]["row_ix"]).alias("a_row"), F.when(share, F.col("total_row")).otherwise(F.get("told", F.lit(1))["row_ix"]).alias("b_row")).filter("kind is not null")
    both = wanted.join(_cell(cells, "a"), ["table_id", "a_row", "a_col"]).join(_cell(cells, "b"), ["table_id", "b_row", "b_col"])
    ratio = F.when(F.col("kind") == "share", F.round(F.try_divide("a_value", "b_value") * 100, 1)).otherwise(F.round(F.try_divide("a_value", "b_value"), 2))
    return both.withColumn("ratio", ratio).filter("ratio is not null").select(*_PAIR, F.col("a_label").alias("first"), F.col("b_label").alias("second"), F.col("a_header").alias("header"), "ratio", "kind")


def stated_share(cells: DataFrame, condition: Column, header: str = "占比") -> DataFrame:
    """table_id, header, part, total, share_pct, stated_pct per column of numbers: the sum of the rows that fit, the table's own total, the part's share, and the sum of what the share column says of these rows (null without one)."""
    is_total = F.col("row_label").rlike("合计|总计|(?i:total)")
    value = F.coalesce(parse_number(F.col("raw")), F.lit(None).cast("double")).cast("decimal(28,4)")
    fits = condition & ~is_total
    sums = cells.groupBy("table_id", "header").agg(F.sum(F.when(fits, value)).cast("double").alias("part"), F.min_by(F.when(is_total, value), F.when(is_total, F.col("row_ix"))).cast("double").alias("total"))
    stated = sums.filter(normal_cell(F.col("header")) == normal_cell(F.lit(header))).select("table_id", F.col("part").alias("stated_pct"))
    rest = sums.filter((normal_cell(F.col("header")) != normal_cell(F.lit(header))) & F.col("part").isNotNull() & F.col("total").isNotNull())
    return rest.join(stated, "table_id", "left").select("table_id", "header", "part", "total", (F.try_divide("part", "total") * 100).alias("share_pct"), "stated_pct")


def table_texts(cells: DataFrame, known: DataFrame) -> DataFrame:
    """table_id, content, sha256, changed: a table's rows as lines of cells between bars, from cells with the header as row 0 and labels as column 0; ``changed`` where ``known`` (table_id, sha256) has another hash or none. Rows and cells are in the order of their numbers."""
    lines = cells.groupBy("table_id", "row_ix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", F.coalesce("raw", F.lit("")).alias("raw")))), lambda c: c["raw"]), " | ").alias("line"))
    texts = lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "line"))), lambda r: r["line"]), "\n").alias("content")).withColumn("sha256", F.sha2("content", 256))
    old = known.select("table_id", F.col("sha256").alias("old"))
    return texts.join(old, "table_id", "left").select("table_id", "content", "sha256", (~F.col("sha256").eqNullSafe(F.col("old"))).alias("changed"))
