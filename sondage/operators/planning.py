"""Which chart, lane and evidence a request takes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.operators.search import rrf
from sondage.operators.selection import hold


def _in_common(a: Column, b: Column) -> Column:
    """Size of the common part of two arrays in which values may come several times."""
    n = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, v: acc + F.least(n(a, v), n(b, v)))


def chart_signatures(points: DataFrame, *, family: Column, title: Column) -> DataFrame:
    """What a request is compared with: scope_id, tokens, names (tokens of each series), families, counts (of series per family, where several), lengths (of series), entities. points: scope_id, series_name, and what ``family`` and ``title`` read."""
    series = points.groupBy("scope_id", "series_name").agg(F.count("*").cast("int").alias("length"), F.first(family).alias("family"), F.first(title).alias("title"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]{2,}"), F.lit(0)))
    per_family = series.groupBy("scope_id", "family").agg(F.count("*").cast("int").alias("n"))
    # the series and families of one chart
    families = per_family.groupBy("scope_id").agg(F.array_sort(F.collect_list("family")).alias("families"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("n")))).alias("counts"))
    whole = series.groupBy("scope_id").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list(words(F.concat_ws(" ", "title", "series_name")))))).alias("tokens"), F.array_sort(F.collect_list(words(F.col("series_name")))).alias("names"), F.array_sort(F.collect_list("length")).alias("lengths"), F.when(F.count("*") > 1, F.count("*")).otherwise(F.max("length")).cast("int").alias("entities"))
    return whole.join(families, "scope_id")


def choose_scope(requests: DataFrame, charts: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """request_id, scope_id, score: the chart that fits a request best.

    requests: request_id, tokens, families, series_counts, point_counts; charts: as of ``chart_signatures``; places: request_id, scope_id, on_element, on_slide (how many preferred elements a chart has, whether it is on a preferred slide). A chart scores one for each token in common, 12 for an element, 10 for a slide, 9 for each number of series and 7 for a number of points that is as asked, 5 for each family, 8 for each series named in full, and 48 less for each of the two numbers that is asked for and fails. The greatest score above 0 wins, then more series, then the greater name. Only charts that share a token or a place with the request are looked at.
    """
    side = lambda df, key: df.select(key, F.explode(F.array_distinct("tokens")).alias("token"))
    shared = side(requests, "request_id").join(side(charts, "scope_id"), "token").groupBy("request_id", "scope_id").agg(F.count("*").alias("overlap"))
    if places is not None:
        shared = shared.join(places, ["request_id", "scope_id"], "full_outer")
    else:
        shared = shared.withColumns({"on_element": F.lit(0), "on_slide": F.lit(False)})
    rows = shared.join(requests.withColumnRenamed("tokens", "asked").withColumnRenamed("families", "wanted"), "request_id").join(charts, "scope_id")
    exact = F.size(F.filter("names", lambda n: (F.size(n) > 0) & (F.size(F.array_except(n, F.col("asked"))) == 0)))
    rows = hold(rows, counted=_in_common(F.col("counts"), F.col("series_counts")), pointed=F.arrays_overlap("lengths", "point_counts"), family=F.size(F.array_intersect("wanted", "families")), exact=exact)
    pointed = F.coalesce("pointed", F.lit(False))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    score = zero("overlap", 0) + 12 * zero("on_element", 0) + F.when(zero("on_slide", False), 10).otherwise(0) + 9 * F.col("counted") + F.when(pointed, 7).otherwise(0) + 5 * F.col("family") + 8 * F.col("exact")
    score = score - F.when((F.size("series_counts") > 0) & (F.col("counted") == 0), 48).otherwise(0) - F.when((F.size("point_counts") > 0) & ~pointed, 48).otherwise(0)
    best = rows.withColumn("score", score).groupBy("request_id").agg(F.max(F.struct("score", "entities", "scope_id")).alias("best"))
    return best.filter("best.score > 0").select("request_id", "best.scope_id", "best.score")


def pick_lane(requests: DataFrame, lexical: DataFrame, vector: DataFrame, weights: tuple[float, float] = (1.25, 1.0)) -> DataFrame:
    """query_id, chunk_id, rank, label: each query's candidates by its ``mode`` (fts, vector, hybrid). Where the lane that it asks for is empty the other takes its place, and the label says so; a query without candidates has no rows."""
    have = lambda lane, name: lane.select("query_id").distinct().withColumn(name, F.lit(True))
    state = requests.join(have(lexical, "has_lexical"), "query_id", "left").join(have(vector, "has_vector"), "query_id", "left")
    lexical_in, vector_in = F.coalesce("has_lexical", F.lit(False)), F.coalesce("has_vector", F.lit(False))
    label = (
        F.when(F.col("mode") == "fts", "lexical")
        .when(~vector_in, "lexical+vector_fallback")
        .when(F.col("mode") == "vector", "vector")
        .when(~lexical_in, "vector+lexical_empty")
        .otherwise("hybrid_rrf")
    )
    state = state.select("query_id", label.alias("label"))
    of = lambda *labels: state.filter(F.col("label").isin(*labels)).select("query_id", "label")
    lane = lambda df, *labels: df.select("query_id", "chunk_id", "rank").join(of(*labels), "query_id")
    fused_for = of("hybrid_rrf")
    both = [x.join(fused_for.select("query_id"), "query_id", "left_semi") for x in (lexical, vector)]
    fused = rrf([("lexical", both[0], weights[0]), ("vector", both[1], weights[1])]).select("query_id", "chunk_id", "rank").join(fused_for, "query_id")
    return lane(lexical, "lexical", "lexical+vector_fallback").unionByName(lane(vector, "vector", "vector+lexical_empty")).unionByName(fused)


def merge_evidence(calculated: DataFrame, retrieved: DataFrame, *, only_slide: bool = False) -> DataFrame:
    """query_id, place, slide_id, element_id, chunk_id, quote, source: evidence of calculations first, then what was retrieved; of rows with one slide, element (else chunk) and quote the first. ``only_slide``: of what was retrieved only that on a slide of the query's calculations, where it has any. Both: query_id, place, slide_id, element_id, chunk_id, quote."""
    if only_slide:
        slides = calculated.select("query_id", "slide_id").distinct()
        on = retrieved.join(slides, ["query_id", "slide_id"], "left_semi")
        retrieved = on.unionByName(retrieved.join(slides.select("query_id").distinct(), "query_id", "left_anti").select(*on.columns))
    rows = calculated.withColumns({"turn": F.lit(1), "source": F.lit("calculation")}).unionByName(retrieved.withColumns({"turn": F.lit(2), "source": F.lit("retrieval")}))
    where = F.coalesce(F.nullif("element_id", F.lit("")), F.col("chunk_id").cast("string"))
    first = Window.partitionBy("query_id", "slide_id", where, "quote").orderBy("turn", "place")
    kept = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "place", "chunk_id", "slide_id", "quote"))).select("query_id", "place", "slide_id", "element_id", "chunk_id", "quote", "source")


def expected_terms_hit(ranked: DataFrame, chunks: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """n_queries, hit_rate: of the queries with expected terms (query_id, term) the share of those of which the first ``k`` chunks hold every term, without regard to case."""
    top = ranked.filter(F.col("rank") <= k).select("query_id", "chunk_id").join(chunks.select("chunk_id", F.lower("content").alias("content")), "chunk_id")
    held = expected.select("query_id", F.lower("term").alias("term")).distinct().join(top, "query_id", "left").groupBy("query_id", "term").agg(F.max(F.coalesce(F.contains("content", F.col("term")), F.lit(False))).alias("held"))
    hits = held.groupBy("query_id").agg(F.every("held").alias("hit"))
    return hits.agg(F.count("*").alias("n_queries"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


#: Words of one field, and paraphrases of a request, each with the vocabulary to search for.
FIELD_WORDS = (
    (("revenue", "sales", "营收", "收入"), "revenue sales 营收 收入"),
    (("profit", "earnings", "利润", "盈利"), "profit earnings 利润 盈利"),
    (("margin", "利润率", "价值率"), "margin rate 利润率 价值率"),
    (("growth", "增长", "增速"), "growth increase 增长 增速"),
    (("risk", "风险"), "risk exposure warning threshold limit current trend 风险 暴露 预警 阈值 限额 当前 趋势"),
    (("capital", "资本"), "capital solvency buffer 资本 偿付能力 缓冲"),
    (("customer", "客户"), "customer retention persistency 客户 留存 继续率"),
    (("channel", "渠道"), "channel distribution productivity 渠道 分销 产能"),
    (("target", "budget", "目标", "预算"), "target budget attainment variance 目标 预算 达成 偏差"),
)
PARAPHRASES = (
    (("总结", "概括", "概览", "summarize", "summary", "overview", "key takeaways"), "executive summary key facts metrics drivers risks actions 执行摘要 核心事实 指标 驱动 风险 行动"),
    (("表现如何", "情况如何", "经营情况", "经营状况", "经营表现", "业务情况", "业绩", "performance", "how is", "how did", "how is the business", "how is the company doing"), "performance results revenue margin growth profitability cash capital operations 业绩 营收 利润率 增长 盈利 现金 资本 运营"),
    (("bad news", "potential issue", "weak spot", "warning sign", "潜在问题", "潜在的问题", "隐患", "短板", "警惕", "主要风险"), "risk concern decline pressure below target threshold concentration 风险 担忧 下滑 承压 未达标 阈值 集中度"),
    (("优势", "亮点", "强项", "strength", "stand out", "competitive edge"), "strength growth outperformance above target resilience 优势 增长 领先 超目标 韧性"),
    (("来源", "公开披露", "模拟数据", "source", "official", "synthetic"), "source provenance official disclosure synthetic boundary 数据来源 公开披露 模拟数据 口径边界"),
    (("什么意思", "什么含义", "是指什么", "what does", "meaning", "define"), "definition meaning terminology 定义 含义 术语"),
    (("趋势", "变化", "比较", "对比", "trend", "change", "compare"), "trend change comparison period start latest 趋势 变化 比较 起始期 最新期"),
    (("集中", "集中度", "concentration", "concentrated", "diversification"), "concentration diversification mix share top current threshold 集中度 多元化 组合 占比 当前 阈值"),
)
FOCUS_STOPWORDS = ("what", "which", "this", "that", "the", "and", "with", "from", "please", "ppt", "请问", "请帮我", "一下", "当前", "这个", "这份")
_HAN = r"[\x{4e00}-\x{9fff}]"


def spread(values: list[str], n: int) -> list[str]:
    """At most ``n`` values, evenly from first to last; places half-way go to the even one."""
    if len(values) <= n:
        return values
    return [values[round(k * (len(values) - 1) / (n - 1))] for k in range(n)]


def bridge_lanes(text: str, han: bool) -> list[str]:
    """The words of a vocabulary as lanes of their own: seven of the question's script, then three of the other."""
    words = list(dict.fromkeys(re.findall(r"[a-z0-9%_.-]{2,}|[\u4e00-\u9fff]{2,}", text.lower())))
    is_han = [w for w in words if re.search(r"[\u4e00-\u9fff]", w)]
    other = [w for w in words if w not in is_han]
    return spread(is_han, 7) + spread(other, 3) if han else spread(other, 7) + spread(is_han, 3)


def query_variants(questions: DataFrame, aliases: DataFrame | None = None, *, most: int = 14, longest: int = 300) -> DataFrame:
    """question_id, variant_no, text, kind, weight: at most ``most`` searches for a question (question_id, text): the literal one (1.35), its telling words (1.1), then words that bridge vocabularies, one from each that applies in turn (1.0 for fields, 1.05 for paraphrases), then the names of a term it asks for (``aliases``: question_id, text; 1.1).

    Blanks are one space; a variant that an earlier one equals but for case, an empty one, or one of more than ``longest`` characters is left out. A null or blank question has none.
    """
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    if aliases is None:
        rows = questions.select("question_id", plain.alias("text"), F.lit(None).cast("string").alias("names"))
    else:
        rows = questions.select("question_id", plain.alias("text")).join(aliases.select("question_id", F.col("text").alias("names")), "question_id", "left")
    low, han = F.lower("text"), F.col("text").rlike(_HAN)
    focus = F.filter(F.regexp_extract_all("text", F.lit(f"[A-Za-z0-9%_-]{{2,}}|{_HAN}{{2,}}"), F.lit(0)), lambda w: ~F.lower(w).isin(*FOCUS_STOPWORDS))
    variant = lambda text, kind, weight: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
    bridges = [(words, text, "vocabulary_bridge", 1.0) for words, text in FIELD_WORDS] + [(words, text, "paraphrase_bridge", 1.05) for words, text in PARAPHRASES]
    lanes = lambda text: F.when(han, F.array(*map(F.lit, bridge_lanes(text, True)))).otherwise(F.array(*map(F.lit, bridge_lanes(text, False))))
    groups = F.filter(F.array(*(F.when(low.rlike("|".join(words)), F.struct(lanes(text).alias("lanes"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))) for words, text, kind, weight in bridges)), lambda g: g.isNotNull())
    # each step is computed once for a question: the lambdas of the next name it for every element
    rows = hold(rows.filter("text <> ''"), groups=groups)
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.transform("groups", lambda g: F.struct(F.get(g["lanes"], k).alias("text"), g["kind"].alias("kind"), g["weight"].alias("weight")))))
    told = F.concat(F.array(variant(F.col("text"), "literal", 1.35), variant(F.array_join(focus, " "), "language_focus", 1.1)), turns, F.array(variant(F.trim(F.regexp_replace("names", r"(?U)\s+", " ")), "document_terminology", 1.1)))
    offered = hold(rows, told=F.filter(told, lambda v: F.coalesce((v["text"] != "") & (F.length(v["text"]) <= longest), F.lit(False)))).select("question_id", "told")
    offered = hold(offered, keys=F.transform("told", lambda v: F.lower(v["text"])))
    fresh = F.filter("told", lambda v, k: F.array_position("keys", F.get("keys", k)) == k + 1)
    return offered.select("question_id", F.posexplode(F.slice(fresh, 1, most)).alias("at", "v")).select("question_id", (F.col("at") + 1).alias("variant_no"), "v.text", "v.kind", "v.weight")
