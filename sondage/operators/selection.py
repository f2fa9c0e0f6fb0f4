"""From ranked candidates to evidence: roles, quotes, scores, and a choice under several limits at once.

Everything is columns: quotes are units scored and put in order as arrays of structs, and the choice is a fold over a request's ordered candidates. A request has at most a few dozen candidates (the k of the retrieval before); work grows with the number of requests.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import semantic_tokens

#: Markers of a content's role, in the order in which they are tried.
BOILERPLATE_MARKERS = ("synthetic deployment validation data", "target file size", "confidential |", "all rights reserved")
PROVENANCE_MARKERS = ("[sources]", "source:", "sources:", "official results", "public baseline", "synthetic test data", "synthetic validation data", "illustrative synthetic", "generated visual", "imagegen", "http://", "https://")
METHODOLOGY_MARKERS = ("deterministic synthetic test", "implemented with", "editable native powerpoint", "dual-axis effect", "for testing")
RISK_MARKERS = ("risk", "concern", "challenge", "pressure", "underperform", "deteriorat", "decline", "drop", "below target", "warning", "breach", "volatile", "volatility", "风险", "担忧", "挑战", "承压", "恶化", "下降", "下滑", "未达", "低于目标", "波动", "集中", "预警", "红色", "黄色")
MANAGEMENT_MARKERS = ("priority", "action", "control", "mitigation", "optimize", "reduce", "remediate", "needs improvement", "requires", "需要", "行动", "优先事项", "缓释", "改善", "校准", "修复", "控制", "降低", "优化")
#: A short line with one of these says something and is no heading.
PREDICATE_MARKERS = ("above limit", "below target", "breach", "concern", "declin", "deteriorat", "fell", "increased", "pressure", "underperform", "volatile", "volatility", "warning", "承压", "控制", "超过", "低于", "高于", "集中在", "集中度", "下滑", "下降", "恶化", "未达", "波动", "担忧", "挑战", "预警")
#: How a request asks for a number, for sources, for methods.
NUMBER_CUES = ("多少", "数值", "金额", "百分比", "准确", "exact", "value", "amount", "percentage", "percent")
AMOUNT_CUES = ("多少", "数值", "准确值", "变化", "增长", "value", "how much", "change", "growth")
SOURCE_CUES = ("来源", "出处", "公开披露", "数据源", "source", "provenance", "official disclosure", "public baseline")
METHOD_CUES = ("方法", "口径", "生成方式", "模拟数据", "method", "methodology", "synthetic", "calculation basis")
#: Words of a request that are no terms of it.
REQUEST_STOPWORDS = ("what", "which", "where", "when", "this", "that", "with", "from", "have", "in", "is", "of", "are", "to", "does", "the", "and", "ppt", "deck", "presentation", "什么", "哪些", "这个", "这份", "一下")
TASK_STOPWORDS = ("what", "which", "this", "that", "with", "from", "directly", "evidence")
#: What a role adds to a candidate's score.
ROLE_BONUS = {"business_fact": "0.4", "management_insight": "0.8", "risk_signal": "1.0", "table": "0.6", "chart": "0.6", "provenance": "0.3", "methodology": "-0.8", "boilerplate": "-1.5"}

#: Blanks: ASCII ones, the no-break and the ideographic space.
BLANK = r"[\x09-\x0D\x20\x{a0}\x{3000}]"
_CJK = r"\x{4e00}-\x{9fff}"
_STAKE = "\x01"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row: the optimiser puts expressions into every later use of theirs otherwise."""
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_held")).select(*df.columns, "_held.*")


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast: both sides have rows for each request, and file sizes say little about how many."""
    return df.hint("merge")


def _any(text: Column, markers: Iterable[str]) -> Column:
    return functools.reduce(operator.or_, (F.contains(text, F.lit(m)) for m in markers))


def _count(text: Column, markers: Iterable[str]) -> Column:
    """How many of the markers the text has."""
    return F.size(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def lines(text: Column) -> Column:
    return _filled(F.split(text, r"[\n\r\x0b\x0c]+"))


def content_role(content: Column, chunk_type: Column, persisted: Column | None = None) -> Column:
    """boilerplate, provenance, methodology, table, chart, risk_signal, management_insight or business_fact: the first rule that holds. A role given before stands; no type counts as text."""
    kind = F.lower(F.coalesce(chunk_type, F.lit("text")))

    def of(folded: Column) -> Column:
        return (
            F.when(folded.rlike(r"^\d{0,3}$"), "boilerplate")
            .when(_any(folded, BOILERPLATE_MARKERS), "boilerplate")
            .when((kind == "notes") | _any(folded, PROVENANCE_MARKERS), F.when(_any(folded, METHODOLOGY_MARKERS), "methodology").otherwise("provenance"))
            .when(kind == "table", "table")
            .when(kind.startswith("chart"), "chart")
            .when(_any(folded, RISK_MARKERS), "risk_signal")
            .when(_any(folded, MANAGEMENT_MARKERS), "management_insight")
            .otherwise("business_fact")
        )

    role = let(F.lower(strip(F.coalesce(content, F.lit("")))), of)
    return role if persisted is None else F.coalesce(F.nullif(persisted, F.lit("")), role)


def request_terms(text: Column, stopwords: Iterable[str] = REQUEST_STOPWORDS) -> Column:
    """Distinct ASCII words of two characters or more and CJK phrases, without stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9%_-]{{2,}}|[{_CJK}]{{2,}}"), F.lit(0)), F.array(*map(F.lit, stopwords)))


def unit_tenths(unit: Column, terms: Column) -> Column:
    """Ten times the score of a unit of text: 1 for each term in it, 0.8 for each marker of risk, 0.5 for a digit. Whole numbers, so that sums don't depend on their order."""
    own = lambda folded: F.size(F.filter(terms, lambda t: F.contains(folded, t)))
    return let(F.lower(unit), lambda folded: 10 * own(folded) + 8 * _count(folded, RISK_MARKERS)) + F.when(unit.rlike(r"\d"), 5).otherwise(0)


def split_units(text: Column) -> Column:
    """Lines; of a single line sentences, those of more than 800 characters cut into clauses."""
    marked = lambda x, marks, blanks: F.regexp_replace(x, rf"([{marks}]){BLANK}{blanks}", rf"$1{_STAKE}")
    sentences = _filled(F.split(marked(strip(text), "。！？!?;；.", "+"), _STAKE))

    def short(unit: Column) -> Column:
        parts = _filled(F.split(marked(unit, ",，:：", "*"), _STAKE))
        return F.when(F.length(unit) > 800, let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(unit)))).otherwise(F.array(unit))

    return let(lines(text), lambda many: F.when(F.size(many) > 1, many).otherwise(F.flatten(F.transform(sentences, short))))


def _scored(units: Column, terms: Column) -> Column:
    return F.transform(units, lambda u, i: F.struct((-unit_tenths(u, terms)).alias("under"), i.alias("at")))


def _best(units: Column, terms: Column, most: int, else_first: int) -> Column:
    """Numbers of the ``most`` best units with a score above 0; without such the first ones. Equal ones in text order."""
    found = F.transform(F.filter(F.slice(F.array_sort(_scored(units, terms)), 1, most), lambda s: s["under"] < 0), lambda s: s["at"])
    first = F.filter(F.sequence(F.lit(0), F.lit(else_first - 1)), lambda i: i < F.size(units))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(first))


def _picked(units: Column, numbers: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda i: F.get(units, i))


def extract_quote(content: Column, terms: Column, chunk_type: Column) -> Column:
    """Whole units that answer a request: the best three in text order, each with the unit before it where that is short (240 characters); of a table the header and the best four rows, repeated rows once. Without a unit that scores, the first two, or three rows."""

    def table(rows: Column) -> Column:
        body = F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
        return F.array_join(let(body, lambda b: F.array_distinct(F.concat(F.slice(rows, 1, 1), _picked(b, _best(b, terms, 4, 3))))), "\n")

    def prose(units: Column) -> Column:
        before = lambda best: F.filter(F.transform(best, lambda i: i - 1), lambda i: (i >= 0) & (F.length(F.get(units, i)) <= 240))
        return F.array_join(let(_best(units, terms, 3, 2), lambda best: _picked(units, F.concat(best, before(best)))), "\n")

    def quote(text: Column) -> Column:
        is_table = (F.coalesce(chunk_type, F.lit("text")) == "table") | (F.contains(text, F.lit("|")) & F.contains(text, F.lit("\n")))
        return F.when(text == "", "").when(is_table, let(lines(text), table)).otherwise(let(split_units(text), lambda u: F.when(F.size(u) == 0, text).otherwise(prose(u))))

    return let(strip(content), quote)


def heading_like(content: Column) -> Column:
    """A line that only names what follows: "section ...", a short line in capitals, or at most 90 characters and six words; not where it ends as a sentence or says something."""

    def names(compact: Column) -> Column:
        folded = F.lower(compact)
        capitals = compact.rlike("[A-Z]") & ~compact.rlike("[a-z]") & (F.length(compact) <= 80)
        words = F.regexp_count(compact, F.lit(rf"[A-Za-z0-9%]+|[{_CJK}]{{2,}}"))
        few = (F.length(compact) <= 90) & (words <= 6)
        return F.when(folded.startswith("section "), True).when(compact.rlike("[。.！!？?；;]$"), False).otherwise((capitals | few) & ~_any(folded, PREDICATE_MARKERS))

    return let(strip(F.regexp_replace(content, f"{BLANK}+", " ")), names)


def infer_facet(content: Column, requirements: Column) -> Column:
    """The requirement that shares most tokens with the content, the first of equals; 'directly relevant evidence' where none shares any."""
    scored = lambda own: F.transform(requirements, lambda r, i: F.struct(F.size(F.array_intersect(_facet_tokens(r), own)).alias("shared"), (-i).alias("first"), r.alias("text")))
    best = let(_facet_tokens(content), lambda own: F.array_max(F.filter(scored(own), lambda s: s["shared"] > 0)))
    return F.coalesce(best["text"], F.lit("directly relevant evidence"))


def _facet_tokens(text: Column) -> Column:
    folded = F.lower(text)
    phrases = F.regexp_extract_all(folded, F.lit(rf"[{_CJK}]{{2,}}"), F.lit(0))
    words = F.regexp_extract_all(folded, F.lit("[a-z0-9%_-]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(words, F.filter(phrases, lambda p: F.length(p) <= 4), F.filter(semantic_tokens(folded), lambda t: t.rlike(f"[{_CJK}]"))))


def task_score(fused: Column, role: Column, content: Column, question: Column) -> Column:
    """A candidate's fused score, what its role adds, 0.45 for each term of the request in it (3 at most), and 1.5 for charts and tables where a number is asked for. Exact decimals."""
    bonus = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLE_BONUS.items() for x in kv)), role), F.lit("0")).cast("decimal(4,2)")
    shared = let(F.lower(content), lambda folded: F.size(F.filter(request_terms(question, TASK_STOPWORDS), lambda t: F.contains(folded, t))))
    overlap = F.least(F.lit(300), 45 * shared).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    numeric = F.when(_any(F.lower(question), AMOUNT_CUES) & role.isin("chart", "table"), F.lit("1.5")).otherwise(F.lit("0")).cast("decimal(4,2)")
    return (fused.cast("decimal(28,10)") + bonus + overlap + numeric).cast("decimal(28,10)")


def score_evidence(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates with their role, facet, quote, score and why they are rejected (null: they are not): by 'role', 'visual_numeric', 'empty', 'off_task_context', 'heading_like'.

    candidates: query_id, chunk_id, document_id, slide_id, content, chunk_type, source_kind, fused. requests: query_id, question, requirements, excluded (roles). Sources and methods are evidence only where the question asks for them; numbers read from pictures not where it asks for exact ones.
    """
    rows = candidates.join(requests.select("query_id", "question", "requirements", "excluded"), "query_id")
    rows = hold(rows, role=content_role(F.col("content"), F.col("chunk_type")), terms=request_terms(F.col("question")))
    rows = hold(rows, quote=extract_quote(F.col("content"), F.col("terms"), F.col("chunk_type")), facet=infer_facet(F.col("content"), F.col("requirements")))
    rows = hold(rows, tenths=unit_tenths(F.col("quote"), F.col("terms")))
    context, asked = F.col("role").isin("provenance", "methodology"), F.lower("question")
    unasked = F.when(F.col("role") == "provenance", ~_any(asked, SOURCE_CUES)).when(F.col("role") == "methodology", ~_any(asked, METHOD_CUES)).otherwise(False)
    visual = (F.col("source_kind") == "visual_model") & _any(asked, NUMBER_CUES) & F.col("content").rlike(r"\d")
    rejected = (
        F.when(F.array_contains("excluded", F.col("role")) | unasked, "role")
        .when(F.coalesce(visual, F.lit(False)), "visual_numeric")
        .when(F.col("quote") == "", "empty")
        .when(context & (F.col("tenths") <= 0), "off_task_context")
        .when(F.col("role").isin("business_fact", "risk_signal", "management_insight") & heading_like(F.col("content")), "heading_like")
    )
    base = task_score(F.col("fused"), F.col("role"), F.col("content"), F.col("question"))
    more = F.when(F.col("role").isin("risk_signal", "management_insight", "table", "chart"), 10).otherwise(0)
    score = (base + (F.col("tenths") + more).cast("decimal(20,0)") / F.lit(10).cast("decimal(3,0)")).cast("decimal(28,10)")
    return hold(rows, rejected=rejected, score=score).select("query_id", "chunk_id", "document_id", "slide_id", "role", "facet", "quote", "score", "rejected")


def rejection_counts(scored: DataFrame) -> DataFrame:
    return scored.filter("rejected is not null").groupBy("query_id", "rejected", "role").agg(F.count("*").alias("n"))


def _dedupe_terms(quote: Column) -> Column:
    folded = F.lower(quote)
    words = F.regexp_extract_all(folded, F.lit("[a-z0-9%_.-]{2,}"), F.lit(0))
    return F.array_distinct(F.concat(words, F.filter(semantic_tokens(folded), lambda t: t.rlike(f"[{_CJK}]"))))


_ATOM = "array<struct<chunk_id:bigint,document_id:string,slide_id:bigint,said:string,terms:array<string>,size:int,role:string,facet:string,quote:string,score:decimal(28,10)>>"


def select_evidence(scored: DataFrame, requests: DataFrame, *, most: int = 8, most_chars: int = 8000, per_slide: int = 2) -> DataFrame:
    """The evidence of each request, in the order in which it is taken: query_id, place, chunk_id, document_id, slide_id, role, facet, quote, score, and n_over_budget of the request.

    Candidates are tried by falling score, then slide and chunk. One is taken unless its words are those of one before or nearly so (88 % of the larger set of terms), its slide has ``per_slide`` already, or its quote doesn't fit into what is left of ``most_chars`` (the first always fits), until there are ``most``. Where a request names several documents (requests.document_ids), the first that can be taken of each goes ahead, in their order. n_over_budget counts refusals for length.
    """
    said = F.lower(strip(F.regexp_replace("quote", f"{BLANK}+", " ")))
    item = F.struct("chunk_id", "document_id", "slide_id", said.alias("said"), _dedupe_terms(F.col("quote")).alias("terms"), F.length("quote").alias("size"), "role", "facet", "quote", "score")
    rows = scored.filter("rejected is null").select("query_id", F.struct((-F.col("score")).alias("under"), "slide_id", "chunk_id", item.alias("item")).alias("row"))
    # at most the candidates of one request
    listed = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["item"]).alias("ranked")).join(requests.select("query_id", "document_ids"), "query_id")
    turn = lambda items, ahead: F.transform(items, lambda x: F.struct(F.lit(ahead).alias("ahead"), x.alias("item")))
    scoped = F.flatten(F.transform("document_ids", lambda d: F.filter("ranked", lambda x: x["document_id"] == d)))
    queue = F.concat(F.when(F.size("document_ids") > 1, turn(scoped, True)).otherwise(turn(F.slice("ranked", 1, 0), True)), turn(F.col("ranked"), False))
    zero = F.struct(F.array().cast(_ATOM).alias("atoms"), F.lit(0).alias("chars"), F.lit(0).alias("over"))

    def take(acc: Column, entry: Column) -> Column:
        x, atoms = entry["item"], acc["atoms"]
        open_ = (F.size(atoms) < most) & ~(entry["ahead"] & F.exists(atoms, lambda a: a["document_id"] == x["document_id"]))
        near = lambda a: F.size(F.array_intersect(a["terms"], x["terms"])) * 100 >= 88 * F.greatest(F.size(a["terms"]), F.size(x["terms"]))
        known = F.exists(atoms, lambda a: (a["said"] == x["said"]) | ((F.size(x["terms"]) > 0) & (F.size(a["terms"]) > 0) & near(a)))
        full = F.size(F.filter(atoms, lambda a: (a["document_id"] == x["document_id"]) & (a["slide_id"] == x["slide_id"]))) >= per_slide
        fits = (F.size(atoms) == 0) | (acc["chars"] + x["size"] <= most_chars)
        able = open_ & ~known & ~full
        return F.struct(F.when(able & fits, F.concat(atoms, F.array(x).cast(_ATOM))).otherwise(atoms).alias("atoms"), (acc["chars"] + F.when(able & fits, x["size"]).otherwise(0)).alias("chars"), (acc["over"] + (able & ~fits).cast("int")).alias("over"))

    chosen = hold(hold(listed, queue=queue), pack=F.aggregate("queue", zero, take))
    rows = chosen.select("query_id", F.posexplode("pack.atoms").alias("place", "a"), F.col("pack.over").alias("n_over_budget"))
    return rows.select("query_id", (F.col("place") + 1).alias("place"), "a.chunk_id", "a.document_id", "a.slide_id", "a.role", "a.facet", "a.quote", F.round("a.score", 6).cast("double").alias("score"), "n_over_budget")


def answerability(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per request (query_id, deep, document_ids, requirements): n_atoms, missing documents and requirements, and its warning: INSUFFICIENT_EVIDENCE with less than one piece (two where ``deep``), PARTIAL_EVIDENCE_COVERAGE where something is missing, else null."""
    # at most the evidence of one request
    have = evidence.groupBy("query_id").agg(F.count("*").alias("n_atoms"), F.collect_set("document_id").alias("documents"), F.collect_set("facet").alias("facets"))
    rows = requests.join(have, "query_id", "left").withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0).cast("long")))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"missing_documents": F.array_except("document_ids", F.coalesce("documents", none)), "missing_facets": F.array_except("requirements", F.coalesce("facets", none))})
    least = F.when(F.col("deep"), 2).otherwise(1)
    warning = F.when(F.col("n_atoms") < least, "INSUFFICIENT_EVIDENCE").when((F.size("missing_documents") > 0) | (F.size("missing_facets") > 0), "PARTIAL_EVIDENCE_COVERAGE")
    return rows.select("query_id", "n_atoms", "missing_documents", "missing_facets", warning.alias("warning"))


def document_anchors(asked: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """query_id, document_id, chunk_id, place, score: the ``k`` tables and charts of each document that a broad request names, so that no document goes without facts: by task score, number of digits and slide, the best of each slide first.

    asked: query_id, question, document_id; chunks: chunk_id, document_id, slide_id, slide_no, content, chunk_type. Of equal ones the lower chunk is first; a null content has no digits.
    """
    facts = chunks.filter((F.col("chunk_type") == "table") | F.startswith("chunk_type", F.lit("chart")))
    rows = hold(asked.select("query_id", "question", "document_id").distinct().join(facts, "document_id"), role=content_role(F.col("content"), F.col("chunk_type")))
    rows = rows.withColumns({"score": task_score(F.lit(0), F.col("role"), F.coalesce("content", F.lit("")), F.col("question")), "digits": F.regexp_count(F.coalesce("content", F.lit("")), F.lit("[0-9]"))})
    by = [F.desc("score"), F.desc("digits"), F.coalesce("slide_no", F.lit(0)), F.col("chunk_id")]
    pair = Window.partitionBy("query_id", "document_id")
    turned = rows.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "document_id", "slide_id").orderBy(*by)) > 1)
    return turned.withColumn("place", F.row_number().over(pair.orderBy("again", *by))).filter(F.col("place") <= k).select("query_id", "document_id", "chunk_id", "place", "score")
