"""What a request asks for, as facets with checks, and how far evidence meets them.

A facet is a row: a part of the question, its subject, its constraints, and any number of validators from a table of rules. Facets meet their request's evidence in an equal join; of the evidence that is about a facet and reliable, one text is made (a request has at most a few dozen pieces), and each validator is a predicate on it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import semantic_tokens
from sondage.operators.mentions import mention_join
from sondage.operators.scope import constraint_satisfied
from sondage.operators.selection import _any, apart, hold, let, strip

#: Words of a question by which it asks for a validator, and words of evidence that meet one.
COMPARISON = ("同比", "环比", "增长", "增速", "变化", "变动", "增加", "提高", "下降", "降低", "差异", "相差", "比较", "compare", "growth", "grow", "change", "increase", "decrease")
DRIVER = ("主要来自", "来自哪些", "增长来源", "贡献增长", "增长贡献", "驱动", "归因", "为什么", "原因", "contribut", "driv", "drove", "driven", "mainly from", "why", "reason")
ATTRIBUTION_EVIDENCE = ("主要来自", "增长来源", "贡献", "驱动", "推动", "带动", "归因", "contribut", "driv", "drove", "driven", "mainly from", "attribut")
SEGMENT = ("业务板块", "板块", "市场", "地区", "区域", "产品线", "渠道", "segment", "market", "region", "product line", "channel")
SOURCE = ("来源", "出处", "数据源", "公开披露", "source", "provenance", "disclosure")
ACTION = ("建议", "行动", "措施", "改善", "优化", "怎么办", "recommend", "action", "improve", "mitigat")
ACTION_REQUEST = ("建议", "行动", "措施", "怎么办", "recommend", "action", "mitigat")
DEFINITION = ("是什么意思", "什么含义", "定义", "解释", "meaning", "definition", "define")
VALUE = ("多少", "数值", "金额", "比例", "value", "amount", "how much")
DECISION = ("是否", "达标", "阈值", "限额", "超限", "越线", "whether", "threshold", "target", "limit", "breach")
ANALYSIS = ("解读", "分析", "说明了什么", "怎么看", "interpret", "analy", "what does", "show")
#: How questions name periods and charts.
PERIOD = r"20[0-9]{2}年|(?:FY|CY)?20[0-9]{2}|Q[1-4]|H[12]|第[一二三四1-4]季度"
VISUAL = r"图(?:表)?|柱(?:状|形)?图|折线|坐标轴|系列|charts?|graphs?|plots?|axes|axis|series|bars?|columns?|lines?"
#: Polite openings, and words by which any evidence would match.
OPENING = r"^(?:请问|请帮我|请|what is|what was|how much did|how much|compare)[ \t]*"
NEUTRAL = ("answer", "evidence", "supported", "support", "directly", "relevant", "explain", "summarize", "identify", "state", "give", "use", "回答", "证据", "支持", "直接", "相关", "说明", "总结", "概括", "识别", "给出", "使用", "用户", "问题")
#: Evidence that comes from a calculation.
CALCULATED = ("native_chart_calculation", "native_table_calculation", "native_chart_analysis_bundle")

_CJK = r"\x{4e00}-\x{9fff}"


def _insensitive(pattern: str) -> str:
    return f"(?i){pattern}"


def terms(text: Column) -> Column:
    """ASCII words of two characters or more, CJK phrases of at most four, and pairs of neighbouring CJK characters."""

    def of(folded: Column) -> Column:
        runs = F.regexp_extract_all(folded, F.lit(f"[{_CJK}]{{2,}}"), F.lit(0))
        pairs = F.filter(semantic_tokens(folded), lambda t: t.rlike(f"[{_CJK}]"))
        return F.array_distinct(F.concat(F.regexp_extract_all(folded, F.lit("[a-z0-9%_.-]{2,}"), F.lit(0)), F.filter(runs, lambda p: F.length(p) <= 4), pairs))

    return let(F.lower(text), of)


def _telling(text: Column) -> Column:
    return F.array_except(terms(text), F.array(*map(F.lit, NEUTRAL)))


def canonical_subject(text: Column) -> Column:
    """What a phrase is about: its first four ASCII words joined by "_", else its Chinese characters (24 at most); without what locates a chart, periods, and counting words at the end."""
    x = F.regexp_replace(strip(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), r"^[ ,，、:：?？]+|[ ,，、:：?？]+$", "")
    x = F.regexp_replace(x, r"^.*(?:表|图|矩阵)(?:中|的)?", "")
    x = F.regexp_replace(x, _insensitive(PERIOD), "")
    x = F.regexp_replace(x, r"(?:从|由)[ ]*[^，,]*?(?:到|至)[ ]*[^，,]*$", "")
    x = F.lower(F.regexp_replace(x, r"(?:分别|各自|合计占|合计|占)$", ""))
    return let(x, lambda y: let(F.regexp_extract_all(y, F.lit("[a-z][a-z0-9_-]+"), F.lit(0)), lambda w: F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, 4), "_")).otherwise(F.substring(F.regexp_replace(y, f"[^{_CJK}]", ""), 1, 24))))


def _some(cases: Iterable[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cases)))


def validators(text: Column) -> Column:
    """The checks that a request asks for: direct_support always, others by its words."""

    def of(folded: Column) -> Column:
        better = folded.rlike(r"(?:如何|怎么)优?化|(?:如何|怎么)(?:改善|提高|降低)|how\s+(?:to|should|can)\b[^?.!]*(?:improve|optimi[sz]e|reduce)")
        decided = _any(folded, DECISION)
        return _some((("direct_support", F.lit(True)), ("provenance", _any(folded, SOURCE)), ("attribution", _any(folded, DRIVER)), ("action", _any(folded, ACTION_REQUEST) | better), ("definition", _any(folded, DEFINITION)), ("comparison", _any(folded, COMPARISON)), ("numeric", _any(folded, VALUE) | decided), ("decision_criterion", decided), ("visual_analysis", folded.rlike(VISUAL) & _any(folded, ANALYSIS))))

    return let(F.lower(text), of)


def _parts(question: Column) -> Column:
    """Clauses in order, repeated ones too."""
    found = F.filter(F.transform(F.split(question, r"[?？!！;；。]+"), lambda c: F.trim(c, F.lit(" ,，"))), lambda x: x != "")
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(question)))


def _once(df: DataFrame) -> DataFrame:
    """``df`` computed now, on the executors' disks: each later use would compute it anew."""
    return df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)


def evidence_contract(requests: DataFrame, glossary: DataFrame) -> DataFrame:
    """Facets of requests (query_id, question, deep): query_id, facet_no, facet_id, label, subject, aliases, constraints, validators, minimum, match_terms, semantic_required.

    Each clause is a facet with the validators that it, and the clause that it shares most terms with, ask for; one about numbers has a facet for each metric that it names before its cue: terms of the glossary (term, alias), else the words themselves. Equal facets of a request count once. A lone plain question of a ``deep`` request needs two pieces of evidence from two places.
    """
    glossary = glossary.select("term", "alias").union(glossary.select("term", "term")).distinct()  # a term is a name of itself
    asked = hold(requests.select("query_id", F.trim("question").alias("question"), "deep"), parts=_parts(F.trim("question")))
    asked = hold(asked, visual=let(F.lower("question"), lambda q: q.rlike(VISUAL) & _any(q, ANALYSIS)), tokens=F.transform("parts", terms))
    rows = asked.select("query_id", "deep", "visual", "parts", "tokens", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part_no", "requirement"))
    own = F.get("tokens", F.col("part_no"))
    nearest = F.array_max(F.transform("tokens", lambda t, i: F.struct(F.size(F.array_intersect(t, own)).alias("n"), (-i).alias("i"))))
    rows = hold(rows, clause=F.get("parts", -nearest["i"]), match_terms=F.array_sort(F.array_except(own, F.array(*map(F.lit, NEUTRAL))))).drop("parts", "tokens")
    context = F.when(F.col("clause") == F.col("requirement"), F.col("requirement")).otherwise(F.concat_ws(" ", "requirement", "clause"))
    rows = hold(rows, context=context)
    rows = hold(rows, validators=F.array_distinct(F.concat(validators(F.col("context")), F.when(F.col("visual"), F.array(F.lit("visual_analysis"))).otherwise(F.array().cast("array<string>")))), constraints=F.array_distinct(F.regexp_extract_all("context", F.lit(_insensitive(PERIOD)), F.lit(0))))
    plain = F.size("validators") == 1
    quantitative = F.array_contains("validators", F.lit("numeric"))
    rows = rows.withColumns({"minimum": F.when(plain & (F.col("n_parts") == 1) & F.col("deep"), 2).otherwise(1), "semantic_required": plain & (F.col("n_parts") > 1), "quantitative": quantitative})
    rows = _once(rows)

    # the metrics that stand before the cue of a clause
    folded = lambda text: F.regexp_replace(text, _insensitive(OPENING), "")

    def boundary(low: Column) -> Column:
        at = lambda markers: F.array_min(F.filter(F.array(*(F.instr(low, F.lit(m)) for m in markers)), lambda k: k > 0))
        primary = (*VALUE, *DECISION)
        return F.coalesce(F.when(_any(low, primary), at(primary)).otherwise(at(COMPARISON)), F.length(low) + 1)

    metric = hold(rows.filter("quantitative").select("query_id", "part_no", "clause"), working=folded(F.col("clause")))
    metric = hold(metric, prefix=F.regexp_replace(strip(F.element_at(F.split(F.substring(F.col("working"), F.lit(1), boundary(F.lower("working")) - 1), "[,，:：]"), -1)), "(?:分别|各自)$", ""))
    metric = hold(metric, pieces=F.split(F.col("prefix"), r"(?i)[ \t]*(?:、|，|,|和|及|与|\band\b)[ \t]*"))
    pieces = metric.select("query_id", "part_no", "working", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("piece_no", "piece"))
    pieces = pieces.withColumn("text_id", F.concat_ws("\x01", F.col("query_id").cast("string"), F.col("part_no").cast("string"), F.col("piece_no").cast("string")))
    pieces = _once(pieces)
    hits = mention_join(glossary.select(F.col("term").alias("label_id"), F.col("alias").alias("label")), pieces.select("text_id", F.col("piece").alias("text")))
    # a left join, though each term is there: so hits, whose number grows with the requests, are never broadcast
    hits = hits.select("text_id", F.col("label_id").alias("term")).distinct().join(glossary, "term", "left").join(apart(pieces.select("text_id", "n_pieces", F.lower("working").alias("working"))), "text_id")
    # the last one named before a cue; of one piece among several the longest name
    last = F.length("working") - F.instr(F.reverse("working"), F.reverse(F.lower("alias"))) - F.length("alias") + 1
    place = F.when(F.instr("working", F.lower("alias")) > 0, last).otherwise(-1)
    ranked = hits.groupBy("text_id", "n_pieces", "term").agg(F.max(place).alias("place")).withColumn("best", F.when(F.col("n_pieces") == 1, F.col("place")).otherwise(F.length("term")))
    top = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("best"), "term"))).filter("nth = 1").select("text_id", "term")
    term_subject = let(F.regexp_extract_all(F.lower("term"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.when(F.size(w) > 0, F.array_join(w, "_")).otherwise(canonical_subject(F.col("term"))))
    found = pieces.join(apart(top), "text_id", "left")
    subject = F.when(F.col("term").isNotNull(), term_subject).when(F.col("n_pieces") > 1, canonical_subject(F.col("piece")))
    # a question's pieces: at most the words of a clause
    subjects = hold(found, subject=subject).filter("subject <> ''").groupBy("query_id", "part_no").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "subject"))), lambda s: s["subject"])), 1, 8).alias("subjects"))
    rows = rows.join(apart(subjects), ["query_id", "part_no"], "left")
    segment = let(F.lower("clause"), lambda c: F.slice(F.filter(F.array(*map(F.lit, SEGMENT)), lambda m: F.contains(c, m)), 1, 1))
    none = F.array().cast("array<string>")
    listed = F.when(F.size(F.coalesce("subjects", none)) > 0, F.col("subjects")).when(F.array_contains("validators", F.lit("attribution")), F.transform(segment, lambda s: F.replace(s, F.lit(" "), F.lit("_")))).otherwise(none)
    rows = hold(rows, listed=listed)
    rows = rows.withColumns({"n_subjects": F.size("listed"), "listed": F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.array(F.lit("")))})
    facets = rows.select("*", F.posexplode("listed").alias("subject_no", "subject"))
    label = F.when(F.col("n_subjects") > 1, F.concat(F.replace("subject", F.lit("_"), F.lit(" ")), F.lit(": "), "requirement")).otherwise(F.col("requirement"))
    facets = hold(facets, label=label)
    key = F.when(F.col("subject") != "", F.col("subject")).otherwise(F.substring(F.sha1(F.lower("label").cast("binary")), 1, 10))
    facets = hold(facets, facet_id=F.concat_ws(":", F.lit("requirement"), F.array_join("validators", "+"), key))
    first = Window.partitionBy("query_id", "facet_id").orderBy("part_no", "subject_no")
    facets = facets.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    facets = facets.withColumn("facet_no", F.row_number().over(Window.partitionBy("query_id").orderBy("part_no", "subject_no")))
    facets = _once(facets)
    # a subject is also known by its words, and by all names of a term that has it as one
    spaced = F.replace("subject", F.lit("_"), F.lit(" "))
    bare = lambda c: F.regexp_replace(F.lower(c), f"[^a-z0-9{_CJK}]", "")
    subjects = hold(facets.filter("subject <> ''").select("subject").distinct(), key=bare(spaced))
    others = glossary.select("term", bare("alias").alias("key")).distinct().join(subjects, "key").select("subject", "term").distinct().join(glossary.select("term", F.lower("alias").alias("alias")), "term")
    others = others.groupBy("subject").agg(F.array_sort(F.collect_set("alias")).alias("others"))  # names of one term or two
    words = F.filter(F.split(spaced, " "), lambda w: F.length(w) > 1)
    aliases = F.when(F.col("subject") == "", none).otherwise(F.filter(F.array_distinct(F.concat(F.array(spaced), words, F.coalesce("others", none))), lambda a: a != ""))
    return facets.join(others, "subject", "left").select("query_id", "facet_no", "facet_id", "label", "subject", aliases.alias("aliases"), "constraints", "validators", "minimum", "match_terms", "semantic_required")


def evaluate_coverage(facets: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, facet_no, facet_id, label, status, missing, evidence_ids of each facet.

    evidence: query_id, evidence_id, place, text, role, extraction, source_kind, confidence, document_id, slide_id. A facet is *supported* if its reliable evidence (confidence 0.65; for numbers not read from a picture) meets every validator and constraint and comes from enough places, *partial* if it doesn't, *unreliable* if all that is about it is not reliable, *unsupported* if nothing is.
    """
    told = hold(evidence, folded=F.lower("text"), tokens=_telling(F.col("text")))
    pairs = facets.select("query_id", "facet_no", "subject", "aliases", "validators", "match_terms", "semantic_required").join(apart(told), "query_id")
    subject_terms = _telling(F.replace("subject", F.lit("_"), F.lit(" ")))
    half = let(subject_terms, lambda s: (F.size(s) > 0) & (2 * F.size(F.array_intersect(s, F.col("tokens"))) >= F.size(s)))
    driven = F.array_contains("validators", F.lit("attribution")) & _any(F.col("folded"), (*SEGMENT, *COMPARISON))
    about = F.when(F.size("aliases") > 0, F.exists("aliases", lambda a: F.contains(F.col("folded"), a)) | half | driven).otherwise(~F.col("semantic_required") | F.arrays_overlap("match_terms", "tokens"))
    reliable = (F.coalesce("confidence", F.lit(1.0)) >= 0.65) & ~((F.coalesce("source_kind", F.lit("")) == "visual_model") & F.array_contains("validators", F.lit("numeric")))
    related = hold(pairs, about=about, reliable=reliable).filter("about")
    piece = F.struct("place", "evidence_id", "text", "role", "extraction", "document_id", "slide_id", "reliable")
    # at most the evidence of one request
    met = related.groupBy("query_id", "facet_no").agg(F.array_sort(F.collect_list(piece)).alias("related"))
    rows = facets.join(apart(met), ["query_id", "facet_no"], "left").withColumn("related", F.coalesce("related", F.slice(F.array(F.struct(F.lit(None).cast(evidence.schema["place"].dataType).alias("place"), F.lit(None).cast(evidence.schema["evidence_id"].dataType).alias("evidence_id"), *(F.lit(None).cast("string").alias(n) for n in ("text", "role", "extraction")), F.lit(None).cast(evidence.schema["document_id"].dataType).alias("document_id"), F.lit(None).cast(evidence.schema["slide_id"].dataType).alias("slide_id"), F.lit(None).cast("boolean").alias("reliable"))), 1, 0)))
    rows = hold(rows, sound=F.filter("related", lambda r: r["reliable"]))
    rows = hold(rows, text=F.array_join(F.transform("sound", lambda r: r["text"]), "\n"))
    rows = hold(rows, folded=F.lower("text"))
    text, folded = F.col("text"), F.col("folded")
    has_role = lambda *names: F.exists("sound", lambda r: r["role"].isin(*names))
    made_by = lambda *names: F.exists("sound", lambda r: r["extraction"].isin(*names))
    some = strip(text) != ""
    checks = {
        "direct_support": some,
        "provenance": has_role("provenance", "methodology") | _any(folded, SOURCE),
        "attribution": _any(folded, ATTRIBUTION_EVIDENCE),
        "action": has_role("management_insight") | _any(folded, ACTION),
        "definition": some & ~text.rlike(r"\A[\s\p{Punct}]*[0-9][0-9\s.,%]*\z"),
        "comparison": made_by(*CALCULATED) | text.rlike(_insensitive(PERIOD)) | text.rlike(r"(?i)[0-9]{2}/[0-9]{1,2}|同比|环比|[+-][0-9]|higher|lower|increase|decrease"),
        "numeric": text.rlike("[0-9]"),
        "decision_criterion": _any(folded, DECISION) & folded.rlike("above|below|within|exceed|高于|低于|超过|范围内|突破"),
        "visual_analysis": made_by("native_chart_analysis_bundle"),
    }
    failed = [(n, F.array_contains("validators", F.lit(n)) & ~F.coalesce(c, F.lit(False))) for n, c in checks.items()]
    failed.append(("explicit_constraints", ~F.forall("constraints", lambda c: constraint_satisfied(c, text))))
    failed.append(("evidence_breadth", F.size(F.array_distinct(F.transform("sound", lambda r: r["evidence_id"]))) < F.col("minimum")))
    failed.append(("context_breadth", F.size(F.array_distinct(F.transform("sound", lambda r: F.struct(r["document_id"], r["slide_id"])))) < F.col("minimum")))
    rows = hold(rows, missing=_some(failed))
    any_, sound = F.size("related") > 0, F.size("sound") > 0
    status = F.when(~any_, "unsupported").when(~sound, "unreliable").when(F.size("missing") == 0, "supported").otherwise("partial")
    ids = F.transform(F.when(sound, F.col("sound")).otherwise(F.col("related")), lambda r: r["evidence_id"])
    return rows.select("query_id", "facet_no", "facet_id", "label", status.alias("status"), "missing", ids.alias("evidence_ids"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Per query: total, supported, partial, ratio (3 places), gaps (labels that are not supported, in order)."""
    n = lambda s: F.count_if(F.col("status") == s)
    gap = F.when(F.col("status") != "supported", F.struct("facet_no", "label"))
    return covered.groupBy("query_id").agg(F.count("*").alias("total"), n("supported").alias("supported"), n("partial").alias("partial"), F.round(n("supported") / F.count("*"), 3).alias("ratio"), F.transform(F.array_sort(F.collect_list(gap)), lambda g: g["label"]).alias("gaps"))


def facets_of_evidence(covered: DataFrame) -> DataFrame:
    """query_id, evidence_id and the facets that it serves, in order."""
    rows = covered.select("query_id", "facet_no", "facet_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return rows.groupBy("query_id", "evidence_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("facet_no", "facet_id"))), lambda f: f["facet_id"])).alias("facet_ids"))




def fully_answers(facets: DataFrame, evidence: DataFrame, reconciled: DataFrame | None = None) -> DataFrame:
    """query_id, complete: may a calculation's own evidence stand as the whole answer?

    Yes if every facet is supported by it and none asks for no more than direct support; also if a lone facet is supported once its subject is left out, and the evidence has two of the request's terms (all, if fewer). Always for queries of ``reconciled`` (query_id). Facets and evidence as in ``evaluate_coverage``; queries without evidence are not complete.
    """
    own = Window.partitionBy("query_id")
    rows = facets.withColumns({"plain": F.bool_or(F.array_distinct("validators") == F.array(F.lit("direct_support"))).over(own), "n_facets": F.count("*").over(own)})
    told = evidence.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(_telling(F.col("text"))))).alias("told"))  # the evidence of one request
    wanted = F.array_except("match_terms", F.array(*map(F.lit, NEUTRAL)))
    shared = F.size(F.array_intersect(wanted, F.col("told"))) >= F.least(F.lit(2), F.size(wanted))
    version = lambda number, subject, aliases: F.struct(number.cast("int").alias("facet_no"), subject.alias("subject"), aliases.alias("aliases"))
    bare = F.when((F.col("n_facets") == 1) & ~F.col("plain") & (F.col("subject") != "") & shared, version(F.lit(-1), F.lit(""), F.array().cast("array<string>")))
    # both versions of a facet are evaluated in one pass; one that asks for direct support only is made to be never enough
    versions = rows.join(apart(told), "query_id", "left").withColumn("v", F.explode(F.filter(F.array(version(F.col("facet_no"), F.col("subject"), F.col("aliases")), bare), lambda v: v.isNotNull())))
    versions = versions.select("query_id", "v.*", "facet_id", "label", "constraints", "validators", F.when(F.col("plain"), 2**31 - 1).otherwise(F.col("minimum")).alias("minimum"), "match_terms", "semantic_required")
    met, first = F.col("status") == "supported", F.col("facet_no") > 0
    found = evaluate_coverage(versions, evidence).groupBy("query_id").agg((F.every(F.when(first, met)) | F.coalesce(F.bool_or(F.when(~first, met)), F.lit(False))).alias("complete"))
    if reconciled is None:
        return found
    return found.join(apart(reconciled.select("query_id", F.lit(True).alias("sure")).distinct()), "query_id", "left").select("query_id", (F.col("complete") | F.coalesce("sure", F.lit(False))).alias("complete"))
