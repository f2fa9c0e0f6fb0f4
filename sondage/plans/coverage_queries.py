"""Evidence contracts of questions about parts, and how far statements about them meet these."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import coverage
from sondage.sources.bindings import spread, table

from .registry import query
from .selection_queries import _has, _list, _pairs, _strip

_J = r"\x{4e00}-\x{9fff}"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, parts = F.col("p_partkey") % 8, spread(table(spark, sf_dir, "part"), "p_partkey")
    texts = {0: ("What is the ", "p_name", " value in 2024 Q2?"), 1: ("How much did ", "p_name", " and ", "p_brand", " change; why"), 2: ("Show the chart of ", "p_type", "! Interpret it"), 3: ("Which segment drove ", "p_name", "?"), 4: ("Explain ", "p_name", ". Define ", "p_type"), 5: ("Does ", "p_brand", " breach its limit in FY2023; recommend action"), 6: ("p_type", " ", "p_name")}
    joined = lambda bits: F.concat(*(F.col(b) if b.startswith("p_") else F.lit(b) for b in bits))
    text: Column = joined(("库存多少；", "p_name", "和", "p_brand", "比例"))
    for k, bits in texts.items():
        text = F.when(kind == k, joined(bits)).otherwise(text)
    return parts.select(F.col("p_partkey").alias("query_id"), text.alias("question"), (F.col("p_size") > 25).alias("deep"))


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for each length of part names, with the names as aliases."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("Kind "), F.length("p_name").cast("string")).alias("term"), F.col("p_name").alias("alias")).distinct()


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three statements a part."""
    key = F.col("p_partkey")
    first = F.struct(F.lit(1).alias("place"), F.concat(F.lit("The price of "), "p_name", F.lit(" was "), F.format_string("%.1f", "p_retailprice"), F.when(key % 3 == 0, " in 2024, above the limit of Q2").otherwise(" before")).alias("text"), F.when(key % 5 == 0, "provenance").otherwise("business_fact").alias("role"), F.lit(None).cast("string").alias("extraction"), F.when(key % 7 == 0, "visual_model").otherwise("native").alias("source_kind"), F.lit(0.9).alias("confidence"))
    second = F.struct(F.lit(2).alias("place"), F.concat("p_brand", F.lit(" growth was driven by the region; improve it, FY2023")).alias("text"), F.lit("management_insight").alias("role"), F.when(key % 2 == 0, "native_chart_analysis_bundle").alias("extraction"), F.lit("native").alias("source_kind"), F.when(key % 11 == 0, 0.5).otherwise(1.0).alias("confidence"))
    third = F.struct(F.lit(3).alias("place"), F.concat(F.lit("库存 "), F.col("p_size").cast("string")).alias("text"), F.lit("table").alias("role"), F.lit(None).cast("string").alias("extraction"), F.lit("native").alias("source_kind"), F.lit(None).cast("double").alias("confidence"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("query_id"), F.explode(F.array(first, second, third)).alias("e")).select("query_id", "e.*").filter((F.col("query_id") + F.col("place")) % 4 > 0)
    return rows.withColumns({"evidence_id": F.concat(F.lit("e"), F.col("place").cast("string")), "document_id": F.lit("d"), "slide_id": F.col("place").cast("long")})


def _terms(x: str) -> str:
    return f"list_distinct(list_concat(list_concat(regexp_extract_all(lower({x}), '[a-z0-9%_.-]{{2,}}'), list_filter(regexp_extract_all(lower({x}), '[{_J}]{{2,}}'), lambda p: length(p) <= 4)), {_pairs(f'lower({x})')}))"


def _telling(x: str) -> str:
    return f"list_filter({_terms(x)}, lambda y: NOT list_contains({_list(coverage.NEUTRAL)}, y))"


def _subject(x: str) -> str:
    compact = rf"regexp_replace({_strip(f"regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g')")}, '^[ ,，、:：?？]+|[ ,，、:：?？]+$', '', 'g')"
    y = rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({compact}, '^.*(?:表|图|矩阵)(?:中|的)?', ''), '(?i){coverage.PERIOD}', '', 'g'), '(?:从|由)[ ]*[^，,]*?(?:到|至)[ ]*[^，,]*$', ''), '(?:分别|各自|合计占|合计|占)$', ''))"
    return f"CASE WHEN regexp_matches({y}, '[a-z][a-z0-9_-]+') THEN array_to_string(regexp_extract_all({y}, '[a-z][a-z0-9_-]+')[:4], '_') ELSE substr(regexp_replace({y}, '[^{_J}]', '', 'g'), 1, 24) END"


def _at(markers) -> str:
    return f"list_min(list_filter(list_transform({_list(markers)}, lambda k: instr(low, k)), lambda k: k > 0))"


_BETTER = r"(?:如何|怎么)优?化|(?:如何|怎么)(?:改善|提高|降低)|how\s+(?:to|should|can)\b[^?.!]*(?:improve|optimi[sz]e|reduce)"
_RULES = (("provenance", _has("f", coverage.SOURCE)), ("attribution", _has("f", coverage.DRIVER)), ("action", f"({_has('f', coverage.ACTION_REQUEST)} OR regexp_matches(f, '{_BETTER}'))"), ("definition", _has("f", coverage.DEFINITION)), ("comparison", _has("f", coverage.COMPARISON)), ("numeric", f"({_has('f', coverage.VALUE)} OR {_has('f', coverage.DECISION)})"), ("decision_criterion", _has("f", coverage.DECISION)), ("visual_analysis", f"(vis OR (regexp_matches(f, '{coverage.VISUAL}') AND {_has('f', coverage.ANALYSIS)}))"))
_VALIDATORS = "list_concat(['direct_support'], list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + "], lambda x: x IS NOT NULL))"
_CONTRACT = rf"""req AS (SELECT p_partkey AS query_id, p_size > 25 AS deep, trim(CASE p_partkey % 8 WHEN 0 THEN 'What is the ' || p_name || ' value in 2024 Q2?' WHEN 1 THEN 'How much did ' || p_name || ' and ' || p_brand || ' change; why' WHEN 2 THEN 'Show the chart of ' || p_type || '! Interpret it' WHEN 3 THEN 'Which segment drove ' || p_name || '?'
  WHEN 4 THEN 'Explain ' || p_name || '. Define ' || p_type WHEN 5 THEN 'Does ' || p_brand || ' breach its limit in FY2023; recommend action' WHEN 6 THEN p_type || ' ' || p_name ELSE '库存多少；' || p_name || '和' || p_brand || '比例' END) AS question FROM part),
gl AS (SELECT DISTINCT 'Kind ' || length(p_name) AS term, p_name AS alias FROM part UNION SELECT DISTINCT 'Kind ' || length(p_name), 'Kind ' || length(p_name) FROM part),
cl AS (SELECT *, lower(question) AS ql, list_filter(list_transform(regexp_split_to_array(question, '[?？!！;；。]+'), lambda y: trim(y, ' ,，')), lambda y: y <> '') AS ps FROM req),
pt AS (SELECT query_id, deep, CAST(k AS BIGINT) AS part_no, ps, ps[k] AS requirement, len(ps) AS n_parts, regexp_matches(ql, '{coverage.VISUAL}') AND {_has("ql", coverage.ANALYSIS)} AS vis FROM cl, unnest(range(1, len(ps) + 1)) AS u(k)),
nr AS (SELECT pt.*, (SELECT arg_max(ps[k], len(list_intersect({_terms("ps[k]")}, {_terms("requirement")})) * 1000 - k) FROM unnest(range(1, n_parts + 1)) AS u(k)) AS clause FROM pt),
cx AS (SELECT *, CASE WHEN clause = requirement THEN requirement ELSE requirement || ' ' || clause END AS context FROM nr),
va AS (SELECT *, {_VALIDATORS} AS validators, list_distinct(regexp_extract_all(context, '(?i){coverage.PERIOD}')) AS constraints FROM (SELECT *, lower(context) AS f FROM cx)),
wk AS (SELECT query_id, part_no, regexp_replace(clause, '(?i){coverage.OPENING}', '') AS working FROM va WHERE list_contains(validators, 'numeric')),
bd AS (SELECT *, COALESCE(CASE WHEN {_has("low", (*coverage.VALUE, *coverage.DECISION))} THEN {_at((*coverage.VALUE, *coverage.DECISION))} ELSE {_at(coverage.COMPARISON)} END, length(low) + 1) AS b FROM (SELECT *, lower(working) AS low FROM wk)),
pf AS (SELECT *, regexp_split_to_array(regexp_replace({_strip("regexp_split_to_array(substr(working, 1, CAST(b - 1 AS BIGINT)), '[,，:：]')[-1]")}, '(?:分别|各自)$', ''), '(?i)[ \t]*(?:、|，|,|和|及|与|\band\b)[ \t]*') AS pc FROM bd),
pi AS (SELECT query_id, part_no, low, CAST(k AS BIGINT) AS piece_no, pc[k] AS piece, len(pc) AS n_pieces FROM pf, unnest(range(1, len(pc) + 1)) AS u(k)),
ht AS (SELECT DISTINCT pi.*, term FROM pi JOIN gl ON regexp_matches(lower(piece), '(^|[^a-z0-9])' || regexp_escape(lower(alias)) || '($|[^a-z0-9])')),
rk AS (SELECT query_id, part_no, piece_no, ht.term, CASE WHEN n_pieces = 1 THEN max(CASE WHEN contains(low, lower(alias)) THEN length(low) - instr(reverse(low), reverse(lower(alias))) - length(alias) + 1 ELSE -1 END) ELSE length(ht.term) END AS best FROM ht JOIN gl ON ht.term = gl.term GROUP BY query_id, part_no, piece_no, n_pieces, ht.term),
tp AS (SELECT query_id, part_no, piece_no, term FROM rk QUALIFY row_number() OVER (PARTITION BY query_id, part_no, piece_no ORDER BY best DESC, term) = 1),
sj AS (SELECT pi.query_id, pi.part_no, pi.piece_no, CASE WHEN term IS NOT NULL THEN array_to_string(regexp_extract_all(lower(term), '[a-z0-9]+'), '_') WHEN n_pieces > 1 THEN {_subject("piece")} ELSE '' END AS subject FROM pi LEFT JOIN tp USING (query_id, part_no, piece_no)),
sd AS (SELECT query_id, part_no, subject, min(piece_no) AS piece_no FROM sj WHERE subject <> '' GROUP BY ALL),
ss AS (SELECT query_id, part_no, list(subject ORDER BY piece_no)[:8] AS subjects FROM sd GROUP BY ALL),
ls AS (SELECT va.*, CASE WHEN len(COALESCE(subjects, [])) > 0 THEN subjects WHEN list_contains(validators, 'attribution') THEN list_transform(list_filter({_list(coverage.SEGMENT)}, lambda y: contains(lower(clause), y))[:1], lambda y: replace(y, ' ', '_')) ELSE [] END AS listed FROM va LEFT JOIN ss USING (query_id, part_no)),
fa AS (SELECT ls.*, CAST(k AS BIGINT) AS subject_no, CASE WHEN len(listed) = 0 THEN '' ELSE listed[k] END AS subject FROM ls, unnest(range(1, greatest(len(listed), 1) + 1)) AS u(k)),
fl AS (SELECT *, CASE WHEN len(listed) > 1 THEN replace(subject, '_', ' ') || ': ' || requirement ELSE requirement END AS label FROM fa),
fi AS (SELECT *, 'requirement:' || array_to_string(validators, '+') || ':' || CASE WHEN subject <> '' THEN subject ELSE substr(sha1(lower(label)), 1, 10) END AS facet_id FROM fl),
ff AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY query_id, facet_id ORDER BY part_no, subject_no) = 1),
al AS (SELECT DISTINCT s.subject, lower(b.alias) AS alias FROM (SELECT DISTINCT subject FROM ff WHERE subject <> '') s JOIN gl a ON regexp_replace(lower(a.alias), '[^a-z0-9{_J}]', '', 'g') = regexp_replace(lower(replace(s.subject, '_', ' ')), '[^a-z0-9{_J}]', '', 'g') JOIN gl b ON a.term = b.term),
ao AS (SELECT subject, list(alias) AS others FROM al GROUP BY 1),
facets AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part_no, subject_no) AS INTEGER) AS facet_no, facet_id, label, ff.subject, CASE WHEN ff.subject = '' THEN [] ELSE list_distinct(list_concat(list_concat([replace(ff.subject, '_', ' ')], list_filter(string_split(replace(ff.subject, '_', ' '), ' '), lambda y: length(y) > 1)), COALESCE(others, []))) END AS aliases, constraints, validators,
  CASE WHEN len(validators) = 1 AND n_parts = 1 AND deep THEN 2 ELSE 1 END AS minimum, list_sort({_telling("requirement")}) AS match_terms, len(validators) = 1 AND n_parts > 1 AS semantic_required FROM ff LEFT JOIN ao ON ff.subject = ao.subject)"""


@query(f"WITH {_CONTRACT} SELECT query_id, facet_no, facet_id, label, subject, array_to_string(list_sort(aliases), '|') AS aliases, array_to_string(list_sort(constraints), '|') AS constraints, minimum, array_to_string(match_terms, '|') AS match_terms, semantic_required FROM facets")
def e4_evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.evidence_contract(_requests(spark, sf_dir), _glossary(spark, sf_dir)).drop("validators")
    text = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return found.select("query_id", "facet_no", "facet_id", "label", "subject", text("aliases"), text("constraints"), "minimum", text("match_terms"), "semantic_required")


_EVIDENCE = """ev AS (SELECT * FROM (SELECT p_partkey AS query_id, 1 AS place, 'The price of ' || p_name || ' was ' || printf('%.1f', p_retailprice) || CASE WHEN p_partkey % 3 = 0 THEN ' in 2024, above the limit of Q2' ELSE ' before' END AS text, CASE WHEN p_partkey % 5 = 0 THEN 'provenance' ELSE 'business_fact' END AS role, '' AS extraction, p_partkey % 7 = 0 AS visual, 0.9 AS confidence FROM part
  UNION ALL SELECT p_partkey, 2, p_brand || ' growth was driven by the region; improve it, FY2023', 'management_insight', CASE WHEN p_partkey % 2 = 0 THEN 'native_chart_analysis_bundle' ELSE '' END, false, CASE WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 1.0 END FROM part
  UNION ALL SELECT p_partkey, 3, '库存 ' || p_size, 'table', '', false, 1.0 FROM part) WHERE (query_id + place) % 4 > 0)"""
_YEAR = "regexp_extract(c, '20[0-9]{2}')"
_NAMED = f"CASE WHEN {_YEAR} <> '' THEN contains(t, {_YEAR}) WHEN regexp_matches(c, '(?i)Q[1-4]') THEN regexp_matches(t, '(?i)Q' || regexp_extract(c, '(?i)Q([1-4])', 1) || '\\b|第' || translate(regexp_extract(c, '(?i)Q([1-4])', 1), '1234', '一二三四') || '季度') ELSE contains(lower(t), lower(c)) END"
_COVERED = rf"""{_CONTRACT}, {_EVIDENCE},
pa AS (SELECT f.*, place, text, role, extraction, visual, confidence, lower(text) AS low, {_telling("text")} AS tok, {_telling("replace(subject, '_', ' ')")} AS st FROM facets f JOIN ev USING (query_id)),
ab AS (SELECT query_id, facet_no, place, text, role, extraction, confidence >= 0.65 AND NOT (visual AND list_contains(validators, 'numeric')) AS sound FROM pa
  WHERE CASE WHEN len(aliases) > 0 THEN len(list_filter(aliases, lambda y: contains(low, y))) > 0 OR (len(st) > 0 AND 2 * len(list_intersect(st, tok)) >= len(st)) OR (list_contains(validators, 'attribution') AND {_has("low", (*coverage.SEGMENT, *coverage.COMPARISON))}) ELSE NOT semantic_required OR len(list_intersect(match_terms, tok)) > 0 END),
ag AS (SELECT query_id, facet_no, count(*) AS n, count(*) FILTER (sound) AS n_sound, COALESCE(string_agg(text, chr(10) ORDER BY place) FILTER (sound), '') AS t, COALESCE(list(role) FILTER (sound), []) AS roles, COALESCE(list(extraction) FILTER (sound), []) AS made, string_agg('e' || place, ',' ORDER BY place) AS all_ids, string_agg('e' || place, ',' ORDER BY place) FILTER (sound) AS ids FROM ab GROUP BY ALL),
jn AS (SELECT f.*, COALESCE(n, 0) AS n, COALESCE(n_sound, 0) AS n_sound, COALESCE(t, '') AS t, lower(COALESCE(t, '')) AS low, COALESCE(roles, []) AS roles, COALESCE(made, []) AS made, COALESCE(CASE WHEN n_sound > 0 THEN ids ELSE all_ids END, '') AS evidence_ids FROM facets f LEFT JOIN ag USING (query_id, facet_no)),
ck AS (SELECT *, list_filter([CASE WHEN list_contains(validators, 'direct_support') AND t = '' THEN 'direct_support' END,
  CASE WHEN list_contains(validators, 'provenance') AND NOT (len(list_intersect(roles, ['provenance', 'methodology'])) > 0 OR {_has("low", coverage.SOURCE)}) THEN 'provenance' END,
  CASE WHEN list_contains(validators, 'attribution') AND NOT {_has("low", coverage.ATTRIBUTION_EVIDENCE)} THEN 'attribution' END,
  CASE WHEN list_contains(validators, 'action') AND NOT (list_contains(roles, 'management_insight') OR {_has("low", coverage.ACTION)}) THEN 'action' END,
  CASE WHEN list_contains(validators, 'definition') AND (t = '' OR regexp_full_match(t, '[\s[:punct:]]*[0-9][0-9\s.,%]*')) THEN 'definition' END,
  CASE WHEN list_contains(validators, 'comparison') AND NOT (len(list_intersect(made, {_list(coverage.CALCULATED)})) > 0 OR regexp_matches(t, '(?i){coverage.PERIOD}') OR regexp_matches(t, '(?i)[0-9]{{2}}/[0-9]{{1,2}}|同比|环比|[+-][0-9]|higher|lower|increase|decrease')) THEN 'comparison' END,
  CASE WHEN list_contains(validators, 'numeric') AND NOT regexp_matches(t, '[0-9]') THEN 'numeric' END,
  CASE WHEN list_contains(validators, 'decision_criterion') AND NOT ({_has("low", coverage.DECISION)} AND regexp_matches(low, 'above|below|within|exceed|高于|低于|超过|范围内|突破')) THEN 'decision_criterion' END,
  CASE WHEN list_contains(validators, 'visual_analysis') AND NOT list_contains(made, 'native_chart_analysis_bundle') THEN 'visual_analysis' END,
  CASE WHEN len(list_filter(constraints, lambda c: NOT ({_NAMED}))) > 0 THEN 'explicit_constraints' END, CASE WHEN n_sound < minimum THEN 'evidence_breadth' END, CASE WHEN n_sound < minimum THEN 'context_breadth' END], lambda x: x IS NOT NULL) AS missing FROM jn),
cov AS (SELECT query_id, facet_no, facet_id, label, CASE WHEN n = 0 THEN 'unsupported' WHEN n_sound = 0 THEN 'unreliable' WHEN len(missing) = 0 THEN 'supported' ELSE 'partial' END AS status, array_to_string(missing, ',') AS missing, evidence_ids FROM ck)"""


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.evaluate_coverage(coverage.evidence_contract(_requests(spark, sf_dir), _glossary(spark, sf_dir)), _evidence(spark, sf_dir))


@query(f"WITH {_COVERED} SELECT * FROM cov")
def e5_evaluate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir).withColumns({"missing": F.array_join("missing", ","), "evidence_ids": F.array_join("evidence_ids", ",")})


@query(f"WITH {_COVERED} SELECT query_id, count(*) AS total, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'partial') AS partial, round(count(*) FILTER (status = 'supported') / count(*), 3) AS ratio, COALESCE(string_agg(label, '|' ORDER BY facet_no) FILTER (status <> 'supported'), '') AS gaps FROM cov GROUP BY 1")
def e6_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_summary(_covered(spark, sf_dir)).withColumn("gaps", F.array_join("gaps", "|"))


@query(f"WITH {_COVERED}, x AS (SELECT query_id, facet_no, facet_id, unnest(string_split(evidence_ids, ',')) AS evidence_id FROM cov WHERE evidence_ids <> '') SELECT query_id, evidence_id, string_agg(facet_id, '|' ORDER BY facet_no) AS facet_ids FROM x GROUP BY ALL")
def e6_facets_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.facets_of_evidence(_covered(spark, sf_dir)).withColumn("facet_ids", F.array_join("facet_ids", "|"))


def _again(sql: str) -> str:
    """The chain from facets to coverage once more, under names of its own."""
    return re.sub(r"\b(facets|pa|ab|ag|jn|ck|cov)\b(?=[ .)(,]|$)", r"x_\1", sql)


#: The second chain is over lone facets without their subjects.
_RELAXED = _again(_COVERED.split(_EVIDENCE + ",", 1)[1])


@query(f"""WITH {_COVERED}, pq AS (SELECT query_id, bool_or(list_distinct(validators) = ['direct_support']) AS plain, count(*) AS n FROM facets GROUP BY 1), w AS (SELECT query_id, bool_and(status = 'supported') AS whole FROM cov GROUP BY 1),
x_facets AS (SELECT f.* REPLACE ('' AS subject, [] AS aliases) FROM facets f JOIN pq USING (query_id) WHERE n = 1 AND NOT plain AND subject <> ''), {_RELAXED},
tk AS (SELECT query_id, list_distinct(flatten(list({_telling("text")}))) AS tok FROM ev GROUP BY 1), sh AS (SELECT query_id FROM facets JOIN tk USING (query_id) WHERE len(list_intersect(match_terms, tok)) >= least(2, len(match_terms))),
rx AS (SELECT query_id FROM x_cov JOIN sh USING (query_id) WHERE status = 'supported') SELECT query_id, NOT plain AND (whole OR query_id IN (SELECT query_id FROM rx)) OR query_id % 10 = 0 AS complete FROM pq JOIN w USING (query_id)""")
def e21_fully_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth request was answered by a reconciliation."""
    facets = coverage.evidence_contract(_requests(spark, sf_dir), _glossary(spark, sf_dir))
    return coverage.fully_answers(facets, _evidence(spark, sf_dir), _requests(spark, sf_dir).filter("query_id % 10 = 0"))
