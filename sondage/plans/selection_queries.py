"""Evidence from fused candidates, whole documents as chunks, benchmark texts as requests; roles, units and headings of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions.text import clauses
from sondage.operators import selection
from sondage.sources.bindings import table

from .registry import query
from .search_queries import _BM25, _VECTORS, r8_rank_fusion


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with bars between words count as tables; every thirteenth as read from a picture."""
    kind = F.when(F.contains("text", F.lit(" | ")), "table").otherwise("text")
    source = F.when(F.col("doc_id") % 13 == 0, "visual_model").otherwise("native")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.floor(F.col("doc_id") / 10).alias("slide_id"), F.col("text").alias("content"), kind.alias("chunk_type"), source.alias("source_kind"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other request names three documents, every third excludes boilerplate, every fifth is a deep one."""
    item = F.col("item_id")
    names = F.when(item % 2 == 0, F.array(F.lit("src0"), F.lit("src1"), F.lit("src2"))).otherwise(F.array().cast("array<string>"))
    out = F.when(item % 3 == 0, F.array(F.lit("boilerplate"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "benchmark").select(item.alias("query_id"), F.col("text").alias("question"), clauses(F.col("text")).alias("requirements"), names.alias("document_ids"), out.alias("excluded"), (item % 5 == 0).alias("deep"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = r8_rank_fusion(spark, sf_dir).select("query_id", "chunk_id", F.col("score").alias("fused"))
    candidates = fused.join(_documents(spark, sf_dir), "chunk_id")
    return selection.score_evidence(candidates, _requests(spark, sf_dir))


def _list(markers) -> str:
    return "[" + ",".join(f"'{m}'" for m in markers) + "]"


_B = r"[\x09-\x0D\x20\x{a0}\x{3000}]"
_J = r"\x{4e00}-\x{9fff}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _has(x: str, markers) -> str:
    return f"(len(list_filter({_list(markers)}, lambda m: contains({x}, m))) > 0)"


def _filled(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda y: {_strip('y')}), lambda y: y <> '')"


def _lines(x: str) -> str:
    return _filled(rf"regexp_split_to_array({x}, '[\n\r\x0b\x0c]+')")


_ROLE = f"""CASE WHEN regexp_matches(t, '^[0-9]{{0,3}}$') OR {_has("f", selection.BOILERPLATE_MARKERS)} THEN 'boilerplate'
  WHEN {_has("f", selection.PROVENANCE_MARKERS)} THEN CASE WHEN {_has("f", selection.METHODOLOGY_MARKERS)} THEN 'methodology' ELSE 'provenance' END
  WHEN chunk_type = 'table' THEN 'table' WHEN {_has("f", selection.RISK_MARKERS)} THEN 'risk_signal' WHEN {_has("f", selection.MANAGEMENT_MARKERS)} THEN 'management_insight' ELSE 'business_fact' END"""
_DOCS = f"""docs AS (SELECT doc_id AS chunk_id, source AS document_id, doc_id // 10 AS slide_id, text AS content, CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS chunk_type, doc_id % 13 = 0 AS visual, {_strip("text")} AS t, lower({_strip("text")}) AS f FROM documents)"""
#: Sentences of single lines, long ones cut: a row a unit, numbered from 0. ``t``: the stripped text.
_UNITS = rf"""
ln AS (SELECT *, {_lines("t")} AS l FROM @source),
st AS (SELECT *, {_filled(rf"string_split(regexp_replace(t, '([。！？!?;；.]){_B}+', '\1' || chr(1), 'g'), chr(1))")} AS s FROM ln),
lu AS (SELECT @key, CAST(i AS BIGINT) AS i, 0 AS j, l[i + 1] AS u FROM st, unnest(range(0, len(l))) AS r(i) WHERE len(l) > 1),
su AS (SELECT @key, CAST(i AS BIGINT) AS i, s[i + 1] AS u, {_filled(rf"string_split(regexp_replace(s[i + 1], '([,，:：]){_B}*', '\1' || chr(1), 'g'), chr(1))")} AS c FROM st, unnest(range(0, len(s))) AS r(i) WHERE len(l) <= 1),
units AS (SELECT @key, row_number() OVER (PARTITION BY @key ORDER BY i, j) - 1 AS i, u FROM (
  SELECT * FROM lu UNION ALL SELECT @key, i, 0, u FROM su WHERE length(u) <= 800 OR len(c) < 2 UNION ALL SELECT @key, i, CAST(j AS INTEGER), c[j + 1] FROM su, unnest(range(0, len(c))) AS r(j) WHERE length(u) > 800 AND len(c) > 1))"""


def _units(source: str, key: str) -> str:
    return _UNITS.replace("@source", source).replace("@key", key)


_COMPACT = _strip(f"regexp_replace(content, '{_B}+', ' ', 'g')")
_HEADING = rf"""CASE WHEN starts_with(lower(k), 'section ') THEN true WHEN regexp_matches(k, '[。.！!？?；;]$') THEN false
  ELSE NOT {_has("lower(k)", selection.PREDICATE_MARKERS)} AND ((regexp_matches(k, '[A-Z]') AND NOT regexp_matches(k, '[a-z]') AND length(k) <= 80) OR (length(k) <= 90 AND len(regexp_extract_all(k, '[A-Za-z0-9%]+|[{_J}]{{2,}}')) <= 6)) END"""


def _pairs(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '[{_J}]{{2,}}'), lambda p: list_transform(range(1, length(p)), lambda k: substr(p, CAST(k AS BIGINT), 2))))"


def _tokens(x: str) -> str:
    """Tokens of facets."""
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({x}, '[a-z0-9%_-]{{2,}}'), list_filter(regexp_extract_all({x}, '[{_J}]{{2,}}'), lambda p: length(p) <= 4)), {_pairs(x)}))"


def _terms(x: str, stop) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9%_-]{{2,}}|[{_J}]{{2,}}'), lambda y: NOT list_contains({_list(stop)}, y)))"


_CLAUSES = "list_filter(list_transform(regexp_split_to_array(text, '[?？!！;；。]+'), lambda y: trim(y, ' ,，')), lambda y: y <> '')"
_REQ = f"""req AS (SELECT item_id AS query_id, text AS question, lower(text) AS asked, CASE WHEN len({_CLAUSES}) > 0 THEN list_distinct({_CLAUSES}) ELSE [text] END AS requirements,
  CASE WHEN item_id % 2 = 0 THEN ['src0','src1','src2'] ELSE [] END AS document_ids, item_id % 3 = 0 AS strict, item_id % 5 = 0 AS deep, {_terms("text", selection.REQUEST_STOPWORDS)} AS terms, {_terms("text", selection.TASK_STOPWORDS)} AS task_terms FROM benchmark)"""
_FUSED = f"""{_BM25}, {_VECTORS}, lane AS (SELECT query_id, chunk_id, 1.25 / (60 + rank) AS part FROM bm UNION ALL SELECT query_id, chunk_id, CAST(1.0 AS DOUBLE) / (60 + rank) FROM vr),
fused AS (SELECT query_id, chunk_id, round(sum(CAST(part AS DOUBLE)), 8) AS fused FROM lane GROUP BY ALL)"""


def _tenths(u: str, terms: str) -> str:
    return f"10 * len(list_filter({terms}, lambda y: contains(lower({u}), y))) + 8 * len(list_filter({_list(selection.RISK_MARKERS)}, lambda y: contains(lower({u}), y))) + CASE WHEN regexp_matches({u}, '[0-9]') THEN 5 ELSE 0 END"


_BONUS = "CASE role " + " ".join(f"WHEN '{r}' THEN {b}" for r, b in selection.ROLE_BONUS.items()) + " ELSE 0 END"
_E1 = f"""{_FUSED}, {_DOCS}, {_REQ},
cand AS (SELECT fused.query_id, fused.query_id || '/' || fused.chunk_id AS pair, fused.fused, docs.*, {_ROLE} AS role, asked, requirements, strict, terms, task_terms FROM fused JOIN docs USING (chunk_id) JOIN req USING (query_id)),
{_units("cand", "pair")},
rows_ AS (SELECT pair, CAST(i AS BIGINT) AS i, l[i + 1] AS u FROM st, unnest(range(0, len(l))) AS r(i)),
tab AS (SELECT pair FROM cand WHERE chunk_type = 'table' OR (contains(t, '|') AND contains(t, chr(10)))),
pu AS (SELECT x.pair, x.i, x.u, {_tenths("x.u", "terms")} AS v FROM units x JOIN cand USING (pair) WHERE pair NOT IN (SELECT pair FROM tab)),
tu AS (SELECT x.pair, x.i, x.u, {_tenths("x.u", "terms")} AS v FROM rows_ x JOIN cand USING (pair) WHERE i > 0 AND pair IN (SELECT pair FROM tab)),
pb AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY v DESC, i) <= 3 AND v > 0 AS best FROM pu), tb AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY v DESC, i) <= 4 AND v > 0 AS best FROM tu),
pn AS (SELECT *, bool_or(best) OVER (PARTITION BY pair) AS any_best FROM pb), tn AS (SELECT *, bool_or(best) OVER (PARTITION BY pair) AS any_best FROM tb),
pc AS (SELECT *, best OR (NOT any_best AND i < 2) AS on_ FROM pn),
pk AS (SELECT pair, i, u FROM (SELECT *, lead(on_) OVER (PARTITION BY pair ORDER BY i) AS next_on FROM pc) WHERE on_ OR (COALESCE(next_on, false) AND length(u) <= 240)),
tk AS (SELECT pair, min(i) AS i, u FROM (SELECT pair, i, u FROM tn WHERE best OR (NOT any_best AND i <= 3) UNION ALL SELECT pair, i, u FROM rows_ WHERE i = 0 AND pair IN (SELECT pair FROM tab)) GROUP BY pair, u),
q AS (SELECT pair, string_agg(u, chr(10) ORDER BY i) AS quote FROM (SELECT * FROM pk UNION ALL SELECT pair, i, u FROM tk) GROUP BY pair),
fr AS (SELECT pair, k, requirements[k] AS r, len(list_intersect({_tokens("lower(requirements[k])")}, tok)) AS n FROM (SELECT pair, requirements, {_tokens("lower(content)")} AS tok FROM cand), unnest(range(1, len(requirements) + 1)) AS z(k)),
ft AS (SELECT pair, arg_max(r, n * 1000 - k) FILTER (n > 0) AS facet FROM fr GROUP BY pair),
e0 AS (SELECT cand.*, COALESCE(quote, '') AS quote, COALESCE(facet, 'directly relevant evidence') AS facet, {_tenths("COALESCE(quote, '')", "terms")} AS tenths, {_COMPACT} AS k FROM cand LEFT JOIN q USING (pair) LEFT JOIN ft USING (pair)),
e1 AS (SELECT query_id, chunk_id, document_id, slide_id, role, facet, quote,
  CASE WHEN (strict AND role = 'boilerplate') OR (role = 'provenance' AND NOT {_has("asked", selection.SOURCE_CUES)}) OR (role = 'methodology' AND NOT {_has("asked", selection.METHOD_CUES)}) THEN 'role'
    WHEN visual AND {_has("asked", selection.NUMBER_CUES)} AND regexp_matches(content, '[0-9]') THEN 'visual_numeric' WHEN quote = '' THEN 'empty' WHEN role IN ('provenance', 'methodology') AND tenths <= 0 THEN 'off_task_context'
    WHEN role IN ('business_fact', 'risk_signal', 'management_insight') AND {_HEADING} THEN 'heading_like' END AS rejected,
  CAST(CAST(fused AS DECIMAL(28,10)) + CAST({_BONUS} AS DECIMAL(4,2)) + CAST(least(300, 45 * len(list_filter(task_terms, lambda y: contains(lower(content), y)))) AS DECIMAL(10,2)) * 0.01
    + CASE WHEN role IN ('chart', 'table') AND {_has("asked", selection.AMOUNT_CUES)} THEN 1.5 ELSE 0 END + CAST(tenths + CASE WHEN role IN ('risk_signal', 'management_insight', 'table', 'chart') THEN 10 ELSE 0 END AS DECIMAL(20,1)) * 0.1 AS DECIMAL(28,10)) AS score FROM e0)"""
_E2 = f"""{_E1}, dt AS (SELECT *, regexp_replace(lower({_strip(f"regexp_replace(quote, '{_B}+', ' ', 'g')")}), '^$', '') AS said, list_distinct(list_concat(regexp_extract_all(lower(quote), '[a-z0-9%_.-]{{2,}}'), {_pairs("lower(quote)")})) AS tok, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slide_id, chunk_id) AS rk FROM e1 WHERE rejected IS NULL),
qu AS (SELECT d.*, true AS ahead, list_position(document_ids, document_id) AS dn FROM dt d JOIN req USING (query_id) WHERE list_contains(document_ids, document_id) UNION ALL SELECT *, false, 99 FROM dt),
que AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dn, rk) AS pos FROM qu),
rec AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS STRUCT(c BIGINT, d VARCHAR, s BIGINT, said VARCHAR, tok VARCHAR[])[]) AS atoms, CAST(0 AS BIGINT) AS chars, CAST(0 AS BIGINT) AS over FROM que
  UNION ALL SELECT query_id, pos, CASE WHEN able AND fits THEN list_append(atoms, own) ELSE atoms END, CASE WHEN able AND fits THEN chars + n ELSE chars END, CASE WHEN able AND NOT fits THEN over + 1 ELSE over END FROM (
    SELECT query_id, x.pos, atoms, chars, over, length(quote) AS n, len(atoms) = 0 OR chars + length(quote) <= 8000 AS fits, {{'c': chunk_id, 'd': document_id, 's': slide_id, 'said': x.said, 'tok': x.tok}} AS own,
      len(atoms) < 8 AND NOT (ahead AND len(list_filter(atoms, lambda a: a.d = document_id)) > 0) AND len(list_filter(atoms, lambda a: a.d = document_id AND a.s = slide_id)) < 2
      AND len(list_filter(atoms, lambda a: a.said = x.said OR (len(x.tok) > 0 AND len(a.tok) > 0 AND 100 * len(list_intersect(a.tok, x.tok)) >= 88 * greatest(len(a.tok), len(x.tok))))) = 0 AS able
    FROM rec JOIN que x USING (query_id) WHERE x.pos = rec.pos + 1)),
fin AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1),
ev AS (SELECT fin.query_id, CAST(p AS INTEGER) AS place, atoms[p].c AS chunk_id, CAST(over AS INTEGER) AS n_over_budget FROM fin, unnest(range(1, len(atoms) + 1)) AS u(p)),
e2 AS (SELECT ev.*, document_id, slide_id, role, facet, quote, round(CAST(score AS DECIMAL(28,6)), 6) AS score FROM ev JOIN e1 USING (query_id, chunk_id))"""


@query(f"WITH {_DOCS} SELECT chunk_id, {_ROLE} AS role FROM docs")
def x12_content_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("chunk_id", selection.content_role(F.col("content"), F.col("chunk_type")).alias("role"))


@query(f"WITH {_DOCS}, {_units('docs', 'chunk_id')} SELECT docs.chunk_id, count(u) AS n_units, md5(COALESCE(string_agg(u, chr(10) ORDER BY i), '')) AS units_md5 FROM docs LEFT JOIN units USING (chunk_id) GROUP BY 1")
def x14_split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = selection.split_units(F.col("content"))
    return _documents(spark, sf_dir).select("chunk_id", F.explode(F.array(units)).alias("units")).select("chunk_id", F.size("units").alias("n_units"), F.md5(F.array_join("units", "\n")).alias("units_md5"))


@query(rf"""WITH l AS (SELECT doc_id AS chunk_id, unnest({_lines("text")}) AS content FROM documents), c AS (SELECT chunk_id, {_COMPACT} AS k FROM l)
SELECT chunk_id, count(*) AS n_lines, count(*) FILTER ({_HEADING}) AS n_headings FROM c GROUP BY 1""")
def x16_heading_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and how many of them only name what follows."""
    rows = _documents(spark, sf_dir).select("chunk_id", F.explode(selection.lines(F.col("content"))).alias("line"))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("n_lines"), F.count_if(selection.heading_like(F.col("line"))).alias("n_headings"))


@query(f"WITH RECURSIVE {_E1} SELECT query_id, chunk_id, role, facet, md5(quote) AS quote_md5, CAST(CAST(score AS DECIMAL(28,6)) AS DOUBLE) AS score, rejected FROM e1")
def e1_score_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("query_id", "chunk_id", "role", "facet", F.md5("quote").alias("quote_md5"), F.round("score", 6).cast("double").alias("score"), "rejected")


@query(f"WITH RECURSIVE {_E2} SELECT query_id, place, chunk_id, document_id, slide_id, role, facet, md5(quote) AS quote_md5, CAST(score AS DOUBLE) AS score, n_over_budget FROM e2")
def e2_select_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.select_evidence(_scored(spark, sf_dir), _requests(spark, sf_dir))
    return chosen.withColumn("quote_md5", F.md5("quote")).drop("quote")


@query(f"""WITH RECURSIVE {_E2}, h AS (SELECT query_id, count(*) AS n_atoms, list(document_id) AS ds, list(facet) AS fs FROM e2 GROUP BY 1),
m AS (SELECT query_id, COALESCE(n_atoms, 0) AS n_atoms, deep, list_filter(document_ids, lambda y: NOT list_contains(COALESCE(ds, []), y)) AS md, list_filter(requirements, lambda y: NOT list_contains(COALESCE(fs, []), y)) AS mf FROM req LEFT JOIN h USING (query_id))
SELECT query_id, n_atoms, array_to_string(md, ',') AS missing_documents, len(mf) AS n_missing_facets, CASE WHEN n_atoms < CASE WHEN deep THEN 2 ELSE 1 END THEN 'INSUFFICIENT_EVIDENCE' WHEN len(md) > 0 OR len(mf) > 0 THEN 'PARTIAL_EVIDENCE_COVERAGE' END AS warning FROM m""")
def e20_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    found = selection.answerability(requests, selection.select_evidence(_scored(spark, sf_dir), requests))
    return found.select("query_id", "n_atoms", F.array_join("missing_documents", ",").alias("missing_documents"), F.size("missing_facets").alias("n_missing_facets"), "warning")


@query(f"""WITH docs AS (SELECT doc_id AS chunk_id, doc_id // 20 AS document_id, doc_id // 4 AS slide_id, doc_id % 5 AS slide_no, text AS content, 'table' AS chunk_type, {_strip("text")} AS t, lower({_strip("text")}) AS f FROM documents WHERE doc_id % 3 = 0), {_REQ},
a AS (SELECT DISTINCT query_id, unnest([query_id, query_id + 1]) AS document_id, asked, task_terms FROM req), c AS (SELECT a.*, docs.* EXCLUDE (document_id), {_ROLE} AS role FROM a JOIN docs USING (document_id)),
s AS (SELECT *, CAST({_BONUS} AS DECIMAL(4,2)) + CAST(least(300, 45 * len(list_filter(task_terms, lambda y: contains(lower(content), y)))) AS DECIMAL(10,2)) * 0.01 + CASE WHEN role IN ('chart', 'table') AND {_has("asked", selection.AMOUNT_CUES)} THEN 1.5 ELSE 0 END AS score, len(regexp_extract_all(content, '[0-9]')) AS digits FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, slide_id ORDER BY score DESC, digits DESC, slide_no, chunk_id) > 1 AS again FROM s)
SELECT query_id, document_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, document_id ORDER BY again, score DESC, digits DESC, slide_no, chunk_id) AS INTEGER) AS place, CAST(score AS DOUBLE) AS score FROM w QUALIFY place <= 4""")
def r13_document_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty texts are a document, four a slide, every third a table; a benchmark text asks about two documents."""
    table_row = F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 20).alias("document_id"), F.floor(F.col("doc_id") / 4).alias("slide_id"), (F.col("doc_id") % 5).alias("slide_no"), F.col("text").alias("content"), table_row.alias("chunk_type"))
    asked = _requests(spark, sf_dir).select("query_id", "question", F.explode(F.array(F.col("query_id"), F.col("query_id") + 1)).alias("document_id"))
    return selection.document_anchors(asked, chunks).withColumn("score", F.col("score").cast("double"))
