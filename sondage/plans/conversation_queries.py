"""Conversation state over the shared conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import conversation, memory
from sondage.sources.bindings import table

from .registry import query


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).alias("sequence_no"), "role", F.col("text").alias("content"))


_M = "m AS (SELECT conv_id AS conversation_id, turn + 1 AS sequence_no, role, text AS content FROM conversations)"
_T = f"{_M}, t AS (SELECT u.conversation_id, u.sequence_no AS turn, u.content AS question, a.content AS answer FROM m u JOIN m a ON u.conversation_id = a.conversation_id AND a.sequence_no = u.sequence_no + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query(f"WITH {_T} SELECT conversation_id, turn, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM t")
def j6_pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.pair_turns(_messages(spark, sf_dir)).select("conversation_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("SELECT conv_id AS conversation_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS INTEGER) AS sequence_no FROM conversations")
def w1_assign_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role")
    return conversation.assign_sequence(rows, ["role", "turn"]).drop("role")


@query(f"WITH {_T} SELECT conversation_id, count(*) AS total_turns, max(turn) AS last_turn FROM t GROUP BY 1")
def w2_total_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turn_totals(conversation.pair_turns(_messages(spark, sf_dir)))


@query(f"""WITH {_T}, k AS (SELECT *, CAST(ceil(length(question) / 4.0) + ceil(length(answer) / 4.0) AS INTEGER) AS tok FROM t), r AS (SELECT *, row_number() OVER w AS back, sum(tok) OVER w AS used FROM k WINDOW w AS (PARTITION BY conversation_id ORDER BY turn DESC))
SELECT conversation_id, turn, CAST(least(tok, 120) AS INTEGER) AS tokens, back = 1 AND tok > 120 AS truncated FROM r WHERE back <= 4 AND (used <= 120 OR back = 1)""")
def w15_token_budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.token_budget_select(conversation.pair_turns(_messages(spark, sf_dir)), 120, 4)


@query(f"WITH {_T}, b AS (SELECT conversation_id, min(turn) AS lo, max(turn) AS hi FROM t GROUP BY 1) SELECT t.conversation_id, turn FROM t JOIN b USING (conversation_id) WHERE turn > lo AND turn < hi")
def j8_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation.pair_turns(_messages(spark, sf_dir))
    return conversation.between(turns, turns.groupBy("conversation_id").agg(F.min("turn").alias("through"), F.max("turn").alias("cutoff"))).select("conversation_id", "turn")


@query(f"WITH {_M} SELECT conversation_id, count(*) AS n_messages, max(sequence_no) AS last_sequence, arg_max(content, sequence_no) FILTER (role = 'user') AS last_question FROM m GROUP BY 1")
def a7_conversation_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.overview(_messages(spark, sf_dir))


@query(f"WITH {_M}, g AS (SELECT *, min(CASE WHEN length(content) % 7 = 0 THEN sequence_no END) OVER (PARTITION BY conversation_id) AS gap FROM m) SELECT conversation_id, sequence_no FROM g WHERE gap IS NULL OR sequence_no < gap")
def v4c_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose length is divisible by seven stand for unfinished ones."""
    rows = _messages(spark, sf_dir).withColumn("status", F.when(F.length("content") % 7 == 0, "running").otherwise("completed"))
    return conversation.contiguous(rows).select("conversation_id", "sequence_no")


def _full_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their answers. Canonical forms name a period or a topic in some; questions whose length is divisible by five are unresolved."""
    turns = conversation.pair_turns(_messages(spark, sf_dir))
    third = F.col("turn") % 3
    canonical = F.when(third == 0, F.concat("question", F.lit(" in 2024 Q2 vs FY2023"))).when(third == 1, F.concat(F.lit("About KPI-7: "), "question")).otherwise(F.col("question"))
    ident = lambda c: F.concat(F.lit("m"), "conversation_id", F.lit("-"), c)
    return turns.select("conversation_id", (F.col("turn") + 1).cast("long").alias("sequence_no"), "question", "answer", canonical.alias("canonical"), (F.length("question") % 5 != 0).alias("resolved"), ident(F.col("turn")).alias("question_id"), ident(F.col("turn") + 1).alias("answer_id"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.compact(memory.turn_items(memory.old_turns(_full_turns(spark, sf_dir), 1)))


_LISTS = tuple(memory.LIMITS)
_FULL = rf"""{_T}, f AS (SELECT conversation_id, turn + 1 AS sequence_no, question, answer, CASE turn % 3 WHEN 0 THEN question || ' in 2024 Q2 vs FY2023' WHEN 1 THEN 'About KPI-7: ' || question ELSE question END AS canonical, length(question) % 5 <> 0 AS resolved,
  'm' || conversation_id || '-' || turn AS question_id, 'm' || conversation_id || '-' || (turn + 1) AS answer_id FROM t),
g AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no) AS nth, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no DESC) AS back, min(sequence_no) OVER (PARTITION BY conversation_id) AS fst FROM f),
o AS (SELECT *, substr(trim(regexp_replace(question, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 300) AS q, substr(trim(regexp_replace(canonical, '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 300) AS c, question || ' ' || canonical AS both_ FROM g WHERE back > 1 AND fst <= 3 AND sequence_no = fst + 2 * (nth - 1)),
it AS (SELECT conversation_id, nth, sequence_no, [c] AS conversation_goals, list_filter(regexp_extract_all(both_, '[\p{{L}}\p{{N}}_&/-]+'), lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9&/_-]{{1,39}}$') AND regexp_matches(w, '[A-Z0-9]')) AS entities, regexp_extract_all(both_, '{memory.PERIOD}') AS time_ranges,
  CASE WHEN resolved AND trim(regexp_replace(question, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> trim(regexp_replace(canonical, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) THEN [{{'original': q, 'resolved': c, 'source_message_id': question_id}}] ELSE [] END AS resolved_references, CASE WHEN resolved THEN [] ELSE [q] END AS pending_questions, CASE WHEN regexp_matches(question, '[\x{{4e00}}-\x{{9fff}}]') THEN ['respond_in_zh'] ELSE [] END AS user_preferences, [question_id, answer_id] AS source_message_ids FROM o),
"""


def _joined(name: str) -> str:
    """Old and new items, each spelling once at its first place; references in their newest form there."""
    both = f"list_concat(r.{name}, it.{name})"
    if name == "resolved_references":
        first = f"list_filter({both}, lambda x, i: list_position(list_transform({both}, lambda y: lower(y.original)), lower(x.original)) = i)"
        return f"list_transform({first}, lambda x: list_extract(list_filter({both}, lambda z: lower(z.original) = lower(x.original)), -1))[-{memory.LIMITS[name][0]}:]"
    return f"list_filter({both}, lambda x, i: list_position(list_transform({both}, lambda y: lower(y)), lower(x)) = i)[-{memory.LIMITS[name][0]}:]"


_TYPES = {n: "STRUCT(original VARCHAR, resolved VARCHAR, source_message_id VARCHAR)[]" if n == "resolved_references" else "VARCHAR[]" for n in _LISTS}
_FOLDED = f"""{_FULL} r AS (SELECT DISTINCT conversation_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS sequence_no, {", ".join(f"CAST([] AS {_TYPES[n]}) AS {n}" for n in _LISTS)} FROM it
  UNION ALL SELECT it.conversation_id, it.nth, it.sequence_no, {", ".join(_joined(n) for n in _LISTS)} FROM r JOIN it ON it.conversation_id = r.conversation_id AND it.nth = r.nth + 1),
s AS (SELECT conversation_id, sequence_no AS through_sequence, nth AS n_folded, {", ".join(_LISTS)} FROM r WHERE nth > 0 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY nth DESC) = 1)"""
_SHOWN_SQL = ", ".join(f"array_to_string({'list_transform(' + n + ', lambda x: x.original || chr(61) || x.resolved || chr(61) || x.source_message_id)' if n == 'resolved_references' else n}, '|') AS {n}" for n in _LISTS)


def _shown(df: DataFrame) -> DataFrame:
    """Lists as text."""
    text = lambda n: F.transform(n, lambda x: F.concat_ws("=", x["original"], x["resolved"], x["source_message_id"])) if n == "resolved_references" else F.col(n)
    return df.withColumns({n: F.array_join(text(n), "|") for n in _LISTS})


@query(f"WITH RECURSIVE {_FOLDED} SELECT conversation_id, through_sequence, n_folded, {_SHOWN_SQL} FROM s")
def v3c_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns but the newest."""
    return _shown(_summaries(spark, sf_dir))


#: Items in the order in which they go; what stays is the longest end that fits.
_FIT = rf"""{_FOLDED}, fi AS (SELECT conversation_id, f, i, j, CAST(len(regexp_extract_all(j, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]')) AS BIGINT) AS wide, length(j) AS n FROM (
  {" UNION ALL ".join(f"SELECT conversation_id, {k} AS f, i, CAST(to_json({n}[i]) AS VARCHAR) AS j FROM s, unnest(range(1, len({n}) + 1)) AS u(i)" for k, n in enumerate(memory.REMOVED_FIRST) if n in memory.LIMITS)})),
fc AS (SELECT *, sum(wide) OVER w AS w_all, sum(n - wide) OVER w + (count(*) OVER w - count(DISTINCT f) OVER w) AS o_all FROM fi WINDOW w AS (PARTITION BY conversation_id ORDER BY f DESC, i DESC ROWS UNBOUNDED PRECEDING)),
fk AS (SELECT conversation_id, f, i FROM fc QUALIFY bool_and(w_all + ceil((o_all + @bare) / 4.0) <= @budget) OVER (PARTITION BY conversation_id ORDER BY f DESC, i DESC ROWS UNBOUNDED PRECEDING)),
fn AS (SELECT conversation_id, {", ".join(f"count(*) FILTER (f = {k}) AS n_{n}" for k, n in enumerate(memory.REMOVED_FIRST) if n in memory.LIMITS)} FROM fk GROUP BY 1),
fs AS (SELECT s.conversation_id, through_sequence, n_folded, {", ".join(f"CASE WHEN COALESCE(n_{n}, 0) = 0 THEN [] ELSE {n}[-n_{n}:] END AS {n}" for n in _LISTS)} FROM s LEFT JOIN fn USING (conversation_id))"""
_BARE = len("{" + ",".join(f'"{n}":[]' for n in sorted(_LISTS)) + "}")


def _fitted(budget: int) -> str:
    return _FIT.replace("@bare", str(_BARE)).replace("@budget", str(budget))


@query(f"WITH RECURSIVE {_fitted(260)} SELECT conversation_id, through_sequence, n_folded, {_SHOWN_SQL}, true AS fits FROM fs")
def v2c_fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries cut to 260 estimated tokens."""
    return _shown(memory.fit_summary(_summaries(spark, sf_dir), 260))


_WIDE_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def _tok(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{_WIDE_SQL}')) + ceil((length({x}) - len(regexp_extract_all({x}, '{_WIDE_SQL}'))) / 4.0) AS BIGINT)"


def _cut(x: str, n: str) -> str:
    """Texts of these tables have no wide characters: a budget is four characters a token, one of them the mark."""
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {_tok(x)} <= {n} THEN {x} ELSE regexp_replace(substr({x}, 1, CAST(4 * {n} - 1 AS BIGINT)), '\\s+$', '') || '…' END"


_JSON = ", ".join(f"'{n}': {n}" for n in sorted(_LISTS))


@query(f"""WITH RECURSIVE {_fitted(200)}, cu AS (SELECT conversation_id, max(sequence_no) AS cutoff FROM m WHERE role = 'user' GROUP BY 1),
hv AS (SELECT cu.conversation_id, cutoff, COALESCE(through_sequence, 0) AS through_sequence, COALESCE(CAST(to_json({{{_JSON}}}) AS VARCHAR), '{{}}') AS summary FROM cu LEFT JOIN fs ON fs.conversation_id = cu.conversation_id AND through_sequence < cutoff),
hb AS (SELECT conversation_id, cutoff, through_sequence, CASE WHEN has THEN summary ELSE '{{}}' END AS summary FROM (SELECT hv.*, EXISTS (SELECT 1 FROM fs WHERE fs.conversation_id = hv.conversation_id AND fs.through_sequence < cutoff) AS has FROM hv)),
hl AS (SELECT *, greatest(400 - {_tok("summary")}, 0) AS room FROM hb),
ot AS (SELECT hl.*, f.sequence_no, question, answer, question_id, answer_id, row_number() OVER w AS back, sum({_tok("question")} + {_tok("answer")}) OVER w AS used FROM hl JOIN f ON f.conversation_id = hl.conversation_id AND f.sequence_no - 1 > through_sequence AND f.sequence_no - 1 < cutoff WINDOW w AS (PARTITION BY hl.conversation_id ORDER BY f.sequence_no DESC)),
oc AS (SELECT *, back = 1 AND used > room AS cut_, least(room, greatest(1, room // 3)) AS share FROM ot WHERE back <= 4 AND room > 0 AND (used <= room OR back = 1)),
tx AS (SELECT *, CASE WHEN cut_ THEN {_cut("question", "share")} ELSE question END AS qt, CASE WHEN cut_ THEN {_cut("answer", "(room - share)")} ELSE answer END AS at_ FROM oc),
hi AS (SELECT conversation_id, list([{{'id': question_id, 'role': 'user', 'content': qt}}, {{'id': answer_id, 'role': 'assistant', 'content': at_}}] ORDER BY sequence_no) AS h, count(*) AS n_turns, sum({_tok("qt")} + {_tok("at_")}) AS told, bool_or(cut_) AS truncated FROM tx GROUP BY 1)
SELECT hl.conversation_id, cutoff, through_sequence, COALESCE(n_turns, 0) AS n_turns, CAST({_tok("summary")} + COALESCE(told, 0) AS BIGINT) AS tokens, COALESCE(truncated, false) AS truncated,
  sha256('{{"conversation_id":"' || hl.conversation_id || '","cutoff":' || cutoff || ',"history":' || COALESCE(CAST(to_json(flatten(h)) AS VARCHAR), '[]') || ',"summary":' || summary || '}}') AS context_hash FROM hl LEFT JOIN hi USING (conversation_id)""")
def v1c_context_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each conversation's last question, in 400 estimated tokens, of which the summary takes 200."""
    messages = _messages(spark, sf_dir)
    cutoffs = messages.filter("role = 'user'").groupBy("conversation_id").agg(F.max("sequence_no").alias("cutoff"))
    found = memory.context_at(_full_turns(spark, sf_dir), _summaries(spark, sf_dir), cutoffs, token_budget=400, summary_budget=200)
    return found.drop("history")
