"""What a conversation remembers: old turns folded into bounded lists, those cut to a token budget, and the context of an answer at a given place.

The fold goes turn by turn: each turn's items join their lists at the end, known ones keep their place (references take the newer form there), and what is beyond a list's limit leaves it at the front. So folding in parts gives what folding at once gives, and a stream what a batch gives (``sondage.streaming.compact``). The order of turns is the operator's own: a conversation is folded by one task, but never held by it, since turns come in order and the state is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import estimate_tokens, truncate_to_tokens
from sondage.operators.selection import hold

#: Lists of a summary, how many items each holds and how many characters an item.
LIMITS = {"conversation_goals": (8, 300), "entities": (20, 80), "time_ranges": (12, 80), "resolved_references": (8, 300), "pending_questions": (8, 300), "user_preferences": (8, 120), "source_message_ids": (64, 80)}
#: The order in which lists give up items for a budget.
REMOVED_FIRST = ("source_message_ids", "entities", "time_ranges", "terminology", "user_preferences", "pending_questions", "conversation_goals", "resolved_references", "document_scope")
#: Fixed value: how periods are written.
PERIOD = r"20[0-9]{2}(?:[ \t]*(?:年|[-/][0-9]{1,2}|[Qq][1-4]|第?[一二三四1-4]季度))?|(?:[Qq][1-4]|第?[一二三四1-4]季度)(?:[ \t]*20[0-9]{2})?"

_STRINGS = ("conversation_goals", "entities", "time_ranges", "pending_questions", "user_preferences", "source_message_ids")
_REFERENCE = "struct<original:string,resolved:string,source_message_id:string>"
SUMMARY = ", ".join(f"{n} array<{_REFERENCE if n == 'resolved_references' else 'string'}>" for n in LIMITS)
_ARROW_REFERENCE = pa.list_(pa.struct([("original", pa.string()), ("resolved", pa.string()), ("source_message_id", pa.string())]))


def _plain(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")), 1, limit)


def turn_items(turns: DataFrame) -> DataFrame:
    """conversation_id, sequence_no and what each turn adds to each list. turns: conversation_id, sequence_no (the answer's), question, canonical (the question made self-contained), resolved, question_id, answer_id.

    Entities are words of ASCII letters, digits and ``& / _ -`` that begin with a letter and have a capital or a digit; an unresolved question is pending; a resolved one whose canonical form differs is a reference; Chinese questions ask for Chinese answers.
    """
    both = F.concat_ws(" ", "question", "canonical")
    words = F.regexp_extract_all(both, F.lit(r"[\p{L}\p{N}_&/-]+"), F.lit(0))
    entity = F.filter(words, lambda w: w.rlike("^[A-Za-z][A-Za-z0-9&/_-]{1,39}$") & w.rlike("[A-Z0-9]"))
    question, canonical = _plain(F.col("question"), 300), _plain(F.col("canonical"), 300)
    differs = F.trim(F.regexp_replace("question", r"[ \t\n\x0B\f\r]+", " ")) != F.trim(F.regexp_replace("canonical", r"[ \t\n\x0B\f\r]+", " "))
    reference = F.struct(question.alias("original"), canonical.alias("resolved"), F.substring(F.col("question_id").cast("string"), 1, 300).alias("source_message_id"))
    some = lambda when, value, kind="string": F.when(when, F.array(value)).otherwise(F.array().cast(f"array<{kind}>"))
    return turns.select(
        "conversation_id",
        "sequence_no",
        some(canonical != "", canonical).alias("conversation_goals"),
        entity.alias("entities"),
        F.regexp_extract_all(both, F.lit(PERIOD), F.lit(0)).alias("time_ranges"),
        some(F.col("resolved") & differs & (question != ""), reference, _REFERENCE).alias("resolved_references"),
        some(~F.col("resolved") & (question != ""), question).alias("pending_questions"),
        some(F.col("question").rlike(r"[\x{4e00}-\x{9fff}]"), F.lit("respond_in_zh")).alias("user_preferences"),
        F.array(F.col("question_id").cast("string"), F.col("answer_id").cast("string")).alias("source_message_ids"),
    )


def empty_summary() -> dict[str, list]:
    return {name: [] for name in LIMITS}


def fold_turn(summary: dict[str, list], turn: dict[str, Any]) -> None:
    """Add one turn's items to a summary, in place."""
    for name, (most, _) in LIMITS.items():
        items = summary[name]
        if name == "resolved_references":
            for x in turn[name]:
                at = next((k for k, y in enumerate(items) if y["original"].lower() == x["original"].lower()), None)
                if at is None:
                    items.append(dict(x))
                else:
                    items[at] = dict(x)
        else:
            known = {y.lower() for y in items}
            for x in turn[name]:
                if x.lower() not in known:
                    known.add(x.lower())
                    items.append(x)
        del items[:-most]


def _folded(rows: Iterable[dict[str, Any]]) -> Iterator[tuple[Any, int, int, dict[str, list]]]:
    """(conversation, last turn, turns, summary) of turns that come in order."""
    now, last, n, summary = None, 0, 0, empty_summary()
    for row in rows:
        if n and row["conversation_id"] != now:
            yield now, last, n, summary
            n, summary = 0, empty_summary()
        now, last, n = row["conversation_id"], row["sequence_no"], n + 1
        fold_turn(summary, row)
    if n:
        yield now, last, n, summary


def compact(items: DataFrame) -> DataFrame:
    """conversation_id, through_sequence, n_folded and the lists, of all turns in ``items`` (``turn_items``) in their order."""
    spark_type = items.schema["conversation_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list) -> pa.RecordBatch:
            columns = [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([f[3][n] for f in found], _ARROW_REFERENCE if n == "resolved_references" else pa.list_(pa.string())) for n in LIMITS)], ["conversation_id", "through_sequence", "n_folded", *LIMITS])

        first = next(batches, None)
        if first is None:
            return
        kind, found = first.schema.field("conversation_id").type, []
        rows = (row for batch in (x for part in ([first], batches) for x in part) for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)) for row in small.to_pylist())
        for one in _folded(rows):
            found.append(one)
            if len(found) == 1000:
                yield packed(found)
                found = []
        if found:
            yield packed(found)

    rows = items.repartition("conversation_id").sortWithinPartitions("conversation_id", "sequence_no")
    return rows.mapInArrow(fold, f"conversation_id {spark_type}, through_sequence long, n_folded long, {SUMMARY}")


def old_turns(turns: DataFrame, keep: int) -> DataFrame:
    """All turns of a conversation but the newest ``keep``, up to the first gap. A turn follows the one whose number is 2 less; the first has 2, or 3 after a message of the system."""
    by = Window.partitionBy("conversation_id")
    rows = turns.withColumns({"_back": F.row_number().over(by.orderBy(F.desc("sequence_no"))), "_nth": F.row_number().over(by.orderBy("sequence_no")), "_first": F.min("sequence_no").over(by)})
    return rows.filter((F.col("_back") > keep) & (F.col("_first") <= 3) & (F.col("sequence_no") == F.col("_first") + 2 * (F.col("_nth") - 1))).drop("_back", "_nth", "_first")


def _json_items(name: str) -> Column:
    """An item's text in JSON."""
    return F.transform(F.col(name), lambda x: F.to_json(x) if name == "resolved_references" else F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))


def summary_json(names: Iterable[str] = tuple(sorted(LIMITS))) -> Column:
    """The lists as one JSON object, keys in order."""
    return F.to_json(F.struct(*(F.col(n) for n in names)))


def fit_summary(summaries: DataFrame, budget: int) -> DataFrame:
    """Summaries that take at most ``budget`` estimated tokens as JSON: the oldest items go, list by list in the fixed order, until the rest fits; ``fits`` is false where even empty lists don't, and lists are empty then.

    What can stay is the longest end of all items in the order of their removal, so it is found from that end, adding up what an item takes, its comma included.
    """
    names = [n for n in REMOVED_FIRST if n in LIMITS]
    wide = lambda c: F.regexp_count(c, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"))
    cost = lambda n, k: F.transform(_json_items(n), lambda j: F.struct(F.lit(k).alias("field"), wide(j).alias("wide"), (F.length(j) - wide(j)).alias("other")))
    items = F.reverse(F.concat(*(cost(n, k) for k, n in enumerate(names))))
    bare = len("{" + ",".join(f'"{n}":[]' for n in sorted(names)) + "}")
    kept = [F.lit(0).alias(n) for n in names]
    zero = F.struct(F.lit(0).alias("wide"), F.lit(bare).alias("other"), F.lit(-1).alias("field"), F.lit(bare <= budget * 4).alias("on"), *kept)

    def add(acc: Column, x: Column) -> Column:
        other = acc["other"] + x["other"] + (acc["field"] == x["field"]).cast("int")
        fits = acc["on"] & (acc["wide"] + x["wide"] + F.ceil(other / 4) <= budget)
        return F.struct(F.when(fits, acc["wide"] + x["wide"]).otherwise(acc["wide"]).alias("wide"), F.when(fits, other).otherwise(acc["other"]).alias("other"), F.when(fits, x["field"]).otherwise(acc["field"]).alias("field"), fits.alias("on"), *((acc[n] + (fits & (x["field"] == k)).cast("int")).alias(n) for k, n in enumerate(names)))

    rows = hold(summaries, _kept=F.aggregate(items, zero, add))
    ends = {n: F.slice(F.col(n), F.size(n) - F.col(f"_kept.{n}") + 1, F.col(f"_kept.{n}")) for n in names}
    return rows.select(*(ends[c].alias(c) if c in ends else F.col(c) for c in summaries.columns), F.lit(bare <= budget * 4).alias("fits"))


def context_at(turns: DataFrame, summaries: DataFrame, cutoffs: DataFrame, *, token_budget: int = 2400, summary_budget: int = 800, most: int = 4) -> DataFrame:
    """The context of a message: conversation_id, cutoff, through_sequence, n_turns, tokens, truncated, history (id, role, content), context_hash.

    The newest summary that ends before the cutoff, cut to its budget; then the newest turns after it and before the cutoff, ``most`` at most, while they fit into what is left. The newest may be cut: a third of what is left for the question, the rest for the answer. The hash is that of the context as JSON, so equal contexts have equal hashes.

    turns: conversation_id, sequence_no (the answer's), question, answer, question_id, answer_id; summaries: as of ``compact``, several a conversation; cutoffs: conversation_id, cutoff.
    """
    names = sorted(LIMITS)
    by = Window.partitionBy("conversation_id", "cutoff").orderBy(F.desc("through_sequence"))
    before = cutoffs.join(summaries, "conversation_id").filter("through_sequence < cutoff").withColumn("nth", F.row_number().over(by)).filter("nth = 1").drop("nth")
    fitted = fit_summary(before, summary_budget)
    have = hold(fitted, summary=F.when(F.col("fits"), summary_json(names)).otherwise("{}")).select("conversation_id", "cutoff", "through_sequence", "summary")
    rows = cutoffs.join(have, ["conversation_id", "cutoff"], "left").withColumns({"summary": F.coalesce("summary", F.lit("{}")), "through_sequence": F.coalesce("through_sequence", F.lit(0).cast("long"))})
    rows = hold(rows, left=F.greatest(F.lit(token_budget) - estimate_tokens(F.col("summary")), F.lit(0)))
    open_ = rows.join(turns, "conversation_id", "left").withColumn("fit", (F.col("sequence_no") - 1 > F.col("through_sequence")) & (F.col("sequence_no") - 1 < F.col("cutoff")))
    newest = Window.partitionBy("conversation_id", "cutoff").orderBy(F.desc("sequence_no"))
    open_ = open_.filter("fit").withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most)
    open_ = hold(open_, q=estimate_tokens(F.col("question")), a=estimate_tokens(F.col("answer")))
    open_ = open_.withColumn("used", F.sum(F.col("q") + F.col("a")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    # a turn beyond the budget ends the choice, so running sums tell who is in
    open_ = open_.filter((F.col("left") > 0) & ((F.col("used") <= F.col("left")) | (F.col("back") == 1)))
    share = F.least("left", F.greatest(F.lit(1), F.floor(F.col("left") / 3).cast("int")))
    cut = (F.col("back") == 1) & (F.col("used") > F.col("left"))
    texts = hold(open_, qt=F.when(cut, truncate_to_tokens(F.col("question"), share)).otherwise(F.col("question")), at=F.when(cut, truncate_to_tokens(F.col("answer"), F.col("left") - share)).otherwise(F.col("answer")), truncated=cut)
    message = lambda i, role, c: F.struct(F.col(i).cast("string").alias("id"), F.lit(role).alias("role"), F.col(c).alias("content"))
    pair = F.struct("sequence_no", F.array(message("question_id", "user", "qt"), message("answer_id", "assistant", "at")).alias("m"))
    # at most ``most`` turns
    told = texts.groupBy("conversation_id", "cutoff").agg(F.flatten(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["m"])).alias("history"), F.count("*").alias("n_turns"), F.sum(estimate_tokens(F.col("qt")) + estimate_tokens(F.col("at"))).alias("told"), F.bool_or("truncated").alias("truncated"))
    out = rows.join(told, ["conversation_id", "cutoff"], "left").withColumns({"n_turns": F.coalesce("n_turns", F.lit(0).cast("long")), "truncated": F.coalesce("truncated", F.lit(False)), "history": F.coalesce("history", F.array().cast("array<struct<id:string,role:string,content:string>>"))})
    tokens = (estimate_tokens(F.col("summary")) + F.coalesce("told", F.lit(0))).cast("long")
    payload = F.concat(F.lit('{"conversation_id":"'), F.col("conversation_id").cast("string"), F.lit('","cutoff":'), F.col("cutoff").cast("string"), F.lit(',"history":'), F.to_json("history"), F.lit(',"summary":'), "summary", F.lit("}"))
    return out.select("conversation_id", "cutoff", "through_sequence", "n_turns", tokens.alias("tokens"), "truncated", "history", F.sha2(payload.cast("binary"), 256).alias("context_hash"))


