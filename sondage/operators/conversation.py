"""Conversations: messages (conversation_id, sequence_no, role, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import estimate_tokens


def assign_sequence(messages: DataFrame, order: list[str]) -> DataFrame:
    return messages.withColumn("sequence_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy(*order)))


def pair_turns(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's message right after: conversation_id, turn (the user's number), question, answer."""
    w = Window.partitionBy("conversation_id").orderBy("sequence_no")
    after = lambda c: F.lead(c).over(w)
    rows = messages.withColumns({"next_role": after("role"), "next_no": after("sequence_no"), "answer": after("content")})
    return rows.filter("role = 'user' and next_role = 'assistant' and next_no = sequence_no + 1").select("conversation_id", F.col("sequence_no").alias("turn"), F.col("content").alias("question"), "answer")


def turn_totals(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conversation_id").agg(F.count("*").alias("total_turns"), F.max("turn").alias("last_turn"))


def token_budget_select(turns: DataFrame, budget: int, most: int) -> DataFrame:
    """Newest turns first while their tokens fit ``budget``, ``most`` at most; the newest stays even where it alone is too long, marked as truncated."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("tokens", estimate_tokens(F.col("question")) + estimate_tokens(F.col("answer")))
    rows = rows.withColumns({"back": F.row_number().over(newest), "used": F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.filter((F.col("back") <= most) & ((F.col("used") <= budget) | (F.col("back") == 1)))
    return rows.select("conversation_id", "turn", F.least("tokens", F.lit(budget)).alias("tokens"), ((F.col("back") == 1) & (F.col("tokens") > budget)).alias("truncated"))


def between(turns: DataFrame, bounds: DataFrame) -> DataFrame:
    """Turns after ``through`` and before ``cutoff`` of their conversation."""
    return turns.join(bounds, "conversation_id").filter("turn > through and turn < cutoff")


def overview(messages: DataFrame) -> DataFrame:
    """Per conversation: number of messages, last number, last question."""
    asked = F.when(F.col("role") == "user", F.col("sequence_no"))
    return messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.max("sequence_no").alias("last_sequence"), F.max_by("content", asked).alias("last_question"))


def contiguous(messages: DataFrame) -> DataFrame:
    """Messages up to the first that is not completed."""
    first = F.min(F.when(F.col("status") != "completed", F.col("sequence_no"))).over(Window.partitionBy("conversation_id"))
    return messages.withColumn("gap", first).filter("gap is null or sequence_no < gap").drop("gap")
