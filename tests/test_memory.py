"""Conversation memory: folds, budgets and the stream beside the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sondage.operators import memory
from sondage.plans.conversation_queries import _full_turns
from sondage.streaming.compact import compact_stream
from sondage.streaming.sinks import newest

D = "/root/testdata/sf0.01"
TURN = "conversation_id long, sequence_no long, question string, answer string, canonical string, resolved boolean, question_id string, answer_id string"


def turn(n, question, canonical=None, resolved=True, conversation=1):
    return (conversation, 2 * n, question, "fine", canonical or question, resolved, f"q{n}", f"a{n}")


def test_lists_of_a_summary(spark):
    rows = [turn(1, "Why did North-2 fall in 2024Q3?"), turn(2, "and then", "And NORTH-2 in 2025?"), turn(3, "still open", resolved=False), turn(4, "And  Then", "What of X9 in Q1 2026")]
    got = memory.compact(memory.turn_items(spark.createDataFrame(rows, TURN))).first()
    assert got.through_sequence == 8 and got.n_folded == 4
    assert got.conversation_goals == ["Why did North-2 fall in 2024Q3?", "And NORTH-2 in 2025?", "still open", "What of X9 in Q1 2026"]
    assert got.entities == ["Why", "North-2", "And", "Then", "What", "X9", "Q1"]
    assert got.time_ranges == ["2024Q3", "2025", "Q1 2026"]
    assert [tuple(r) for r in got.resolved_references] == [("And Then", "What of X9 in Q1 2026", "q4")]  # the newer form at the earlier place
    assert got.pending_questions == ["still open"] and got.user_preferences == []
    assert got.source_message_ids == ["q1", "a1", "q2", "a2", "q3", "a3", "q4", "a4"]


def test_limits_and_folding_in_parts(spark):
    rng = random.Random(2)
    rows = [turn(n, f"Topic{rng.randrange(14)} and Name{rng.randrange(30)} of 20{rng.randrange(10, 40)}", resolved=n % 3 > 0) for n in range(1, 121)]
    items = memory.turn_items(spark.createDataFrame(rows, TURN))
    whole = memory.compact(items).first()
    assert all(len(whole[n]) <= most for n, (most, _) in memory.LIMITS.items()) and len(whole.entities) == 20
    state = memory.empty_summary()
    listed = sorted((r.asDict(recursive=True) for r in items.collect()), key=lambda r: r["sequence_no"])
    for r in listed[:50]:
        memory.fold_turn(state, r)
    state = json.loads(json.dumps(state))  # as it would be stored between two runs
    for r in listed[50:]:
        memory.fold_turn(state, r)
    assert state == {n: whole.asDict(recursive=True)[n] for n in memory.LIMITS}


@pytest.mark.parametrize("budget", [10, 60, 75, 120, 200, 400, 4000])
def test_budgets_like_dropping_one_by_one(spark, budget):
    rows = [turn(n, f"Frage {n} 中文{n % 4} Name{n} 20{n + 10}", f"Self-contained {n} in Q{1 + n % 4}", n % 3 > 0) for n in range(1, 30)]
    summary = memory.compact(memory.turn_items(spark.createDataFrame(rows, TURN)))
    lists = {n: summary.first().asDict(recursive=True)[n] for n in memory.LIMITS}
    wide = lambda c: "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿"

    def tokens():
        text = json.dumps(lists, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        n = sum(map(wide, text))
        return n + -(-(len(text) - n) // 4)

    while tokens() > budget and any(lists.values()):
        del next(lists[n] for n in memory.REMOVED_FIRST if lists.get(n))[0]
    got = memory.fit_summary(summary, budget).first().asDict(recursive=True)
    assert {n: got[n] for n in memory.LIMITS} == lists and got["fits"] == (tokens() <= budget)


def test_context_cuts_the_newest_turn(spark):
    rows = [(1, 2, "short", "a" * 400, "short", True, "q1", "a1"), (1, 4, "q" * 90, "b" * 900, "x", True, "q2", "a2")]
    turns = spark.createDataFrame(rows, TURN)
    summaries = memory.compact(memory.turn_items(turns.filter("false")))
    at = lambda n, budget: memory.context_at(turns, summaries, spark.createDataFrame([(1, n)], "conversation_id long, cutoff long"), token_budget=budget).first()
    all_ = at(5, 2400)
    assert (all_.n_turns, all_.truncated, all_.through_sequence) == (2, False, 0) and [m.id for m in all_.history] == ["q1", "a1", "q2", "a2"]
    cut = at(5, 61)
    assert (cut.n_turns, cut.truncated, cut.tokens) == (1, True, 61) and [len(m.content) for m in cut.history] == [80, 160]
    assert at(3, 2400).n_turns == 1 and at(1, 2400).n_turns == 0
    assert at(5, 2400).context_hash == all_.context_hash != cut.context_hash


def test_stream_equals_batch_over_shuffled_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    turns = _full_turns(spark, D)
    rows = memory.turn_items(turns).collect()
    schema = memory.turn_items(turns).schema
    # one conversation lacks a turn: what comes after it waits
    lost = next(r for r in rows if r.sequence_no == 4 and any(x.conversation_id == r.conversation_id and x.sequence_no == 8 for x in rows))
    rows = [r for r in rows if r is not lost]
    random.Random(1).shuffle(rows)
    path = f"file://{tmp_path}/in"
    for k in range(4):
        part = rows[k::4] + (rows[:30] if k == 3 else [])  # some come twice
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    out = f"{tmp_path}/out"
    query = compact_stream(stream, 1).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"file://{out}/{n}")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = newest(spark.read.option("recursiveFileLookup", "true").parquet(f"file://{out}"), ["conversation_id"], "through_sequence")
    want = memory.compact(memory.turn_items(memory.old_turns(turns, 1).filter(F.col("conversation_id") != lost.conversation_id)))
    as_rows = lambda df: sorted(str(r) for r in df.select("conversation_id", "through_sequence", "n_folded", *memory.LIMITS).collect())
    assert as_rows(got.filter(F.col("conversation_id") != lost.conversation_id)) == as_rows(want)
    held = got.filter(F.col("conversation_id") == lost.conversation_id).first()
    assert held.through_sequence == 2  # not beyond the gap
