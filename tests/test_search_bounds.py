"""Searches hold a bounded number of similarities and pairs at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import coverage, mentions, search


def test_vectors_are_multiplied_in_slices(spark, monkeypatch):
    """What a task keeps between slices is cut to the best k, with ties by id."""
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, (300, 3)).astype(float)
    monkeypatch.setattr(search, "_CELLS", 64)
    kept = (np.array([1, 1]), np.array([9, 4]), np.array([0.5, 0.5]))
    q, c, s = search._best(kept, [(np.array([2, 1]), np.array([7, 2]), np.array([0.1, 0.5]))], 2)
    assert (q.tolist(), c.tolist(), s.tolist()) == ([1, 1, 2], [2, 4, 7], [0.5, 0.5, 0.1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(300, None), (301, [1.0])], "chunk_id long, vec array<double>")
    got = search.vector_search(rows.filter("chunk_id < 40").withColumnRenamed("chunk_id", "query_id"), rows, 5).collect()
    unit = search._unit_rows(vecs)
    sims = np.round(unit[:40] @ unit.T, 6)
    want = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(300), -sims[i]))[:5] if sims[i, j] >= 0.3}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want


def test_pairs_of_queries_and_chunks_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(search, "_PAIRS", 100)
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("red "), F.col("id").cast("string")).alias("content"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.array(F.lit("red"), F.col("id").cast("string")).alias("terms"))
    scores = search.bm25_scores(chunks, queries)
    assert "REPARTITION_BY_NUM, [" in scores._jdf.queryExecution().executedPlan().toString() and scores.count() == 500


def test_words_are_dealt_before_they_are_counted(spark):
    """No task counts the words of a whole file, and none sorts all rows of a query's lanes."""
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.concat(F.lit("red red "), F.col("id").cast("string")).alias("content"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.array(F.lit("red"), F.col("id").cast("string")).alias("terms"))
    scores = search.bm25_scores(chunks, queries)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" not in plan[plan.index("REPARTITION_BY_NUM") :].split("BroadcastExchange")[0]
    lanes = search.document_lanes(scores.withColumn("document_id", F.col("chunk_id") % 3), 5)
    assert "WindowGroupLimit" in lanes._jdf.queryExecution().executedPlan().toString()
    rows = sorted(((r["query_id"], -r["score"], r["chunk_id"]) for r in scores.collect()))
    want = {}
    for query, _, chunk in rows:
        own = want.setdefault(query, [[], {}])
        own[0].append(chunk)
        own[1].setdefault(chunk % 3, []).append(chunk)
    size = max(4, min(8, 16 // 3 + 2))
    expected = {(q, c, "global" if c in whole[:5] else "document") for q, (whole, docs) in want.items() for own in docs.values() for c in own if c in whole[:5] or c in own[:size]}
    assert {(r["query_id"], r["chunk_id"], r["lane"]) for r in lanes.collect()} == expected


def test_features_are_never_shuffled(spark):
    """Hash embeddings against plain loops; texts are dealt by id once."""
    import hashlib
    from collections import Counter

    texts = [(1, "Revenue grew, revenue_2 fell 12 times"), (2, "净利息收入 rose rose"), (3, ""), (4, None)]
    rows = search.hash_embedding(spark.createDataFrame(texts, "id long, text string"))
    want = Counter()
    for key, words in ((1, ["revenue", "grew", "revenue_2", "fell", "12", "times"]), (2, ["净利", "利息", "息收", "收入", "rose", "rose"])):
        for w in words:
            for feature in [w] + ["#" + w[k : k + 3] for k in range(len(w) - 2) if len(w) > 3]:
                number = int(hashlib.md5(feature.encode()).hexdigest()[:15], 16)
                want[key, number % 384] += 1 - 2 * (number // 384 % 2)
    assert {(r["id"], r["bucket"]): r["weight"] for r in rows.collect()} == {k: v for k, v in want.items() if v}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan.split("Initial Plan")[0].split("Final Plan")[-1]


def test_terms_are_looked_for_in_words_not_in_runs_of_characters(spark, monkeypatch):
    """Texts are not cut into rows of three characters; the best k of each query are those of plain search, ties by id."""
    monkeypatch.setattr(search, "_CELLS", 16)
    texts = ["Red redder", "a-b under", "", None, "库存周转 red", "x" * 300 + "red", "ed a-b", "red under a-b 存周", "éred ÉRED", "under_red"] * 3
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    asked = {"p": ["red", "red", "und", ""], "q": ["a-b", "存周", "ed"], "r": ["zz"], "s": ["é", "r_r"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>")
    want = set()
    for q, terms in asked.items():
        scores = [(-sum(t in c.lower() for t in set(terms) - {""}), i) for i, c in enumerate(texts) if c is not None]
        want |= {(q, i, float(-n), at) for at, (n, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:5], 1)}
    for block in (1, 4096):
        found = search.substring_search(chunks, queries, 5, block=block)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in found.select("query_id", "chunk_id", "score", "rank").collect()} == want


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_few_labels_are_found_without_shuffling_texts(spark, monkeypatch, few):
    """Each text is walked by itself, in slices; the first place counts, and labels with one spelling are found each."""
    monkeypatch.setattr(mentions, "_FEW_LABELS", few)
    monkeypatch.setattr(mentions, "_CHARS", 16)
    texts = [(1, "Blue anvil, blueanvil"), (2, "xblue anvil blue anvil"), (3, "\N{GRINNING FACE}é, anvil."), (4, None), (5, ""), (6, "blue anvil" * 9), (7, "库存 blue")]
    labels = [("a", "blue anvil"), ("b", " Blue Anvil"), ("c", "é, an"), ("d", "库存"), ("e", ""), ("f", "zz"), ("a", "blue anvil"), ("g", "blue")]
    found = mentions.mention_join(spark.createDataFrame(labels, "label_id string, label string"), spark.createDataFrame(texts, "text_id long, text string"))
    if few:
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("a", 1, 0), ("a", 2, 12), ("b", 1, 0), ("b", 2, 12), ("c", 3, 1), ("d", 7, 0), ("g", 1, 0), ("g", 2, 12), ("g", 6, 0), ("g", 7, 3)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_contracts_are_computed_once(spark):
    """Questions are read once, not for each use of their parts, and what is found in them is never broadcast."""
    requests = spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("How much did sales and cost change in "), (F.col("id") + 2000).cast("string")).alias("question"), F.lit(False).alias("deep"))
    glossary = spark.createDataFrame([("Turnover", "sales"), ("Turnover", "revenue"), ("Cost", "cost")], "term string, alias string")
    found = coverage.evidence_contract(requests, glossary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "BuildLeft" not in plan
    assert {(r["query_id"], r["subject"]) for r in found.collect()} == {(i, s) for i in range(20) for s in ("turnover", "cost")}
