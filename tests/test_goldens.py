"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from sondage.functions import text as X
from sondage.operators import conversation, cubes, lifecycle, metrics, search, tables


def points(spark, rows):
    return spark.createDataFrame([("s", series, category, k, float(v) if v is not None else None) for k, (series, category, v) in enumerate(rows)], "scope_id string, series_name string, category string, point_order int, y_value double")


def test_growth_attribution(spark):
    p = points(spark, [("FY2024", "North", 100), ("FY2024", "South", 80), ("FY2024", "West", 40), ("FY2025", "North", 150), ("FY2025", "South", 105), ("FY2025", "West", 35)])
    got = {r.category: (r.change, round(r.share, 2), r.is_primary) for r in cubes.group_change_attribution(p, "FY2024", "FY2025").collect()}
    assert got == {"North": (50, 71.43, True), "South": (25, 35.71, True), "West": (-5, -7.14, False)}
    assert cubes.group_change_attribution(p, "FY2025", "FY2024").count() == 0


def test_year_on_year_takes_the_newest_period_with_a_partner(spark):
    r = cubes.yoy_pair(points(spark, [("ROEV", "24/12", 53.4), ("ROEV", "25/12", 56.1), ("ROEV", "26/03", 56.0)]), 2025).first()
    assert (r.base_category, r.target_category, round(r.change, 1), round(r.change_pct, 1)) == ("24/12", "25/12", 2.7, 5.1)


def test_composition_and_comparison(spark):
    pie = points(spark, [("share", "North", 60), ("share", "South", 40), ("share", "East", None)])
    got = {r.category: (r.total, r.share_pct, r.is_largest, r.percent_scale) for r in cubes.share_composition(pie).collect()}
    assert got == {"North": (100, 60, True, True), "South": (100, 40, False, True)}
    two = points(spark, [("Revenue", "Q2", 120), ("Profit", "Q2", 100)])
    assert cubes.compare_series(two, "Revenue", "Profit").first()[2:] == ("Revenue", 20)


def test_common_totals_need_all_series(spark):
    p = points(spark, [("a", "2024Q1", 1), ("a", "2024Q2", 2), ("b", "2024Q1", 3), ("b", "2024Q2", 4), ("a", "2024Q3", 9)])
    assert sorted((r.category, r.total) for r in cubes.common_totals(p).collect()) == [("2024Q1", 4), ("2024Q2", 6)]
    assert cubes.common_totals(p.filter("series_name = 'a'")).count() == 0


@pytest.mark.parametrize(("current", "condition", "passes"), [("43%", "<45%", True), ("68%", "<70%", True), ("12%", ">10%", True), ("52%", "<50%", False), ("9%", ">8%", True), ("n/a", ">8%", None), ("9", "none", None)])
def test_conditions(spark, current, condition, passes):
    assert spark.range(1).select(tables.condition_passes(F.lit(current), F.lit(condition))).first()[0] is passes


def facts(spark, source, cells):
    return spark.createDataFrame([(source, "VONB", k, float(v)) for k, v in cells.items()], "source string, metric string, label string, value double")


def test_reconciliation_and_its_negative(spark):
    table = facts(spark, "table", {"Hong Kong": 2256, "Mainland China": 1660, "Thailand": 587, "Singapore": 444, "Malaysia": 285, "Other": 865})
    chart = facts(spark, "chart", {"Hong Kong": 2256, "Mainland China": 1660, "Thailand": 587, "Singapore": 444, "Other": 1150})
    r = tables.reconcile(table, chart).first()
    assert (r.target_label, r.folded, r.target_value, r.folded_value) == ("Other", "Malaysia", 1150, 285)
    narrow, broad = {"North": 100, "South": 50, "Adjacent": 20, "Residual": 30}, {"North": 100, "South": 50, "Residual": 50}
    assert tables.reconcile(facts(spark, "chart", narrow), facts(spark, "table", broad)).first().folded_value == 20
    assert tables.reconcile(facts(spark, "chart", narrow), facts(spark, "table", broad | {"Residual": 51})).count() == 0


def test_groups_and_tables(spark):
    cells = spark.createDataFrame([("t", label, 1, h, v) for label, a, b in (("a", 2480.0, 34.0), ("b", 1743.0, 24.0), ("c", 2314.0, 32.0), ("d", 420.0, 6.0), ("e", 180.0, 2.0)) for h, v in (("VONB", a), ("share", b))], "table_id string, row_label string, col_ix int, header string, value double")
    got = {r.header: (r.a, r.b, r.difference, r.multiple) for r in tables.compare_groups(cells, ["a", "b"], ["c", "d", "e"]).collect()}
    assert got == {"VONB": (4223, 2914, 1309, 1.45), "share": (58, 40, 18, 1.45)}
    chunk = spark.createDataFrame([("c", "市场 | VONB | x\n香港 | 2,256\nTotal | 9 | 8 | 7"), ("d", "no table")], "chunk_id string, content string")
    assert sorted(((r.row_label, r.header, r.value) for r in tables.parse_tables(chunk).collect()), key=str) == sorted([("香港", "VONB", 2256.0), ("香港", "x", None), ("Total", "VONB", 9.0), ("Total", "x", 8.0)], key=str)


def test_rank_fusion(spark):
    lane = lambda *ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id int, chunk_id string, rank int")
    rows = search.rrf([("lexical", lane("lexical-only", "both"), 1.25), ("vector", lane("both", "vector-only"), 1.0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["both", "lexical-only", "vector-only"] and rows[0].score == 0.03655473 and rows[0].sources == "lexical,vector"


def test_rerank_and_variants(spark):
    candidates = spark.createDataFrame([(1, c, k + 1) for k, c in enumerate("abcde")], "query_id int, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.9), (1, "e", 1.0)], "query_id int, chunk_id string, score double")
    assert [r.chunk_id for r in search.apply_rerank(candidates, scores, 4).orderBy("rank").collect()] == list("bcade")
    ranked = spark.createDataFrame([(1, 1, 1.35, "x", 1), (1, 2, 1.0, "x", 2), (1, 2, 1.0, "y", 1)], "query_id int, variant_id int, weight double, chunk_id string, rank int")
    assert [(r.chunk_id, r.variants) for r in search.fuse_variants(ranked).orderBy("rank").collect()] == [("x", "1,2"), ("y", "2")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.parse_number(F.lit("down −1,234.5 bp"))) == -1234.5
    assert one(X.hard_constraints(F.lit("2025 Q1 and 12.5% of 2025"))) == ["2025", "Q1", "12.5%"]
    assert one(X.estimate_tokens(F.lit("新业务 ab"))) == 4 and one(X.answer_language(F.lit("新"))) == "zh"
    assert one(cubes.period_coordinate(F.lit("25/12"))).asDict() == {"year": 2025, "suffix": "M12"}
    assert [one(cubes.is_temporal(F.lit(x))) for x in ("FY2025", "25/12", "2025Q1", "Asia")] == [True, True, True, False]


def test_context_and_sequences(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"m{k}" * 30) for k in range(1, 8)]
    turns = conversation.pair_turns(spark.createDataFrame(rows, "conversation_id int, sequence_no int, role string, content string"))
    assert sorted(r.turn for r in turns.collect()) == [1, 3, 5]
    got = conversation.token_budget_select(turns, 20, 4).collect()
    assert [(r.turn, r.tokens, r.truncated) for r in got] == [(5, 20, True)]


def test_lifecycle(spark):
    new = spark.createDataFrame([("w", 9, "h1"), ("w", 10, "h3")], "workspace_id string, document_id long, sha256 string")
    old = spark.createDataFrame([("w", 1, "h1", 1), ("w", 2, "h1", 2), ("v", 3, "h3", 1)], "workspace_id string, document_id long, sha256 string, version_no int")
    by = lambda mode: sorted(tuple(r) for r in lifecycle.dedup_by_content(new, old, mode).collect())
    assert by("reuse") == [("w", "h1", 9, 2), ("w", "h3", 10, 10)] and by("new_version") == [("w", "h1", 9, 3), ("w", "h3", 10, 1)]
    assert [r.document_id for r in lifecycle.dedup_by_content(new, old, "reject").collect()] == [9]
    kept, counts = lifecycle.purge({"docs": (old, "document_id")}, new.select(F.lit(1).alias("document_id")), "document_id")
    assert counts.first()[1] == 1 and lifecycle.purge({"docs": (kept["docs"], "document_id")}, new.select(F.lit(1).alias("document_id")), "document_id")[1].first()[1] == 0


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2)], "key string, at long, left_id long")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b")], "key string, at long, v string")
    assert {r.left_id: r.v for r in metrics.as_of(left, right, "key", "at", "v").collect()} == {1: "a", 2: None}


def test_answers(spark):
    from sondage.operators import evidence

    answers = spark.createDataFrame([(1, "up [1], [2]", 2), (2, "up [3]", 2), (3, "up", 1), (4, "up", 0)], "answer_id int, answer string, n_evidence int")
    assert {r.answer_id: (r.unknown, r.ok) for r in evidence.verify_citations(answers).collect()} == {1: ([], True), 2: ([3], False), 3: ([], False), 4: ([], True)}
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(evidence.markdown_balanced(F.lit("**a** `x`"))) and not one(evidence.markdown_balanced(F.lit("**a")))
    groups = F.array(F.array(F.lit("5,516"), F.lit("5516")), F.array(F.lit("9%")))
    assert one(evidence.group_coverage(F.lit("US$5,516M"), groups)) == 0.5
    assert one(evidence.abstains(F.lit("There is not enough evidence."))) and not one(evidence.abstains(F.lit("It rose.")))
    texts = lambda t: spark.createDataFrame([(1, t)], "id int, text string")
    assert evidence.token_multiset_changes(texts("5% and 5% [1]"), texts("[1] 5% 5%")).count() == 0
    assert [(r.token, r.in_before, r.in_after) for r in evidence.token_multiset_changes(texts("5% and 5%"), texts("5%")).collect()] == [("5%", 2, 1)]
    wanted = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, document_id string")
    assert tuple(evidence.document_coverage(wanted, wanted.filter("document_id = 'a'")).first()) == (1, 1, ["b"])


def test_chart_scopes(spark, tmp_path):
    from sondage.operators import layout

    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    boxes = spark.createDataFrame([("s", "A", 0.0, 0.0, 1.0, 1.0), ("s", "B", 0.0, 0.1, 1.0, 1.0), ("s", "C", 2.0, 2.0, 3.0, 3.0), ("t", "A", 0.0, 0.0, 1.0, 1.0)], "slide_id string, element_id string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r) for r in layout.chart_scopes(boxes).collect()) == [("s", "A", "A"), ("s", "B", "A"), ("s", "C", "C"), ("t", "A", "A")]


def test_keys_of_whole_texts_and_full_width_forms(spark):
    df = spark.createDataFrame([("Ｒｅｖｅｎｕｅ （２０２４）",), ("ﬁrst Half",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normal_key(X.nfkc(F.col("t")))).collect()] == ["revenue2024", "firsthalf", None]


def test_x1_whole_key_tells_texts_with_one_head_apart(spark, tmp_path):
    from sondage.plans.text_queries import x1_whole_key

    spark.createDataFrame([(1, "a " * 300 + "one"), (2, "a " * 300 + "two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.key_md5 for r in x1_whole_key(spark, str(tmp_path)).collect()}) == 2
