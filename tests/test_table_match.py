"""Requests against tables of our own, and the evaluation and deck operators on small cases."""

import pytest
from pyspark.sql import functions as F

from sondage.operators import coverage, cubes, decks, evaluation, planning, selection, table_match

ROWS = {"t": (["险种", "2023", "2024", "新业务价值", "单位"], [["寿险和年金", "10", "12%", "5", "亿元"], ["Health", "4", "7%", "", "bn"], ["Health Plus/健康险", "3", "9%", "2", None], ["合计", "17", "28%", "7", "亿元"]])}


@pytest.fixture(scope="module")
def cells(spark):
    data = [(t, i + 1, r[0], c, h[c], r[c]) for t, (h, rows) in ROWS.items() for i, r in enumerate(rows) for c in range(1, len(h))]
    return spark.createDataFrame(data, "table_id string, row_ix long, row_label string, col_ix long, header string, raw string")


def ask(spark, *questions):
    return spark.createDataFrame([(i, "t", q) for i, q in enumerate(questions)], "request_id long, table_id string, question string")


def test_rows_and_columns_named(spark, cells):
    asked = ask(spark, "寿险年金的VONB是多少", "Health的2024", "HealthX 2023", "健康险", None, "")
    rows = {(r.request_id, r.row_label) for r in table_match.match_rows(asked, cells).collect()}
    # a conjunction is set aside, an ASCII label ends where its word ends, parts of labels count, nulls name nothing
    assert rows == {(0, "寿险和年金"), (1, "Health"), (3, "Health Plus/健康险")}
    columns = {(r.request_id, r.header) for r in table_match.match_columns(asked, cells).collect()}
    assert columns == {(0, "新业务价值"), (1, "2024"), (2, "2023")}


def test_values_differences_ratios(spark, cells):
    asked = ask(spark, "健康险的2023是多少", "合计的2024", "寿险和年金从2023到2024提高多少", "寿险和年金比健康险2023高多少", "健康险占合计多少，2023", "寿险和年金的2023是健康险的几倍", "Health的新业务价值是健康险的几倍", None)
    values = {r.request_id: (r.header, r.value) for r in table_match.asked_values(asked, cells).collect()}
    assert values[0] == ("2023", "3") and values[1] == ("2024", "28%")  # no unit, and its own
    found = {r.request_id: (r.first, r.second, r.difference, r.points) for r in table_match.asked_differences(asked, cells).collect()}
    # the label with a slash stands in the question by a part of it, whose place is not known: it comes first
    assert found == {2: ("2023", "2024", 2.0, True), 3: ("Health Plus/健康险", "寿险和年金", -7.0, False)}
    ratios = {r.request_id: (r.ratio, r.kind) for r in table_match.asked_ratios(asked, cells).collect()}
    assert ratios == {4: (17.6, "share"), 5: (0.3, "multiple")}  # nothing where a cell is empty


def test_relevance_and_empty(spark, cells):
    tables = spark.createDataFrame([("t", "险种", "table", "合计")], "table_id string, corner string, chunk_type string, content string")
    got = {r.request_id: r.relevance for r in table_match.relevance(ask(spark, "表中险种合计2023", "nothing", None), cells, tables).collect()}
    assert got == {0: 4 + 3 + 5 + 2 + 2, 1: 0, 2: 0}
    none = cells.limit(0)
    for f in (table_match.asked_values, table_match.asked_differences, table_match.asked_ratios, table_match.match_rows):
        assert f(ask(spark, "Health 2023"), none).count() == 0
    assert table_match.stated_share(none, F.lit(True)).count() == 0


def test_recall_and_precision(spark):
    cases = spark.createDataFrame([(1, False, "required"), (2, None, None), (3, True, "required"), (4, False, "optional"), (5, False, "forbidden"), (6, False, "required")], "case_id long, abstains boolean, policy string")
    place = "case_id long, document_id string, slide_no long"
    cited = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (1, None, None), (3, "a", 1), (5, "a", 1)], place)
    gold = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "c", 3), (2, "a", 1)], place)
    assert {r.case_id: r.precision for r in evaluation.citation_precision(cases, cited, gold).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0}
    groups = gold.withColumn("group_no", F.when(F.col("document_id") == "c", 2).otherwise(1))
    assert {r.case_id: r.recall for r in evaluation.evidence_recall(cases, cited, groups).collect()} == {1: 0.5, 2: 0.0, 3: None, 4: None, 5: None, 6: None}
    assert evaluation.evidence_recall(cases.limit(0), cited, groups).count() == 0


def test_sources_reports_retries(spark):
    values = spark.createDataFrame([("s", 1, "vision", 9.0), ("s", 1, "chart_cache", 2.0), ("s", 1, "chart_cache", 3.0), ("s", 2, "embedded_workbook", None), ("s", 2, "pdf", 4.0)], "series string, ix long, source string, value double")
    got = {r.ix: (r.value, r.source, r.value_cache, r.source_cache) for r in evaluation.source_precedence(values, ["series", "ix"]).collect()}
    assert got == {1: (3.0, "chart_cache", 9.0, "vision"), 2: (4.0, "pdf", None, None)}
    runs = spark.createDataFrame([("model", ["A", "A"]), (None, None), ("model", ["B"])], "source string, warnings array<string>")
    assert {(r.kind, r.name): r.n for r in evaluation.run_report(runs).collect()} == {("source", "model"): 2, ("source", "none"): 1, ("warning", "A"): 2, ("warning", "B"): 1}
    quality = "query_id long, documents long, supported long, atoms long"
    first = spark.createDataFrame([(1, 2, 1, 5), (2, 2, 1, 5), (3, 1, 1, 1)], quality)
    again = spark.createDataFrame([(1, 2, 2, 1), (2, 2, 1, 5)], quality)
    assert {r.query_id: (r.atoms, r.retried) for r in evaluation.keep_better(first, again).collect()} == {1: (1, True), 2: (5, False), 3: (1, False)}
    empty = evaluation.score_diagnostics(spark.createDataFrame([], "category string, score double, a double, b double"), ["a", "b"], ("a", "b")).collect()
    assert [tuple(r) for r in empty] == [(None, None, None, None)]


def test_variants(spark):
    asked = spark.createDataFrame([(1, "revenue"), (2, "  "), (3, None), (4, "x" * 400), (5, "Please  compare REVENUE with risk")], "question_id long, text string")
    got = {}
    for r in planning.query_variants(asked).orderBy("question_id", "variant_no").collect():
        got.setdefault(r.question_id, []).append((r.text, r.kind, r.weight))
    assert [t for t, _, _ in got[1]] == ["revenue", "sales", "营收", "收入"]  # its own word is not said twice
    assert set(got) == {1, 5}  # blank, missing and overlong questions have no variant
    assert got[5][:5] == [("Please compare REVENUE with risk", "literal", 1.35), ("compare REVENUE risk", "language_focus", 1.1), ("revenue", "vocabulary_bridge", 1.0), ("risk", "vocabulary_bridge", 1.0), ("trend", "paraphrase_bridge", 1.05)]
    assert len(got[5]) == 14


def test_decks(spark):
    axes = spark.createDataFrame([(1, 1, "a", "catAx", "b"), (1, 2, "b", "valAx", None), (1, 3, "c", "valAx", ""), (2, 1, "a", "valAx", "R")], "chart_id long, axis_no long, axis_id string, axis_type string, position string")
    series = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c", "c"]), (1, 3, ["a"]), (1, 4, ["z"]), (1, 5, None), (2, 1, ["a"])], "chart_id long, series_id long, axis_ids array<string>")
    assert {(r.chart_id, r.series_id): (r.axis_id, r.role) for r in decks.axis_resolution(series, axes).collect()} == {(1, 1): ("b", "primary"), (1, 2): ("c", "secondary"), (1, 3): ("a", "primary"), (2, 1): ("a", "secondary")}
    titles = spark.createDataFrame([("w", 2, 1, 1, "Plan B", "年度计划"), ("w", 3, 5, 2, None, "Plan C-1"), ("w", 3, 4, 3, "Q4 view", None)], "workspace_id string, updated_at long, slide_no long, slide_id long, document_title string, slide_title string")
    assert [r.term for r in decks.document_vocabulary(titles).orderBy("place").collect()] == ["Q4", "view", "Plan", "C-1", "年度计划"]
    assert [r.term for r in decks.document_vocabulary(titles, rows=1).orderBy("place").collect()] == ["Q4", "view"]
    profile = decks.document_profile(*(spark.createDataFrame(rows, schema) for rows, schema in (([(1,), (2,)], "document_id long"), ([(1, 1), (1, 1), (2, 1)], "slide_id long, document_id long"), ([(1, 1, "table"), (2, 2, "text")], "element_id long, slide_id long, element_type string"), ([(1, 2)], "chart_id long, element_id long"), ([], "series_id long, chart_id long"), ([], "point_id long, series_id long"))))
    assert {r.document_id: tuple(r)[1:] for r in profile.collect()} == {1: (2, 2, 1, 1, 0, 0), 2: (0, 0, 0, 0, 0, 0)}


def test_points_and_anchors(spark):
    schema = "scope_id string, series_name string, category string, point_order int, y_value double, unit string, chart_type string, grouping string"
    points = spark.createDataFrame([("s", "A", "2023 Q1", 1, 0.0, "USD", "bar", None), ("s", "A", "2023Q2", 2, 5.0, "", "bar", None), ("s", "B", "2023Q2", 2, 4.0, "eur", "line", None), ("s", "B", "2023 Q1", 1, 4.0, "EUR", "line", None), ("s", "B", "x", 3, None, None, None, None)], schema)
    pairs = spark.createDataFrame([("s", "A", "2023q1", "2023 q2"), ("s", "B", "2023q2", "x"), ("s", None, "a", None)], "scope_id string, series_name string, start_category string, end_category string")
    assert [(r.change, r.change_pct) for r in cubes.change_between(points, pairs).collect()] == [(5.0, None)]
    assert [(r.category, r.higher_series, r.unit) for r in cubes.compare_measured(points, "A", "B").collect()] == [("2023Q2", "A", "eur")]
    assert cubes.bar_totals(points).count() == 0  # one series of bars has no total
    chunks = spark.createDataFrame([(1, "d", 1, 1, "12 34", "table"), (2, "d", 1, 1, "revenue 5", "chart_series"), (3, "d", 2, 2, None, "table"), (4, "d", 2, 2, "revenue", "text"), (5, "d", 3, None, "7", "table")], "chunk_id long, document_id string, slide_id long, slide_no long, content string, chunk_type string")
    asked = spark.createDataFrame([(1, "revenue amount", "d"), (1, "revenue amount", "d"), (2, "x", "none")], "query_id long, question string, document_id string")
    got = selection.document_anchors(asked, chunks, 3).orderBy("place").collect()
    assert [r.chunk_id for r in got][0] == 2 and len(got) == 3 and 4 not in [r.chunk_id for r in got]
    assert len({r.chunk_id for r in got} & {1}) == 0  # the first of each slide comes before a second


def test_complete_answers(spark):
    facets = spark.createDataFrame([(1, 1, "f", "l", "net sales", ["net sales"], [], ["numeric"], 1, ["sales", "net"], False), (2, 1, "f", "l", "", [], [], ["direct_support"], 1, [], False), (3, 1, "f", "l", "margin", ["margin"], [], ["numeric"], 1, ["margin", "group"], False)], "query_id long, facet_no int, facet_id string, label string, subject string, aliases array<string>, constraints array<string>, validators array<string>, minimum int, match_terms array<string>, semantic_required boolean")
    evidence = spark.createDataFrame([(1, "e", 1, "net sales were 5", "chart", "", "native", 1.0, "d", 1), (2, "e", 1, "5", "chart", "", "native", 1.0, "d", 1), (3, "e", 1, "profit was 5", "chart", "", "native", 1.0, "d", 1)], "query_id long, evidence_id string, place int, text string, role string, extraction string, source_kind string, confidence double, document_id string, slide_id long")
    assert {r.query_id: r.complete for r in coverage.fully_answers(facets, evidence).collect()} == {1: True, 2: False, 3: False}
    assert {r.query_id: r.complete for r in coverage.fully_answers(facets, evidence.limit(0), facets.filter("query_id = 3").select("query_id")).collect()} == {1: False, 2: False, 3: True}
