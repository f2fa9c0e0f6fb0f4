"""Numeric facts and what answers may say, with examples of our own; whole documents against a scanner."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sondage.operators import scope
from sondage.operators import verification as V
from sondage.plans import registry

D = "/root/testdata/sf0.001"


def facts(spark, text):
    rows = spark.createDataFrame([(text,)], "text string").select(V.numeric_facts(F.col("text")).alias("f")).first().f
    return None if rows is None else [(r.exact, r.unit) for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2. Yield rose from 3.5% to 4%. [3]\n- 7) open\n# **4. Outlook**", [("3.5", "percent"), ("4", "percent")]),
        ("45 branches closed", [("45", None)]),
        ("HKD 2.5bn, $ 1,300k, 25 basis points, 2.0x, 3个百分点", [("2500000000", "currency:hkd"), ("1300000", "currency:usd"), ("25", "basis_point"), ("2", "multiple"), ("3", "percentage_point")]),
        ("25M persistency 88%", [("88", "percent")]),
        ("H1 x7 -0.25 亿 +07.50", [("-25000000", None), ("7.5", None)]),
        ("900719925474099312345678901234567890 vs 0.1234567890123", [("900719925474099312345678901234567890", None), ("0.1234567890123", None)]),
        ("", []),
        (None, None),
    ],
)
def test_facts(spark, text, want):
    assert facts(spark, text) == want


def test_units_of_table_headers(spark):
    texts = ["| | £m | rate |\n| a | 2 | 5% |\n| b | 3 bps | 6 |\nplain 4\n| c | 5 |", "| CNY | 7 | 8 |\n| 9 |", None]
    rows = V.number_rows(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id", "k").collect()
    assert [(r.id, r.exact, r.unit) for r in rows] == [(0, "2000000", "currency:gbp"), (0, "5", "percent"), (0, "3", "basis_point"), (0, "6", None), (0, "4", None), (0, "5", None), (1, "7", "currency:cny"), (1, "8", "currency:cny"), (1, "9", "currency:cny")]


@pytest.mark.parametrize(
    ("answer", "evidence", "want"),
    [
        ("Deposits grew to GBP 3bn; £3,000m. [1]", "Deposits £3bn", []),
        ("Deposits were 3000000000%. [1]", "Deposits £3bn", ["3000000000"]),
        ("Margin is 40%, over the floor. [1]\nThe buffer is 15 percentage points. [1]", "margin 40%, floor 25%", []),
        ("Margin is 40%, over the floor. [1]\nIt is 15 percentage points. [1]", "margin 40%, floor 25%", ["15"]),
        ("It is a change of 60% and 1.6x. [1]", "from 25 to 40", []),
        ("In 2031 it was 6.", "31/3: 6", []),
        ("In 2030 it was 6.", "31/3: 6", ["2030"]),
        ("The account is 12345678901234567 of 98765432109876543210987654321098765.", "12345678901234568", ["12345678901234567", "98765432109876543210987654321098765"]),
        (None, "6", []),
        ("It was 6.", None, ["6"]),
    ],
)
def test_support(spark, answer, evidence, want):
    a = spark.createDataFrame([(1, answer)], "answer_id int, text string")
    e = spark.createDataFrame([(1, evidence), (2, "6 2030 15 3000000000")], "answer_id int, text string")
    got = V.unsupported_numbers(a, e).collect()
    assert sorted(r.raw.rstrip("% percentagoins") for r in got) == sorted(want)


def scan(text):
    """The digits of each number of a text, character by character."""
    words = sorted((*V.SCALES, *(u for u in V.UNITS)), key=len, reverse=True)
    letter = lambda c: c.isascii() and c.isalpha()
    digit = lambda c: "0" <= c <= "9"
    out, i = [], 0
    while i < len(text):
        sign = text[i] in "+-" and i + 1 < len(text) and digit(text[i + 1])
        before = text[i - 1] if i else " "
        if not (digit(text[i]) or sign) or before.isascii() and (before.isalnum() or before == "_"):
            i += 1
            continue
        start = i + sign
        j = start
        while j < len(text) and digit(text[j]):
            j += 1
        end = j
        if j - start <= 3:
            while text[j : j + 1] == "," and len(text[j + 1 : j + 4]) == 3 and all(map(digit, text[j + 1 : j + 4])):
                j += 4
        ends = {j, end}
        found = None
        for stop in sorted(ends, reverse=True):
            k = stop
            if text[k : k + 1] == "." and k + 1 < len(text) and digit(text[k + 1]):
                k += 1
                while k < len(text) and digit(text[k]):
                    k += 1
            rest = text[k:].lstrip(" \t\n\r\x0b\x0c").lower()
            unit = any(rest.startswith(w) and not letter(rest[len(w) : len(w) + 1] or " ") for w in words)
            if unit or not letter(text[k : k + 1] or " "):
                found = k
                break
        if found is None:
            return None  # backtracks into a shorter number: left to the engine
        out.append(text[i:found].lstrip("+").replace(",", ""))
        i = found
    return out


def test_whole_documents_against_a_scanner(spark):
    got = {}
    for r in registry.queries()["x4_numeric_facts"](spark, D).orderBy("doc_id", "k").collect():
        got.setdefault(r.doc_id, []).append(r)
    compared = 0
    for doc_id, text in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect():
        if any(c in (text or "") for c in "[|#*") or any(line.lstrip()[:1].isdigit() for line in (text or "").split("\n")):
            continue  # labels, tables and list numbers have tests of their own
        want = scan(text or "")
        if want is not None:
            rows = got.get(doc_id, [])
            assert [Decimal(r.raw.replace(",", "").lstrip("$€£¥").split("%")[0].strip("+ kKmMxXbn")) for r in rows] == [Decimal(w) for w in want], doc_id
            compared += len(want)
    assert compared > 20


def test_segments(spark):
    text = "1. First point! Second 2.5 one. [1] [2] Third\n\n| a. | b. |\n答案。还有？"
    got = spark.createDataFrame([(text,)], "t string").select(V.segments(F.col("t")).alias("s")).first().s
    assert got == ["1. First point!", " Second 2.5 one. [1] [2]", " Third", "| a. | b. |", "答案。", "还有？"]


SCOPE = "answer_id int, selected array<string>, excluded array<string>, families array<struct<family:string,names:array<string>,least:int>>, no_mapping boolean"


def test_scope_of_series(spark):
    answers = spark.createDataFrame([(1, "Blue-Sky cards and sky loans; 北方区域 rose, 南方 fell"), (2, None), (3, "x")], "answer_id int, text string")
    scopes = spark.createDataFrame([(1, ["Blue Sky"], ["Sky", "blue", "loan", "北方", "南方"], [("bar", ["Blue Sky", "Loans", "Other"], 3), ("line", ["北方"], 5)], False), (2, [], ["Sky"], [("bar", ["A"], 1)], False)], SCOPE)
    got = {r.answer_id: (r.outside, r.lacking) for r in V.series_scope(answers, scopes).collect()}
    assert got == {1: (["Sky", "南方"], ["bar"]), 2: ([], ["bar"])}


CASES = [
    ("Retail loans were 7 [1].", ["loans 7"], "accepted", [], None),
    ("", [], "accepted", [], None),
    ("# A\n## B\nRetail loans were 7 [1]. Cards were 8 [1].\n\n**C**\nCards were 8 [1].", ["loans 7"], "repaired", ["NUMERIC"], "## B\nRetail loans were 7 [1]."),
    ("Retail loans were 7 [1]. See [4].", ["loans 7"], "repaired", ["CITATION"], "Retail loans were 7 [1]."),
    ("Retail loans were 7.", ["loans 7"], "fallback", ["CITATION"], None),
    ("Cards 8 [1].", ["loans 7"], "fallback", ["NUMERIC"], None),
    ("There are no material risks in lending [1]. Retail loans were 7 [1].", ["loans 7"], "repaired", ["ABSOLUTE_NEGATIVE"], "Retail loans were 7 [1]."),
    ("There are no material risks in lending [1].", ["The audit saw no material risks in lending."], "accepted", [], None),
    ("We cannot confirm that none remain; loans were 7 [1].", ["loans 7"], "accepted", [], None),
]


def repaired(spark, cases, scope_rows=()):
    """The results of (text, evidence) cases, all in one run."""
    a = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "answer_id int, text string")
    e = spark.createDataFrame([(i, k + 1, t) for i, (_, evidence) in enumerate(cases) for k, t in enumerate(evidence)], "answer_id int, ref_no int, text string")
    found = V.repair_answers(a, e, spark.createDataFrame(list(scope_rows), SCOPE))
    return sorted(found.collect(), key=lambda r: r.answer_id)


def test_repair(spark):
    got = repaired(spark, [case[:2] for case in CASES])
    for r, (text, _, disposition, warnings, new) in zip(got, CASES, strict=True):
        assert (r.disposition, r.repaired) == (disposition, new), text
        assert len(r.warnings) == len(warnings) and all(any(w in x for x in r.warnings) for w in warnings), text
    again = repaired(spark, [(new, evidence) for _, evidence, _, _, new in CASES if new is not None])
    assert {r.disposition for r in again} == {"accepted"}  # what was repaired needs no repair


def test_causes_count_where_charts_map_nothing(spark):
    text = "Retail loans were 7 [1]. They rose due to rates [1]. This is not proof, though it may be caused by rates [1]."
    free, bound = repaired(spark, [(text, ["loans 7"])] * 2, [(1, [], [], [], True)])
    assert free.disposition == "accepted"
    assert bound.repaired == "Retail loans were 7 [1]. This is not proof, though it may be caused by rates [1]."


def test_chunks_with_cjk_terms(spark):
    rows = spark.createDataFrame([(1, "收入增长来自北方地区"), (2, "收入增长来自北方地区。"), (3, "alpha beta gamma delta epsilon zeta eta theta iota"), (4, "alpha beta gamma delta epsilon zeta eta theta"), (5, ""), (6, None)], "id int, text string")
    got = {r.id: (r.set_id, r.n_links) for r in scope.near_duplicate_chunks(rows).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 1), 4: (4, 1)}


def test_chunks_of_large_groups_meet_in_blocks(spark, monkeypatch):
    """Links against brute force: a group of copies in many blocks, copies with another home, and texts of two lengths of signature."""
    monkeypatch.setattr(scope, "_BLOCK", 3)
    base = [f"w{k}" for k in range(60)]
    texts = [base[:i] + [f"x{i}"] + base[i + 1 :] for i in range(0, 60, 3)] + [base + [f"y{i}-{k}" for k in range(i)] for i in range(9)]
    wide = [f"v{k}" for k in range(350)]
    texts += [wide, wide[:330], wide[:300], base[:20] + wide[:20], wide[20:40] + base[30:50]]
    want = [sum(i != j and 100 * len(set(a) & set(b)) >= 88 * max(len(a), len(b)) for j, b in enumerate(texts)) for i, a in enumerate(texts)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["n_links"] for r in scope.near_duplicate_chunks(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) > 20


def test_numbers_of_21_to_29_digits_have_a_value(spark):
    long = "123456789012345678901234"
    rows = spark.createDataFrame([(1, f"{long} units, then {long}.5 million and -1.25 bn")], "id long, text string")
    got = [(r["value"] and str(r["value"]), r["exact"]) for r in V.number_rows(rows).orderBy("k").collect()]
    assert got == [(f"{long}.000000000", long), (None, f"{long}.5e6"), ("-1250000000.000000000", "-1250000000")]


def test_a_confidence_of_zero_is_zero(spark):
    rows = spark.createDataFrame([(1, None, 0.0), (2, None, None), (3, '{"confidence": 0.5}', 0.0)], "id int, metadata_json string, element_confidence double").withColumn("source_kind", F.lit(""))
    assert [r["confidence"] for r in scope.hydrate(rows).orderBy("id").collect()] == [0.0, 1.0, 0.5]


def _shuffled(spark, df) -> float:
    """Bytes that a run of ``df`` writes to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    every = lambda: {x.stageId(): x.shuffleWriteBytes() for x in (stages().apply(i) for i in range(stages().size()))}
    before = set(every())
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in every().items() if k not in before)


def test_terms_of_chunks_are_shuffled_twice_at_most(spark):
    """Once by id, and once to the sets of the same home; sets that are alone in theirs stay."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000)]
    rows = [(i, " ".join(rng.sample(words, 150))) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert _shuffled(spark, scope.near_duplicate_chunks(df)) < 5 * sum(len(t) for _, t in rows)
