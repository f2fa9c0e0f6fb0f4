import math

import numpy as np
import pytest

from sondage.llm.hard_negatives import mine_hard_negatives, whole_numbers

SCHEMA = "vec_id long, label string, v array<long>, score double, row string"


def brute(rows, every=50):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for i, (a, label, v, *_) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), math.inf if b is None else b, b, m) for j, (b, m, w, *_) in enumerate(rows) if j != i), key=lambda s: s[:2])  # noqa: B905
        for p, _, b, m in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, b, k, s[2], -p, -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0.5, "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, mine_hard_negatives(df, **more).collect()), key=str)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_brute_force(spark, spread):
    """Narrow clusters, whose members stop early, and none; blocks and segments of a few rows."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), str(i % 4), [int(x) for x in np.floor(256 * (centres[i % 6] + spread * rng.normal(size=8)))]) for i in rng.permutation(600)]
    want = brute(rows, 10)
    assert want and mined(spark, rows, every=10, block_anchors=7, segment_rows=40) == want
    assert mined(spark, rows, every=10) == want


def test_nulls_ties_repeats_and_lengths(spark):
    rng = np.random.default_rng(1)
    vector = lambda: [int(x) for x in rng.integers(-2, 3, 3)]  # noqa: E731  many ties
    rows = [(i, "ab"[i % 2], vector()) for i in range(120)]
    rows += [((1 << 53) + 1, "a", [1, 2, 1]), ((1 << 53) + 2, "b", [1, 2, 1]), (50, None, [1, 1, 1]), (100, "a", None), (3, "b", [1, None, 2]), (None, "b", [2, 2, 2]), (None, "a", [2, 2, 1]), (200, "a", [0, 0, 0]), (250, "b", []), (300, "a", [2, 2]), (350, "c", [2, 2, 2]), (60, "a", [2, 2, 2])]
    want = brute(rows, 10)
    assert want and mined(spark, rows, every=10, segment_rows=16) == want
    # of repeated rows each is an anchor, and the other's neighbour
    twice = [r for r in rows if r[0] is not None for _ in range(2)]
    assert mined(spark, twice, every=10, segment_rows=16) == brute(twice, 10)


def test_hot_vector_and_empty_tables(spark):
    rows = [(i, str(i % 2), [256, 0] if i % 3 else [200 + i % 50, i % 7]) for i in range(900)]
    assert mined(spark, rows, every=10, block_anchors=16, segment_rows=64) == brute(rows, 10)
    assert mined(spark, []) == [] and mined(spark, [(1, "a", [1])]) == [] and mined(spark, [(50, "a", [1])]) == []


def test_large_numbers(spark):
    rows = [(i * 10, "ab"[i % 2], [(1 << 30) - i, i - (1 << 30), 1]) for i in range(20)]
    assert mined(spark, rows, every=10, low=10, high=100) == sorted(brute_wide(rows), key=str)


def brute_wide(rows):
    out = []
    for a, label, v in rows:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, m) for b, m, w in rows if b != a)
        for p, b, m in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 10 * -p <= 100 * -s[0] <= 100 * -p][:3]
            out += [(a, b, k, s[1], -p, -s[0]) for k, s in enumerate(fits, 1)]
    return out


def test_whole_numbers(spark):
    rows = [([0.5, -0.001],), ([1e300, 0.0],), ([float("nan")],), ([float("inf")],), ([1.0, None],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<double>")
    assert [r.v for r in got.select(whole_numbers(got, "e", 256).alias("v")).collect()] == [[128, -1], None, None, None, None, None, []]
