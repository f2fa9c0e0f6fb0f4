import numpy as np
import pytest

from sondage.llm import queries
from sondage.llm.quality_model import FOLDS, best_limit, classify, features, fit, fit_fold, loss_and_gradient, word_features


def test_features_of_odd_texts():
    assert len(features(None)) == len(features("")) == 2
    assert word_features("Stupid,") == word_features("stupid") and word_features("***") != word_features("THE!!")
    assert (np.diff(features("a b a c B")) > 0).all()


def test_grades_are_ordered_and_probabilities_exact():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [features(" ".join([f"noise{rng.integers(50)}" for _ in range(20)] + [f"grade{g}"])) for g in grades]
    model = fit(rows, grades, 3)
    assert model.thresholds[0] <= model.thresholds[1]
    expected, top = model.grades(np.array([model.score(r) for r in rows]))
    assert [round(float(expected[grades == g].mean())) for g in range(3)] == [0, 1, 2]
    s = model.score(rows[0])
    above = [1 - 1 / (1 + np.exp(-(t - s))) for t in model.thresholds]
    assert np.isclose(expected[0], sum(above)) and np.isclose(top[0], above[-1])


def test_without_two_grades_everything_is_kept(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = classify(docs.withColumnRenamed("id", "selected"), labels).collect()
    assert len(rows) == docs.count() and all(r.selected for r in rows)
    assert classify(docs, labels.limit(0)).filter("not selected").count() == 0
    assert classify(no_docs, labels).count() == 0


@pytest.mark.parametrize("part", [0])
def test_held_out_accuracy(spark, part):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = classify(docs, labels.filter(f"doc_id % 2 = {part}")).drop("text").join(labels.filter(f"doc_id % 2 <> {part}"), "doc_id")
    r = got.selectExpr("avg(if(toxic=1, int(selected), null)) t", "avg(if(toxic=0 and quality=1, int(selected), null)) g", "avg(if(toxic=0 and quality=0, int(selected), null)) q").first()
    assert r.t < 0.1 and r.g > 0.95 and r.q < 0.7


def test_query(spark):
    rows = queries.op5_quality_classifier(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "expected_grade", "top_probability", "selected"]
    assert rows.filter("expected_grade between 0 and 2 and top_probability between 0 and 1").count() == rows.count() > 0


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)) for _ in range(40)]
    flat, starts = np.concatenate(rows), np.cumsum([0, *(len(r) for r in rows[:-1])])
    grades, share = rng.integers(0, 3, 40), rng.random(40)
    w, cut = rng.normal(size=12), np.array([-0.4, 0.7])
    # the loss itself, by its definition
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def plain(w, cut):
        total = 0.0
        for r, g, h in zip(rows, grades, share, strict=True):
            bounds = [-np.inf, *cut, np.inf]
            total -= h * np.log(logistic(bounds[g + 1] - w[r].sum()) - logistic(bounds[g] - w[r].sum()))
        return total

    loss, by_weight, by_cut = loss_and_gradient(w, cut, flat, starts, grades, share)
    assert np.isclose(loss, plain(w, cut))
    for x, got, at in ((w, by_weight, lambda v: plain(v, cut)), (cut, by_cut, lambda v: plain(w, v))):
        for k in range(len(x)):
            step = np.eye(len(x))[k] * 1e-6
            assert np.isclose(got[k], (at(x + step) - at(x - step)) / 2e-6, rtol=1e-4, atol=1e-7)


def test_limit_and_folds():
    # two good rows lie below 0.5; taking the limit down to 0.3 gains one of them and no bad row
    scored, grades = np.array([0.9, 0.8, 0.7, 0.3, 0.1, 0.2, 0.15, 0.05]), np.array([2, 2, 2, 2, 2, 0, 0, 0])
    assert best_limit(scored, grades, 3, good_counts=1.0) == 0.3
    assert best_limit(scored, grades, 3, good_counts=50.0) == 0.1
    assert best_limit(scored[:5], grades[:5], 3) == 0.5
    rows = [features(f"word{k % 3} other") for k in range(30)]
    held = [fit_fold(rows, np.arange(30) % 3, 3, f) for f in range(FOLDS + 1)]
    assert sum(len(top) for _, top, _ in held) == 30 and len(held[-1][1]) == 0


def test_odd_rows_are_scored(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "good words here " * 9000, "c"), (3, "bad, worse", None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (3, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    got = classify(spark.createDataFrame(rows, "doc_id long, text string, expected_grade string"), labels).collect()
    assert len(got) == 5 and all(0 <= r.top_probability <= 1 and isinstance(r.expected_grade, float) for r in got)
    assert len({r.top_probability for r in got if not r.text}) == 1
