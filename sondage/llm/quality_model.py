"""Ordinal quality model: cumulative-link regression on hashed text features.

One weight vector is shared by all grades; ordered thresholds cut its score into grades: P(grade <= k) = logistic(threshold_k - score). The expected grade and the probability of the top grade select documents. The model is fitted on a bounded sample of labelled rows (``per_grade`` rows of each grade, by a hash of the id), and the limit for selection set on the same rows, each scored by a model that has not seen it; every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, slices, worker_cache

#: Hash buckets of the weights: 2**20 floats, whatever the corpus.
BITS = 20
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_"
_SYMBOLS = "#*$%&|<>"
#: Words whose features a worker keeps, about 200 bytes each.
_MOST_SEEN = 150_000


def _bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> bytes:
    """Buckets of a word: itself, its first four and five letters, its shape; in lower case, without marks at its ends."""
    bare = word.lower().strip(_EDGE)
    shape = "symbol" if word[-1] in _SYMBOLS else "shout" if word[-1] == "!" and word.isupper() else "upper" if len(bare) > 1 and word.isupper() else "digit" if bare[:1].isdigit() else "word"
    return np.array([_bucket("word", bare), _bucket("start4", bare[:4]), _bucket("start5", bare[:5]), _bucket("shape", shape)], "<u4").tobytes()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text; its length and share of distinct words count as buckets too."""
    words = text.split() if text else []
    distinct = set(words)
    parts, seen = [], worker_cache("word-features", dict)
    for w in distinct:
        found = seen.get(w)
        if found is None:
            found = word_features(w)
            if len(seen) < _MOST_SEEN:
                seen[w] = found
        parts.append(found)
    own = np.array([_bucket("length", str(len(words).bit_length())), _bucket("variety", str(10 * len(distinct) // max(1, len(words))))], "<u4")
    return np.unique(np.concatenate([np.frombuffer(b"".join(parts), "<u4"), own]))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    #: A document is selected from this probability of the top grade on.
    least: float = 0.5

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum(dtype=np.float64))

    def grades(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the top grade."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))  # P(grade > k)
        return above.sum(1), above[:, -1]


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, steps: int = 200, rate: float = 0.3, sparse: float = 0.15, relax: float = 0.05, least_docs: int = 4) -> OrdinalModel:
    """Proximal AdaGrad on the mean loss over grades (each grade weighs the same), with an L1 penalty of ``sparse`` by the root of the rows of the rarest grade; then again on the buckets so chosen, with a ``relax`` part of it. Buckets of fewer than ``least_docs`` rows keep weight 0."""
    size = 1 << BITS
    thresholds = np.linspace(-1.0, 1.0, n_grades - 1)
    if not rows or len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(size, np.float32), thresholds - 1e3)  # nothing to tell apart: everything gets the top grade
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r] += 1  # a row names a bucket once
    penalty = sparse / np.sqrt(min(n for n in np.bincount(grades) if n))
    chosen, cut = np.flatnonzero(counts >= least_docs), thresholds
    for part in (1.0, relax):
        w, cut = _descend(rows, grades, chosen, cut, steps, rate, part * penalty)
        if part == 1.0:
            chosen = chosen[w != 0]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return OrdinalModel(weights, cut)


def loss_and_gradient(w: np.ndarray, cut: np.ndarray, flat: np.ndarray, starts: np.ndarray, grades: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of the rows' grades, each row weighed by ``share``, and its derivatives by weights and thresholds. Row i has the buckets flat[starts[i]] up to flat[starts[i + 1]]."""
    index, lens = np.arange(len(starts)), np.diff(np.append(starts, len(flat)))
    s = np.add.reduceat(w[flat], starts)
    below = 1 / (1 + np.exp(np.clip(s[:, None] - cut[None, :], -500, 500)))  # P(grade <= k)
    full = np.concatenate([np.zeros((len(starts), 1)), below, np.ones((len(starts), 1))], 1)
    slope = full * (1 - full)
    p = (full[index, grades + 1] - full[index, grades]).clip(1e-12)
    up, down = slope[index, grades + 1] / p * share, slope[index, grades] / p * share
    by_weight = np.bincount(flat, np.repeat(up - down, lens), minlength=len(w))
    by_cut = np.array([down[grades == k + 1].sum() - up[grades == k].sum() for k in range(len(cut))])
    return float(-(share * np.log(p)).sum()), by_weight, by_cut


def _descend(rows: list[np.ndarray], grades: np.ndarray, used: np.ndarray, thresholds: np.ndarray, steps: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the buckets ``used``, and thresholds, after ``steps`` of proximal AdaGrad over all rows."""
    n_grades, size = len(thresholds) + 1, 1 << BITS
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    lens = np.array([1 + np.count_nonzero(place[r] >= 0) for r in rows], np.int64)
    starts = np.cumsum(lens) - lens
    flat = np.full(int(lens.sum()), len(used), np.int64)  # each row ends with one dummy, so that none is empty
    for at, n, r in zip(starts, lens, rows, strict=True):
        own = place[r]
        flat[at : at + n - 1] = own[own >= 0]
    w, seen = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-8)
    cut, cut_seen = thresholds.copy(), np.full(n_grades - 1, 1e-8)
    share = (1 / (np.bincount(grades, minlength=n_grades) * len(set(grades.tolist()))).clip(1e-9))[grades]
    for _ in range(steps):
        _, g, g_cut = loss_and_gradient(w, cut, flat, starts, grades, share)
        g[-1] = 0
        seen += g * g
        step = rate / np.sqrt(seen)
        w -= step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
        cut_seen += g_cut * g_cut
        cut = np.maximum.accumulate(cut - rate / np.sqrt(cut_seen) * g_cut)
    return w[:-1], cut


#: Parts of the sample that are held out in turn to set the limit.
FOLDS = 3


def fit_fold(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, fold: int) -> tuple[OrdinalModel, np.ndarray, np.ndarray]:
    """The model of the rows outside of ``fold`` (of all, for fold ``FOLDS``), and probabilities of the top grade of the rows within, with their grades."""
    held = np.arange(len(rows)) % FOLDS == fold
    model = fit([r for r, h in zip(rows, held, strict=True) if not h], grades[~held], n_grades)
    top = model.grades(np.array([model.score(r) for r, h in zip(rows, held, strict=True) if h]))[1] if held.any() else np.zeros(0)
    return model, top, grades[held]


def best_limit(scored: np.ndarray, grades: np.ndarray, n_grades: int, *, good_counts: float = 5.0) -> float:
    """Of the probabilities up to 0.5, the one that as a limit does best: the part of the top grade that reaches it, times ``good_counts``, less the part of the lowest grade that does."""
    top, low = (np.sort(scored[grades == g]) for g in (n_grades - 1, 0))
    if not len(top) or not len(low):
        return 0.5
    limits = np.unique(np.append(top[top < 0.5], 0.5))
    gain = good_counts * (1 - np.searchsorted(top, limits) / len(top)) - (1 - np.searchsorted(low, limits) / len(low))
    return float(limits[np.argmax(gain)])


def train(docs: DataFrame, labels: DataFrame, *, per_grade: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``per_grade`` labelled documents of each grade: 0 toxic, 1 low quality, 2 good.

    Labels with a null are left out, as are ids that are no whole numbers; of several labels of a document the lowest counts. Without two grades the model keeps everything.
    """
    grade = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.filter("quality is not null and toxic is not null").filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(grade).alias("grade"))
    picked = None
    for k in range(3):
        some = graded.filter(F.col("grade") == k).orderBy(F.xxhash64("id"), "id").limit(per_grade)
        picked = some if picked is None else picked.unionByName(some)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = source.join(F.broadcast(materialize(picked, "label-sample")), "id")  # at most 3 * per_grade ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grade"), pa.array(found, pa.binary())], ["id", "grade", "buckets"])

    rows = materialize(sample.mapInArrow(extract, "id long, grade int, buckets binary"), "label-features")

    def solve(table: pa.Table) -> pa.Table:
        fold, table = table.column("fold")[0].as_py(), table.sort_by([("id", "ascending"), ("buckets", "ascending")])
        rows = [np.frombuffer(r.as_buffer(), "<u4") for r in table.column("buckets")]  # views of the batch
        model, top, grades = fit_fold(rows, table.column("grade").to_numpy().astype(np.int64), 3, fold)
        give_back()
        return pa.table({"weights": pa.array([model.weights.tobytes() if fold == FOLDS else None], pa.binary()), "thresholds": pa.array([model.thresholds.tolist()]), "top": pa.array([top.tolist()], pa.list_(pa.float64())), "grades": pa.array([grades.tolist()], pa.list_(pa.int64()))})

    # the bounded sample is fitted once for each fold and once as a whole, a task each; of these come one vector of weights and the held-out probabilities
    folds = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).groupBy("fold").applyInArrow(solve, "weights binary, thresholds array<double>, top array<double>, grades array<long>")
    found = materialize(folds, "quality-model").collect()
    if not found:
        return fit([], np.zeros(0, np.int64), 3)
    whole = next(r for r in found if r["weights"] is not None)
    if len({g for r in found for g in r["grades"]}) < 2:
        return OrdinalModel(np.frombuffer(bytes(whole["weights"]), np.float32), np.array(whole["thresholds"]))
    least = best_limit(np.concatenate([r["top"] for r in found]), np.concatenate([r["grades"] for r in found]), 3)
    return OrdinalModel(np.frombuffer(bytes(whole["weights"]), np.float32), np.array(whole["thresholds"]), least)


def score(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade and top_probability of each row; columns of these names are replaced. Null and empty texts are scored as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade double, top_probability double>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        scores = np.array([shared.value.score(features(t)) for t in texts], np.float64)
        expected, top = shared.value.grades(scores) if len(scores) else (scores, scores)
        return pd.DataFrame({"expected_grade": expected, "top_probability": top})

    # the row is packed, so that no name of its own can clash
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), grade(F.col(f"`{text_col}`").cast("string")).alias("grade"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("expected_grade", "top_probability")]
    return found.select(*kept, F.col("grade.expected_grade"), F.col("grade.top_probability"))


def classify(docs: DataFrame, labels: DataFrame, *, least: float | None = None, per_grade: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with expected_grade, top_probability and selected (top_probability >= ``least``, by default the model's own).

    Rows that repeat an id are scored each; an empty table gives no rows; columns of the three names are replaced.
    """
    model = train(docs, labels, per_grade=per_grade, id_col=id_col, text_col=text_col)
    return score(docs, model, text_col=text_col).withColumn("selected", F.col("top_probability") >= (model.least if least is None else least))
