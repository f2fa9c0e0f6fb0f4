"""Hard negatives for anchors: exact inner-product search over lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster, a row's score with any member a is at most |a| |x| cos(max(0, angle(x, centre) - r)), r the greatest angle of a member to the centre. The rows in falling order of |x| cos(...) are the cluster's list; each member walks it and stops where its bound falls below what it has found, which certifies that no later row can change its result.

On Spark the list is a sequence of levels of that bound. Their sizes are counted once (clusters x levels numbers), and the levels are walked in rounds of a growing share of the list, which members that are certified don't join. In a round a cluster's members come in blocks and its rows in segments of bounded size; each pair of a block and a segment is a group of its own, in which rows are sorted by their bound and walked in chunks, so that a hot cluster or a hot level is many groups. What the groups find is ranked per anchor by a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release

_LEVELS = 64
#: Shares of a list that are walked by the end of each round.
_ROUNDS = (0.04, 0.2, 1.0)
_CHUNK = 512
#: Angles near 0 are computed with errors of about 1e-8.
_SLACK = 1e-7
_LAST = np.iinfo(np.int64).max


def whole_numbers(df: DataFrame, vector_col: str, factor: int) -> Column:
    """floor(factor * x) of each component x; null for a null vector, or one with a null or non-finite component, or one of 2^31 or more in size."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c * factor) < float(1 << 31), F.lit(False)) & ~F.isnan(c))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * factor).cast("int")))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def _numbers(column: pa.ChunkedArray | pa.Array, null: int) -> np.ndarray:
    return column.fill_null(null).to_numpy().astype(np.int64)


def _scores(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products of whole numbers of at most ``most`` in size."""
    if most * most * max(1, a.shape[1]) < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _centres(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``k`` clusters by direction (Lloyd's iterations from the rows that lie furthest apart)."""
    norm = np.linalg.norm(sample, axis=1)
    x = sample[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return np.eye(1, sample.shape[1])
    centres = x[:1]
    nearest = x @ x[0]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[nearest.argmin()]])
        nearest = np.maximum(nearest, x @ centres[-1])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


class _Lists:
    """Bounds of rows for clusters, and their levels."""

    def __init__(self, centres: np.ndarray, reach: np.ndarray, longest: float) -> None:
        self.centres, self.reach, self.longest = centres, reach, longest

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Rows x clusters: the greatest score with a member of length 1."""
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        cosine = x @ self.centres.T / np.maximum(norm, 1e-300)[:, None]
        angle = np.arccos(np.clip(cosine, -1, 1))
        return norm[:, None] * (np.cos(np.minimum(np.maximum(angle - self.reach, 0), math.pi)) + _SLACK)

    def levels(self, bounds: np.ndarray) -> np.ndarray:
        return np.clip(((1 - bounds / self.longest) * (_LEVELS // 2)).astype(np.int64), 0, _LEVELS - 1)

    def edge(self, level: int) -> float:
        """No row of this or a later level has a greater bound."""
        return self.longest * (1 - level / (_LEVELS // 2)) + 1e-9 * self.longest if level else math.inf


def _first(member: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first k of each member: higher scores, then smaller ids, then rows."""
    order = np.lexsort((row, ident, -score, member))
    member = member[order]
    start = np.flatnonzero(np.diff(member, prepend=-1))
    nth = np.arange(len(member)) - np.repeat(start, np.diff(np.append(start, len(member))))
    order = order[nth < k]
    return member[nth < k], score[order], ident[order], row[order]


class _Best:
    """The first k finds of each member, and the score that a further one must reach."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.least, self.k = floor.copy(), k
        self.found = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, member: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if len(member):
            self.found = _first(*(np.concatenate(x) for x in zip(self.found, (member, score.astype(np.int64), ident, row), strict=True)), self.k)
            full, count = np.unique(self.found[0], return_counts=True)
            ends = np.cumsum(count) - 1
            full, ends = full[count == self.k], ends[count == self.k]
            self.least[full] = np.maximum(self.least[full], self.found[1][ends])


_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _walk(dtype: np.dtype, dim: int, most: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block of members along one segment of their list. Members have slots: windows (low, high, floor) of scores, with rows of the same label or of others."""

    def walk(members: pa.Table, rows: pa.Table) -> pa.Table:
        if not members.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        bound = rows.column("bound").to_numpy()
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        x, row, ident = _matrix(rows.column("v"), dtype, dim)[order], rows.column("row").to_numpy()[order], _numbers(rows.column("id"), _LAST)[order]
        a, anchor = _matrix(members.column("v"), dtype, dim), members.column("row").to_numpy()
        label = pd.factorize(pd.concat([members.column("label").to_pandas(), rows.column("label").to_pandas()]))[0]
        own, other = label[: len(a)], label[len(a) :][order]
        same = np.array(members.column("same").to_pylist())
        norm = np.linalg.norm(a.astype(np.float64), axis=1)
        slots = members.column("slots").to_pylist()
        width = max(map(len, slots))
        edge = np.full((3, width, len(a)), [[[1]], [[0]], [[_LAST]]], np.int64)  # an empty window where a member has fewer slots
        for i, s in enumerate(slots):
            for j, w in enumerate(s):
                edge[:, j, i] = w["low"], w["high"], w["floor"]
        low, high, floor = edge
        best = [_Best(np.maximum(low[j], floor[j]), k) for j in range(width)]
        for at in range(0, len(x), _CHUNK):
            ceiling = norm * bound[at]
            on = np.flatnonzero(np.any([(b.least <= ceiling) & (b.least <= high[j]) for j, b in enumerate(best)], axis=0))
            if not len(on):
                break
            part = slice(at, at + _CHUNK)
            score = _scores(a[on], x[part], most)
            fits = ((own[on][:, None] == other[part][None, :]) == same[on][:, None]) & (anchor[on][:, None] != row[part][None, :])
            for j, b in enumerate(best):
                m, c = np.nonzero(fits & (score >= b.least[on][:, None]) & (score <= high[j][on][:, None]))
                b.add(on[m], score[m, c], ident[part][c], row[part][c])
        found = [(anchor[m], np.full(len(m), j, np.int32), r, i, s) for j, b in enumerate(best) for m, s, i, r in [b.found]]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], mask=columns[3] == _LAST), pa.array(columns[4])], schema=_FOUND)

    return walk


class _Search:
    def __init__(self, rows: DataFrame, members: DataFrame, lists: _Lists, dtype: np.dtype, dim: int, most: int, segment_rows: int, block_anchors: int, sizes: dict[int, int]) -> None:
        self.rows, self.members, self.lists, self.dtype, self.dim, self.most, self.segment_rows = rows, members, lists, dtype, dim, most, segment_rows
        self.blocks = {c: -(-n // block_anchors) for c, n in sizes.items()}
        counts = self._counts()
        #: per cluster and round: first level, level after the last, rows between.
        self.plan: list[dict[int, tuple[int, int, int]]] = [{} for _ in _ROUNDS]
        for c in sizes:
            total, begin = np.cumsum(counts[c]), 0
            for r, share in enumerate(_ROUNDS):
                end = max(begin, int(np.searchsorted(total, share * total[-1])) + 1) if share < 1 else _LEVELS
                self.plan[r][c] = begin, end, int(counts[c][begin:end].sum())
                begin = end

    def _counts(self) -> np.ndarray:
        lists, dtype, dim = self.lists, self.dtype, self.dim

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(lists.centres), _LEVELS), np.int64)
            for batch in batches:
                level = lists.levels(lists.bounds(_matrix(batch.column("v"), dtype, dim)))
                for c in range(len(total)):
                    total[c] += np.bincount(level[:, c], minlength=_LEVELS)
            c, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at), pa.array(total[c, at])], ["cluster", "level", "n"])

        out = np.zeros((len(lists.centres), _LEVELS), np.int64)
        for r in self.rows.select("v").mapInArrow(count, "cluster long, level long, n long").groupBy("cluster", "level").agg(F.sum("n").alias("n")).collect():  # clusters x levels
            out[r["cluster"], r["level"]] = r["n"]
        return out

    def _segments(self, nth: int, active: set[int]) -> DataFrame:
        """The rows of a round for each active cluster and block: cluster, block, segment, row, id, label, v, bound."""
        plan, lists, dtype, dim, blocks = {c: p for c, p in self.plan[nth].items() if c in active}, self.lists, self.dtype, self.dim, self.blocks
        most = self.segment_rows

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = lists.bounds(_matrix(batch.column("v"), dtype, dim))
                level, row = lists.levels(bound), batch.column("row").to_numpy()
                mixed = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for c, (begin, end, n) in plan.items():
                    at = np.flatnonzero((level[:, c] >= begin) & (level[:, c] < end))
                    if len(at):
                        own = batch.take(pa.array(at))
                        segment = (mixed[at] % np.uint64(max(1, -(-n // most)))).astype(np.int64)
                        for b in range(blocks[c]):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c)), pa.array(np.full(len(at), b)), pa.array(segment), *own.columns, pa.array(bound[at, c])], ["cluster", "block", "segment", *own.schema.names, "bound"])

        return self.rows.select("row", "id", "label", "v").mapInArrow(pick, "cluster long, block long, segment long, row long, id long, label string, v binary, bound double")

    def run(self, members: DataFrame, slots: Callable[[DataFrame], DataFrame], same: bool, k: int, name: str) -> DataFrame:
        """(anchor, slot, row, id, score, nth) of the first ``k`` rows in each slot of ``members`` (row, cluster, block, norm, label, v); ``slots`` gives slots (low, high) by row and slot."""
        windows = slots(members).select("row", "slot", "low", "high")
        found, pending = None, {c for c, (_, _, n) in self.plan[0].items()}
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        for nth in range(len(_ROUNDS)):
            parts = {c: max(1, -(-n // self.segment_rows)) for c, (_, _, n) in self.plan[nth].items() if c in pending and n}
            if parts:
                edge = {c: self.lists.edge(self.plan[nth][c][0]) for c in parts}
                floor = F.lit(-_LAST)
                open_ = windows.withColumn("floor", floor)
                if found is not None:
                    kth = found.filter(F.col("nth") == k).select(F.col("anchor").alias("row"), "slot", F.col("score").alias("kth"))
                    open_ = windows.join(kth, ["row", "slot"], "left").withColumn("floor", F.coalesce("kth", floor))
                by_row = open_.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high", "floor"))).alias("slots"))  # at most as many as positives are asked for
                # one row a cluster of the model
                edges = members.sparkSession.createDataFrame([(c, float(edge[c]), parts[c]) for c in parts], "cluster long, edge double, parts long")
                own = members.join(F.broadcast(edges), "cluster").join(by_row, "row")
                ceiling = F.col("norm") * F.col("edge")
                open_slot = F.exists("slots", lambda s: (F.greatest(s["low"], s["floor"]) <= ceiling) & (F.greatest(s["low"], s["floor"]) <= s["high"]))
                own = own.filter(open_slot).select("cluster", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("segment"), "row", "label", "v", F.lit(same).alias("same"), "slots")
                own = materialize(own, f"{name}-members")
                active = {r["cluster"] for r in own.select("cluster").distinct().collect()}  # at most the model's clusters
                pending &= active
                if active:
                    key = ["cluster", "block", "segment"]
                    more = own.groupBy(*key).cogroup(self._segments(nth, active).groupBy(*key)).applyInArrow(_walk(self.dtype, self.dim, self.most, k), "anchor long, slot int, row long, id long, score long")
                    every = more if found is None else more.unionByName(found.drop("nth"))
                    found = materialize(every.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k), name)
        return found if found is not None else members.sparkSession.createDataFrame([], "anchor long, slot int, row long, id long, score long, nth int")


def mine_hard_negatives(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, most_clusters: int = 256, fit_rows: int = 20_000, block_anchors: int = 1024, segment_rows: int = 8192) -> DataFrame:
    """For each anchor (a row whose id is divisible by ``every``) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vector_col`` holds whole numbers (``whole_numbers``); a score is the integer inner product, higher ones come first, ties by smaller id (no id comes last), then by row. Rows with a null label or vector take no part; rows without an id are no anchors, but may be found. Vectors of unequal length are filled up with zeros. Repeated rows are rows of their own: each is an anchor, and each other row's neighbour. A zero vector scores 0 with all. An empty table, and one without anchors, gives no rows; other columns are not carried. Results don't depend on the clusters, which are fitted on at most ``fit_rows`` anchors (those with the least hash); every row is in every cluster's list.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<long>").alias("x")).filter("label is not null and x is not null and not exists(x, c -> c is null)")
    raw = materialize(source.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")
    size = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c)
    dim, most, longest = raw.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.sqrt(F.max(size))).first()
    dim, most, longest = max(1, dim or 0), most or 0, longest or 1.0
    dtype = np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.zeros((batch.num_rows, dim), dtype)
            for i, x in enumerate(batch.column("x").to_pylist()):
                full[i, : len(x)] = x
            v = pa.array([r.tobytes() for r in full], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), v, pa.array(np.linalg.norm(full.astype(np.float64), axis=1))], ["row", "id", "label", "v", "norm"])

    rows = materialize(raw.mapInArrow(packed, "row long, id long, label string, v binary, norm double"), "packed")
    release(raw)
    anchors = rows.filter(F.col("id") % every == 0)
    n_anchors = anchors.count()
    sample = anchors.select("v").orderBy(F.xxhash64("id"), "row").limit(fit_rows).toArrow()  # at most fit_rows vectors
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    centres = _centres(_matrix(sample.column("v"), dtype, dim).astype(np.float64), min(most_clusters, -(-n_anchors // block_anchors)))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm = _matrix(batch.column("v"), dtype, dim), np.maximum(batch.column("norm").to_numpy(), 1e-300)
            cosine = np.clip(x @ centres.T / norm[:, None], -1, 1)
            own = cosine.argmax(1)
            angle = np.where(norm > 1e-300, np.arccos(cosine[np.arange(len(own)), own]), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(angle)], [*batch.schema.names, "cluster", "angle"])

    found = materialize(anchors.mapInArrow(assigned, "row long, id long, label string, v binary, norm double, cluster long, angle double"), "anchors")
    reach, sizes = np.zeros(len(centres)), {}
    for r in found.groupBy("cluster").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect():  # one row a cluster
        reach[r["cluster"]], sizes[r["cluster"]] = r["angle"], r["n"]
    search = _Search(rows, found, _Lists(centres, reach, longest), dtype, dim, most, segment_rows, block_anchors, sizes)
    # one row a cluster of the model
    blocks = spark.createDataFrame(list(search.blocks.items()), "cluster long, blocks long")
    members = materialize(found.join(F.broadcast(blocks), "cluster").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks"), "members")
    every_score = lambda m: m.select("row", F.lit(0).alias("slot"), F.lit(-_LAST).alias("low"), F.lit(_LAST).alias("high"))
    near = search.run(members, every_score, True, positives, "positives")
    slots = near.select(F.col("anchor").alias("row"), F.col("nth").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wide = F.col("positive_score").cast("decimal(30,0)")
    limits = materialize(slots.withColumns({"low": F.ceil(wide * low / 100).cast("long"), "high": F.floor(wide * high / 100).cast("long")}).filter("low <= high"), "windows")
    # slots are numbered from 0 among an anchor's own
    own = Window.partitionBy("row").orderBy("slot")
    limits = materialize(limits.withColumn("slot", (F.row_number().over(own) - 1).cast("int")), "slots")
    far = search.run(members, lambda m: limits, False, negatives, "negatives")
    pairs = far.select(F.col("anchor").alias("row"), "slot", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(limits, ["row", "slot"]).join(members.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
