"""Approximate vector search by an inverted file.

Centres are fitted on a bounded sample; each vector is in the list of its nearest centre, and a query looks into the lists of its nearest centres only. How many, is settled on a bounded sample of queries, for which the exact result is known: the least number that reaches the wanted recall there. Scores are exact, so what is missed is missed whole.

On Spark lists come in segments of bounded size, so a list that holds a third of all vectors is many groups; a query goes to each segment of each of its lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import _ranked, _unit_rows


class InvertedFile(NamedTuple):
    centres: np.ndarray
    probes: int

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        """Lists by falling similarity to each vector, the vector's own first."""
        return np.argsort(-(_unit_rows(vectors) @ self.centres.T), axis=1, kind="stable")


def _centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    x = _unit_rows(sample)
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
    return centres


def fit_index(vectors: DataFrame, dims: int, k: int, *, lists: int = 64, recall: float = 0.95, sample_rows: int = 10_000, sample_queries: int = 200, least: float = 0.30) -> InvertedFile:
    """Centres and probes from the ``sample_rows`` vectors (chunk_id, vec) with the least hashes; at most ``sample_queries`` of them are the queries that settle the probes. The driver holds that sample."""
    rows = vectors.filter(F.size("vec") == dims).select("vec", F.xxhash64("chunk_id").alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(sample_rows).toArrow()
    if not rows.num_rows:
        return InvertedFile(np.zeros((1, dims)), 1)
    sample = np.array(rows.column("vec").to_pylist(), np.float64)
    index = InvertedFile(_centres(sample, max(1, min(lists, len(sample) // 8))), 1)
    asked, n = _unit_rows(sample[:sample_queries]), len(index.centres)
    scores = np.round(asked @ _unit_rows(sample).T, 6)
    own, order = index.lists_of(sample)[:, 0], index.lists_of(sample[:sample_queries])
    place = np.empty_like(order)  # of each list in a query's order
    np.put_along_axis(place, order, np.arange(n)[None, :].repeat(len(order), 0), 1)
    hits = np.zeros(n, np.int64)
    for q in range(len(asked)):
        top = np.argsort(-scores[q], kind="stable")[:k]
        np.add.at(hits, place[q, own[top[scores[q, top] >= least]]], 1)
    enough = np.cumsum(hits) >= recall * hits.sum()
    return index._replace(probes=int(np.argmax(enough)) + 1)


def _assigned(index: InvertedFile, dims: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the numbers of their ``most`` nearest lists."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index.lists_of(np.array(batch.column("vec").to_pylist(), np.float64).reshape(-1, dims))[:, :most]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(found.tolist(), pa.list_(pa.int32()))], ["id", "vec", "lists"])

    return assign


def ann_vector_search(queries: DataFrame, vectors: DataFrame, k: int, *, dims: int, index: InvertedFile | None = None, least: float = 0.30, segment_rows: int = 8192) -> DataFrame:
    """query_id, chunk_id, score, rank as of ``vector_search``, from the lists that the index probes. Vectors of other lengths than ``dims`` match nothing."""
    index = fit_index(vectors, dims, k, least=least) if index is None else index
    of = lambda df, key: df.filter(F.size("vec") == dims).select(F.col(key).cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    schema = "id long, vec array<double>, lists array<int>"
    placed = of(vectors, "chunk_id").mapInArrow(_assigned(index, dims, 1), schema).select("id", "vec", F.get("lists", F.lit(0)).alias("list"))
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / segment_rows).cast("int").alias("segments"))
    sizes = F.broadcast(sizes)  # one row a list of the index
    rows = placed.join(sizes, "list").withColumn("segment", F.pmod(F.xxhash64("id"), F.col("segments"))).drop("segments")
    asked = of(queries, "query_id").mapInArrow(_assigned(index, dims, index.probes), schema).select("id", "vec", F.explode("lists").alias("list"))
    asked = asked.join(sizes, "list").select("id", "vec", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segments").cast("long") - 1)).alias("segment"))

    def score(q: pa.Table, v: pa.Table) -> pa.Table:
        out = {"query_id": [], "chunk_id": [], "score": []}
        if q.num_rows and v.num_rows:
            names, ids = q.column("id").to_numpy(), v.column("id").to_numpy()
            own = _unit_rows(np.array(v.column("vec").to_pylist(), np.float64))
            vecs = q.column("vec")
            for at in range(0, q.num_rows, 512):
                sims = np.round(_unit_rows(np.array(vecs.slice(at, 512).to_pylist(), np.float64)) @ own.T, 6)
                for j, row in enumerate(sims):
                    on = np.flatnonzero(row >= least)
                    if len(on) > k:
                        on = on[np.lexsort((ids[on], -row[on]))[:k]]
                    out["query_id"].append(np.full(len(on), names[at + j]))
                    out["chunk_id"].append(ids[on])
                    out["score"].append(row[on])
        kinds = {"query_id": np.int64, "chunk_id": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate(x).astype(kinds[n]) if x else np.zeros(0, kinds[n]) for n, x in out.items()})

    found = asked.groupBy("list", "segment").cogroup(rows.groupBy("list", "segment")).applyInArrow(score, "query_id long, chunk_id long, score double")
    return _ranked(found, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact result (query_id, chunk_id) that was found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
