"""Recall of the inverted file against the exact search, on the shared vectors and on clustered ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import ann, search
from sondage.plans import registry


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_shared_vectors(spark, sf):
    d = f"/root/testdata/{sf}"
    found, exact = (registry.queries()[n](spark, d) for n in ("r7_ann_vector_search", "r6_vector_search"))
    assert ann.recall(found, exact) >= 0.9
    # what is found has its exact score
    both = found.join(exact, ["query_id", "chunk_id"]).filter(found["score"] != exact["score"])
    assert both.isEmpty()


def test_clusters_need_few_probes_and_hot_lists_are_split(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[0 if i % 3 == 0 else i % 40] + rng.normal(size=16)).tolist()) for i in range(4000)]
    vectors = spark.createDataFrame([*rows, (9999, [1.0, 2.0]), (9998, None)], "chunk_id long, vec array<double>")
    queries = vectors.filter("chunk_id % 50 = 0 and size(vec) = 16").withColumnRenamed("chunk_id", "query_id")
    index = ann.fit_index(vectors, 16, 10)
    assert index.probes <= len(index.centres) // 4
    found = ann.ann_vector_search(queries, vectors, 10, dims=16, index=index, segment_rows=100)
    assert ann.recall(found, search.vector_search(queries, vectors, 10)) >= 0.9
    assert found.groupBy("query_id").agg(F.max("rank").alias("n")).filter("n > 10").isEmpty()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "chunk_id long, vec array<double>")
    assert ann.ann_vector_search(none.withColumnRenamed("chunk_id", "query_id"), none, 3, dims=4).count() == 0
