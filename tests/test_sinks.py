"""Sinks that may be repeated, and new documents' versions."""

import pytest
from pyspark.sql import functions as F

from sondage.operators import lifecycle, search, tables
from sondage.streaming import sinks

SCHEMA = "k long, v string, at long"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_counts_once(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert table.read().count() == 0 and table.version() == 0
    write = sinks.upsert_sink(table, ["k"], "at")
    batch = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    write(batch((1, "a", 1), (2, "b", 1), (1, "c", 2)), 0)
    assert rows_of(table.read()) == [(1, "c", 2), (2, "b", 1)]
    write(batch((2, "d", 3), (3, "e", 3)), 1)
    want = [(1, "c", 2), (2, "d", 3), (3, "e", 3)]
    assert rows_of(table.read()) == want
    write(batch((2, "d", 3), (3, "e", 3)), 1)  # again
    write(batch((9, "z", 9)), 0)  # a replay of another content changes nothing either
    assert rows_of(table.read()) == want and rows_of(table.ledger()) == [(0, 2, 1), (1, 3, 2)]


def test_a_batch_that_fails_before_the_ledger_is_run_again(spark, tmp_path):
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA)
    write = sinks.upsert_sink(table, ["k"], "at")
    write(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    # what a failed attempt leaves: the next snapshot without its ledger row
    spark.createDataFrame([(7, "half", 1)], SCHEMA).write.parquet(f"file://{tmp_path}/t/data/version=2")
    assert rows_of(table.read()) == [(1, "a", 1)]
    with pytest.raises(ZeroDivisionError):
        table.commit(1, lambda target: 1 / 0)
    write(spark.createDataFrame([(2, "b", 1)], SCHEMA), 1)
    assert rows_of(table.read()) == [(1, "a", 1), (2, "b", 1)]


def test_stream_of_embeddings_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("chunk_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"), F.col("text").alias("content"))
    for k in range(3):
        docs.filter(F.col("chunk_id") % 3 == k).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    docs.filter("chunk_id < 20").coalesce(1).write.parquet(f"file://{tmp_path}/in/4")  # known ones come again
    table = sinks.VersionedTable(spark, f"file://{tmp_path}/t", "chunk_id long, content_sha256 string, model string, dims int, batch long, vec array<double>")
    asked = []

    def embed(chunks):
        asked.append(chunks.count())
        return chunks.select("chunk_id", F.array(F.length("content").cast("double"), F.lit(1.0)).alias("vec"))

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    query = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(sinks.embed_sink(table, "m", 2, embed)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sum(asked) == docs.count()  # nothing is embedded twice
    assert search.missing_embeddings(docs, table.read(), "m", 2).isEmpty()
    assert rows_of(table.read().select("chunk_id", "vec")) == rows_of(embed(docs))


def test_versions_of_equal_documents(spark):
    new = spark.createDataFrame([("w", "d3", "x"), ("w", "d2", "x"), ("w", "d4", "y")], "workspace_id string, document_id string, sha256 string")
    old = spark.createDataFrame([("w", "d1", "x", 4)], "workspace_id string, document_id string, sha256 string, version_no int")
    got = lifecycle.dedup_by_content(new, old, "new_version").select("document_id", "version_no")
    assert rows_of(got) == [("d2", 5), ("d3", 6), ("d4", 1)]


def test_groups_of_two_tables_stay_apart(spark):
    cells = spark.createDataFrame([(t, r, 1, "n", v) for t, r, v in [("t1", "A", 1.0), ("t1", "B", 2.0), ("t2", "A", 10.0), ("t2", "B", 20.0)]], "table_id string, row_label string, col_ix int, header string, value double")
    assert rows_of(tables.group_total(cells, {"all": ["A", "B"]}).select("table_id", "total")) == [("t1", 3.0), ("t2", 30.0)]
    assert rows_of(tables.compare_groups(cells, ["A"], ["B"]).select("table_id", "difference")) == [("t1", -1.0), ("t2", -10.0)]


def test_projections_and_reconciliation(spark):
    cells = spark.createDataFrame([("t", r, 1, "sales", v) for r, v in [("North", 10.0), ("South", 20.0), ("East", 5.0), ("Total", 35.0), ("west", None)]], "table_id string, row_label string, col_ix int, header string, value double")
    points = spark.createDataFrame([("c", "sales", "NORTH", 10.0), ("c", "sales", "South", 25.0), ("c", "cost", "North", 10.0), ("c", "cost", "South", 24.0), ("d", "sales", "a", 1.0), ("d", "sales", "A", 1.0)], "scope_id string, series_name string, category string, y_value double")
    charts = tables.chart_projections(points)
    assert rows_of(charts.filter("source = 'd'").select("metric", "label")) == []
    found = tables.reconcile(tables.table_projections(cells), charts.drop("turned")).collect()
    assert [(r.source_b, r.metric_b, r.target_label, r.folded, r.folded_value) for r in found] == [("c", "sales", "south", "east", 5.0)]  # the other chart is off by one
