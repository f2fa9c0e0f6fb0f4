"""A stream over files gives the rows of its batch twin."""

import pytest
from pyspark.sql import functions as F

from sondage.plans.metric_queries import _attempts
from sondage.streaming import streams

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def attempts(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('events')}/in"
    rows = _attempts(spark, D)
    for k, part in enumerate(("event_id < 300", "event_id >= 300 and event_id < 600", "event_id >= 600")):
        rows.filter(part).coalesce(1).write.parquet(f"{path}/{k}")
    return path, rows


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, path):
    return spark.readStream.schema("event_id long, key long, at long, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_failed_attempts(spark, attempts, tmp_path):
    path, rows = attempts
    got = drain(streams.failed_attempts_stream(stream(spark, path), 86_400, 5), "failed", "append", tmp_path)
    want = streams.failed_attempts(rows, 86_400, 5)
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "key", "recent", "blocked").collect())
    assert key(got) == key(want)


def test_status_counts_and_tail(spark, attempts, tmp_path):
    path, rows = attempts
    got = drain(streams.status_counts(streams.tail(stream(spark, path), 100), "kind"), "counts", "complete", tmp_path)
    want = streams.status_counts(streams.tail(rows, 100), "kind")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_first_submissions(spark, attempts, tmp_path):
    path, rows = attempts
    timed = stream(spark, path).withColumn("time", F.timestamp_seconds("at"))
    got = drain(streams.first_submissions(timed, ["key", "kind"], "time", "10000 days"), "firsts", "append", tmp_path)
    assert sorted(map(tuple, got.select("key", "kind").collect())) == sorted(map(tuple, streams.first_submissions(rows, ["key", "kind"]).select("key", "kind").collect()))


def test_failed_attempts_forgets(spark, tmp_path):
    """Keys without late failures leave the state; a key that comes back after its window starts anew."""
    day = 86_400
    batches = [[(1, 1, day, "failure"), (2, 2, day, "failure"), (3, 3, day, "failure"), (4, 3, day + 1, "reset")], [(5, 4, 20 * day, "failure")], [(6, 4, 20 * day + 5, "failure"), (7, 1, 20 * day + 5, "failure")], [(8, 5, 40 * day, "failure")], [(9, 5, 40 * day + 1, "failure")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, key long, at long, kind string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    df = streams.failed_attempts_stream(stream(spark, f"file://{tmp_path}/in"), 600, 5)
    q = df.writeStream.format("memory").queryName("forgets").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.recent for r in spark.table("forgets").collect()} == {1: 0, 2: 0, 3: 0, 5: 0, 6: 1, 7: 0, 8: 0, 9: 1}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
