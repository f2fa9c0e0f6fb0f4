"""Streaming forms of the incremental operators, each beside its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files under ``path``, each once; progress is kept in the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tail(events: DataFrame, after: int, id_col: str = "event_id") -> DataFrame:
    """Events after a cursor. On a stream the checkpoint is the cursor, and ``after`` its start."""
    return events.filter(F.col(id_col) > after)


def status_counts(events: DataFrame, status_col: str = "event_type") -> DataFrame:
    """Running totals by status: a grouped count in complete or update mode."""
    return events.groupBy(status_col).agg(F.count("*").alias("n"))


def first_submissions(events: DataFrame, keys: list[str], time_col: str | None = None, keep: str = "1 day") -> DataFrame:
    """One event per key. On a stream keys are remembered for ``keep`` of event time; our choice, since the batch form has no limit."""
    if events.isStreaming:
        return events.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def failed_attempts(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Failures (key, at in seconds, event_id, kind: 'failure' or 'reset'): how many earlier failures of the key since its last reset lie within ``seconds`` before this one, and whether they reach ``limit``: then the attempt is refused."""
    by = Window.partitionBy("key")
    rows = events.withColumn("spell", F.sum(F.when(F.col("kind") == "reset", 1).otherwise(0)).over(by.orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 'failure'")
    before = F.count("*").over(Window.partitionBy("key", "spell").orderBy("at").rangeBetween(-(seconds - 1), -1))
    recent = before + F.row_number().over(Window.partitionBy("key", "spell", "at").orderBy("event_id")) - 1
    return rows.select("event_id", "key", recent.alias("recent"), (recent >= limit).alias("blocked"))


def failed_attempts_stream(events: DataFrame, seconds: int, limit: int, lateness: str = "1 day") -> DataFrame:
    """The same, with the times of a key's recent failures as its state. Events of a key must arrive in order of time; those of one second in one batch.

    A key's state goes when the watermark, ``lateness`` behind the newest event, has passed its last failure by ``seconds``, or with a reset; an event that is later than the watermark is not counted.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        out = []
        for at, same in rows.groupby("at", sort=True):
            spells: list[list[int]] = [[]]
            for event_id, kind in zip(same["event_id"], same["kind"], strict=True):
                if kind == "reset":
                    spells.append([])
                else:
                    spells[-1].append(int(event_id))
            for k, ids in enumerate(spells):
                if k:
                    times = []
                times = [t for t in times if t > at - seconds]
                for i in ids:
                    out.append((i, key[0], len(times), len(times) >= limit))
                    times.append(int(at))
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max((times[-1] + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["event_id", "key", "recent", "blocked"])

    timed = events.select("event_id", "key", "at", "kind", F.timestamp_seconds("at").alias("time")).withWatermark("time", lateness)
    return timed.groupBy("key").applyInPandasWithState(step, "event_id long, key long, recent long, blocked boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
