"""Benchmark passages in documents, by Wu-Manber search.

Texts are reduced to " word word ... " in UTF-8, so that a window of words is a byte string that begins and ends with a blank. Windows are grouped by length; a group has a block length B, a shift table over hashed B-byte blocks of its windows' first m bytes (m: its shortest window) and buckets of windows by the hash of the m-byte head's last block. A cursor whose block has a shift above zero skips that far. Cursors over many stretches of many documents advance together, so that the search is a few array operations per step. Where the shift is zero, the windows of the bucket are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, slices, worker_cache

#: A-Z to lower case; other ASCII characters than letters and digits to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TABLE_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _hash(block: np.ndarray) -> np.ndarray:
    return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


class WindowGroup:
    """Shift table and buckets of windows of at least ``m`` bytes."""

    def __init__(self, windows: list[bytes]) -> None:
        self.m = min(map(len, windows))
        self.block = min(8, self.m)
        self.shift = np.full(1 << _TABLE_BITS, self.m - self.block + 1, np.int64)
        self.buckets: dict[int, list[bytes]] = defaultdict(list)
        heads = np.frombuffer(b"".join(w[: self.m] for w in windows), np.uint8).reshape(len(windows), self.m)
        for at in range(self.m - self.block + 1):
            keys = _hash(self.blocks(heads[:, at : at + self.block]))
            np.minimum.at(self.shift, keys, self.m - self.block - at)
        for window, key in zip(windows, keys.tolist(), strict=True):
            self.buckets[key].append(window)

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        for k in range(self.block):
            value = value << np.uint64(8) | rows[:, k]
        return value

    def search(self, data: bytes, starts: np.ndarray, ends: np.ndarray, stretch: int = 1024) -> Iterator[tuple[int, bytes]]:
        """(position, window) of all occurrences that lie within one of the ranges starts..ends of ``data``."""
        stream = np.frombuffer(data, np.uint8)
        if len(stream) < self.m:
            return
        view = np.lib.stride_tricks.sliding_window_view(stream, self.block)
        counts = np.maximum(0, -(-(ends - starts - self.m + 1) // stretch))
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(starts, counts) + nth * stretch  # cursors: where a window may begin
        limit = np.repeat(ends, counts)
        last = np.minimum(at + stretch, limit - self.m + 1)
        while len(at):
            key = _hash(self.blocks(view[at + (self.m - self.block)]))
            skip = self.shift[key]
            for i in np.flatnonzero(skip == 0).tolist():
                p = int(at[i])
                for window in self.buckets.get(int(key[i]), ()):
                    if data.startswith(window, p) and p + len(window) <= limit[i]:
                        yield p, window
            at = at + np.maximum(skip, 1)
            on = at < last
            at, limit, last = at[on], limit[on], last[on]


class WuManber:
    def __init__(self, items: dict[bytes, list[str]]) -> None:
        """items: the ids of the items that have a window."""
        self.items = items
        classes: dict[int, list[bytes]] = defaultdict(list)
        for window in items:
            classes[len(window).bit_length()].append(window)
        self.groups = [WindowGroup(w) for w in classes.values()]

    def find(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """(words, hit intervals of words as rows (begin, end), item ids) of each text; the intervals are ascending and apart."""
        split = [words_of(t) for t in texts]
        rows = [b" " + b" ".join(w) + b" " for w in split]
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        starts, data = ends - np.array([len(r) for r in rows], np.int64), b"".join(rows)
        found: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for group in self.groups:
            for p, window in group.search(data, starts, ends):
                found[int(np.searchsorted(ends, p, "right"))].append((p, window))
        out = []
        for i, words in enumerate(split):
            spans, ids = np.zeros((0, 2), np.int64), set()
            if i in found:
                blanks = np.flatnonzero(np.frombuffer(rows[i], np.uint8) == 32)
                covered = np.zeros(len(words) + 1, np.int64)
                for p, window in set(found[i]):
                    first = int(np.searchsorted(blanks, p - starts[i]))
                    covered[first] += 1
                    covered[first + window.count(b" ") - 1] -= 1
                    ids.update(self.items[window])
                spans = np.flatnonzero(np.diff(np.cumsum(covered) > 0, prepend=False)).reshape(-1, 2)
            out.append((len(words), spans, ids))
        return out

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, set[str]]]:
        """(words, hit words, item ids) of each text."""
        return [(n, int((spans[:, 1] - spans[:, 0]).sum()), ids) for n, spans, ids in self.find(texts)]


def item_windows(text: str | None, size: int) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[k : k + size]) + b" " for k in range(max(1, len(words) - size + 1))] if words else []


@dataclass(frozen=True)
class Block:
    """A part of a benchmark: (item, words) of runs of its items' words, which hold all their windows. Broadcast as it is; the windows, a dozen times that, are made in the workers."""

    name: str
    runs: list[tuple[str, bytes]]

    def search(self, size: int) -> WuManber:
        """The worker's search for these windows."""

        def make() -> WuManber:
            owners: dict[bytes, set[str]] = defaultdict(set)
            for item, run in self.runs:
                for window in item_windows(run.decode("utf-8", "replace"), size):
                    owners[window].add(item)
            return WuManber({w: sorted(items) for w, items in owners.items()})

        return worker_cache(("wu-manber", self.name, size), make)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[Block]:
    """Blocks of at most about ``most`` bytes of words, or one window; a longer item is cut into runs that overlap by ``window`` - 1 words. The driver holds one part of the texts at a time."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    parts = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most + 1
    if parts > 1:
        items = materialize(items.repartition(parts).withColumn("part", F.spark_partition_id()), "benchmark")
    runs: list[tuple[str, bytes]] = []
    used = 0
    for part in range(parts):
        for row in (items.filter(F.col("part") == part) if parts > 1 else items).toLocalIterator():
            words, at = words_of(row["text"]), 0
            while at < len(words):
                end, size = at, 0
                while end < len(words) and (end - at < window or used + size + len(words[end]) < most):
                    size += len(words[end]) + 1
                    end += 1
                runs.append((row["item"], b" ".join(words[at:end])))
                used += size
                at = len(words) if end == len(words) else end - window + 1
                if used >= most or at < len(words):
                    yield Block(uuid.uuid4().hex, runs)
                    runs, used = [], 0
    if runs:
        yield Block(uuid.uuid4().hex, runs)


def _first_two(blocks: Iterator[Block]) -> tuple[Block, Block | None]:
    return next(blocks, Block("empty", [])), next(blocks, None)


def _in_turn(rows: DataFrame, blocks: Iterator[Block], window: int) -> DataFrame:
    """row, n_words, n_hit, ids of all ``rows`` (row, text), which are scanned once for each block; a text's intervals are joined over the blocks."""
    context, found = rows.sparkSession.sparkContext, None
    for nth, block in enumerate(blocks):
        shared = context.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, every: bool = nth == 0) -> Iterator[pa.RecordBatch]:
            search = shared.value.search(window)
            for batch in slices(batches, "text"):
                out = search.find(batch.column("text").to_pylist())
                columns = [batch.column("row"), pa.array([n for n, _, _ in out], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in spans.tolist()] for _, spans, _ in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(ids) for _, _, ids in out], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "spans", "ids"]).filter(pa.array([every or len(spans) > 0 for _, spans, _ in out], pa.bool_()))

        own = materialize(rows.mapInArrow(scan, "row long, n_words long, spans array<struct<a:bigint,b:bigint>>, ids array<string>"), "benchmark-hits")
        shared.unpersist()
        found = own if found is None else found.unionByName(own)
    joined = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    hit = F.aggregate("spans", zero, lambda acc, s: F.struct(F.greatest(acc["at"], s["b"]).alias("at"), (acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["at"]), F.lit(0).cast("long"))).alias("n")), lambda acc: acc["n"])
    return joined.select("row", "n_words", hit.alias("n_hit"), "ids")


def _contaminated(share: int):
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated by the rule of ``find_benchmark``, with all their columns. No shuffle where the benchmark is one block; else the rows are written once with a number, and those of contaminated rows are joined to them."""
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = _first_two(blocks)
    if second is not None:
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), "numbered")
        found = _in_turn(rows.select("row", F.col("whole")[text_col].cast("string").alias("text")), itertools.chain([first, second], blocks), window)
        bad = materialize(found.filter(_contaminated(share)).select("row"), "contaminated")
        return rows.join(bad, "row", "left_anti").select(*(F.col("whole")[c].alias(c) for c in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = shared.value.search(window)
        for texts in parts:
            yield pd.Series([not (h > 0 and share * h >= n) for k in range(0, len(texts), 1000) for n, h, _ in search.scan(texts.iloc[k : k + 1000].tolist())], dtype=bool)

    return docs.filter(clean(F.col(text_col).cast("string")))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), item_ids.

    The benchmark is broadcast in blocks of at most ``block_bytes`` bytes of words. Where there are several, the texts are written once with a number, scanned for each block in turn, and their hits joined by number. A null or empty text has no words and is never contaminated. Null item ids are the text "null"; null items have no windows. Repeated rows are judged each. With an empty benchmark nothing is hit.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = _first_two(blocks)
    if second is not None:
        rows = materialize(source.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
        found = rows.select("row", "id").join(_in_turn(rows.select("row", "text"), itertools.chain([first, second], blocks), window), "row")
        digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
        return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), digest.alias("items_sha256"), _contaminated(share).alias("contaminated"), F.col("ids").alias("item_ids"))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value.search(window)
        for batch in slices(batches, "text"):
            found = search.scan(batch.column("text").to_pylist())
            ids = [sorted(x) for _, _, x in found]
            n, hit = [x[0] for x in found], [x[1] for x in found]
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]), pa.array([h > 0 and share * h >= w for w, h in zip(n, hit, strict=True)], pa.bool_()), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    return source.mapInArrow(scan, "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>").withColumnRenamed("id", id_col)
