"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised and cut on the executors. Only a histogram of piece lengths (at most ``width`` numbers) reaches the driver. Pieces of one length are alike, so best-fit decreasing runs on whole groups of bins with equal room: a segment tree over the remaining capacities finds the tightest group that still fits, and the plan is a list of runs (length, first rank, first bin, bins, pieces per bin, offset) that executors look up. The plan is that of best-fit decreasing over all pieces, whatever their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pack, slices
from .tokens import encoder


class RoomTree:
    """Segment tree over capacities 0..width: is a bin with this room open? ``tightest(n)`` finds the least open room of at least n in logarithmic time."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = self.leaves + room
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan_best_fit(counts: dict[int, int], width: int) -> np.ndarray:
    """Runs of best-fit decreasing for ``counts[length]`` pieces: columns length, rank, bin, bins, each, offset.

    The pieces of ``length`` with ranks rank, rank + 1, ... fill ``bins`` bins from ``bin`` on, ``each`` pieces a bin, from ``offset``.
    """
    tree, groups = RoomTree(width), [[] for _ in range(width + 1)]  # groups[room]: (first bin, bins)
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted((n for n in counts if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # every bin that fits no more is closed to this length: open as many new ones as the rest needs
                room, each = width, width // length
                first, have = bins, -(-left // each)
                bins += have
            else:
                first, have = groups[room].pop()
                each = room // length
            full = min(have, left // each)
            pieces = [(full, each)] if full else []
            if full < have and left - full * each:
                pieces.append((1, left - full * each))
            for n, k in pieces:
                runs.append((length, rank, first, n, k, width - room))
                rank, left, first, have = rank + n * k, left - n * k, first + n, have - n
                if rest := room - k * length:
                    groups[rest].append((first - n, n))
                    tree.set(rest, True)
            if have:
                groups[room].append((first, have))
            if room <= width:
                tree.set(room, bool(groups[room]))
    return np.array(runs, np.int64).reshape(-1, 6)


_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()), ("ids", pa.binary())])


def _cutter(path: str, width: int, end_id: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), np.zeros(width + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            for key, raw in zip(batch.column("id").to_pylist(), encoder(path, "words").encode(batch.column("text").to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * width)):
                    ids = raw[at : at + 4 * width]
                    n = len(ids) // 4
                    for name, value in (("id", key), ("piece", k), ("start", at // 4), ("length", n), ("ids_crc32", zlib.crc32(ids)), ("part", part), ("rank", int(seen[n])), ("ids", ids if keep_ids else None)):
                        out[name].append(value)
                    seen[n] += 1
            yield pack(out, _PIECE)

    return cut


_PLACED = pa.schema([*(f for f in _PIECE if f.name not in ("part", "rank")), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _placer(runs):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = runs.value
        order = np.lexsort((plan[:, 1], plan[:, 0]))
        plan = plan[order]
        keys = plan[:, 0] << 44 | plan[:, 1]  # lengths below 2**19, ranks below 2**44
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - run[:, 1]
            found = {"sequence_id": run[:, 2] + nth // run[:, 4], "offset": run[:, 5] + nth % run[:, 4] * length}
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else batch.column(f.name) for f in _PLACED], schema=_PLACED)

    return place


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, ids (null unless ``keep_ids``), sequence_id, offset.

    Each document is its ids and ``end_id``; only longer ones than ``width`` are cut. A null or empty text is the end id alone. Rows that repeat an id, or have a null id, are documents of their own; ids are whole numbers, others become null. An empty table gives no rows. Other columns are not read. Which of equally long pieces lies where depends on the order of the rows in their files; the number of sequences doesn't.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(source.mapInArrow(_cutter(tokenizer, width, end_id, keep_ids), "id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary"), "pieces")
    parts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `width` rows
    runs = spark.sparkContext.broadcast(plan_best_fit(counts, width))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # as many shifts as partitions times lengths: never broadcast
    ranked = pieces.join(shifts.hint("shuffle_merge"), ["part", "length"]).select(*(F.col(f.name) if f.name != "rank" else (F.col("rank") + F.col("shift")).alias("rank") for f in _PIECE if f.name != "part"))
    placed = ranked.mapInArrow(_placer(runs), "id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
