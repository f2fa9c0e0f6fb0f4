"""Token ids in a compact file format: canonical length-limited Huffman codes in independent blocks.

A first table holds the ids of each document in ascending id order. Their counts over all documents give code lengths (package-merge, at most ``limit`` bits). A block holds whole documents of about ``block_ids`` ids as one bit string, with the bit offset of every ``stride``-th id, so that a reader starts anywhere and decodes all strides of many blocks at once by table. The codebook of the file names vocabulary and stride: readers need nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pack, scratch_dir, shuffle_cleanup, slices
from .tokens import encoder


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits for the ids with counts, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, items = weights, [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        sort = np.argsort(merged, kind="stable")
        level = merged[sort]
        items.append(sort < len(weights))
    take = 2 * len(order) - 2
    depth = np.zeros(len(order), np.int64)
    for flags in reversed(items):
        own = int(flags[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


@dataclass(frozen=True)
class Codebook:
    """Canonical codes from lengths alone: shorter first, then by id."""

    lengths: np.ndarray

    @property
    def width(self) -> int:
        return max(1, int(self.lengths.max(initial=0)))

    def codes(self) -> np.ndarray:
        order = self._order()
        n = self.lengths[order].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(np.int64(1) << (self.width - n))[:-1]]) if len(n) else n
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[order] = (starts >> (self.width - n)).astype(np.uint64)
        return codes

    def _order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every value of the next ``width`` bits: the id and its length."""
        order = self._order()
        spans = np.int64(1) << (self.width - self.lengths[order].astype(np.int64))
        size = 1 << self.width
        ids = np.repeat(order, spans).astype(np.uint32)
        pad = size - len(ids)
        return np.pad(ids, (0, pad)), np.pad(np.repeat(self.lengths[order], spans).astype(np.uint8), (0, pad), constant_values=1)


def encode_bits(ids: np.ndarray, book: Codebook, codes: np.ndarray, stride: int) -> tuple[bytes, np.ndarray]:
    """The bit string, first bit highest, padded by eight bytes; the bit offset of every ``stride``-th id."""
    n = book.lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    # a code of at most 32 bits lies in two neighbouring 32-bit words; codes don't overlap, so sums are unions
    at, shift = starts >> 5, (64 - (starts & 31) - n).astype(np.uint64)
    value = codes[ids] << shift
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        where = at[first]
        words[where] += np.add.reduceat(value >> np.uint64(32), first)
        words[where + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), starts[::stride]


def decode_bits(blocks: list[tuple[bytes, np.ndarray, int]], tables: tuple[np.ndarray, np.ndarray], width: int, stride: int) -> list[np.ndarray]:
    """Ids of blocks (bits, offsets, number of ids): all strides of all blocks advance together."""
    ids, lengths = tables
    base = np.cumsum([0] + [len(b) for b, _, _ in blocks])[:-1] * 8
    stream = np.frombuffer(b"".join(b for b, _, _ in blocks) + bytes(8), np.uint8)
    at = np.concatenate([o + s for (_, o, _), s in zip(blocks, base, strict=True)]) if blocks else np.zeros(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(stream, 8)
    out = np.zeros((len(at), stride), np.uint32)
    left = np.concatenate([np.minimum(stride, n - stride * np.arange(len(o))) for _, o, n in blocks]) if blocks else at
    longest = int(left.max(initial=0))
    down = np.uint64(64 - width)
    for k in range(longest):
        peek = np.ascontiguousarray(wide[at >> 3]).view(">u8").ravel().astype(np.uint64)
        peek = (peek << (at & 7).astype(np.uint64)) >> down
        out[:, k] = ids[peek]
        step = lengths[peek]
        at = at + (step if k + 1 < longest and (left > k + 1).all() else np.where(left > k + 1, step, 0))
    result, row = [], 0
    for _, o, n in blocks:
        result.append(out[row : row + len(o)].ravel()[:n])
        row += len(o)
    return result


_IDS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_BLOCK = pa.schema([("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ns", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary()), ("part", pa.int32())])
_READ = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, vocabulary: int) -> DataFrame:
    """Table of ids per document, range-partitioned and sorted by id: part ascends with the ids, local counts the ids before it in its part.

    The last row of each part, with local -1, holds the part's ids and their counts. Rows with equal or null ids are in the order of a hash of their texts, by which the partitions may split them too.
    """
    spark = docs.sparkSession
    kind = _kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        total = np.zeros(vocabulary, np.int64)
        for batch in slices(batches, "text"):
            out: dict[str, list] = {f.name: [] for f in _IDS}
            for key, raw in zip(batch.column("id").to_pylist(), encoder(tokenizer, "bytes").encode(batch.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, "<u4").astype(kind)
                for name, value in (("id", key), ("part", part), ("local", local), ("n", len(ids)), ("ids", ids.tobytes())):
                    out[name].append(value)
                local += len(ids)
            total += np.bincount(np.frombuffer(b"".join(out["ids"]), kind), minlength=vocabulary)
            yield pack(out, _IDS)
        if local:
            used = np.flatnonzero(total)
            yield pack({"id": [None], "part": [part], "local": [-1], "n": [local], "ids": [np.stack([used, total[used]]).astype("<i8").tobytes()]}, _IDS)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), "tie"]
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("id", "text")
    return materialize(ordered.mapInArrow(run, "id long, part int, local long, n long, ids binary"), "token-ids")


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 50_257, end_id: int = 0, limit: int = 20, block_ids: int = 65_536, stride: int = 256) -> None:
    """Write ``path``/blocks (Parquet rows: one block each, in directories part=0, 1, ... that ascend with the ids) and ``path``/codebook (one row: vocabulary, stride, code length of each id).

    A null or empty text has the end id alone. Null ids come first; rows that repeat an id follow one another, ordered by a hash of their texts and then by text. Ids are whole numbers; others become null. An empty table gives an empty file. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = _kind(vocabulary)
    table = tokenized(docs, tokenizer, id_col, text_col, end_id, vocabulary)
    ids, ends_of_parts = table.filter("local >= 0"), table.filter("local < 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("ids"):
                used, n = np.frombuffer(raw.as_buffer(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"token": used, "count": n})

    sums = ends_of_parts.select("ids").mapInArrow(count, "token long, count long").groupBy("token").agg(F.sum("count").alias("count")).collect()  # at most `vocabulary` rows
    counts = np.zeros(vocabulary, np.int64)
    for r in sums:
        counts[r["token"]] = r["count"]
    lengths = code_lengths(counts, limit)
    parts = {r["part"]: r["n"] for r in ends_of_parts.select("part", "n").collect()}  # one row per partition
    ends = dict(zip(sorted(parts), np.cumsum([0, *(parts[p] for p in sorted(parts))]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((lengths, ends))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ends = shared.value
        book = Codebook(lengths)
        codes, held, size = book.codes(), [], 0

        def block() -> pa.RecordBatch:
            bits, offsets = encode_bits(np.concatenate([np.frombuffer(raw, kind) for *_, raw in held]), book, codes, stride)
            key, part, local, _, _ = held[0]
            return pack({"start": [ends[part] + local], "n_ids": [size], "doc_ids": [[h[0] for h in held]], "doc_ns": [[h[3] for h in held]], "bits": [bits], "checkpoints": [offsets.astype("<i8").tobytes()], "part": [part]}, _BLOCK)

        for batch in batches:
            for row in zip(*(batch.column(f.name).to_pylist() for f in _IDS), strict=True):
                if held and (size + row[3] > block_ids or held[-1][1:3] != (row[1], row[2] - held[-1][3])):
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block()

    blocks = ids.mapInArrow(encode, "start long, n_ids long, doc_ids array<long>, doc_ns array<long>, bits binary, checkpoints binary, part int")
    with shuffle_cleanup(spark):
        blocks.write.partitionBy("part").option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")
        spark.createDataFrame([(vocabulary, stride, bytearray(lengths.tobytes()))], "vocabulary int, stride int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")


def read_token_ids(spark: SparkSession, path: str, *, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Decode the files: id, start, n_tokens, ids_crc32 and, where asked for, ids (little-endian unsigned 32-bit)."""
    book = spark.read.schema("vocabulary int, stride int, lengths binary").parquet(f"{path}/codebook").first()
    stride = book["stride"]
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(book["lengths"]), np.uint8))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(shared.value)
        tables = book.table()
        for batch in slices(batches, "bits", 2 << 20):
            rows = batch.to_pylist()
            found = decode_bits([(r["bits"], np.frombuffer(r["checkpoints"], "<i8"), r["n_ids"]) for r in rows], tables, book.width, stride)
            out: dict[str, list] = {f.name: [] for f in _READ}
            for r, ids in zip(rows, found, strict=True):
                raw, at = ids.astype("<u4").tobytes(), 0
                for key, n in zip(r["doc_ids"], r["doc_ns"], strict=True):
                    own = raw[4 * at : 4 * (at + n)]
                    for name, value in (("id", key), ("start", r["start"] + at), ("n_tokens", n), ("ids_crc32", zlib.crc32(own)), ("ids", own if keep_ids else None)):
                        out[name].append(value)
                    at += n
            yield pack(out, _READ)

    schema = "start long, n_ids long, doc_ids array<long>, doc_ns array<long>, bits binary, checkpoints binary, part int"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks").drop("part")
    return blocks.mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long, ids binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write into the shared folder and read back."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write_token_ids(docs, tokenizer, path, **options)
    return read_token_ids(docs.sparkSession, path, id_col=options.get("id_col", "doc_id"))
