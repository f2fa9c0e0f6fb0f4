"""Removal of passages that an earlier document has, by merged Burrows-Wheeler transforms.

Documents are packed into shards of about a megabyte. Each window of ``length`` bytes belongs to the least hash of its ``GRAM``-byte grams (its minimizer), so that equal windows meet under one value, and neighbouring windows with one value form a string of at most 2 * length - GRAM bytes. Values that occur once in the corpus are dropped. Values of more than ``hot`` strings (a phrase that very many documents have, each with other words around it) are split: their windows belong to the hash of all their bytes instead, and again only hashes that occur twice stay. The strings go to buckets by value, each distinct string of a shard once. In a bucket, the parts of the strings whose windows may be equal to others (by a hash of all their bytes) are kept, each distinct part once; every shard's parts have a Burrows-Wheeler transform; the transforms are merged by refining the interleave of their rows symbol by symbol (Holt and McMillan), without sorting all suffixes anew. Each step also refines the common prefixes, and after ``length`` steps equal windows are intervals of rows, for each of which the least document is known. Shards then cover the windows whose least document is smaller than their own.

A task holds a shard, or a bucket: ``values_per_bucket`` values on average, each with at most ``hot`` strings or one string a shard. Shards move compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, key_filter, materialize, slices

GRAM = 20
_LAST = np.iinfo(np.int64).max
#: Places that are hashed at a time, so that the intermediate arrays stay in a core's cache.
_BLOCK = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _in_blocks(data: np.ndarray, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of`` the data, which gives a number for each ``size`` neighbouring bytes, block by block."""
    n = len(data) - size + 1
    found = np.empty(max(0, n), np.uint64)
    for a in range(0, n, _BLOCK):
        found[a : a + _BLOCK] = of(data[a : min(a + _BLOCK, n) + size - 1])
    return found


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each place on."""
    return _in_blocks(data, size, lambda part: _gram_hashes(part, size))


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """``gram_hashes`` of one block, by doubling."""
    factor = 0x100000001B3
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    parts = {1: h}
    while 2 * have <= size:
        h, have, factor = h[:-have] * np.uint64(factor) + h[have:], 2 * have, factor * factor % (1 << 64)
        parts[have] = h
    n = len(data) - size + 1
    found, at, rest = h[:n], have, size - have
    while rest:
        step = 1 << (rest.bit_length() - 1)
        found = _mix(found) + parts[step][at : at + n]
        at, rest = at + step, rest - step
    return _mix(found)


def window_strings(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of the strings of texts that end at ``ends``: runs of windows with one minimizer, at most ``length - GRAM + 1`` windows each."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    size = min(GRAM, length)
    least = _in_blocks(data, length, lambda part: _sliding_min(_gram_hashes(part, size), length - size + 1))
    valid = np.ones(len(least), bool)
    # a window that crosses an end is none
    for k in ends[:-1].tolist():
        valid[max(0, k - length + 1) : k] = False
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    change[~valid] = True
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(least)))
    on = valid[first]
    first, n = first[on], n[on]
    most = length - size + 1
    if (n > most).any():
        cuts = -(-n // most)
        nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, n = np.repeat(first, cuts) + nth * most, np.minimum(most, np.repeat(n, cuts) - nth * most)
    return first, n, least[first]


def shard_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all suffixes of the strings in order: (symbol before, 0 at a string's begin; string; offset). End marks are smaller than bytes and ordered by string."""
    lens = np.array([len(s) for s in strings], np.int64)
    words = -(-int(lens.max()) // 8) + 1
    grid = np.zeros((len(strings), 8 * words + int(lens.max())), np.uint8)
    for k, s in enumerate(strings):
        grid[k, : len(s)] = np.frombuffer(s, np.uint8)
    owner = np.repeat(np.arange(len(strings)), lens + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(lens + 1) - (lens + 1), lens + 1)
    view = np.lib.stride_tricks.sliding_window_view(grid, 8 * words, axis=1)
    keys = np.ascontiguousarray(view[owner, offset]).view(">u8").astype(np.uint64)
    order = np.lexsort((owner, lens[owner] - offset, *(keys[:, k] for k in range(words - 1, -1, -1))))
    owner, offset = owner[order], offset[order]
    before = np.where(offset > 0, grid[owner, np.maximum(offset - 1, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)
    return before, owner, offset


def merge_bwts(symbols: list[np.ndarray], n_strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the rows of several transforms after ``depth`` refinements: row numbers in order (rows of the transforms counted through), and the common prefix of each row with the one before it, ``depth`` where it is at least that long."""
    sizes = np.array([len(s) for s in symbols], np.int64)
    bwt = np.concatenate(symbols)
    kind = np.uint8 if len(symbols) <= 1 << 8 else np.uint16 if len(symbols) <= 1 << 16 else np.uint32
    index = np.int32 if len(bwt) < 1 << 31 else np.int64
    source = np.repeat(np.arange(len(symbols), dtype=kind), sizes)
    marks = np.repeat(np.arange(len(symbols), dtype=kind), n_strings)  # rows of end marks come first, source by source
    common = np.full(len(bwt), depth, np.int64)
    common[: len(marks) + 1] = 0
    z = np.concatenate([marks, np.repeat(np.arange(len(symbols), dtype=kind), sizes - np.array(n_strings))])
    edge = np.zeros(len(bwt), bool)
    edge[0] = True  # of no symbols all rows are equal; end marks differ from the first symbol on
    row, count = np.empty(len(bwt), index), np.arange(len(bwt), dtype=index)
    for k in range(1, depth + 1):
        row[np.argsort(z, kind="stable")] = count
        symbol = bwt[row]
        on = np.flatnonzero(symbol)
        symbol = (symbol[on] - np.uint16(1)).astype(np.uint8)  # without end marks: a byte, which is sorted in one pass
        turn = np.argsort(symbol, kind="stable")
        order = on[turn]
        block = np.cumsum(edge, dtype=index)[order]
        z = np.concatenate([marks, z[order]])
        symbol = symbol[turn]
        new = edge.copy()
        new[: len(marks) + 1] = True
        if len(order):
            new[len(marks) + 1 :] |= (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        common[new & ~edge] = k - 1
        edge = new
    row[np.argsort(z, kind="stable")] = count
    return row, common


def _merged_least(shards: list[list[bytes]], firsts: np.ndarray, length: int) -> np.ndarray:
    """Least document of every window of the strings, which are all different and numbered through: the transforms of the shards are merged, and equal windows are intervals of the merged rows."""
    bwts = [shard_bwt(x) for x in shards]
    row, common = merge_bwts([b[0] for b in bwts], [len(x) for x in shards], length)
    base = np.cumsum([0] + [len(x) for x in shards])
    string = np.concatenate([b[1] + at for b, at in zip(bwts, base, strict=False)])[row]
    offset = np.concatenate([b[2] for b in bwts])[row]
    lens = np.array([len(s) for x in shards for s in x], np.int64)
    n_windows = lens - length + 1
    found = np.empty(int(n_windows.sum()), np.int64)
    # an interval's rows are neighbours, and full: a row that ends earlier has a shorter common prefix
    full = np.flatnonzero(lens[string] - offset >= length)
    starts = np.flatnonzero(common[full] < length)
    groups = np.minimum.reduceat(firsts[string[full]], starts)
    found[(np.cumsum(n_windows) - n_windows)[string[full]] + offset[full]] = np.repeat(groups, np.diff(np.append(starts, len(full))))
    return found


def least_documents(shards: list[tuple[list[bytes], np.ndarray]], length: int) -> list[np.ndarray]:
    """For each shard's strings, joined: the least document of every window, where a string comes with its least document in the shard."""
    known: dict[bytes, int] = {}
    least: list[int] = []
    places, fresh = [], []
    for strings, docs in shards:
        own, new = [], []
        for s, d in zip(strings, docs.tolist(), strict=True):
            k = known.setdefault(s, len(known))
            if k == len(least):
                least.append(d)
                new.append(s)
            elif d < least[k]:
                least[k] = d
            own.append(k)
        places.append(own)
        fresh.append(new)
    firsts = np.array(least, np.int64)
    lens = np.array([len(s) for s in known], np.int64)
    n_windows = lens - length + 1
    begin = np.cumsum(n_windows) - n_windows
    found = np.repeat(firsts, n_windows)
    # windows whose hash no other window has are equal to none: what is left of the strings are runs of the others
    joined = b"".join(known)
    owner = np.repeat(np.arange(len(known)), n_windows)
    at = np.repeat(np.cumsum(lens) - lens - begin, n_windows) + np.arange(len(owner))
    _, which, counts = np.unique(gram_hashes(np.frombuffer(joined, np.uint8), length)[at], return_inverse=True, return_counts=True)
    shared = counts[which] > 1
    ahead = np.concatenate([[False], shared[:-1] & (owner[1:] == owner[:-1])])
    run = np.flatnonzero(shared & ~ahead)
    if len(run):
        number = np.cumsum(shared & ~ahead)[shared] - 1
        sizes = np.bincount(number, minlength=len(run))
        trimmed: dict[bytes, int] = {}
        shard_of = np.repeat(np.arange(len(fresh)), [len(x) for x in fresh])
        kept: list[list[bytes]] = [[] for _ in fresh]
        use = []
        for a, n, shard in zip(at[run].tolist(), sizes.tolist(), shard_of[owner[run]].tolist(), strict=True):
            s = joined[a : a + n + length - 1]
            k = trimmed.get(s)
            if k is None:
                k = trimmed[s] = len(trimmed)
                kept[shard].append(s)
            use.append(k)
        use = np.array(use, np.int64)
        own = np.full(len(trimmed), _LAST, np.int64)
        np.minimum.at(own, use, firsts[owner[run]])
        merged = _merged_least([x for x in kept if x], own, length)
        size_of = np.array([len(s) - length + 1 for s in trimmed], np.int64)
        start_of = np.cumsum(size_of) - size_of
        within = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found[shared] = merged[start_of[use][number] + within]
    return [np.concatenate([found[begin[k] : begin[k] + n_windows[k]] for k in own]) for own in places]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", 1 << 20):
        rows = sorted(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True), key=lambda r: _LAST if r[0] is None else r[0])
        raw = [(t or "").encode("utf-8", "replace") for _, t in rows]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[i for i, _ in rows]], pa.list_(pa.int64())), pa.array([[len(r) for r in raw]], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(raw))], pa.binary())], ["shard", "ids", "lens", "data"])
        n += 1


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) by bucket, ascending in both."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[part[0]]), part) for part in np.split(order, at[1:])] if len(order) else []


class _Values:
    """Distinct values of a shard's runs of windows: which of them other runs have, here or, once the states are added, elsewhere (1), and which are hot (2)."""

    def __init__(self, value: np.ndarray, buckets: int) -> None:
        self.values, self.which, self.counts = np.unique(value, return_inverse=True, return_counts=True)
        self.bucket = (self.values % np.uint64(buckets)).astype(np.int64)
        self.state = (self.counts > 1).astype(np.uint8)

    def add(self, states: list | None) -> None:
        found = {x["bucket"]: x["states"] for x in states or []}
        for bucket, part in _by_bucket(self.bucket):
            if bucket in found:
                self.state[part] = np.maximum(self.state[part], np.frombuffer(found[bucket], np.uint8))

    def batch(self, shard: int) -> pa.RecordBatch:
        """bucket, shard, values, counts: a row for each bucket."""
        parts = _by_bucket(self.bucket)
        columns = [pa.array([b for b, _ in parts], pa.int64()), pa.array([shard] * len(parts), pa.int64())]
        columns += [pa.array([x[p].tobytes() for _, p in parts], pa.binary()) for x in (self.values, self.counts.astype(np.uint32))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "values", "counts"])


class _Shard:
    """A shard's runs of windows (first, n, bucket) and which of them may repeat."""

    def __init__(self, row: dict, length: int, buckets: int) -> None:
        self.shard, self.ids = row["shard"], row["ids"]
        self.raw = zstandard.ZstdDecompressor().decompress(row["data"])
        self.lens = np.array(row["lens"], np.int64)
        self.ends = np.cumsum(self.lens)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.length, self.buckets = length, buckets
        self.first, self.n, value = window_strings(self.data, self.ends, length)
        self.coarse = _Values(value, buckets)

    def hot_windows(self, states: list | None) -> tuple[np.ndarray, _Values]:
        """First bytes of the windows of hot values, and the hashes of these windows."""
        self.coarse.add(states)
        hot = np.flatnonzero(self.coarse.state[self.coarse.which] == 2)
        n = self.n[hot]
        first = np.repeat(self.first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return first, _Values(gram_hashes(self.data, self.length)[first] if len(first) else np.zeros(0, np.uint64), self.buckets)

    def settle(self, states: list | None, finer: list | None) -> None:
        """Runs that may repeat: those of values that do, and single windows for hot values."""
        first, fine = self.hot_windows(states)
        fine.add(finer)
        warm, again = self.coarse.state[self.coarse.which] == 1, fine.state[fine.which] > 0
        self.bucket = np.concatenate([self.coarse.bucket[self.coarse.which][warm], fine.bucket[fine.which][again]])
        self.once = np.concatenate([self.coarse.counts[self.coarse.which][warm], fine.counts[fine.which][again]]) == 1
        self.first, self.n = np.concatenate([self.first[warm], first[again]]), np.concatenate([self.n[warm], np.ones(int(again.sum()), np.int64)])

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """First runs of the distinct strings of each bucket, by bucket; for every run the place of its string among these. A run whose value the shard has once is compared with no other."""
        same = np.arange(len(self.first))
        seen: dict[tuple[int, bytes], int] = {}
        more = np.flatnonzero(~self.once)
        begin = self.first[more]
        for run, a, b, bucket in zip(more.tolist(), begin.tolist(), (begin + self.n[more] + self.length - 1).tolist(), self.bucket[more].tolist(), strict=True):
            same[run] = seen.setdefault((bucket, self.raw[a:b]), run)
        order = np.argsort(self.bucket, kind="stable")
        distinct = order[same[order] == order]
        place = np.empty(len(same), np.int64)
        place[distinct] = np.arange(len(distinct))
        return distinct, place[same]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, values_per_bucket: int = 1 << 17, hot: int = 4096) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Removed is each byte covered by a ``length``-byte string (``length`` at least 1) that also starts in a document with a smaller id, judged on the input. A null or empty text has no bytes. Ids are whole numbers, others become null. Rows that repeat an id don't count as earlier for one another; a null id counts as the largest. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = materialize(source.mapInArrow(_pack, "shard long, ids array<long>, lens array<long>, data binary"), "shards", block_mb=4)
    total = shards.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 16 // values_per_bucket + 1)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _Shard(row, length, buckets).coarse.batch(row["shard"])

    def hot_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _Shard(row, length, buckets).hot_windows(row["states"])[1].batch(row["shard"])

    def shared(table: pa.Table) -> pa.Table:
        """Which values of each shard another shard has, and which of these are hot."""
        lists = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("values")]
        counts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) for c in table.column("counts")])
        _, which, shards_of = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        sums = np.bincount(which, counts)
        state = np.where(sums > hot, 2, shards_of > 1).astype(np.uint8)[which]
        cuts = np.cumsum([len(v) for v in lists])[:-1]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "states": pa.array([x.tobytes() for x in np.split(state, cuts)], pa.binary())})

    def states_of(found: DataFrame, name: str) -> DataFrame:
        states = found.groupBy("bucket").applyInArrow(shared, "shard long, bucket long, states binary")
        is_hot = F.locate("\u0002", F.decode("states", "ISO-8859-1")) > 0
        return materialize(states.groupBy("shard").agg(F.collect_list(F.struct("bucket", "states")).alias(name), F.max(is_hot).alias("has_hot")), "repeat-states")

    by_bucket = "bucket long, shard long, values binary, counts binary"
    states = states_of(shards.mapInArrow(values, by_bucket), "states")
    hot_shards = states.filter("has_hot").select("shard", "states")
    if hot_shards.isEmpty():
        states = states.select("shard", "states", F.lit(None).cast("array<struct<bucket:bigint,states:binary>>").alias("finer"))
    else:
        likely = key_filter(hot_shards, F.col("shard"))(shards, F.col("shard")).filter("_may_hold").drop("_may_hold")
        finer = states_of(likely.join(hot_shards, "shard").mapInArrow(hot_values, by_bucket), "finer")
        states = states.join(finer.select("shard", "finer"), "shard", "left").select("shard", "states", "finer")
    known = shards.join(states, "shard", "left")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row, length, buckets)
                s.settle(row["states"], row["finer"])
                yield _by_buckets(s)

    def merged(table: pa.Table) -> pa.Table:
        own = []
        for raw, sizes, firsts in zip(table.column("strings").to_pylist(), table.column("sizes").to_pylist(), table.column("first_ids").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64).tolist()
            own.append(([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], np.frombuffer(firsts, np.int64)))
        out = []
        for least in least_documents(own, length):
            at = np.flatnonzero(np.diff(least, prepend=least[0] ^ 1))
            out.append((least[at].tobytes(), np.diff(np.append(at, len(least))).astype(np.uint32).tobytes()))
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "least": pa.array([x for x, _ in out], pa.binary()), "runs": pa.array([x for _, x in out], pa.binary())})

    least = known.mapInArrow(strings, "bucket long, shard long, strings binary, sizes binary, first_ids binary").groupBy("bucket").applyInArrow(merged, "shard long, bucket long, least binary, runs binary")
    least = materialize(least.groupBy("shard").agg(F.collect_list(F.struct("bucket", "least", "runs")).alias("least")), "least-documents")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row, length, buckets)
                s.settle(row["states"], row["finer"])
                yield _covered(s, row["least"])
        give_back()

    covered = shards.join(states.join(least, "shard", "left"), "shard", "left").mapInArrow(cover, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return covered.withColumnRenamed("id", id_col)


def _by_buckets(s: _Shard) -> pa.RecordBatch:
    """A shard's distinct strings, each with its least document: a row for each bucket."""
    distinct, _ = s.strings()
    ids = np.array([_LAST if i is None else i for i in s.ids], np.int64)
    first, size = s.first[distinct], s.n[distinct] + s.length - 1
    firsts = ids[np.searchsorted(s.ends, first, "right")]
    parts = _by_bucket(s.bucket[distinct])
    strings = [b"".join([s.raw[a:b] for a, b in zip(first[p].tolist(), (first[p] + size[p]).tolist(), strict=True)]) for _, p in parts]
    columns = [pa.array([b for b, _ in parts], pa.int64()), pa.array([s.shard] * len(parts), pa.int64()), pa.array(strings, pa.binary())]
    columns += [pa.array([x[p].tobytes() for _, p in parts], pa.binary()) for x in (size.astype(np.uint32), firsts)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "strings", "sizes", "first_ids"])


def _covered(s: _Shard, least: list | None) -> pa.RecordBatch:
    distinct, place = s.strings()
    edge = np.zeros(len(s.data) + 1, np.int64)
    if len(distinct):
        flat = np.concatenate([np.repeat(np.frombuffer(x["least"], np.int64), np.frombuffer(x["runs"], np.uint32)) for x in sorted(least, key=lambda x: x["bucket"])])
        begin = (np.cumsum(s.n[distinct]) - s.n[distinct])[place]
        n, first = s.n, s.first
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids = np.array([_LAST if i is None else i for i in s.ids], np.int64)
        own = ids[np.searchsorted(s.ends, first, "right")]
        hit = (np.repeat(first, n) + nth)[flat[np.repeat(begin, n) + nth] < np.repeat(own, n)]
        edge[hit] += 1  # a window is in one run
        edge[hit + s.length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    out: dict[str, list] = {"id": s.ids, "n_bytes": s.lens, "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for a, b in zip((s.ends - s.lens).tolist(), s.ends.tolist(), strict=True):
        own = gone[a:b]
        kept = s.data[a:b][~own].tobytes()
        out["n_removed"].append(b - a - len(kept))
        out["n_spans"].append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept)
    return pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary())], list(out))
