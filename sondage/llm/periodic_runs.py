"""Periodic runs of words in documents.

A run is a maximal repetition of words. Every run has, for the order of words or its reverse, a Lyndon word as root, and this is the longest Lyndon word that starts at one of its places (the runs theorem). So two candidates per word, extended in both directions by the longest common extension (LCE) of two places, give all runs. Extensions are lowest common ancestors: in the suffix tree of the document forward, in that of its reversal backward, both built by Ukkonen's algorithm; ancestors are range minima over the inner nodes of an Euler tour, by a sparse table.

Trees are built over the words that can be in a run: a run of at least 12 words has, between any two words one period apart, six words that occur again one period further, so each of its words is covered by a passage of six words that is found twice within one stretch of such words. All others are left out before, by a few array operations for a batch; stretches are parted by words that occur nowhere else.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

#: A run has at least so many words, and so at least half of them found again a period later.
LEAST = 12
_GRAM = LEAST // 2


class SuffixTree(NamedTuple):
    """What is asked of a suffix tree: leaves in the order of their suffixes, and the sparse table of minima over the depths of the inner nodes between them."""

    rank: np.ndarray
    minima: list[np.ndarray]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, which differ: the depth of their lowest common ancestor."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k)])
        return out


def _ukkonen(word: list[int], size: int) -> tuple[dict[int, int], list[int]]:
    """Edges (node * size + first word -> child) and depths of the inner nodes of the suffix tree of ``word``, whose last symbol occurs nowhere else. Nodes from 0 are inner ones, the root first; the leaf of the suffix at i is -1 - i."""
    n = len(word)
    edges: dict[int, int] = {}
    get = edges.get
    depth, link, begin = [0], [0], [0]  # begin: where the label of the edge to the node begins
    leaf_begin = [0] * n
    node = length = at = left = 0
    for i, c in enumerate(word):
        left += 1
        last = 0
        while left:
            if not length:
                at = i
            key = node * size + word[at]
            child = get(key)
            if child is None:
                suffix = i - left + 1
                edges[key] = -1 - suffix
                leaf_begin[suffix] = i
                if last:
                    link[last] = node
                    last = 0
            else:
                if child >= 0:
                    run = depth[child] - depth[node]
                    if length >= run:
                        at += run
                        length -= run
                        node = child
                        continue
                    first = begin[child]
                else:
                    first = leaf_begin[-1 - child]
                if word[first + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                inner = len(depth)
                depth.append(depth[node] + length)
                link.append(0)
                begin.append(first)
                edges[key] = inner
                suffix = i - left + 1
                edges[inner * size + c] = -1 - suffix
                leaf_begin[suffix] = i
                edges[inner * size + word[first + length]] = child
                if child >= 0:
                    begin[child] = first + length
                else:
                    leaf_begin[-1 - child] = first + length
                if last:
                    link[last] = inner
                last = inner
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - left + 1
    return edges, depth


def suffix_tree(word: np.ndarray) -> SuffixTree:
    """The tree of ``word``: non-negative symbols, the last of which occurs nowhere else."""
    size, n = int(word.max()) + 1, len(word)
    edges, depth = _ukkonen(word.tolist(), size)
    keys, child = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
    del edges
    order = np.argsort(keys)
    first = np.searchsorted(keys[order] // size, np.arange(len(depth) + 1)).tolist()
    child = child[order].tolist()
    # Euler tour from the root: an inner node is noted where the tour comes back to it between two leaves
    leaves, between, pending = [], [], 0
    todo, above = [0], [-1]
    while todo:
        node, back = todo.pop(), above.pop()
        if back >= 0:
            pending = back
        if node < 0:
            leaves.append(-1 - node)
            between.append(pending)
            continue
        a, b = first[node], first[node + 1]
        todo += child[a:b][::-1]
        above += [depth[node]] * (b - a - 1)
        above.append(-1)
    rank = np.empty(n, np.int64)
    rank[leaves] = np.arange(n)
    minima = [np.array(between[1:], np.int32)]
    while (k := 1 << len(minima)) < n:
        row = minima[-1]
        minima.append(np.minimum(row[: n - k], row[k // 2 : n - k // 2]))
    return SuffixTree(rank, minima)


def _next_beyond(rank: list[int]) -> tuple[list[int], list[int]]:
    """The next place with a lesser and with a greater rank; the number of places where there is none."""
    n = len(rank)
    less, more = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for j, r in enumerate(rank):
        while falling and rank[falling[-1]] > r:
            less[falling.pop()] = j
        falling.append(j)
        while rising and rank[rising[-1]] < r:
            more[rising.pop()] = j
        rising.append(j)
    return less, more


def find_runs(word: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``least`` symbols, ascending by start, then period. ``word``: non-negative symbols."""
    n = len(word)
    if n < max(2, least):
        return np.zeros((0, 3), np.int64)
    stop = int(word.max()) + 1
    ahead, back = suffix_tree(np.append(word, stop)), suffix_tree(np.append(word[::-1], stop))
    at = np.arange(n)
    # no suffix begins another, thanks to the last symbol: the reverse order of words reverses the ranks
    ends = np.concatenate([np.array(x[:n], np.int64) for x in _next_beyond(ahead.rank.tolist())])
    i, j = np.concatenate([at, at]), ends
    ok = j + np.minimum(j - i, 1) <= n  # the suffix that is only the last symbol is no root's end
    i, j = i[ok], j[ok]
    p = j - i
    forward = np.where(j < n, ahead.common(i, np.minimum(j, n)), 0)
    backward = np.zeros(len(i), np.int64)
    inside = i > 0
    backward[inside] = back.common(n - i[inside], n - j[inside])
    runs = np.stack([i - backward, backward + p + forward, p], 1)
    runs = runs[runs[:, 1] >= np.maximum(least, 2 * p)]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _repeating(word: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which words are covered by a passage of ``_GRAM`` words that is found twice in their part. Passages meet by a 64-bit hash: equal ones always do."""
    n = len(word) - _GRAM + 1
    marked = np.zeros(len(word), bool)
    if n <= 0:
        return marked
    value = np.zeros(n, np.uint64)
    for k in range(_GRAM):
        value = value * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n].astype(np.uint64)
    value = (value ^ (part[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    whole = np.flatnonzero(part[:n] == part[_GRAM - 1 :])
    value = value[whole]
    # a table of counts first, so that few are sorted
    bits = max(10, min(22, int(len(value)).bit_length() + 2))
    slot = (value & np.uint64((1 << bits) - 1)).astype(np.int64)
    shared = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    _, where, count = np.unique(value[shared], return_inverse=True, return_counts=True)
    start = whole[shared[count[where] > 1]]
    for k in range(_GRAM):
        marked[start + k] = True
    return marked


def _stretches(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in runs, and the number of the stretch of each."""
    at, part = np.arange(len(word)), doc
    while True:
        marked = _repeating(word[at], part)
        if marked.all():
            return at, part
        at = at[marked]
        if not len(at):
            return at, part[:0]
        part = np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc[at]) != 0)]))


def _planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """First word and period of the stretch that the query makes periodic in a document of n words. Fixed values of the contract."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


_OUT = pa.schema([("id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string())])


def _scan(batch: pa.RecordBatch, plant: bool, texts_out: bool) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    real = np.asarray(pc.not_equal(flat, ""))
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    flat = flat.filter(pa.array(real))
    word = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = batch.column("id").to_pylist()
    source = np.arange(len(word))
    changed = set()
    for k, doc_id in enumerate(ids):
        if plant and doc_id is not None and (made := _planted(doc_id, n := int(offsets[k + 1] - offsets[k]))):
            (a, p), o = made, int(offsets[k])
            source[o + a : o + n] = o + a + np.arange(n - a) % p
            changed.add(k)
    word = word[source]
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    at, part = _stretches(word, doc)
    # each document's stretches, with a word of its own after each
    edges = np.searchsorted(doc[at], np.arange(len(ids) + 1)) if len(at) else np.zeros(len(ids) + 1, np.int64)
    columns: dict[str, list] = {f.name: [] for f in _OUT}
    for k, doc_id in enumerate(ids):
        o, n = int(offsets[k]), int(offsets[k + 1] - offsets[k])
        runs = np.zeros((0, 3), np.int64)
        if edges[k] < edges[k + 1]:
            place, own = at[edges[k] : edges[k + 1]], part[edges[k] : edges[k + 1]]
            _, symbols = np.unique(word[place], return_inverse=True)
            cuts = np.flatnonzero(np.diff(own)) + 1
            symbols = np.insert(symbols, cuts, symbols.max() + 1 + np.arange(len(cuts)))
            place = np.insert(place, cuts, -1)
            runs = find_runs(symbols)
            runs[:, 0] = place[runs[:, 0]] - o
            runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        body = texts[k].as_py().encode()
        if k in changed or len(runs):
            words = body.split()
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
            np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
            kept = source[o : o + n][np.cumsum(cover[:n]) == 0] - o
            body = b" ".join([words[x] for x in kept.tolist()])
        else:
            body = b" ".join(body.split())
        rows = runs.tolist()
        top = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
        for name, value in (("id", doc_id), ("n_runs", len(rows)), ("start", top and top[0]), ("length", top and top[1]), ("period", top and top[2]), ("exponent_milli", top and 1000 * top[1] // top[2]), ("runs_sha256", hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in rows).encode()).hexdigest()), ("collapsed_sha256", hashlib.sha256(body).hexdigest()), ("runs", rows if texts_out else None), ("collapsed", body.decode() if texts_out else None)):
            columns[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _OUT], schema=_OUT)


def collapse_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, texts: bool = True) -> DataFrame:
    """Per document: n_runs, the longest run (start, length, period, exponent_milli: 1000 times its length by its period, rounded down), runs_sha256, collapsed_sha256, runs (start, length, period of each), collapsed (its text with each run reduced to its first period and words joined by blanks).

    Words are parted by blanks and the control characters 9 to 13. A null or empty text has no words and no runs; of equally long runs the first is given, then that with the smaller period. Repeated rows are judged each; other columns are not carried. A long text is one task's work: the trees take about 700 bytes for each word that a run can hold. ``plant``: first make documents periodic by their ids as the query asks (not those without an id). Without ``texts`` runs and collapsed are null. No shuffle.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield _scan(batch, plant, texts)

    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<array<bigint>>, collapsed string"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
