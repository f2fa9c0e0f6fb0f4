"""Near-duplicate classes by weighted Jaccard similarity of word shingles, with BagMinHash signatures.

A text is the multiset of its shingles of five words. A shingle's weight axis is cut at 1, 2, 4, 8, ...; each piece has its own Poisson process, whose points carry a register and a place in the piece, so that a shingle with count c takes the points below c. The least point of each register is the signature: two texts agree in a register with the probability of their weighted Jaccard similarity. Points of a text are drawn in rising order and only until they exceed its largest register.

Equal texts are one node. Bands of the signature give buckets. The node of each bucket that has most company over all its buckets is compared with the others (first by signature, then by exact multiset overlap): links that give components. Buckets that then still hold several components are open. An open bucket whose lesser components together exceed ``BLOCK`` nodes is split by longer bands of the same signatures (``FINE_BANDS`` of ``FINE_ROWS`` registers; a pair of similarity 0.8 that meets in no band at all has a probability of about 1e-5, and meets in a dozen other buckets). Open buckets are settled exactly, in blocks of about ``BLOCK`` nodes and pairs of blocks, where the blocks of the largest component are paired with the others only: a first pass over signatures keeps the nodes that may have a partner in another component, a second one compares their multisets and gives at most one link for each component that it joins. No pair of a bucket becomes a row unless it is compared with the bucket's centre or joins two components.

Texts are read twice: for the signatures, and, where a key filter says that they may be wanted, for the multisets. Whole texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, key_filter, materialize, release, slices, worker_cache

BANDS, ROWS = 40, 5
FINE_BANDS, FINE_ROWS = 80, 8
BLOCK = 512
REGISTERS = BANDS * ROWS
#: A pair of similarity 0.8 agrees in fewer registers with a probability below 1e-9.
_SLACK = 0.17
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < 120_000:  # about 170 bytes each
            self[word] = value
        return value


def shingle_hashes(texts: list[list[bytes]], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts, and the text of each; a text of fewer words, but not none, is one shingle."""
    counts = np.array([len(w) for w in texts], np.int64)
    known = worker_cache("word-hashes", _WordHashes)
    words = np.fromiter((known[w] for ws in texts for w in ws), np.uint64, int(counts.sum()))
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    have = np.minimum(counts, size)[owner]
    value = np.zeros(len(first), np.uint64)
    for k in range(size):
        value = _mix(value * _GOLD + np.where(k < have, padded[first + k], np.uint64(k + 1)))
    return value, owner


def bag_min_hash(shingles: np.ndarray, owner: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """One signature byte per register and text."""
    bits = np.uint64(20)  # the same for all batches, of at most 2**20 texts: 44 bits of a shingle's hash tell it from others of its text
    key = np.sort(owner.astype(np.uint64) << (np.uint64(64) - bits) | shingles >> bits)
    starts = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(starts, len(key)))
    text, element = (key[starts] >> (np.uint64(64) - bits)).astype(np.int64), key[starts] << bits
    # pieces of the weight axis: [0,1), [1,2), [2,4), ... each with its width as rate
    units = [(text, element, np.ones(len(text)), np.zeros(len(text), np.int64), weight)]
    low = 1
    while (more := weight > low).any():
        t, e, w = text[more], element[more], weight[more]
        units.append((t, _mix(e + np.full(1, low, np.uint64) * _GOLD), np.full(len(t), float(low)), np.full(len(t), low), w))
        low *= 2
    text, seed, rate, low_end, weight = (np.concatenate(x) for x in zip(*units, strict=True))
    seed = _mix(seed)
    least = np.full((n_texts, registers), np.iinfo(np.uint64).max, np.uint64)
    flat = least.reshape(-1)
    per_text = np.bincount(text, minlength=n_texts)
    goal = registers * (np.log(registers) + 1.5)
    points = np.exp2(np.ceil(np.log2(np.clip(goal / np.maximum(per_text, 1), 1, None)))).astype(np.int64)[text]
    active, done, reached = np.arange(len(text)), np.zeros(len(text), np.int64), np.zeros(len(text))
    while len(active):
        on = []
        for m in np.unique(points[active]).tolist():
            u = active[points[active] == m]
            nth = (done[u][:, None] + np.arange(1, m + 1)).astype(np.uint64)
            draw = _mix(seed[u][:, None] + nth * _GOLD)
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate[u][:, None]
            gap[:, 0] += reached[u]
            x = np.cumsum(gap, axis=1)
            other = _mix(draw)
            register = (other >> np.uint64(32)) % np.uint64(registers)
            at = text[u][:, None] * registers + register.astype(np.int64)
            value = x.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | other & np.uint64(0xFFFFFFFF)
            wide = low_end[u] > 1
            if wide.any():
                place = low_end[u][:, None] + (_mix(other) % np.maximum(low_end[u], 1).astype(np.uint64)[:, None]).astype(np.int64)
                keep = place < weight[u][:, None]
                keep[~wide] = True
                np.minimum.at(flat, at[keep], value[keep])
            else:
                np.minimum.at(flat, at.ravel(), value.ravel())
            done[u] += m
            reached[u] = x[:, -1]
            on.append(u)
        active = np.concatenate(on)
        largest = (least[np.unique(text[active])] >> np.uint64(32)).max(1)
        limit = np.full(n_texts, -1.0)
        limit[np.unique(text[active])] = np.where(largest == 0xFFFFFFFF, np.inf, largest.astype(np.uint32).view(np.float32).astype(np.float64))
        active = active[reached[active] < limit[text[active]]]
        points[active] = np.maximum(1, points[active] // 2)
    return (_mix(least & np.uint64(0xFFFFFFFF)) & np.uint64(0xFF)).astype(np.uint8)


def unit_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of (shingle, occurrence): the overlap of two such sets is the multiset overlap."""
    h, _ = shingle_hashes([words])
    h = np.sort(h)
    first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(_mix(h + _GOLD * nth.astype(np.uint64)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        words = [_words(t) for t in batch.column("text").to_pylist()]
        found = bag_min_hash(*shingle_hashes(words), len(words))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_digest(w) for w in words], pa.binary()), pa.array([s.tobytes() if w else b"" for s, w in zip(found, words, strict=True)], pa.binary())], ["id", "digest", "sketch"])
    forget()


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = (np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)).astype(np.uint64)
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
        keys = (sketch.astype(np.uint64) * place).sum(2) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["key", "node"])
    give_back()


def _near(least: float):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= least - _SLACK))

    return near


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, units of the texts; of equal texts in a task mostly one, so that no text is repeated a million times."""
    seen: set[bytes] = set()
    for batch in slices(batches, "text", 1 << 20):
        found = {_digest(w): w for w in map(_words, batch.column("text").to_pylist())}
        fresh = [d for d in found if d not in seen]
        if len(seen) < 200_000:
            seen.update(fresh)
        yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary()), pa.array([unit_hashes(found[d]).tobytes() for d in fresh], pa.binary())], ["digest", "units"])
    forget()


def _verify(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= least for a, b in zip(batch.column("units_a"), batch.column("units_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return verify


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows with equal keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *change.tolist(), batch.num_rows]
        for x, y in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(x, y - x)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)


def _likely(table: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows after it with another label that may be similar, their agreement)."""
    label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    for x in range(len(label) - 1):
        other = np.flatnonzero((label[x + 1 :] != label[x]) & (within | (block[x + 1 :] != block[x]))) + x + 1
        if len(other):
            agree = (sketch[other] == sketch[x]).mean(1)
            near = agree >= least - _SLACK
            if near.any():
                yield x, other[near], agree[near]


def _suspects(least: float):
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "i", "j"]):
            hit = np.zeros(table.num_rows, bool)
            for x, near, _ in _likely(table, least):
                hit[x], hit[near] = True, True
            if hit.any():
                yield from table.select(["key", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return suspects


def _joining(least: float):
    """Links between components of a bucket, likeliest first, none between nodes that are joined already."""

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "i", "j"]):
            found = list(_likely(table, least))
            if not found:
                continue
            a = np.concatenate([np.full(len(near), x) for x, near, _ in found])
            b = np.concatenate([near for _, near, _ in found])
            order = np.argsort(-np.concatenate([agree for *_, agree in found]), kind="stable")
            units = [np.frombuffer(u.as_buffer(), np.uint64) for u in table.column("units")]
            node, names = table.column("node").to_pylist(), table.column("label").to_pylist()
            root = {n: n for n in names}

            def find(n: int, root: dict = root) -> int:
                while root[n] != n:
                    root[n] = n = root[root[n]]
                return n

            links = []
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                p, q = find(names[x]), find(names[y])
                if p != q and similarity(units[x], units[y]) >= least:
                    root[max(p, q)] = min(p, q)
                    links.append((node[x], node[y]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])
        give_back()

    return joining


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longer bands of the signatures, within their buckets: random choices of registers, the same for all."""
    picks = np.random.default_rng(8).permuted(np.tile(np.arange(REGISTERS), (FINE_BANDS, 1)), axis=1)[:, :FINE_ROWS]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
            bands = np.ascontiguousarray(sketch[:, picks]).view("<u8").reshape(-1, FINE_BANDS)
            own = _mix(part.column("key").to_numpy().astype(np.int64).view(np.uint64)[:, None] + _GOLD * np.arange(1, FINE_BANDS + 1, dtype=np.uint64))
            repeated = [pa.array(np.repeat(part.column(c).to_numpy(), FINE_BANDS)) for c in ("node", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(_mix(bands ^ own).ravel().view(np.int64)), *repeated], ["key", "node", "label"])
    give_back()


def _open(members: DataFrame) -> DataFrame:
    """The rows (key, node, label) of buckets with several labels, with the most frequent label (main), its rows and those of all."""
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n_all")).filter("top.n < n_all")
    return members.join(shape.select("key", F.col("top.label").alias("main"), F.col("top.n").alias("n_main"), "n_all"), "key")


def _in_blocks(opened: DataFrame) -> DataFrame:
    """Rows of open buckets dealt to blocks of about ``BLOCK``, once for every pair of blocks (i, j) of the bucket that theirs is part of, sorted by bucket and pair. Blocks of the main label come last, and form no pairs among themselves."""
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = opened.withColumns({"is_main": F.col("label") == F.col("main"), "rest_blocks": blocks(F.col("n_all") - F.col("n_main")), "main_blocks": blocks(F.col("n_main"))})
    hashed = F.xxhash64("node", F.lit("block"))
    own = F.when(F.col("is_main"), F.col("rest_blocks") + F.pmod(hashed, "main_blocks")).otherwise(F.pmod(hashed, "rest_blocks")).cast("int")
    last = F.col("rest_blocks") - 1 + F.when(F.col("is_main"), 0).otherwise(F.col("main_blocks"))
    rows = rows.withColumns({"block": own, "other": F.explode(F.sequence(F.lit(0), last))})
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "is_main", "rest_blocks", "main_blocks", "main", "n_main", "n_all")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def components(links: DataFrame) -> DataFrame:
    """node, label for the nodes of ``links`` (a, b): label is the least node of the connected component. Labels spread to neighbours and then jump to their label's label; each round is written to the shared folder."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = last = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = materialize(moved.join(jump, moved["label"] == jump["at"]).select("node", "old", F.least("label", "next").alias("label")), "labels")
        release(last)
        labels, last = moved.select("node", "label"), moved
        if moved.filter("old <> label").isEmpty():
            release(both)
            return labels


def _classified(source: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """id, digest, sketch of the rows of ``source`` (id, text); digest, label, class_id, class_rows of the distinct texts: label tells classes apart, also where ids are null or repeat."""
    signed = materialize(source.mapInArrow(_sign, "id long, digest binary, sketch binary"), "signatures")
    nodes = signed.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    bands = nodes.filter("length(sketch) > 0").select("node", "sketch").mapInArrow(_band, "key long, node long")
    buckets = materialize(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = materialize(bands.join(buckets, "key").select("key", "node", "n"), "members")
    release(buckets)
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    centres = materialize(members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("hub")), "centres")
    pairs = members.select("key", "node").join(centres, "key").filter("node <> hub")
    pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def units_of(wanted: DataFrame) -> DataFrame:
        """node, units of the nodes wanted: their texts are among those with their first ids."""
        wanted = materialize(nodes.join(wanted, "node").select("node", "digest", "first_id"), "wanted")
        texts = key_filter(wanted, F.col("first_id"))(source, F.col("id")).filter("_may_hold").select("text")
        found = texts.mapInArrow(_units, "digest binary, units binary").dropDuplicates(["digest"])
        return materialize(found.join(wanted.select("digest", "node"), "digest").select("node", "units"), "units")

    sketch = nodes.select("node", "sketch")
    pairs = pairs.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
    pairs = materialize(pairs.mapInArrow(_near(least), "a long, b long"), "pairs")
    release(centres)
    units = units_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    checked = pairs.join(units.toDF("a", "units_a"), "a").join(units.toDF("b", "units_b"), "b")
    links = materialize(checked.mapInArrow(_verify(least), "a long, b long"), "near-links")
    release(pairs)
    labels = components(links)

    # a bucket of two is settled: its centre was one of them
    labelled = members.filter("n > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    opened = materialize(_open(labelled), "open-buckets")
    release(members)
    large = F.col("n_all") - F.col("n_main") > BLOCK
    finer = opened.filter(large).join(sketch, "node").mapInArrow(_refine, "key long, node long, label long")
    todo = opened.filter(~large).unionByName(_open(finer)).join(sketch, "node")
    suspects = _in_blocks(todo).mapInArrow(_suspects(least), "key long, node long")
    suspects = materialize(suspects.distinct().join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "suspects")
    if not suspects.isEmpty():
        more = suspects.select("node").distinct().join(units.select("node"), "node", "left_anti")
        units = units.unionByName(units_of(more))
        joined = _in_blocks(_open(suspects).join(sketch, "node").join(units, "node")).mapInArrow(_joining(least), "a long, b long")
        labels = components(links.unionByName(materialize(joined, "joining-links")))
    release(opened)

    named = nodes.join(labels, "node", "left").select("digest", "first_id", "n", F.coalesce("label", "node").alias("label"))
    classes = named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_rows"))
    return signed, materialize(named.join(classes, "label").select("digest", "label", "class_id", "class_rows"), "classes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per row: id, class_id (least id of its class), class_rows (rows in the class).

    Classes are the components of the links between texts with a weighted Jaccard similarity of at least ``least``; equal texts are always linked, texts without words (null, empty, blank) with each other only. Ids are whole numbers, others become null. Rows that repeat an id are documents alike; a null id counts as the largest. An empty table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, found = _classified(source, least)
    return signed.select("id", "digest").join(found, "digest").select(F.col("id").alias(id_col), "class_id", "class_rows")


def first_of_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of ``near_duplicates``, with all its columns: that with the least id, and among equal ids one text's. Rows are told apart by id and digest of the words, so that rows with null or equal ids and different texts stay.

    Rows whose ids no class of several rows has are kept where they lie; only the others are shuffled.
    """
    signed, found = _classified(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), least)
    rows = materialize(signed.select("id", "digest").join(found.filter("class_rows > 1").select("digest", "label"), "digest").groupBy("label", "id", "digest").agg(F.count("*").alias("n")), "class-rows")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "n")).alias("x"))
    single = signed.select("id", "digest").join(found.filter("class_rows = 1").select("digest"), "digest").select("id", "digest", F.lit(1).cast("long").alias("n"))
    of_several = key_filter(rows, F.col("id"))
    # single rows are looked up only where they have an id, or a false alarm, in common with a class
    first = of_several(first.select("x.id", "x.digest", "x.n").unionByName(single), F.col("id")).filter("_may_hold")
    first = materialize(first.select(F.col("id").alias("_first_id"), F.col("digest").alias("_first_digest"), F.col("n").alias("_first_n")), "first-rows")

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(_words(t)))

    # rows are packed, so that no name of theirs can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row_id = F.col("row")[id_col].cast("long")
    marked = of_several(whole, row_id)
    apart = marked.filter(~F.col("_may_hold")).select("row")
    own = marked.filter("_may_hold").withColumn("_digest", digest(F.col("row")[text_col].cast("string")))
    own = own.join(first, row_id.eqNullSafe(F.col("_first_id")) & (F.col("_digest") == F.col("_first_digest")))
    repeated = own.filter("_first_n > 1").withColumn("_id", row_id).dropDuplicates(["_id", "_digest"])
    return apart.unionByName(own.filter("_first_n = 1").select("row")).unionByName(repeated.select("row")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
