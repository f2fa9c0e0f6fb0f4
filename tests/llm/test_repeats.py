import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from sondage.llm import queries
from sondage.llm.repeats import _BLOCK, gram_hashes, least_documents, merge_bwts, remove_repeats, shard_bwt, window_strings

from .conftest import TEXTS


def brute(rows, length=50):
    key = lambda i: float("inf") if i is None else i
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, float("inf")), key(i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(8))
def test_merged_rows_are_sorted_and_prefixes_right(seed):
    rng = random.Random(seed)
    shards = [["".join(rng.choice("ab\0c"[: 2 + seed % 3]) for _ in range(rng.randint(1, 14))).encode() for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 4))]
    bwts = [shard_bwt(x) for x in shards]
    depth = 15
    row, common = merge_bwts([b[0] for b in bwts], [len(x) for x in shards], depth)
    base = np.cumsum([0] + [len(x) for x in shards])
    string = np.concatenate([b[1] + at for b, at in zip(bwts, base, strict=False)])[row]
    offset = np.concatenate([b[2] for b in bwts])[row]
    every = [s for x in shards for s in x]
    suffix = [tuple([c + 1 for c in every[s][o:]] + [0]) + (s,) for s, o in zip(string.tolist(), offset.tolist(), strict=True)]
    assert suffix == sorted(suffix)
    for k in range(len(base[:1]), len(suffix)):
        a, b = every[string[k - 1]][offset[k - 1] :], every[string[k]][offset[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k] == n


def test_least_documents_of_windows():
    rng = random.Random(3)
    text = bytes(rng.choice(b"xyz") for _ in range(120))
    shards = [([text[k : k + 20] for k in (0, 30, 37)], np.array([5, 3, 9])), ([text[0:20], text[5:25]], np.array([4, 1])), ([text[33:53]], np.array([7]))]
    first = {}
    for strings, ids in shards:
        for s, d in zip(strings, ids, strict=True):
            for k in range(11):
                first[s[k : k + 10]] = min(first.get(s[k : k + 10], 99), d)
    for (strings, _), got in zip(shards, least_documents(shards, 10), strict=True):
        assert got.tolist() == [first[s[k : k + 10]] for s in strings for k in range(11)]


def test_every_window_is_in_one_string():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 49, 50, 51, 400)] + [b"ab" * 200, b"\0" * 130]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    first, n, _ = window_strings(data, ends, 50)
    got = sorted(int(a) + k for a, m in zip(first, n, strict=True) for k in range(m))
    assert got == [int(e - len(t)) + k for t, e in zip(texts, ends, strict=True) for k in range(len(t) - 49)] and n.max() <= 31


def test_hashes_are_taken_block_by_block():
    rng = random.Random(4)
    data = np.frombuffer(rng.randbytes(1 << 20), np.uint8)
    tracemalloc.start()
    got = gram_hashes(data, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(data)  # eight bytes a place for the result
    for a in (0, 1, _BLOCK - 30, _BLOCK, 3 * _BLOCK - 49, len(data) - 50):
        assert got[a] == gram_hashes(data[a : a + 50], 50)[0]


def test_against_brute_force(spark, docs, no_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(3, 40))) for _ in range(25)]
    rows = list(TEXTS) + [(100 + i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(None, pool[0] * 3), (None, pool[0] * 3), (200, "ab" * 300), (201, "é" * 70), (199, "é" * 30 + "\0" * 60), (202, "\0" * 80)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    assert result(remove_repeats(df)) == brute(rows)
    assert result(remove_repeats(df, values_per_bucket=20)) == brute(rows)
    assert result(remove_repeats(df, hot=3)) == brute(rows)
    for length in (1, 7, 20, 300):
        assert result(remove_repeats(df, length=length)) == brute(rows, length)
    assert remove_repeats(no_docs).count() == 0


def test_a_phrase_that_most_documents_have(spark):
    """One phrase amid other words in each document, some of it repeated beyond the phrase: its windows are split by their whole bytes."""
    rng = random.Random(6)
    phrase = "this very common phrase of some seventy bytes stands in each document"
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    rows = []
    for i in range(120):
        before, after = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(12))
        rows.append((i, f"{before} {phrase} {after}"))
        if i % 10 == 0:
            rows.append((500 - i, f"{before[-25:]} {phrase} {after[:30]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows)
    for hot in (2, 50, 4096):
        assert result(remove_repeats(df, hot=hot)) == want


def test_query_on_the_given_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op7_repeated_passages(spark, d)) == brute(rows)
