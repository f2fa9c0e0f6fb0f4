import hashlib
import random
import re
import zlib

import numpy as np

from sondage.llm import queries
from sondage.llm.periodic_runs import LEAST, collapse_runs, find_runs, suffix_tree

from .conftest import TEXTS


def brute_runs(w, least=LEAST):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, m, p) for (s, m), p in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    text = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest()


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(0, 80)
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least in (2, LEAST):
            assert [tuple(r) for r in find_runs(np.array(w, np.int64), least).tolist()] == brute_runs(w, least)


def test_common_prefixes():
    rng = np.random.default_rng(2)
    w = np.append(rng.integers(0, 2, 200), 2)
    tree = suffix_tree(w)
    i, j = np.meshgrid(np.arange(201), np.arange(201))
    i, j = i[i != j], j[i != j]
    want = [next(k for k in range(201) if w[a + k] != w[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert tree.common(i, j).tolist() == want


def test_edge_cases_and_planted_runs(spark, docs, no_docs):
    for plant in (False, True):
        assert rows_of(collapse_runs(docs, plant=plant)) == sorted((brute(i, t, plant) for i, t in TEXTS), key=str)
    assert collapse_runs(no_docs).count() == 0
    rows = [(None, "x y " * 20), (1, "x y " * 20), (1, "x y " * 20), (2, "a b c d e f a b c d e f a b c d e f tail a b c d e f a b c d e f")]
    got = collapse_runs(spark.createDataFrame([(i, t, 1.0, "clash") for i, t in rows], "doc_id long, text string, runs double, start string"), plant=True)
    assert rows_of(got) == sorted((brute(i, t, True) for i, t in rows), key=str)
    two = next(r for r in got.collect() if r.doc_id == 2)
    assert two.runs == [[0, 18, 6], [19, 12, 6]] and two.collapsed == "a b c d e f tail a b c d e f"


def test_long_periodic_text(spark):
    words = [f"w{i}" for i in range(2000)]
    text = " ".join(words * 20)
    row = collapse_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), texts=False).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 40000, 2000, 20000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_query_on_the_given_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = [brute(i, t, True) for i, t in docs if len((t or "").split()) < 3000]
    got = rows_of(queries.op12_periodic_runs(spark, d))
    assert len(got) == len(docs) and set(want) <= set(got)
