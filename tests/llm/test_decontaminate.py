import hashlib
import re

import numpy as np

from sondage.llm import queries
from sondage.llm.decontaminate import WuManber, drop_contaminated, find_benchmark, item_windows, words_of

from .conftest import PASSAGE, TEXTS

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words = plain_words(text)
    hit, ids = set(), set()
    for item, body in items:
        own = plain_words(body)
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if size and tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(words)


def rows_of(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_against_brute_force(spark, docs, no_docs):
    items = [(1, PASSAGE), (2, "fox jumps"), (3, "b"), (4, None), (5, ""), (12, "The QUICK, brown fox jumps over the lazy dog near the river bank today and"), (6, "Über ñandú")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, id string")
    assert rows_of(find_benchmark(docs, bench)) == sorted((i, *brute(t, items)) for i, t in TEXTS)
    assert find_benchmark(no_docs, bench).count() == 0
    assert {r.n_hit for r in find_benchmark(docs, bench.limit(0)).collect()} == {0}


def test_random_words_of_a_small_alphabet():
    rng = np.random.default_rng(1)
    word = lambda: "ab"[rng.integers(2)] * int(rng.integers(1, 3))
    for _ in range(30):
        items = [(i, " ".join(word() for _ in range(rng.integers(1, 20)))) for i in range(4)]
        owners = {}
        for i, t in items:
            for w in set(item_windows(t, 13)):
                owners.setdefault(w, []).append(str(i))
        texts = [" ".join(word() for _ in range(rng.integers(0, 400))) for _ in range(3)]
        for t, (n, hit, ids) in zip(texts, WuManber(owners).scan(texts), strict=True):
            want = brute(t, items)
            assert (n, hit, len(ids)) == want[:3]


def test_words():
    assert words_of("A-b ÀÉ 9_z\x7f") == [w.encode() for w in plain_words("A-b ÀÉ 9_z\x7f")]


def test_query_on_the_given_tables(spark):
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op4_benchmark_decontamination(spark, d)) == sorted((i, *brute(t, items)) for i, t in docs)


def test_benchmark_of_many_blocks(spark, docs, no_docs):
    items = [(1, PASSAGE), (2, "fox jumps"), (3, "b"), (4, None), (5, ""), (12, "The QUICK, brown fox jumps over the lazy dog near the river bank today and"), (6, "Über ñandú"), (7, PASSAGE + " " + PASSAGE), (8, "fox jumps")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute(t, items)) for i, t in TEXTS)
    for most in (100, 400):
        assert rows_of(find_benchmark(docs, bench, block_bytes=most)) == want
        kept = drop_contaminated(docs, bench, block_bytes=most)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[-1]]
    assert find_benchmark(no_docs, bench, block_bytes=100).count() == 0
