import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sondage.llm import near_dup, queries
from sondage.llm.near_dup import bag_min_hash, components, first_of_classes, near_duplicates, shingle_hashes, similarity, unit_hashes

from .conftest import TEXTS


def shingles(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def brute(rows):
    bags = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, bag in enumerate(bags):
        for s in bag or [()]:
            holders[s].append(i)
    for i, j in {(i, j) for own in holders.values() for i in own for j in own if i < j}:
        if jaccard(bags[i], bags[j]) >= 0.8:
            root[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("a", "b"), [({1: 3, 2: 1, 3: 8}, {1: 2, 2: 5, 3: 7}), ({k: 1 for k in range(50)}, {k: 1 for k in range(10, 60)}), ({1: 100}, {1: 70})])
def test_registers_agree_as_often_as_the_bags(a, b):
    rng, hits, rounds = np.random.default_rng(7), 0, 60
    for _ in range(rounds):
        name = {k: np.uint64(rng.integers(1 << 62)) for k in a | b}
        bags = [np.array([name[k] for k, n in x.items() for _ in range(n)], np.uint64) for x in (a, b)]
        s = bag_min_hash(np.concatenate(bags), np.repeat([0, 1], [len(x) for x in bags]), 2)
        hits += (s[0] == s[1]).sum()
    j = jaccard(Counter(a), Counter(b))
    seen, want = hits / rounds / 200, j + (1 - j) / 256
    assert abs(seen - want) < 5 * (want * (1 - want) / rounds / 200) ** 0.5 + 0.002


def test_signatures_do_not_depend_on_the_batch():
    words = [f"{i} a b c d e f g {i % 3} {i % 7}".encode().split() * (1 + i % 4) for i in range(20)] + [[], [b"x"]]
    alone = [bag_min_hash(*shingle_hashes([w]), 1)[0] for w in words]
    assert np.array_equal(bag_min_hash(*shingle_hashes(words), len(words)), alone)


def test_unit_overlap_is_multiset_overlap():
    a, b = "a b c d e a b c d e a b c d e f", "a b c d e a b c d e g"
    assert similarity(unit_hashes(a.encode().split()), unit_hashes(b.encode().split())) == jaccard(shingles(a), shingles(b))


def test_classes_against_brute_force(spark, docs, no_docs):
    rng = random.Random(4)
    rows = [(i, t) for i, t in TEXTS] + [(None, "only once here"), (50, "word"), (51, "one two"), (52, "one  two\n")]
    for g in range(6):
        words = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        for k in range(12):
            own = list(words)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(99)}"
            rows.append((100 + 20 * g + k, " ".join(own)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string")
    got = {(i, c, n) for i, c, n in result(near_duplicates(df.filter("doc_id is not null")))}
    assert got == set(brute([r for r in rows if r[0] is not None]))
    assert near_duplicates(df.filter("doc_id is null")).first() == (None, None, 1)
    assert near_duplicates(no_docs).count() == 0


def test_buckets_with_several_components_are_settled(spark):
    # a chain: each text is near its neighbours only
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 120])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 21)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_query_on_the_given_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op3_near_duplicates(spark, d)) == brute(rows)


def test_hot_buckets_are_split(spark, monkeypatch):
    """Texts that share a passage and little else, near copies of some of them: large open buckets, in blocks of three nodes."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = passage + [f"t{k}w{rng.randrange(999)}" for _ in range(20 + k % 5)]
        rows.append((2 * k, " ".join(own)))
        if k % 3 == 0:
            own[-1] = "changed"
            rows.append((2 * k + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates(df)) == brute(rows)


def test_first_of_classes_keeps_other_columns(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, words(1), "a", 1), (2, words(1) + " end", "b", 2), (3, words(3), None, 3), (3, words(4), "c", 4), (3, words(3), None, 3), (None, words(5), "d", 5), (None, words(4), "e", 6), (7, "", "f", 7), (8, None, "g", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, n int")
    got = first_of_classes(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[5], rows[7]], key=str)
