import random
import re

import pytest

from sondage.llm import queries
from sondage.llm.decontaminate import words_of
from sondage.llm.license_scan import BASE, TEMPLATES, SuffixAutomaton, _chain, Match, scan_licences

from .conftest import TEXTS
from .test_decontaminate import plain_words


def brute_base(text):
    words, hits = plain_words(text), []
    for phrase, label in BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    hits.sort()
    return len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits}))


def base_of(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def longest_ends(sequences, words):
    """Matching statistics by trying all passages."""
    passages = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    return [max((k for k in range(1, e + 1) if tuple(words[e - k : e]) in passages), default=0) for e in range(1, len(words) + 1)]


def test_matches_and_places_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        words = [rng.randrange(4) for _ in range(60)]
        automaton, length = SuffixAutomaton(sequences), [*longest_ends(sequences, words), 0]
        want = [(e + 1 - n, e + 1) for e, n in enumerate(length[:-1]) if n >= 2 and length[e + 1] <= n]
        got = list(automaton.maximal_matches(words, 2))
        assert [(a, b) for a, b, _ in got] == want
        for a, b, state in got:
            where = {(k, i + b - a - 1) for k, s in enumerate(sequences) for i in range(len(s) - (b - a) + 1) if s[i : i + b - a] == words[a:b]}
            assert set(automaton.places(state)) == where


def test_chains_keep_order_and_gaps():
    near = [Match(0, 5, 0), Match(7, 12, 6), Match(100, 105, 12)]
    assert sorted(_chain(near, 20, 10)) == [(0, 12, 10), (100, 105, 5)]
    assert sorted(_chain([Match(0, 5, 10), Match(6, 11, 0)], 20, 10)) == [(0, 5, 5), (6, 11, 5)]  # not in the template's order
    assert sorted(_chain([Match(0, 5, 0), Match(4, 9, 5)], 20, 10)) == [(0, 9, 9)]  # the overlap counts once


def test_edge_cases(spark, docs, no_docs):
    got = sorted(((r.doc_id, *base_of(r), r.labels, r.score) for r in scan_licences(docs).collect()), key=str)
    assert got == sorted(((i, *brute_base(t), "", 0.0) for i, t in TEXTS), key=str)
    assert scan_licences(no_docs).count() == 0
    # without templates only base phrases are found
    row = scan_licences(spark.createDataFrame([(1, "The MIT License")], "doc_id long, text string"), ()).first()
    assert (row.labels, row.score, row.n_base) == ("mit", 0.0, 1)
    with pytest.raises(ValueError):
        scan_licences(docs, most_words=3)


def test_changed_templates_are_found(spark):
    filler = " ".join(f"filler{i}" for i in range(50))
    rows, want = [], []
    for k, (label, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 40:
            words[20] = "changed"
            del words[30]
        rows.append((k, f"{filler} {' '.join(words).upper()} {filler}", "clash"))
        want.append((k, label, 50))
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    for k, label, begin in want:
        row = next(r for r in got if r.doc_id == k)
        assert label in row.labels.split(",") and row.score >= 0.75
        assert any(s.label == label and abs(s.begin - begin) <= 4 for s in row.spans), (label, row.spans)
    # half a template is no span; words in another order neither
    mit = TEMPLATES[1][1].split()
    none = scan_licences(spark.createDataFrame([(1, " ".join(mit[: len(mit) // 2])), (2, " ".join(mit[::-1]))], "doc_id long, text string"))
    assert {r.labels for r in none.collect()} == {""}


def test_long_text(spark):
    text = " ".join([TEMPLATES[2][1]] * 3000 + ["the"] * 200_000)
    row = scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.labels) == (3000, 3, 8 * 2999 + 3, "Apache-2.0,apache") and len(row.spans) == 3000


def test_query_on_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_license_scans(spark, d).collect()
    notices = {"MIT": "released under the mit license", "Apache-2.0": "licensed under the apache license version 2 0", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": "licensed under cc by nc 4 0"}
    assert len(got) == len(docs)
    for r in got:
        assert base_of(r) == brute_base(docs[r.doc_id])
        folded = " " + " ".join(plain_words(docs[r.doc_id])) + " "
        assert {x for x, notice in notices.items() if f" {notice} " in folded} <= set(r.labels.split(","))
        assert (r.score > 0) == bool(r.spans) and not re.search("[^0-9A-Za-z.,:-]", r.spans)
    assert sum(r.score == 1.0 for r in got) > 10


def test_words():
    assert words_of("A-b 9") == [b"a", b"b", b"9"]
