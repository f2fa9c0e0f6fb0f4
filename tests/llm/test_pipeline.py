import corpus_pipeline as p

from .test_decontaminate import brute as hits
from .test_near_dup import brute as classes
from .test_secret_scan import brute as secrets

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = p.quality_classifier(spark, docs, D)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    one = p.minhash_near_dedup(spark, docs, D)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c, _ in classes(rows)})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = p.benchmark_decontamination(spark, docs, D)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in rows if not hits(t, items)[-1])
    safe = {r.doc_id: r for r in p.secret_scans(spark, docs, D).collect()}
    assert len(safe) == len(rows)
    for i, t in rows:
        spans, at, out = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in secrets(t)[-1])), 0, ""
        for a, b in spans:
            if a >= at:
                out += t[at:a] + p.MARK
            at = max(at, b)
        assert safe[i].text == out + t[at:] and safe[i].n_chars == len(safe[i].text)
    assert p.best_fit_packing(spark, docs, D).columns[:2] == ["doc_id", "piece"]


def test_run(spark):
    rows = p.run(spark, D)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert 0 < rows.select("doc_id").distinct().count() < docs.count()


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    twice = docs.union(docs)
    assert p.minhash_near_dedup(spark, twice, D).count() == p.minhash_near_dedup(spark, docs, D).count()
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0


def test_null_and_equal_ids_with_different_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4)), (9, text(5)), (None, text(5)), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in p.minhash_near_dedup(spark, docs, D).collect()]
    assert sorted((r for r in got if r[1]), key=str) == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5))], key=str)
    assert len(got) == 6
