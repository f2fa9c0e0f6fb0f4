"""The thin queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules

    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("word_bpe_49k.json")).drop("ids")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_benchmark

    return find_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_ids")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import classify

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


#: Fixed values of the contract.
URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import Rule, judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), [Rule(*r) for r in URL_RULES])


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json")).drop("ids")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licences

    found = scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["begin"], s["end"])), ","))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import collapse_runs

    return collapse_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True, texts=False).drop("runs", "collapsed")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives, whole_numbers

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.select("vec_id", changed.alias("label"), whole_numbers(vectors, "embedding", 256).alias("v")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name, in the order of their numbers."""
    found = [v for k, v in globals().items() if k.startswith("op")]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return ORACLES


ORACLES: dict[str, str] = {}

ORACLES["op8_warc_revisits"] = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

#: Base counts, then cutoffs as in quality_rules: strata are languages, 0.02 / 5 the risk of a feature, 0.05 / (5 * strata) its level.
ORACLES["op1_quality_rules"] = r"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS stratum, COALESCE(text, '') AS text, list_filter(regexp_split_to_array(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM d, unnest(range(1, len(words) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
b AS (SELECT d.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words, len(list_distinct(words)) AS n_distinct, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, COALESCE(1000 * n_symbols // NULLIF(word_chars, 0), 0) AS symbol_rate, COALESCE(1000 * n_dup_lines // NULLIF(n_lines, 0), 0) AS dup_line_rate,
  COALESCE(1000 * n_repeat_words // NULLIF(n_words, 0), 0) AS repeat_rate, COALESCE(1000 * (n_words - n_distinct) // NULLIF(n_words, 0), 0) AS same_word_rate, COALESCE(1000 * n_upper // NULLIF(word_chars, 0), 0) AS upper_rate FROM b),
l AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT f.*, good FROM f JOIN l ON f.doc_id = l.doc_id WHERE NOT base_failed),
u AS (UNPIVOT (SELECT stratum, good, symbol_rate, dup_line_rate, repeat_rate, same_word_rate, upper_rate FROM h) ON symbol_rate, dup_line_rate, repeat_rate, same_word_rate, upper_rate INTO NAME feature VALUE v),
n AS (SELECT stratum, feature, CAST(ceil(least(v, 1000) / 10.0) * 10 - 10 AS BIGINT) AS cutoff, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM u GROUP BY ALL),
s AS (SELECT stratum, feature, cutoff, CAST(sum(good) OVER a AS BIGINT) AS k, CAST(sum(bad) OVER a AS BIGINT) AS caught, CAST(sum(good) OVER (PARTITION BY stratum, feature) AS BIGINT) AS n FROM n WINDOW a AS (PARTITION BY stratum, feature ORDER BY cutoff DESC)),
q AS (SELECT * FROM s WHERE cutoff >= 0 AND caught > 0 AND n > 0 AND k <= floor(n * 0.004)
  AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.004) + (n - j) * ln(0.996)))) <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM h))),
p AS (SELECT stratum, feature, cutoff FROM q QUALIFY row_number() OVER (PARTITION BY stratum, feature ORDER BY caught DESC, cutoff DESC) = 1),
x AS (SELECT f.*, concat_ws(',', CASE WHEN symbol_rate > (SELECT cutoff FROM p WHERE p.stratum = f.stratum AND feature = 'symbol_rate') THEN 'symbol_rate' END, CASE WHEN dup_line_rate > (SELECT cutoff FROM p WHERE p.stratum = f.stratum AND feature = 'dup_line_rate') THEN 'dup_line_rate' END,
  CASE WHEN repeat_rate > (SELECT cutoff FROM p WHERE p.stratum = f.stratum AND feature = 'repeat_rate') THEN 'repeat_rate' END, CASE WHEN same_word_rate > (SELECT cutoff FROM p WHERE p.stratum = f.stratum AND feature = 'same_word_rate') THEN 'same_word_rate' END,
  CASE WHEN upper_rate > (SELECT cutoff FROM p WHERE p.stratum = f.stratum AND feature = 'upper_rate') THEN 'upper_rate' END) AS rejected_by FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM x
"""

_LOWER = "translate(COALESCE({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Items' windows are joined to the documents' windows of the same number of words.
ORACLES["op4_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format("text")} AS w FROM documents),
b AS (SELECT COALESCE(CAST(item_id AS VARCHAR), 'null') AS item_id, {_FOLDED.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS passage FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
s AS (SELECT r, w, n FROM d, (SELECT DISTINCT n FROM g)),
v AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage FROM s, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT r, v.n, i, item_id FROM v JOIN g ON v.n = g.n AND v.passage = g.passage),
c AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, n, i FROM h), unnest(range(0, n)) AS u(k) GROUP BY r),
o AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN o ON d.r = o.r
"""

#: Nodes are texts with the same words; all pairs that share a shingle are compared, and labels spread along the links.
ORACLES["op3_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT row_number() OVER () AS node, * FROM (SELECT w, min(doc_id) AS first_id, count(*) AS n FROM d GROUP BY w)),
s AS (SELECT node, array_to_string(w[i:i + 4], ' ') AS shingle, count(*) AS c FROM n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0 GROUP BY ALL),
z AS (SELECT node, sum(c) AS size FROM s GROUP BY node),
p AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS n_both FROM s x JOIN s y ON x.shingle = y.shingle AND x.node < y.node GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN z za ON za.node = a JOIN z zb ON zb.node = b WHERE 10 * n_both >= 8 * (za.size + zb.size - n_both)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
reach AS (SELECT node, node AS label FROM n UNION SELECT l.b, reach.label FROM reach JOIN l ON l.a = reach.node WHERE reach.label < l.b),
m AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
c AS (SELECT label, min(first_id) AS class_id, CAST(sum(n) AS BIGINT) AS class_rows FROM n JOIN m ON n.node = m.node GROUP BY label)
SELECT doc_id, class_id, class_rows FROM d JOIN n ON d.w = n.w JOIN m ON n.node = m.node JOIN c ON m.label = c.label
"""

#: Bytes are pairs of hex digits; texts are cut into parts of 256 starts first, since a place in a long text is slow to find.
ORACLES["op7_repeated_passages"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
q AS (SELECT r, doc_id, k, substr(x, k * 512 + 1, 610) AS part FROM d, unnest(range(0, length(x) // 512 + 1)) AS u(k)),
s AS (SELECT r, doc_id, k * 256 + i AS i, substr(part, i * 2 + 1, 100) AS g FROM q, unnest(range(0, least(256, length(part) // 2 - 49))) AS u(i)),
f AS (SELECT g, min(doc_id) AS first_id FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
m AS (SELECT r, i FROM s JOIN f ON s.g = f.g WHERE first_id < doc_id),
e AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM m),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM e),
c AS (SELECT r, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, run),
p AS (SELECT r, COALESCE(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM c UNION ALL SELECT r, max(b), NULL FROM c GROUP BY r),
k AS (SELECT r, string_agg(substr(x, p.a * 2 + 1, COALESCE(2 * (p.b - p.a), length(x))), '' ORDER BY p.a, p.b NULLS LAST) AS kept FROM p JOIN d USING (r) GROUP BY r),
o AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM c GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, COALESCE(n_removed, 0) AS n_removed, COALESCE(n_spans, 0) AS n_spans, sha256(unhex(COALESCE(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN o ON d.r = o.r
"""

#: All anchors against all rows; a row's place among those of its anchor, label side and window.
ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""

_CRC32 = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

#: Passages of six words that are p words apart, place after place, make a run; of equal stretches the smallest period counts.
ORACLES["op12_periodic_runs"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS o, {_CRC32} AS h FROM documents),
a AS (SELECT *, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
g AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS g FROM w, unnest(range(0, n - 5)) AS u(i)),
e AS (SELECT x.r, x.i, y.i - x.i AS p FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
s AS (SELECT r, p, min(i) AS start, count(*) + 5 + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM e) GROUP BY r, p, k),
q AS (SELECT r, start, length, min(p) AS period FROM s WHERE length >= greatest(12, 2 * p) GROUP BY r, start, length),
t AS (SELECT r, count(*) AS n_runs, arg_max({{'start': start, 'length': length, 'period': period}}, length::HUGEINT * 1000000000000 - start * 1000000 - period) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM q GROUP BY r),
x AS (SELECT DISTINCT r, i FROM q, unnest(range(start + period, start + length)) AS u(i)),
c AS (SELECT r, array_to_string(list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') AS kept FROM w JOIN (SELECT r, list(i) AS gone FROM x GROUP BY r) USING (r))
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli, sha256(COALESCE(runs, '')) AS runs_sha256, sha256(COALESCE(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM w LEFT JOIN t USING (r) LEFT JOIN c USING (r)
"""
