"""Scopes, snapshots and evidence rules: customers stand for documents, orders for their versions, order lines for slides, events for elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators import scope
from sondage.sources.bindings import QUARTERLY_SQL, quarterly_points, table

from .registry import query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("workspace_id"), F.col("doc_id").alias("document_id"), "source", "text")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))


@query("SELECT doc_id AS document_id, source FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM labels)")
def f1_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one workspace, the documents with labels."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return scope.scope_filter(_documents(spark, sf_dir).drop("text"), "en", wanted).select("document_id", "source")


@query("SELECT o_custkey AS document_id, o_orderkey AS version_id FROM orders WHERE o_orderstatus = 'O'")
def f2_active_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders are active, those in processing deleted."""
    rows = _versions(spark, sf_dir).withColumns({"active": (F.col("status") != "F").cast("int"), "deleted_at": F.when(F.col("status") == "P", F.col("created_at"))})
    return scope.active_only(rows).select("document_id", "version_id")


_LATEST = "v AS (SELECT o_custkey AS document_id, max(struct_pack(a := o_orderdate, b := o_orderkey)) AS x FROM orders GROUP BY 1)"


@query(f"WITH {_LATEST} SELECT o_custkey AS document_id, l_orderkey AS parser_run_id, l_linenumber AS slide_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v ON v.document_id = o_custkey AND x.b = l_orderkey")
def j1_active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each customer's latest order."""
    versions = _versions(spark, sf_dir)
    slides = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parser_run_id"), F.col("l_linenumber").alias("slide_no"))
    slides = slides.join(versions.select("document_id", F.col("version_id").alias("parser_run_id")), "parser_run_id")
    active = versions.groupBy("document_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("active_parser_run_id"))
    return scope.active_snapshot(slides, active).select("document_id", "parser_run_id", "slide_no")


@query(f"WITH {_LATEST} SELECT c_custkey AS document_id, x.b AS version_id FROM customer LEFT JOIN v ON document_id = c_custkey")
def j5_latest_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    found = scope.latest_child(documents, _versions(spark, sf_dir), "document_id", ["created_at", "version_id"])
    return found.select("document_id", F.col("latest.version_id").alias("version_id"))


@query("SELECT source AS request_id, count(*) AS n_requested, count(*) FILTER (lang = 'en') AS n_found, count(*) = count(*) FILTER (lang = 'en') AS complete FROM documents GROUP BY 1")
def j4_scopes_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source asks for its documents in one workspace."""
    documents = _documents(spark, sf_dir)
    return scope.scopes_exist(documents.select(F.col("source").alias("request_id"), F.lit("en").alias("workspace_id"), "document_id"), documents)


@query("""SELECT CASE WHEN l_discount * 10 >= 0.65 THEN 'accepted' ELSE 'pending' END AS status, l_discount * 10 >= 0.65 AND NOT (l_returnflag = 'R' AND l_linestatus = 'F') AS reliable, count(*) AS n FROM lineitem GROUP BY ALL""")
def f4_confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_returnflag") == "R", "visual_model").otherwise("native_ooxml").alias("source_kind"), (F.col("l_linestatus") == "F").alias("numeric"))
    return scope.confidence_gate(rows).groupBy("status", "reliable").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS slide_id, l_linenumber AS element_id, CASE WHEN l_discount * 10 < 0.85 THEN 'LOW_CHART_CONFIDENCE' ELSE 'CHART_WARNING' END AS reason FROM lineitem WHERE l_discount * 10 < 0.85 OR l_returnflag = 'R'""")
def f5_review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("element_id"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").cast("int").alias("n_warnings"))
    return scope.review_candidates(rows).select("slide_id", "element_id", "reason")


@query("SELECT role, count(*) AS n_rejected FROM conversations WHERE role <> 'user' GROUP BY 1")
def f6_role_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.role_filter(table(spark, sf_dir, "conversations").select("role"), ["user"])[1]


@query(r"""SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) END AS k FROM events""")
def x20_safe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of errors are no JSON here."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", scope.safe_json(text, "$.k", "-1").cast("int").alias("k"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'visual_model' WHEN event_type = 'error' THEN 'native_ooxml' ELSE event_type END AS source_kind, CASE WHEN event_type = 'view' THEN 0.5 ELSE value END::DOUBLE AS confidence FROM events""")
def f10_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views have metadata, errors broken ones and no kind of their own."""
    kind = F.col("event_type")
    metadata = F.when(kind == "view", '{"source_kind": "visual_model", "confidence": 0.5}').when(kind == "error", '{"source_kind": ').otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", metadata.alias("metadata_json"), F.when(kind != "error", kind).otherwise("").alias("source_kind"), F.col("value").alias("element_confidence"))
    return scope.hydrate(rows).select("event_id", "source_kind", "confidence")


@query("SELECT l_orderkey AS slide_id, l_linenumber AS element_id, least(1.0, greatest(0.0, l_quantity / 25 - 0.5))::DOUBLE AS confidence, 'unknown' AS source_kind FROM lineitem WHERE l_returnflag <> 'N'")
def f12_validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were not returned have no quote."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_version_id"), F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").alias("element_id"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("quote"), (F.col("l_quantity") / 25 - 0.5).alias("confidence"), F.lit("").alias("source_kind"))
    return scope.validate_evidence(rows)[0].select("slide_id", "element_id", "confidence", "source_kind")


@query("""WITH c AS (SELECT conv_id, string_agg(left(text, 2000), ' · ' ORDER BY turn) FILTER (text <> '') AS t FROM conversations GROUP BY 1)
SELECT conv_id AS slide_id, md5(left(concat('Conversation ', conv_id, COALESCE(' · ' || t, '')), 2000)) AS summary_md5 FROM c""")
def a24_slide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("slide_id"), F.col("turn").alias("position"), "text")
    slides = elements.select("slide_id").distinct().withColumn("title", F.concat(F.lit("Conversation "), F.col("slide_id").cast("string")))
    return scope.slide_summary(slides, elements).select("slide_id", F.md5("summary").alias("summary_md5"))


@query(r"""WITH v AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
i AS (SELECT conv_id, turn * 1000000 + k AS position, left(trim(regexp_replace(w[k], '\s+', ' ', 'g')), 12) AS item FROM v, unnest(range(1, len(w) + 1)) AS u(k)),
f AS (SELECT conv_id, min(position) AS position, arg_min(item, position) AS item FROM i WHERE item <> '' GROUP BY conv_id, lower(item))
SELECT conv_id, position, item FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY position DESC) <= 20""")
def d2_distinct_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 new words of each conversation."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("k", "value"))
    return scope.distinct_last(words.select("conv_id", (F.col("turn") * 1000000 + F.col("k") + 1).alias("position"), "value"), "conv_id", 20, 12)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS position, arg_max(value, event_id) AS value FROM events GROUP BY ALL)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY position DESC) <= 3""")
def d3_replace_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), "event_type", "value")
    return scope.replace_earlier(rows, "user_id", "event_type", 3)


@query("""SELECT o_custkey AS scope_id, count(DISTINCT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END) <= 1 AS compatible FROM orders GROUP BY 1""")
def c8_units_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities stand for units; orders in processing have the format General."""
    unit = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("General")
    return scope.units_compatible(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope_id"), unit.alias("unit")), "scope_id")


@query("SELECT l_orderkey AS element_id, bool_or(l_returnflag = 'R') AS stacked FROM lineitem GROUP BY 1")
def c7_is_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "percentStacked").otherwise("clustered")
    return scope.is_stacked(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.to_json(F.struct(kind.alias("grouping"))).alias("visual_json")), "element_id")


@query("""WITH t AS (SELECT doc_id, lower(COALESCE(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '%|percent') THEN 'percent' WHEN regexp_matches(t, 'us\\$|usd|million|billion|百万|十亿|亿') THEN 'currency' ELSE 'unknown' END AS family FROM t""")
def x_unit_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scope.unit_family(F.col("text")).alias("family"))


_ASKED = ("FY2024", "Q3", "第二季度", "License")


@query(r"""SELECT doc_id, c AS constraint_text, CASE c WHEN 'FY2024' THEN contains(text, '2024') WHEN 'Q3' THEN regexp_matches(text, '(?i)Q3\b|第三季度') WHEN '第二季度' THEN regexp_matches(text, '(?i)Q2\b|第二季度') ELSE contains(lower(text), 'license') END AS satisfied
FROM documents, unnest(['FY2024', 'Q3', '第二季度', 'License']) AS u(c)""")
def f9_constraint_satisfied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*map(F.lit, _ASKED))).alias("constraint_text"))
    return rows.select("doc_id", "constraint_text", scope.constraint_satisfied(F.col("constraint_text"), F.col("text")).alias("satisfied"))


@query(f"WITH {QUARTERLY_SQL} SELECT concat(scope_id, ':', series_name) AS series_key, category, CAST(row_number() OVER (PARTITION BY scope_id, series_name ORDER BY point_order) AS INTEGER) AS place FROM points")
def c1_series_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = quarterly_points(spark, sf_dir).withColumnRenamed("scope_id", "element_id").withColumn("series_id", F.lit(None).cast("string"))
    return scope.series_places(points).select("series_key", "category", "place")


@query("""WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c))
SELECT 'nation' AS table_name, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT * FROM o)""")
def j15_related_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on a region, table by table."""
    t = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    chain = [("nation", t("nation", "n_nationkey", "n_regionkey"), "n_regionkey", "r_regionkey"), ("customer", t("customer", "c_custkey", "c_nationkey"), "c_nationkey", "n_nationkey"), ("orders", t("orders", "o_orderkey", "o_custkey"), "o_custkey", "c_custkey"), ("lineitem", t("lineitem", "l_orderkey"), "l_orderkey", "o_orderkey")]
    found = scope.related_rows(table(spark, sf_dir, "region").filter("r_name = 'ASIA'"), chain)
    counts = [rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, rows in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"""WITH {_LATEST}, o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS document_id, COALESCE(l.n, 0) AS n_slides, COALESCE(p, 0) AS n_pending, x.b AS version_id FROM customer LEFT JOIN v ON document_id = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""")
def a6_document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    slides = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id")).join(versions.select("version_id", "document_id"), "version_id")
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    found = scope.document_overview(documents, slides, versions.filter("status = 'P'"), versions, ["created_at", "version_id"])
    return found.select("document_id", "n_slides", "n_pending", F.col("latest.version_id").alias("version_id"))


@query("""SELECT l_orderkey AS version_id, concat('[', l_linenumber, ']') AS label, c_name AS document, p_name AS element FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey""")
def j19_enrich_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("element_id"), F.col("l_linenumber").alias("ordinal"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("document"))
    elements = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.col("p_name").alias("element"))
    return scope.enrich_citations(citations, _versions(spark, sf_dir).select("version_id", "document_id"), documents, elements).select("version_id", "label", "document", "element")


#: The shared texts hold no CJK characters, whose pairs are left out here.
@query(r"""WITH t AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9%_.\-]{2,}'))) AS terms FROM documents),
s AS (SELECT min(id) AS set_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0 GROUP BY terms),
e AS (SELECT set_id, n, unnest(terms) AS term FROM s),
p AS (SELECT a.set_id AS a, b.set_id AS b FROM e a JOIN e b ON a.term = b.term AND a.set_id <> b.set_id AND 100 * least(a.n, b.n) >= 88 * greatest(a.n, b.n) GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 100 * count(*) >= 88 * greatest(a.n, b.n)),
l AS (SELECT a AS set_id, count(*) AS n_links FROM p GROUP BY 1)
SELECT id, s.set_id, COALESCE(n_links, 0) AS n_links FROM t JOIN s ON t.terms = s.terms LEFT JOIN l ON s.set_id = l.set_id""")
def j11_near_duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.near_duplicate_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
