"""Scoped scans, active snapshots, gates on confidence and role, and small rules on evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import normal_key
from sondage.operators.selection import apart, hold, let


def scope_filter(rows: DataFrame, workspace: str, documents: DataFrame | list | None = None) -> DataFrame:
    """Rows (workspace_id, document_id) of a workspace; of ``documents`` only (ids, or a table of them), unless it is None or an empty list."""
    own = rows.filter(F.col("workspace_id") == workspace)
    if isinstance(documents, DataFrame):
        return own.join(documents.select("document_id"), "document_id", "left_semi")
    return own.filter(F.col("document_id").isin(documents)) if documents else own


def active_only(rows: DataFrame) -> DataFrame:
    return rows.filter("deleted_at is null and active = 1")


def active_snapshot(slides: DataFrame, versions: DataFrame) -> DataFrame:
    """Slides (document_id, parser_run_id) of the run that is active in their document's version."""
    active = versions.select("document_id", F.col("active_parser_run_id").alias("parser_run_id"))
    return slides.join(active, ["document_id", "parser_run_id"], "left_semi")


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Parents with their last child by ``order`` as struct ``latest``, null where they have none."""
    child = F.struct(*(c for c in children.columns if c != key))
    return parents.join(children.groupBy(key).agg(F.max_by(child, F.struct(*order)).alias("latest")), key, "left")


def scopes_exist(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, n_requested, n_found, complete: whether all documents of a request (request_id, workspace_id, document_id) are in its workspace."""
    known = documents.select("workspace_id", "document_id", F.lit(1).alias("known")).distinct()
    rows = requests.select("request_id", "workspace_id", "document_id").distinct().join(known, ["workspace_id", "document_id"], "left")
    counts = rows.groupBy("request_id").agg(F.count("*").alias("n_requested"), F.count("known").alias("n_found"))
    return counts.withColumn("complete", F.col("n_requested") == F.col("n_found"))


def confidence_gate(rows: DataFrame, least: float = 0.65) -> DataFrame:
    """Adds status (accepted or pending) and reliable: numbers read by a visual model never are. An unknown confidence counts as 1; a zero is zero."""
    sure = F.coalesce("confidence", F.lit(1.0)) >= least
    return rows.withColumns({"status": F.when(sure, "accepted").otherwise("pending"), "reliable": sure & ~(F.coalesce(F.col("source_kind") == "visual_model", F.lit(False)) & F.col("numeric"))})


def review_candidates(charts: DataFrame, least: float = 0.85) -> DataFrame:
    """Charts (confidence, n_warnings) to be reviewed, with the reason."""
    reason = F.when(F.col("confidence") < least, "LOW_CHART_CONFIDENCE").when(F.col("n_warnings") > 0, "CHART_WARNING")
    return charts.withColumn("reason", reason).filter("reason is not null")


def role_filter(rows: DataFrame, allowed: list[str] | None = None, excluded: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose role is allowed (any, where none is given) and not excluded; and the numbers of the others by role."""
    role = F.coalesce("role", F.lit(""))
    keep = (role.isin(allowed) if allowed else F.lit(True)) & ~(role.isin(excluded) if excluded else F.lit(False))
    return rows.filter(keep), rows.filter(~keep).groupBy("role").agg(F.count("*").alias("n_rejected"))


def safe_json(text: Column, path: str, default: str) -> Column:
    """The value at ``path``; the default where there is none or the text is no JSON."""
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def hydrate(rows: DataFrame) -> DataFrame:
    """source_kind and confidence from metadata_json, else from the row (source_kind, element_confidence), else native_ooxml and 1. A zero is zero."""
    kind = F.nullif(F.get_json_object("metadata_json", "$.source_kind"), F.lit(""))
    confidence = F.get_json_object("metadata_json", "$.confidence").try_cast("double")
    return rows.withColumns({"source_kind": F.coalesce(kind, F.nullif("source_kind", F.lit("")), F.lit("native_ooxml")), "confidence": F.coalesce(confidence, "element_confidence", F.lit(1.0))})


def validate_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with version, slide and quote, their confidence clamped to 0..1 and defaults set; and the others."""
    needed = ("document_version_id", "slide_id", "quote")
    whole = F.lit(True)
    for name in needed:
        whole = whole & (F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    clean = {"confidence": F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), "source_kind": F.coalesce(F.nullif("source_kind", F.lit("")), F.lit("unknown"))}
    return rows.filter(whole).withColumns(clean), rows.filter(~whole)


def slide_summary(slides: DataFrame, elements: DataFrame, cut: int = 2000) -> DataFrame:
    """slide_id, summary: title and texts of the elements (slide_id, position, text) in order. No element adds more than ``cut`` characters."""
    texts = elements.filter("text <> ''").groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("position", F.substring("text", 1, cut).alias("text"))))["text"].alias("texts"))
    parts = F.concat(F.when(F.col("title") != "", F.array("title")).otherwise(F.array().cast("array<string>")), F.coalesce("texts", F.array().cast("array<string>")))
    return slides.join(texts, "slide_id", "left").select("slide_id", F.substring(F.array_join(parts, " · "), 1, cut).alias("summary"))


def _plain(value: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(value, r"\s+", " ")), 1, most)


def distinct_last(values: DataFrame, by: str, limit: int, item_limit: int) -> DataFrame:
    """by, position, item: of values (by, position, value) each spelling once without regard to case, at its first place and as first spelled; the last ``limit`` of these."""
    items = values.select(by, "position", _plain(F.col("value"), item_limit).alias("item")).filter("item <> ''")
    first = items.groupBy(by, F.lower("item").alias("key")).agg(F.min(F.struct("position", "item")).alias("x")).select(by, "x.*")
    last = Window.partitionBy(by).orderBy(F.desc("position"))
    return first.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= limit).drop("back")


def replace_earlier(objects: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """Of objects (by, position, key, ...) the last of each key, at the place of the first; the last ``limit`` of these."""
    rest = [c for c in objects.columns if c not in (by, "position", key)]
    found = objects.filter(F.col(key) != "").groupBy(by, F.lower(key).alias("_key")).agg(F.min("position").alias("first"), F.max_by(F.struct(key, *rest), "position").alias("x"))
    last = Window.partitionBy(by).orderBy(F.desc("first"))
    return found.withColumn("back", F.row_number().over(last)).filter(F.col("back") <= limit).select(by, F.col("first").alias("position"), "x.*")


def unit_key(unit: Column) -> Column:
    """The unit in normal form; null where it says nothing."""
    key = normal_key(unit)
    return F.when(~key.isin("", "0", "00", "general"), key)  # fixed values


def units_compatible(rows: DataFrame, by: str) -> DataFrame:
    """by, compatible: rows (by, unit) with at most one unit that says something."""
    return rows.groupBy(by).agg((F.count_distinct(unit_key(F.col("unit"))) <= 1).alias("compatible"))


def is_stacked(rows: DataFrame, by: str) -> DataFrame:
    grouping = F.lower(F.get_json_object("visual_json", "$.grouping"))
    return rows.groupBy(by).agg(F.coalesce(F.bool_or(grouping.isin("stacked", "percentstacked")), F.lit(False)).alias("stacked"))


def unit_family(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    money = F.lit(False)
    for marker in ("us$", "usd", "million", "billion", "百万", "十亿", "亿"):  # fixed values
        money = money | low.contains(marker)
    return F.when(low.contains("%") | low.contains("percent"), "percent").when(money, "currency").otherwise("unknown")


def constraint_satisfied(constraint: Column, text: Column) -> Column:
    """Whether a text names the constraint's year, else its quarter in either language, else its words."""
    year = F.regexp_extract(constraint, r"20\d{2}", 0)
    quarter = F.regexp_extract(constraint, r"(?i)Q([1-4])", 1)
    spelled = F.regexp_extract(constraint, r"第([一二三四1-4])季度", 1)

    def named(digit: Column, word: Column) -> Column:
        return F.rlike(text, F.concat(F.lit("(?iU)Q"), digit, F.lit(r"\b|第"), word, F.lit("季度")))

    by_quarter = F.when(quarter != "", named(quarter, F.translate(quarter, "1234", "一二三四"))).when(spelled != "", named(F.translate(spelled, "一二三四", "1234"), spelled))
    return F.when(year != "", F.contains(text, year)).otherwise(F.coalesce(by_quarter, F.contains(F.lower(text), F.lower(constraint))))


def series_places(points: DataFrame) -> DataFrame:
    """series_key, place: points in order within their series (series_id, else element and name), of series with a value."""
    key = F.coalesce(F.nullif(F.col("series_id").cast("string"), F.lit("")), F.concat_ws(":", "element_id", "series_name"))
    rows = points.withColumn("series_key", key)
    own = Window.partitionBy("series_key")
    return rows.withColumns({"n_values": F.count("y_value").over(own), "place": F.row_number().over(own.orderBy(F.coalesce("point_order", F.lit(0))))}).filter("n_values > 0").drop("n_values")


def related_rows(start: DataFrame, chain: list[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Rows that hang on ``start`` by foreign keys: for each (name, table, foreign key, key of the table before) of the chain those that refer to a row found before."""
    found, last = {}, start
    for name, rows, foreign, key in chain:
        last = rows.join(last.select(F.col(key).alias("_key")).distinct(), F.col(foreign) == F.col("_key"), "left_semi")
        found[name] = last
    return found


def document_overview(documents: DataFrame, slides: DataFrame, tasks: DataFrame, versions: DataFrame, order: list[str]) -> DataFrame:
    """Documents with their number of slides, of pending reviews, and their latest version."""
    n = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
    rows = latest_child(documents, versions, "document_id", order).join(n(slides, "n_slides"), "document_id", "left").join(n(tasks, "n_pending"), "document_id", "left")
    return rows.fillna(0, ["n_slides", "n_pending"])


def enrich_citations(citations: DataFrame, versions: DataFrame, documents: DataFrame, elements: DataFrame) -> DataFrame:
    """Citations (version_id, element_id, ordinal) with label, document and, where they have one, element."""
    rows = citations.join(versions, "version_id").join(documents, "document_id").join(elements, "element_id", "left")
    return rows.withColumn("label", F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]")))


def overlap_terms(text: Column) -> Column:
    """Distinct terms for the comparison of chunks: ASCII words of two characters or more, and pairs of neighbouring CJK characters."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"[a-z0-9%_.\-]{2,}"), F.lit(0)), pairs))


#: Sets of one home that a task compares with as many others. A set of a large home is sent once for each of its blocks.
_BLOCK = 1024
#: Terms are ordered by the number of rows in one of so many buckets of their hashes, which are broadcast.
_BUCKETS = 1 << 20


def _signature(terms: Column, n: Column) -> Column:
    """The parity of the terms' hashes in 64-bit words, about a bit for each term: two sets differ in at least as many terms as their signatures in bits."""
    words = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(4.0), n * 0.75 / 64)))).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND((words - 1).cast("long"))
    parity = lambda hs, i: F.aggregate(F.filter(hs, lambda h: word(h) == i), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h)))
    return let(F.transform(terms, lambda t: F.xxhash64(t)), lambda hs: F.transform(F.sequence(F.lit(0), words - 1), lambda i: parity(hs, i)))


def _may_link(percent: int) -> Column:
    """Whether the sizes and signatures of a and b leave room for ``percent`` % in common. Sizes that do are of one number of words, or the longer signature is folded once."""
    x, y = F.col("sig_a"), F.col("sig_b")
    folded = lambda v: F.zip_with(F.slice(v, 1, (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    bits = F.aggregate(F.zip_with(F.when(F.size(x) > F.size(y), folded(x)).otherwise(x), F.when(F.size(y) > F.size(x), folded(y)).otherwise(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, k: acc + k)
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return F.when(100 * least >= percent * most, 100 * (least + most - bits) >= 2 * percent * most).otherwise(False)


def near_duplicate_chunks(rows: DataFrame, percent: int = 88) -> DataFrame:
    """id, set_id, n_links of rows (id, text) with terms: set_id is the least id with the same terms, n_links the number of other sets of terms that share ``percent`` % of the larger one's.

    Exact: sets that share so many terms share one of the first n - ceil(n * percent / 100) + 1 in any common order; terms are ordered by the number of terms of all rows in their bucket, rare ones first, so that few pairs meet that are no links. Rows with the same terms are one set. The home of a set is that of its first terms that most others have among theirs: sets of one home are compared where they meet, in blocks, so that the pairs of a large group of copies are never rows of a shuffle. Where the signatures of sets of two homes leave room for a link, these sets are sent to the two homes, and compared there in blocks too.
    """
    own = rows.select("id", F.array_sort(overlap_terms(F.col("text"))).alias("terms")).filter("size(terms) > 0").withColumn("digest", F.sha2(F.array_join("terms", " "), 256))
    least = own.groupBy("digest").agg(F.min("id").alias("set_id"))
    # the terms are dealt by id once; what is joined or ranked by set_id then stays where they are
    firsts = least.groupBy("set_id").agg(F.collect_list("digest").alias("digests"))
    dealt = own.repartition("id").groupBy("id", "digest").agg(F.first("terms").alias("terms")).withColumnRenamed("id", "set_id")
    sets = dealt.join(apart(firsts), "set_id").filter(F.array_contains("digests", F.col("digest"))).select("set_id", "terms", F.size("terms").alias("n"))
    spread = sets.select("set_id", "n", F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("key"))
    spread = spread.withColumn("bucket", F.pmod("key", F.lit(_BUCKETS)))
    # of as many rows as there are buckets at most
    often = F.broadcast(own.select(F.explode(F.transform("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(_BUCKETS)))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("df")))
    ranked = spread.join(often, "bucket")
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("df", "key"))
    heads = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("key", "set_id", "place")
    common = heads.withColumn("met", F.count("*").over(Window.partitionBy("key"))).filter("met > 1")
    homes = common.groupBy("set_id").agg(F.max(F.struct("met", "key"))["key"].alias("home"))
    homes = homes.withColumn("of_home", F.count("*").over(Window.partitionBy("home")))
    housed = hold(sets.join(apart(homes), "set_id"), sig=_signature(F.col("terms"), F.col("n")))

    def side(df: DataFrame, name: str, *shared: str) -> DataFrame:
        return df.select(*shared, *(F.col(c).alias(name if c == "set_id" else f"{c}_{name}") for c in df.columns if c not in shared))

    # pairs of one home, in pairs of blocks
    blocks = F.ceil(F.col("of_home") / _BLOCK)
    dealt = housed.filter("of_home > 1").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("home", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set_id", "n", "sig", "terms")
    spot = ["home", "low", "high"]
    met = side(dealt, "a", *spot).join(apart(side(dealt, "b", *spot)), spot).filter((F.col("a") < F.col("b")) & ((F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b"))) & _may_link(percent))
    # pairs of two homes
    keyed = common.join(apart(housed.select("set_id", "n", "home", "sig")), "set_id")
    left = lambda x: F.col(f"n_{x}") - F.col(f"place_{x}")
    fits = F.when(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"), True).otherwise(False)
    pairs = side(keyed, "a", "key").join(apart(side(keyed, "b", "key")), "key").filter((F.col("home_a") < F.col("home_b")) & (100 * (F.least(left("a"), left("b")) + 1) >= percent * F.greatest("n_a", "n_b")) & _may_link(percent))
    # the sets that meet are sent to their two homes' pairs of blocks, no pair is
    members = F.explode(F.array(F.struct(F.lit(False).alias("upper"), F.col("a").alias("set_id")), F.struct(F.lit(True).alias("upper"), F.col("b").alias("set_id"))))
    members = pairs.select("home_a", "home_b", members.alias("x")).select("home_a", "home_b", "x.*").distinct()
    parts = {x: F.ceil(F.count_if(F.col("upper") == F.lit(x)).over(Window.partitionBy("home_a", "home_b")) / _BLOCK) for x in (False, True)}
    members = members.withColumns({"own": F.when(F.col("upper"), parts[True]).otherwise(parts[False]), "others": F.when(F.col("upper"), parts[False]).otherwise(parts[True])})
    members = members.withColumn("block", F.pmod(F.xxhash64("set_id"), "own")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    members = members.withColumns({"low": F.when(F.col("upper"), F.col("other")).otherwise(F.col("block")), "high": F.when(F.col("upper"), F.col("block")).otherwise(F.col("other"))})
    spot = ["home_a", "home_b", "low", "high"]
    sent = members.select(*spot, "upper", "set_id").join(apart(sets), "set_id")
    apart_ = side(sent.filter(~F.col("upper")).drop("upper"), "a", *spot).join(apart(side(sent.filter("upper").drop("upper"), "b", *spot)), spot).filter(fits).select("a", "b", "terms_a", "terms_b")
    shared = F.size(F.array_intersect("terms_a", "terms_b"))
    checked = met.select("a", "b", "terms_a", "terms_b").unionByName(apart_)
    links = checked.filter(100 * shared >= percent * F.greatest(F.size("terms_a"), F.size("terms_b")))
    n_links = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    named = own.select("id", "digest").join(least, "digest").select("id", "set_id")
    return named.join(n_links, "set_id", "left").select("id", "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
