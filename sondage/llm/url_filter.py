"""URL verdicts: host and path rules, else trust and distrust that spread over a graph of hosts.

Edges are the links between pages of different hosts, and one each way between a host and the domain above it (of two labels at least), since who runs one runs the other. Trust is personalised PageRank from trusted hosts along edges; distrust is the same from blocked hosts against the edges' direction (who links to a blocked host is suspect). Both run as joins and sums over host edges, and count pages: where no seeds are given, each page that rules block is distrust of its host, and each other page trust. A host is blocked where distrust makes up more than ``threshold`` of the two.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute and protocol-relative targets of href and src; group 1 is the host.
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: So many rules at most become part of an expression; more are joined by host.
_IN_EXPRESSION = 500


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested last, outermost
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _domains(host: Column) -> Column:
    """The host, and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def settled(rules: list[Rule]) -> list[Rule]:
    """Each host and path once: of rules that contradict each other, the one that blocks."""
    found: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if r.verdict == "block" or (r.host, r.path) not in found:
            found[r.host, r.path] = r
    return list(found.values())


def with_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (host, path) with ``found``, as in ``rule_column``. Of rules with one host and path, one that blocks stands. Many rules are collected for each host that they fit, and tested against its paths."""
    rules = settled(rules)
    if len(rules) <= _IN_EXPRESSION:
        return rows.withColumn("found", rule_column(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "of string, path string, rule string, verdict string")
    hosts = rows.select("host").distinct().withColumn("of", F.explode(_domains(F.col("host"))))
    own = hosts.join(table, "of").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "verdict", "path")).alias("own"))
    best = F.array_max(F.filter("own", lambda r: F.col("path").startswith(r["path"])))
    return rows.join(own, "host", "left").withColumn("best", best).withColumn("found", F.when(F.col("best").isNotNull(), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))).drop("own", "best")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links from pages of one host to another host."""
    linked = pages.select(url_host(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("dst"))
    linked = linked.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return linked.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """src, dst, n: each host and domain of ``hosts`` (host) and the domain above it, both ways; top-level domains are left out."""
    chain = F.filter(_domains(F.col("host")), lambda d: d.contains("."))
    pairs = hosts.select(chain.alias("c")).select(F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("src"), F.slice("c", 2, F.size("c")).alias("dst"))).alias("p")).select("p.src", "p.dst").distinct()
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4, cut_every: int = 4) -> DataFrame:
    """graph, host, score: ``personalised_pagerank`` of several graphs at once; edges and seeds have a column graph. The scores are written every ``cut_every`` rounds, and there compared with those of the round before."""
    whole = seeds.groupBy("graph").agg(F.sum("weight").alias("whole"))
    start = materialize(seeds.join(whole, "graph").select("graph", "host", ((1 - damping) * F.col("weight") / F.col("whole")).alias("score")), "seeds")
    out = edges.groupBy("graph", "src").agg(F.sum("n").alias("out"))
    shares = materialize(edges.join(out, ["graph", "src"]).select("graph", F.col("src").alias("host"), "dst", (damping * F.col("n") / F.col("out")).alias("share")), "link-shares")
    scores, last = start, None
    for k in itertools.count(1) if rounds is None else range(1, rounds + 1):
        moved = scores.join(shares, ["graph", "host"]).select("graph", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        cut = k % cut_every == 0 or k == rounds
        if not cut:
            scores = start.unionByName(moved).groupBy("graph", "host").agg(F.sum("score").alias("score"))
            continue
        rows = start.unionByName(moved).withColumn("before", F.lit(0.0)).unionByName(scores.select("graph", "host", F.lit(0.0).alias("score"), F.col("score").alias("before")))
        kept = materialize(rows.groupBy("graph", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "scores")
        if last is not None:
            release(last)
        last, scores = kept, kept.select("graph", "host", "score")
        if rounds is None and (kept.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return scores


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """host, score after ``rounds`` steps, or where they are not given, as many as it takes until all scores together change by less than ``tolerance``, of score = (1 - damping) * seed + damping * sum over in-links of the source's score by link share.

    seeds: host, weight (any positive scale; normalised to sum 1). Mass at hosts without links is not passed on.
    """
    one = F.lit("one")
    return propagate(edges.withColumn("graph", one), seeds.select("host", "weight").withColumn("graph", one), **options).select("host", "score")


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trusted: DataFrame | None = None, blocked: DataFrame | None = None, threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """Per page: host, path, rule, verdict, trust, distrust.

    trusted and blocked: tables of hosts (column host), each of which counts as one page. Where they are not given, the pages that rules block are distrust of their hosts, and all other pages trust. Hosts that neither reaches are allowed. Null urls and urls without "://" have an empty host and path; the empty host is no part of the graph. Null html has no links. Repeated rows are judged each; an empty table gives no rows. Other columns are not read.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = with_rules(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), rules)
    by_host = materialize(rows.groupBy("host").agg(F.count_if(F.col("found.verdict") == "block").alias("stopped"), F.count("*").alias("n")).filter("host <> ''"), "hosts")
    if trusted is None or blocked is None:
        trusted = by_host.select("host", (F.col("n") - F.col("stopped")).cast("double").alias("weight")).filter("weight > 0")
        blocked = by_host.select("host", F.col("stopped").cast("double").alias("weight")).filter("weight > 0")
    else:
        trusted, blocked = (x.select(F.translate("host", _UPPER, _LOWER).alias("host")).filter("host is not null").distinct().withColumn("weight", F.lit(1.0)) for x in (trusted, blocked))
    edges = materialize(host_edges(pages, url_col, html_col).unionByName(domain_edges(by_host.select("host"))).groupBy("src", "dst").agg(F.sum("n").alias("n")), "host-edges")
    both = edges.withColumn("graph", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("graph")))
    seeds = trusted.withColumn("graph", F.lit("trust")).unionByName(blocked.withColumn("graph", F.lit("distrust")))
    pages_of = seeds.groupBy("graph").agg(F.sum("weight").alias("whole"))
    scores = propagate(both, seeds, damping=damping, rounds=rounds).join(F.broadcast(pages_of), "graph").select("graph", "host", (F.col("score") * F.col("whole")).alias("score"))  # two rows
    of = lambda graph: F.sum(F.when(F.col("graph") == graph, F.col("score")).otherwise(0.0))
    scores = materialize(scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")), "host-scores")
    judged = rows.join(scores, "host", "left")
    suspect = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    verdict = F.coalesce(F.col("found.verdict"), F.when(suspect, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
