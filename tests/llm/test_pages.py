import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sondage.llm import common, queries, url_filter
from sondage.llm.url_filter import Rule, host_edges, judge_urls, personalised_pagerank
from sondage.llm.warc import read_warc, round_trip, write_warc

BIG = "x\r\n\r\ny WARC/1.1 \u00e9 " * 200
PAGES = [(1, "http://a.example.com/en/7x", BIG), (2, "https://A.Example.COM/en/1?q#f", BIG), (3, None, None), (4, "no scheme", ""), (5, "ftp://", "small"), (6, "x://h\r\nost/p", "small"), (7, "http://b.org", BIG + "z"), (8, "http://c.net/de/8", BIG), (8, "http://c.net/de/8", BIG), (None, "http://d.net/de/9", BIG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, pages):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(pages).collect()), key=str)
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        top = max(x for x in groups[html or ""] if x is not None)
        revisit = len(raw) >= 1000 and i is not None and i < top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)


def test_archives_hold_the_payloads(spark, pages, tmp_path):
    write_warc(pages, f"file://{tmp_path}/w")
    rows = read_warc(spark, f"file://{tmp_path}/w", payloads=True).collect()
    assert sorted(r.payload.decode() for r in rows if r.payload is not None) == sorted(["", "", "small", "small", BIG + "z", BIG, BIG, BIG])
    assert round_trip(pages.limit(0)).count() == 0


def test_repeated_page_ids_keep_their_own_payloads(spark):
    a, b = "A" * 1500, "B" * 1200
    rows = [(1, "u", a), (5, "u", a), (5, "u", b), (2, "v", b), (5, "w", a), (None, None, a), (7, "x", "\r\n\r\n" * 300), (6, "x", "\r\n\r\n" * 300), (8, "y", "\r\r\n\r\n\r" * 300)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), records_per_file=2).collect()), key=str)
    digest = lambda x: hashlib.sha1(x.encode()).hexdigest()
    revisits = {0: 5, 3: 5, 7: 7}
    assert got == sorted(((i, len(h), digest(h), "revisit" if k in revisits else "response", revisits.get(k)) for k, (i, _, h) in enumerate(rows)), key=str)


def test_query_writes_all_given_pages(spark):
    d = "/root/testdata/sf0.001"
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()}
    top = {}
    for i, h in html.items():
        top[h] = max(i, top.get(h, i))
    want = []
    for i, h in html.items():
        revisit = len(h.encode()) >= 1000 and i < top[h]
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert sorted(map(tuple, queries.op8_warc_revisits(spark, d).collect())) == sorted(want)


def test_false_alarms_of_the_filter_are_responses(spark, monkeypatch):
    """With a filter of one word almost every page is an alarm: none may be lost or doubled."""
    monkeypatch.setattr(common, "_MOST_WORDS", 1)
    rows = [(i, f"http://h{i}/", f"page {i // 2 if i < 40 else i} " * 300) for i in range(80)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("revisit", i + 1) if i < 40 and i % 2 == 0 else ("response", None) for i in range(80)}


def pagerank(edges, seeds, rounds, damping=0.85):
    total = sum(seeds.values())
    base = {h: (1 - damping) * w / total for h, w in seeds.items()}
    out = defaultdict(float)
    for (s, _), n in edges.items():
        out[s] += n
    score = dict(base)
    for _ in range(rounds):
        new = defaultdict(float, base)
        for (s, d), n in edges.items():
            new[d] += damping * score.get(s, 0) * n / out[s]
        score = new
    return score


def test_pagerank_against_a_plain_loop(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1, ("d", "c"): 5}
    seeds = {"a": 1.0, "d": 3.0}
    got = {r.host: r.score for r in personalised_pagerank(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, weight double"), rounds=7).collect()}
    want = pagerank(edges, seeds, 7)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-12 for h in want)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_rules_and_hosts(pages):
    rows = judge_urls(pages, [Rule(*r) for r in queries.URL_RULES]).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=str)
    assert got == sorted(((i, *(hp := plain_parts(u)), plain_rule(*hp)[0]) for i, u, _ in PAGES), key=str)
    assert judge_urls(pages.limit(0), []).count() == 0


def test_distrust_spreads_against_links(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = spark.createDataFrame([(1, "http://good.org/x", link("near.org")), (2, "http://near.org/", ""), (3, "http://farm.org/", link("spam.org") + link("spam.org")), (4, "http://spam.org/", None), (5, "http://lone.org/", "")], "page_id long, url string, html string")
    hosts = lambda h: spark.createDataFrame([(h,)], "host string")
    verdicts = {r.host: r.verdict for r in judge_urls(pages, [], trusted=hosts("good.org"), blocked=hosts("spam.org")).collect()}
    assert verdicts == {"good.org": "allow", "near.org": "allow", "farm.org": "block", "spam.org": "block", "lone.org": "allow"}
    assert {(r.src, r.dst): r.n for r in host_edges(pages).collect()} == {("good.org", "near.org"): 1, ("farm.org", "spam.org"): 1}


def plain_verdicts(urls, html):
    """(rule, verdict, trust, distrust) by page, by plain loops over the documented graph."""
    parts = {i: plain_parts(u) for i, u in urls.items()}
    rules = {i: plain_rule(*p) for i, p in parts.items()}
    edges = defaultdict(int)
    for i, (host, _) in parts.items():
        for link in {x.lower() for x in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html[i] or "")}:
            if host and link != host:
                edges[host, link] += 1
    for host in {h for h, _ in parts.values() if h}:
        labels = host.split(".")
        while len(labels) > 2:
            up = ".".join(labels[1:])
            edges[".".join(labels), up] = max(1, edges[".".join(labels), up])
            edges[up, ".".join(labels)] = max(1, edges[up, ".".join(labels)])
            labels = labels[1:]
    bad, good = defaultdict(float), defaultdict(float)
    for i, (host, _) in parts.items():
        if host:
            (bad if rules[i][1] == "block" else good)[host] += 1
    scores = [{h: x * sum(seeds.values()) for h, x in pagerank(e, seeds, 80).items()} if seeds else {} for e, seeds in ((edges, good), ({(d, s): n for (s, d), n in edges.items()}, bad))]
    out = {}
    for i, (host, _) in parts.items():
        trust, distrust = (s.get(host, 0.0) for s in scores)
        out[i] = (rules[i][0], rules[i][1] or ("block" if distrust > 0.5 * (trust + distrust) else "allow"), trust, distrust)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_given_pages(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = queries.op6_url_filters(spark, d).collect()
    given = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").collect()
    want = plain_verdicts({r.page_id: r.url for r in given}, {r.page_id: r.html for r in given})
    assert len(rows) == len(want)
    for r in rows:
        rule, verdict, trust, distrust = want[r.page_id]
        assert (r.host, r.path) == plain_parts({g.page_id: g.url for g in given}[r.page_id])
        assert (r.rule, r.verdict) == (rule, verdict) and abs(r.trust - trust) < 0.05 and abs(r.distrust - distrust) < 0.05


def test_method_decides_for_mostly_blocked_hosts_and_their_domain(spark):
    """Rules name paths; pages at other paths of a host follow the host, and a host without rules its domain."""
    rules = [Rule("block", "bad.com", "/en/"), Rule("allow", "good.com", "/en/")]
    pages = [(k, f"http://{h}.bad.com/en/{k}", None) for h in ("a", "b") for k in range(3)] + [(10, "http://a.bad.com/fr/1", None), (11, "http://www.a.bad.com/fr/1", "")]
    pages += [(20 + k, f"http://x.good.com/en/{k}", None) for k in range(3)] + [(30, "http://x.good.com/fr/1", None), (31, "http://alone.org/", '<a href="//a.bad.com/">x</a>'), (32, None, None)]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert got[10] == (None, "block") and got[30] == (None, "allow") and got[32] == (None, "allow")
    assert got[20] == ("good.com/en/", "allow") and got[0] == ("bad.com/en/", "block")


def test_many_rules_are_joined(spark, monkeypatch):
    rules = [Rule(*r) for r in queries.URL_RULES] + [Rule("block", "com", "/"), Rule("allow", "c.net", "/de/"), Rule("block", "b.org", "")]
    urls = [(i, u, None) for i, u, _ in PAGES] + [(30, "http://c.net/de/8", None), (31, "http://x.b.org", None), (32, "http://q.com/z", None), (33, "http://com/en/", None)]
    pages = spark.createDataFrame(urls, "page_id long, url string, html string")
    found = lambda: sorted((str(r.page_id), r.host, r.rule, r.verdict) for r in judge_urls(pages, rules).collect())
    want = found()
    monkeypatch.setattr(url_filter, "_IN_EXPRESSION", 0)
    assert found() == want


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    pages = [(i, f"http://h{i}.org/", f'<a href="http://h{i + 1}.org/">x</a>') for i in range(15)] + [(15, "http://h15.org/", None)]
    hosts = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    rows = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), [], trusted=hosts("other.org"), blocked=hosts("h15.org")).collect()
    assert {r.verdict for r in rows} == {"block"}
    assert all(abs(r.distrust - 0.15 * 0.85 ** (15 - r.page_id)) < 1e-9 for r in rows)
