"""URL filters against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from flowgauge.llm import url_filters as U
from flowgauge.llm.queries import ORACLE_SQL
from tests.conftest import TESTDATA
from tests.llm import helpers as H

ODD_URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Example.ORG", "http://example.org/", "http://a.example.org/es/1",
    "http://example.org/en/12", "http://example.org/en/2", "http://EXAMPLE.com/fr/x?y=/de/", "http://x.com/de/9#t",
    "http://xcom/de/", "http://com/de/", "http://org", "http://org?/", "http://İ.com/de/", "http://a.net//x///y1/",
    "http://a.net/q?u=http://b.com/de/", "http://example.org/es/1", "http://example.org/es/1",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.encode().lower().decode(), path


def ruled(host, path):
    best = None
    for rule in U.RULES:
        name, slash, rest = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            if best is None or len(rule.text) > len(best.text):
                best = rule
    return best


def expected(rows):
    """The method, straight from its description."""
    pages = [(i, *parsed(url)) for i, url in rows]
    paths = sorted({(h, p) for _, h, p in pages})
    shaped = lambda s: re.sub("[0-9]+", "*", s)
    below = defaultdict(Counter)
    cut = {k: [s for s in k[1].split("/") if s] for k in paths}
    for (host, path), segments in cut.items():
        for d, s in enumerate(segments):
            below[host, tuple(map(shaped, segments[:d]))][s] += 1
    variable = {
        n for n, c in below.items()
        if len(c) >= U.LEAST_CHILDREN and len(c) > U.CHILDREN_PER_PAGE * sum(c.values())
    }
    template, family = {}, {}
    for (host, path), segments in cut.items():
        parts = [
            "*" if (host, tuple(map(shaped, segments[:d]))) in variable else shaped(s)
            for d, s in enumerate(segments)
        ]
        template[host, path] = "/" + "/".join(parts)
        family[host, path] = "/*/" + "/".join(parts[1:])
    n, bad = Counter(), Counter()
    of = {(h, template[h, p]): (h, family[h, p]) for h, p in paths}
    for _, h, p in pages:
        rule = ruled(h, p)
        if rule:
            n[h, template[h, p]] += 1
            bad[h, template[h, p]] += rule.verdict == U.BLOCK
    overall = sum(bad.values()) / sum(n.values()) if n else 0.0
    all_n, all_bad, pool_n, pool_bad = Counter(), Counter(), Counter(), Counter()
    for t, f in of.items():
        all_n[f] += n[t]
        all_bad[f] += bad[t]
    alike = {}
    for t, f in of.items():
        joint = all_bad[f] / max(all_n[f], 1)
        alike[t] = abs(bad[t] - n[t] * joint) <= U.ALIKE * (n[t] * joint * (1 - joint)) ** 0.5
        if alike[t]:
            pool_n[f] += n[t]
            pool_bad[f] += bad[t]
    rejected = {}
    for t, f in of.items():
        a, b = (pool_n[f], pool_bad[f]) if alike[t] else (n[t], bad[t])
        rejected[t] = a > 0 and (b + U.PRIOR_LABELS * overall) / (a + U.PRIOR_LABELS) >= U.REJECTED_SHARE
    out = []
    for i, h, p in pages:
        rule = ruled(h, p)
        verdict = rule.verdict if rule else U.BLOCK if rejected[h, template[h, p]] else U.ALLOW
        out.append((i, h, p, rule and rule.text, verdict, template[h, p]))
    return out


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_pages(spark, scale):
    table = spark.read.parquet(f"{TESTDATA}/sf{scale}/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url").collect()]
    H.same([tuple(r) for r in U.filter_urls(table).collect()], expected(rows))


def test_odd_urls(spark):
    found = [tuple(r) for r in U.filter_urls(pages(spark, ODD_URLS)).collect()]
    H.same(found, expected(list(enumerate(ODD_URLS))))
    assert U.filter_urls(pages(spark, ODD_URLS).filter("page_id < 0")).collect() == []


def test_a_branch_learns_from_its_pages(spark):
    """Pages that no rule decides go with the template of those that one does."""
    urls = [f"http://a.net/bad/{i}" for i in range(30)] + [f"http://a.net/good/{i}" for i in range(30)]
    rules = (U.UrlRule(U.BLOCK, "a.net/bad/1"), U.UrlRule(U.BLOCK, "a.net/bad/2"), U.UrlRule(U.ALLOW, "a.net/good/1"))
    rows = U.filter_urls(pages(spark, urls), rules).collect()
    verdicts = {(r["path"].split("/")[1], r["verdict"]) for r in rows}
    assert verdicts == {("bad", "block"), ("good", "allow")}
    assert {r["template"] for r in rows} == {"/bad/*", "/good/*"}


def test_the_contracts_rules(spark):
    """Each rule's word, straight from the contract, in the rows and in the SQL."""
    contract = {
        "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
    }
    urls = [f"http://{rule}" for rule in contract] + [f"http://a.{rule}" for rule in contract]
    rows = U.filter_urls(pages(spark, urls)).collect()
    assert len(rows) == len(urls)
    assert {(r["rule"], r["verdict"]) for r in rows} == set(contract.items())
    for rule, verdict in contract.items():
        assert f"('{rule}', '{verdict}')" in ORACLE_SQL["op10_url_filters"]
