import random

import numpy as np
import pytest

from quernstone.llm.url_filters import judge

CASES = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("https://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://notcom/x", "notcom", "/x", None, "allow"),
    ("ftp://x.org?u=http://a.com/", "x.org", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_rules(spark):
    rows = [(i, c[0], None, "x", 1) for i, c in enumerate(CASES)]
    found = judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string, trust int")).orderBy("page_id").collect()
    for r, (url, host, path, rule, verdict) in zip(found, CASES):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), url
    assert judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def link(*hosts):
    return "".join(f'<a class=x HREF="https://{h}/p">t</a>' for h in hosts)


def pagerank(links, seeds, hosts):
    """By power iteration on the dense matrix, to the last digit; dangling mass goes to the seeds."""
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, w in links:
        m[at[b], at[a]] += w
    total = m.sum(0)
    m = m / np.where(total > 0, total, 1)
    s = np.zeros(len(hosts))
    s[[at[h] for h in seeds]] = 1 / max(1, len(seeds))
    r = s.copy()
    for _ in range(2_000):
        r = 0.15 * s + 0.85 * (m @ r + r[total == 0].sum() * s)
    return dict(zip(hosts, r))


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = [f"h{i}.{'com' if i % 7 == 0 else 'net' if i % 11 == 0 else 'org'}" for i in range(60)]
    pages, links = [], []
    for i, host in enumerate(hosts):
        if host == "h59.org":
            continue  # linked to, but without a page
        to = [] if i % 9 == 4 else [rng.choice(hosts[: 20 + i]) for _ in range(rng.randrange(1, 8))]
        if i == 3:
            to = hosts * 3  # a hub
        pages.append((i, f"http://{host}/{'es' if host.endswith('net') else 'x'}/", link(*to)))
        links += [(host, b, 1) for b in to if b != host]
    found = judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    trust = pagerank(links, [h for h in hosts if h.endswith("com")], hosts)
    distrust = pagerank([(b, a, w) for a, b, w in links], [h for h in hosts if h.endswith("net")], hosts)
    assert sum(trust.values()) == pytest.approx(1) and sum(distrust.values()) == pytest.approx(1)
    for r in found:
        t, d = trust[r["host"]], distrust[r["host"]]
        assert r["trust"] == pytest.approx(t, abs=1e-5) and r["distrust"] == pytest.approx(d, abs=1e-5)
        if r["rule"] is None and abs(d - t) > 1e-4:
            assert r["verdict"] == ("block" if d > t else "allow")
    assert {"allow", "block"} == {r["verdict"] for r in found if r["rule"] is None}


def test_distrust_flows_back_and_trust_forward(spark):
    pages = [
        (1, "http://farm.org/", link("spam.net")),  # links to a blocked host: distrusted
        (2, "http://good.com/x", link("friend.org")),
        (4, "http://friend.org/", link("friend.org")),
        (5, "http://spam.net/es/", link("friend.org")),  # what bad hosts link to is not distrusted
        (6, "http://alone.org/", "<a href='/x'>x</a>"),
        (7, "http://deep.org/", "<a href=//farm.org/y>"),
        (8, "http://listed.org/", None),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["host"]: r["verdict"] for r in judge(rows, blocked_hosts=("listed.org",)).collect()}
    assert found == {"farm.org": "block", "good.com": "allow", "friend.org": "allow", "spam.net": "block", "alone.org": "allow", "deep.org": "block", "listed.org": "block"}


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("quernstone.llm.url_filters.ROUNDS", 2)
    with pytest.raises(RuntimeError):
        judge(spark.createDataFrame([(1, "http://a.com/", link("b.org")), (2, "http://b.org/", link("a.com", "c.org"))], "page_id long, url string, html string"))


def test_equally_long_rules(spark):
    """The one that is listed first wins."""
    rows = spark.createDataFrame([(1, "http://a.org/x", None)], "page_id long, url string, html string")
    for first in ("allow", "block"):
        rules = ((first, "org/"), ("block" if first == "allow" else "allow", "org/"))
        assert judge(rows, rules).first()["verdict"] == first
