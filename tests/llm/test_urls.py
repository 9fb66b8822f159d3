"""URL filters: hosts and paths, the longest rule, and reputations against plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taxloom.llm import urls

SCHEMA = "page_id long, url string, html string, host string, Label int, rule string, n long"

ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme.example.net/en/"),
    (4, "http://WWW.Example.NET/en/A?x=/de/"),
    (5, "http://example.net/EN/"),
    (6, "http://example.net"),
    (7, "http://example.net?/en/"),
    (8, "http://badexample.net/en/#x"),
    (9, "http://a.example.com/de/1"),
    (10, "http://a.example.com/fr/1"),
    (11, "http://example.com.evil.org/de/"),
    (12, "http://org/fr/"),
    (13, "x://10.0.0.1:80/fr/"),
    (14, "http://a.b/?u=http://x.net/"),
    (15, "://\u00c9.ORG/fr/" + "long/" * 20000),
    (15, "://\u00c9.ORG/fr/"),
    (None, "http://a.example.com/fr/1"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "clash", 9, "r", -1) for i, u in rows], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host), path


def fit(host, path):
    found = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(found, key=lambda r: len(r.host + r.path), default=None)


def strength(pairs):
    over = sum(n * (r - p) ** 2 - p * (1 - p) for n, r, p in pairs)
    room = sum(p * (1 - p) * (n - 1) for n, r, p in pairs)
    if room <= 0:
        return 10.0
    rho = over / room
    return 1000.0 if rho <= 1 / 1001 else max(1.0, 1 / rho - 1)


def brute(outcomes, z=urls.Z):
    """host: (n, bad, mean, bound) from (host, bad) pairs."""

    def keys(h):
        if re.search(r"^[0-9.]+(:[0-9]*)?$|^\[", h):
            return h, h
        return ".".join(h.split(".")[-2:]), h.split(".")[-1]

    count = [defaultdict(lambda: [0, 0]) for _ in range(4)]
    for h, bad in outcomes:
        d, s = keys(h)
        for level, key in enumerate((h, (d, s), s, "")):
            count[level][key][0] += bad is not None
            count[level][key][1] += bad or 0
    up = [lambda h: keys(h), lambda d: d[1], lambda s: ""]
    m = [strength([(n, b / n, count[i + 1][up[i](k)][1] / count[i + 1][up[i](k)][0]) for k, (n, b) in count[i].items() if n]) for i in range(3)]
    n, b = count[3][""]
    mean = {("", ""): b / n if n else 0.5}
    for i in (2, 1, 0):
        for k, (n, b) in count[i].items():
            mean[i, k] = (b + m[i] * mean[("", "") if i == 2 else (i + 1, up[i](k))]) / (n + m[i])
    return {h: (n, b, mean[0, h], mean[0, h] - z * math.sqrt(mean[0, h] * (1 - mean[0, h]) / (n + m[0] + 1))) for h, (n, b) in count[0].items()}


def check(spark, rows, got):
    found = [(i, *parts(u)) for i, u in rows]
    said = [fit(h, p) for _, h, p in found]
    known = brute([(h, None if r is None else int(r.verdict == "block")) for (_, h, _), r in zip(found, said, strict=True)])
    wanted = Counter()
    for (i, h, p), r in zip(found, said, strict=True):
        wanted[i, h, p, r and r.host + r.path, r.verdict if r else "block" if known[h][3] > urls.LIMIT else "allow", known[h][0]] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.n_labelled) for r in got) == wanted
    for r in got:
        assert r.mean == pytest.approx(known[r.host][2], abs=1e-6) and r.bound == pytest.approx(known[r.host][3], abs=1e-6)


def test_odd_pages(spark):
    check(spark, ODD, urls.judge_urls(pages(spark, ODD)).collect())
    assert urls.judge_urls(pages(spark, [])).collect() == []


def test_given_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    check(spark, [(r.page_id, r.url) for r in df.select("page_id", "url").collect()], urls.judge_urls(df).collect())


def test_shrinkage(spark):
    """A host with few outcomes follows its domain, one with many its own; a single bad page doesn't block a host."""
    rows = [("a.good.x", 0)] * 200 + [("b.good.x", 1)] + [("c.good.x", 1)] * 80 + [("d.bad.x", 1)] * 300 + [("e.bad.x", None), ("f.new.x", None), ("g.y", None)]
    rows += [(f"h{i}.mixed.x", int(i % 2)) for i in range(40)]
    df = spark.createDataFrame([(i, f"http://{h}/", b) for i, (h, b) in enumerate(rows)], "page_id long, url string, bad int").repartition(5)
    got = {r.host: r for r in urls.judge_urls(df, rules=(), bad=F.col("bad")).collect()}
    known = brute(rows)
    for h, r in got.items():
        assert (r.n_labelled, r.mean, r.bound) == pytest.approx((known[h][0], known[h][2], known[h][3]), abs=1e-5)
    verdicts = {h: r.verdict for h, r in got.items()}
    assert verdicts["a.good.x"] == "allow" and verdicts["b.good.x"] == "allow" and verdicts["c.good.x"] == "block"
    assert verdicts["d.bad.x"] == "block" and verdicts["f.new.x"] == "allow" and verdicts["g.y"] == "allow"
    assert got["b.good.x"].mean < got["c.good.x"].mean and got["e.bad.x"].mean > got["f.new.x"].mean


def test_no_labels(spark):
    got = urls.judge_urls(pages(spark, ODD), rules=(), bad=F.lit(None)).collect()
    assert len(got) == len(ODD) and {(r.rule, r.verdict, r.mean) for r in got} == {(None, "allow", 0.5)}
