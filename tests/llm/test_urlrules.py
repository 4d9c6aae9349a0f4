import random
import re

from pyspark.sql import functions as F

from spindrift.llm import urlrules


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h + p), len(h), p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and next(h + p for v, h, p in rules if (len(h + p), len(h), p, v) == best and (host == h or host.endswith("." + h))), best[3] if best else "allow"


def got(spark, urls, rules=None):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = urlrules.op10(pages, rules and urlrules.rule_table(spark, rules))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_odd_urls(spark):
    urls = [None, "", "net/", "http://net/", "http://NET", "https://a.Example.NET/en/x?q#f", "https://example.net/en", "https://example-net/en/", "https://notexample.net/fr/", "ftp://example.com/de/?x", "x://example.com:80/de/", "http://www.org/fr/a#b", "http://org./fr/", "http://ÄB.org/fr/", "a://b://c/d", "http://?x", "http://.net/", "http://a..net/x", "net.://x", "http://x.com/" + "p" * 100_000]
    assert got(spark, urls) == {i: brute(u, urlrules.RULES) for i, u in enumerate(urls)}


def test_nested_rules_against_brute_force(spark):
    rng = random.Random(2)
    labels = ["a", "b", "net", "a-b", "b0", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    rules = sorted({(h, p): v for h, p, v in ((host(3), rng.choice(["", "/", "/a", "/a/", "/a/b"]), rng.choice(["allow", "block"])) for _ in range(60))}.items())
    rules = [(v, h, p) for (h, p), v in rules]
    urls = [f"http://{host(5)}{rng.choice(['', '/', '/a', '/a/', '/a/b/c', '/x'])}" for _ in range(1500)] + ["http://b.a/a/b"] * 800
    assert got(spark, urls, rules) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "q"), (1, "http://a.net/x", "q"), (None, None, "r")], "page_id long, url string, rule string")
    assert sorted((r.page_id or 0, r.verdict) for r in urlrules.op10(pages).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urlrules.op10(pages.where(F.lit(False))).count() == 0
    assert {r.verdict for r in urlrules.op10(pages, urlrules.rule_table(spark).where(F.lit(False))).collect()} == {"allow"}


def test_very_long_urls(spark):
    rows = [(1, "http://" + "a." * 5000 + "net/" + "x" * 200_000), (2, "http://example.com" + "/de/" * 50_000), (3, "x" * 300_000)]
    got = {r.page_id: (len(r.host), len(r.path), r.rule) for r in urlrules.op10(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: (10_003, 200_001, "net/"), 2: (11, 200_000, "example.com/de/"), 3: (0, 0, None)}
