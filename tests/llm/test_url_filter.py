import numpy as np
import pytest

from quantloom.llm import url_filter

URLS = [
    None, "", "no scheme.net/", "http://a.net/x", "http://NET/", "http://net", "http://net?x=/", "http://example.net/en/1", "http://sub.Example.NET/en/", "http://example.net/EN/",
    "http://notexample.com/de/", "http://www.example.com/de/q?x#y", "http://example.com/de", "https://w.org/fr/", "https://w.org/en/", "ftp://x.org#/fr/", "http://a.net:80/x", "x://y://z.net/", "http://example.com/de/\nz", "http://.net/", "http://é.net/ü",
]


def brute(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = max(((len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS verdict")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.op6(df).collect()}


def test_edges_match_brute_force(spark):
    assert judged(spark, URLS) == {i: brute(u) for i, u in enumerate(URLS)}


def test_real_urls_repeated_rows_and_empty_table(spark):
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()] * 2
    assert judged(spark, urls) == {i: brute(u) for i, u in enumerate(urls)}
    assert judged(spark, []) == {}


@pytest.mark.parametrize("limit", [url_filter.MAX_FILTER_BYTES, 8])
def test_many_rules_with_and_without_the_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", limit)
    rules = [(f"h{i}.test", "/p" * (i % 3) + "/", "block" if i % 2 else "allow") for i in range(300)]
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = spark.createDataFrame([(i, f"http://s.h{i}.test/p/p/p/x") for i in range(600)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(urls, listed).collect()}
    assert got == {i: ("".join(rules[i][:2]), rules[i][2]) if i < 300 else (None, "allow") for i in range(600)}


def test_very_long_urls_and_hosts_of_many_labels(spark):
    urls = ["http://" + "a." * 400_000 + "net/x", "http://a.net/" + "p/" * 400_000, "http://" + "x" * 900_000, "http://sub." + "b." * 9 + "example.net/en/"] * 2
    assert judged(spark, urls) == {i: brute(u) for i, u in enumerate(urls)}


def test_rows_keep_their_rule_when_they_were_shuffled(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.{'net' if i % 2 else 'de'}/{i}") for i in range(500)], "page_id long, url string")
    rows = url_filter.op6(df.repartition(7)).collect()
    assert {r.page_id: r.rule for r in rows} == {i: "net/" if i % 2 else None for i in range(500)} and len(rows) == 500


def test_no_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(urls, rules).collect()] == ["allow"]


def test_filter_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 2**63, size=5000).astype(np.uint64) * np.uint64(2)
    words = np.zeros(2000, dtype=np.uint64)
    word, mask = url_filter.words_and_masks(h, len(words))
    np.bitwise_or.at(words, word, mask)
    assert ((words[word] & mask) == mask).all()
