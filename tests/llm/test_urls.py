"""URL filters against a direct reading of the rules."""

import pytest

from nebulark.llm import urls
from nebulark.llm.queries import URL_RULES
from nebulark.llm.urls import judge, rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


def judged(url, listed):
    host, path = parts(url)
    fits = []
    for verdict, rule in listed:
        k = rule.find("/") if "/" in rule else len(rule)
        h, p = rule[:k].translate(LOWER), rule[k:]
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict))
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://COM/x", "http://example.com/en/1", "http://example.com/en", "http://www.Example.com/en/a?b=/en/", "http://a.www.example.com/en/#x",
    "http://xexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://net/de/", "http://.com/", "http://com./", "http://a..com//en//x", "x://y://com/en/", "http://example.com:80/en/", "http://u@example.com/en/",
    "http://é.com/ü?", "http://example.com?/en/", "http://example.com#/en/", "http://deep.a.b.c.d.e.f.com/a/b/c/d/e/f/g", "http://long.com/" + "a/" * 3000, "http://" + "l." * 3000 + "com/en/", "http://x.org/page", "http://x.org/pag", "http://x.org/page/2", "HTTP://X.ORG/PAGE\n/2",
]
MORE = [*URL_RULES, ("block", "x.org/pag"), ("allow", "x.org/page"), ("block", "org"), ("allow", "org"), ("block", "a.b.c.d.e.f.com/a/b/c/"), ("block", "b.c.d.e.f.com/a/b/c/d"), ("block", "/en/"), ("block", "Y:")]


@pytest.mark.parametrize("listed", [URL_RULES, MORE, []])
@pytest.mark.parametrize("few", [200_000, -1])
def test_judge(spark, monkeypatch, listed, few):
    """With rules broadcast, and joined by a shuffle; repeated rows, clashing columns, one URL on a third of all rows."""
    monkeypatch.setattr(urls, "BROADCAST_RULES", few)
    rows = [(i, u, "clash", None) for i, u in enumerate(URLS)] + [(None, URLS[7], "clash", 1)] * 2 + [(1000 + i, URLS[9], "x", 2) for i in range(len(URLS) // 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, digest int")
    book = spark.createDataFrame([], "host string, path string, verdict string") if not listed else rules(spark, listed)
    got = judge(df, book)
    assert got.columns == ["page_id", "url", "digest", "host", "path", "rule", "verdict"]
    want = [(i, u, d, *judged(u, listed)) for i, u, _, d in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_pages(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string"), rules(spark, URL_RULES)).count() == 0


def test_rules_that_fit_nothing(spark):
    book = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", "en", "block"), ("com", None, None), ("com", None, "block")], "host string, path string, verdict string")
    assert [tuple(r) for r in judge(spark.createDataFrame([("http://com",), ("http://comen",)], "url string"), book).select("rule", "verdict").collect()] == [("com", "block"), (None, "allow")]
