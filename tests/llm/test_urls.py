"""Verdicts against rules read one by one, with a filter of one block so that false positives are common."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wakeline.llm import queries, urls

URLS = [
    None, "", "no-scheme/org/", "http://a.org/", "http://a.org", "HTTP://A.ORG/x?y#z", "https://example.org/es/1", "https://www.example.org/en/12#t",
    "https://example.org/en/2", "https://notexample.org/es/1", "http://b.com/fr/", "http://b.com/de/x", "http://b.com/de", "x://c.net/p?utm_source=f",
    "http://c.net/p", "http://www.c.net/p/", "http://c.net/p?b=1&a=2", "http://m.c.net/p?a=2&utm_x=1&b=1", "http://c.net/q", "http://c.net:80/p",
    "a://b://c", "http://ÄB.com/de/ü", "http://c.net/p\n", "http://c.net/p", "http://a.com/de/?x://org/",
]


def judged(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:stop])
    path = rest[stop:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, act) for h, p, act in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if listed(url) else "allow"


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_verdicts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", broadcast)
    pages = spark.createDataFrame([(i, u, "kept", i) for i, u in enumerate(URLS)], "page_id long, url string, block string, host long")
    listed = spark.createDataFrame([("http://c.net/p",), ("https://c.net/p?b=1&a=2&utm_y=2",), (None,), ("http://c.net/p",)], "url string")
    same = {"http://c.net/p", "x://c.net/p?utm_source=f", "http://www.c.net/p/", "http://c.net/p?b=1&a=2", "http://m.c.net/p?a=2&utm_x=1&b=1"}
    out = urls.judge(pages, listed, queries.URL_RULES).collect()
    assert len(out) == len(URLS)
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, lambda u: u in same), r.url
        assert r.block == "kept"


def test_empty_list_and_table(spark):
    pages = spark.createDataFrame([(1, "http://c.net/p")], "page_id long, url string")
    none = pages.select("url").limit(0)
    assert urls.judge(pages, none, []).first().verdict == "allow"
    assert urls.judge(pages.limit(0), none, []).count() == 0


def test_no_listed_url_is_missed_and_few_others_pass(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    blocks = -(-5000 * urls.BITS_PER_URL // urls.BLOCK_BITS)
    filter_ = urls.bloom(listed, blocks)
    block, words = urls._bits(F.col("canonical"), blocks)
    probe = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("canonical"), (F.col("id") < 5000).alias("member"))
    met = probe.join(filter_, block == F.col("block"))
    for i, w in enumerate(words):
        met = met.filter(F.col(f"w{i}").bitwiseAND(w) == w)
    counts = {r.member: r["count"] for r in met.groupBy("member").count().collect()}
    assert counts[True] == 5000 and counts.get(False, 0) < 150


def test_contract_rules(spark):
    """The words of the contract, written out here, so that code and SQL cannot agree on another one."""
    cases = [("http://a.org/x", "org/", "allow"), ("http://example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/1", "example.org/en/1", "block"),
             ("http://www.example.org/en/12?q", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"), ("http://b.com/fr/", "com/fr/", "allow"),
             ("http://b.com/de/x", "com/de/", "block")]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    out = urls.judge(pages, pages.select("url").limit(0), queries.URL_RULES)
    assert {(r.page_id, r.rule, r.verdict) for r in out.collect()} == {(i, rule, act) for i, (_, rule, act) in enumerate(cases)}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, c[0]) for i, c in enumerate(cases)])
    got = con.execute(f"SELECT page_id, rule, verdict FROM ({queries.SQL['op7_url_filter']})").fetchall()
    assert set(got) == {(i, rule, act) for i, (_, rule, act) in enumerate(cases)}
