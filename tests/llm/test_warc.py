"""Archives written and read back, revisits, the loser tree, and the order of the index."""

import base64
import hashlib
import heapq
import random

from wakeline.llm import warc
from wakeline.session import Workspace

PAGES = [
    (1, "http://a.org/x", "same"), (2, "http://www.a.org/y", "same"), (3, "http://a.org/x", "é\r\n\r\nWARC/1.1\r\n\r\n"), (4, None, None),
    (5, "", ""), (6, "http://b.org/\r\nX: 1", "long " * 50_000), (7, "https://a.org/x?q#f", "same"), (7, "https://a.org/x?q#f", "same"),
    (8, "ftp://c", "x\r\n"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("html", "payload")
    with Workspace(spark) as work:
        path = work.path("archives")
        warc.write(df, path, work, "page_id", "url", "payload", archive_bytes=100_000, compression="none")
        records = warc.read(spark, path).collect()
        got = warc.index(warc.read(spark, path), work, range_rows=2).collect()
    assert sorted(r.id for r in records) == sorted(p[0] for p in PAGES)
    largest = {}
    for i, _, html in PAGES:
        largest[html or ""] = max(largest.get(html or "", 0), i)
    text = {i: html or "" for i, _, html in PAGES}
    for r in records:
        raw = text[r.id].encode()
        first = largest[text[r.id]]
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.id == first else ("revisit", first))
        assert (bytes(r.payload) == raw) if r.record_type == "response" else r.payload is None
    keys = [(r.urlkey, r.timestamp, r.id) for r in got]
    assert len(keys) == len(PAGES) and keys == sorted(keys)
    assert keys[-1][0].startswith("org,b)")


def test_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    with Workspace(spark) as work:
        warc.write(df, work.folder + "/a", work, "page_id", "url", "html", min_bytes=3)
        kinds = {r.id: r.record_type for r in warc.read(spark, work.folder + "/a").collect()}
        warc.write(df.limit(0), work.folder + "/b", work, "page_id", "url", "html")
        assert warc.index(warc.read(spark, work.folder + "/b"), work).count() == 0
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))
