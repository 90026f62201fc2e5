"""Tables whose other columns are named like results or like helpers, and a very long text."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wakeline.llm import ann, nndescent, simhash, warc
from wakeline.session import Workspace


def clashing(df, *names):
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def test_simhash(spark):
    rows = [(1, "one two three four"), (2, "one two three four"), (3, None), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(simhash.near_duplicates(df).collect())
    got = simhash.near_duplicates(clashing(df, "fp", "component_id", "node", "a", "b", "doc", "component")).select("doc_id", "fp", "component_id")
    assert sorted(got.collect()) == want and {r.component_id for r in want} == {1, 3, 4}


def test_simhash_of_a_long_text(spark):
    words = [f"w{i * i % 9973}" for i in range(120_000)]
    got = simhash.near_duplicates(spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words).upper())], "doc_id long, text string")).collect()
    ones = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42)
        ones += np.unpackbits(np.array([h], "<u8").view(np.uint8), bitorder="little")
    want = sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)
    assert {r.fp % (1 << 64) for r in got} == {want} and {r.component_id for r in got} == {1}


def vectors(spark, rng):
    x = rng.normal(size=(120, 8))
    x[60:] = x[:60] + 0.001 * rng.normal(size=(60, 8))
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label long")


def test_vectors(spark):
    df = vectors(spark, np.random.default_rng(4))
    plain = sorted(nndescent.near_duplicates(df).collect())
    got = nndescent.near_duplicates(clashing(df, "n_links", "component_id", "kept", "node", "component", "a", "b", "v", "u"))
    assert sorted(got.select(*["vec_id", "n_links", "component_id", "kept"]).collect()) == plain and sum(r.kept for r in plain) == 60
    plain = sorted(ann.nearest(df, F.col("id") % 40 == 0).collect())
    got = ann.nearest(clashing(df, "query_id", "rank", "score", "cell", "box", "distance"), F.col("id") % 40 == 0)
    assert sorted(got.collect()) == plain and len(plain) == 30


def test_archives(spark):
    df = spark.createDataFrame([(1, "http://a.org", "same"), (2, "http://b.org", "same")], "page_id long, address string, html string")
    kinds = []
    for table in (df, clashing(df, "id", "url", "payload", "digest", "key", "response_id", "value")):
        with Workspace(spark) as work:
            path = work.path("archives")
            warc.write(table, path, work, "page_id", "address", "html")
            kinds.append(sorted((r.id, r.url, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()))
    assert kinds[0] == kinds[1] == [(1, "http://a.org", "revisit", 2), (2, "http://b.org", "response", None)]
