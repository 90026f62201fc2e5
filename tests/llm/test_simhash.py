"""SimHash fingerprints and links against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wakeline.llm import simhash
from wakeline.llm.graph import components
from wakeline.session import Workspace


def majority(text, size=3):
    """Bit by bit, from the definition."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    n = min(size, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, budget=3):
    """Smallest index each value reaches."""
    x = np.array(values, np.uint64)
    label = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= budget):
            a, b = label[i], label[int(j)]
            if a != b:
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


TEXTS = [None, "", " \t\n", "One", "two Words", "A b c", "a B C", "ÄÖ ä é É x", "a b c a b c a b c",
         "long " * 3000 + "end", "x y z w", "日本 語 テ"]


def test_fingerprints(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.fp for r in simhash.fingerprints(rows).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] & (2**64 - 1) == majority(t or ""), t


def test_rows_and_edge_cases(spark):
    rows = [(3, "same words here now"), (1, "same words here now"), (3, "same words here now"), (7, None), (5, ""),
            (None, "same words here now"), (9, "quite another text altogether")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (3, 1), (3, 1), (5, 5), (7, 5), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (8, c)], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert rows == {(3, 3), (5, 3), (7, 3), (8, 8)}


def planted(seed):
    """Clusters around centres, one of them large and below one node, and scattered fingerprints."""
    rng = np.random.default_rng(seed)
    out = set(int(x) for x in rng.integers(0, 2**64, 600, np.uint64))
    for n, centre in [(400, 0xDEADBEEF12345678)] + [(6, int(c)) for c in rng.integers(0, 2**64, 40, np.uint64)]:
        for _ in range(n):
            x = centre
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    out |= {(0xABCDEF0123 << 24) | int(v) for v in rng.integers(0, 2**24, 300)}
    return sorted(out)


@pytest.mark.parametrize("blocks,node_leaves", [(4, 1024), (4, 8), (5, 32), (6, 16)])
def test_links_equal_brute_force(spark, blocks, node_leaves):
    values = planted(blocks)
    want = groups(values)
    rows = [(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)]
    leaves = spark.createDataFrame(rows, "fp long, doc long")
    with Workspace(spark) as work:
        found = simhash.links(work, leaves, blocks=blocks, node_leaves=node_leaves)
        label = {r.node: r.component for r in components(work, found).collect()}
    assert [label.get(i, i) for i in range(len(values))] == want


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(1, 200)]
    hub = [(1000, i) for i in range(1001, 1300)]
    extra = [(5, 5), (None, 3), (7, None), (2, 1), (2, 1)]
    edges = spark.createDataFrame(path + hub + extra, "a long, b long")
    with Workspace(spark) as work:
        got = {r.node: r.component for r in components(work, edges).collect()}
        assert components(work, edges.limit(0)).count() == 0
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1300)}
