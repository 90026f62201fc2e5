"""Weights against a direct bisection, and counts against a plain walk through the permutations."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wakeline.llm import mixing
from wakeline.session import Workspace


def docs(spark, sizes, extra=()):
    rows = [(i, s, " ".join(["w"] * (1 + i * 7 % 13))) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, source string, text string")


def entropy(shares, a):
    z = sum(p**a for p in shares)
    return -sum(p**a / z * math.log(p**a / z) for p in shares)


@pytest.mark.parametrize("target, limit", [(0.95, None), (None, 1.5), (0.99, 2.0), (0.2, None)])
def test_exponent(spark, target, limit):
    df = docs(spark, {"a": 300, "b": 90, "c": 40, "d": 11}).withColumn("tokens", mixing.n_tokens(F.col("text")))
    with Workspace(spark) as work:
        plan = mixing.plan(df, work, target, limit)
        rows = {r.source: r for r in plan.sources.collect()}
    tokens = {s: r.tokens for s, r in rows.items()}
    total = sum(tokens.values())
    shares = sorted(t / total for t in tokens.values())
    if target and not limit:
        want = target * math.log(4)
        if entropy(shares, 1.0) >= want:
            assert plan.exponent == pytest.approx(1.0)
        else:
            assert entropy(shares, plan.exponent) == pytest.approx(want, abs=1e-9)
    if limit:
        assert max(r.target / r.tokens for r in rows.values()) <= limit * 1.01
    assert sum(r.weight for r in rows.values()) == pytest.approx(1)
    assert min(r.target / r.tokens for r in rows.values()) == pytest.approx(1, abs=0.01)


def test_copies_follow_the_permutations(spark):
    df = docs(spark, {"a": 300, "b": 90, "c": 40, "d": 11})
    keyed = df.withColumns({"tokens": mixing.n_tokens(F.col("text"))})
    with Workspace(spark) as work:
        plan = mixing.plan(keyed.withColumn("doc_id", F.col("doc_id").cast("string")), work, 0.98, None, budget=9000.0, seed=3)
        target = {r.source: r.asDict() for r in plan.sources.collect()}
        rows = keyed.join(plan.sources.select("source", "epochs"), "source").select(
            "doc_id", "source", "tokens", mixing.order_key(F.col("doc_id").cast("string"), F.col("epochs"), 3).alias("key")).collect()
        got = {r.doc_id: r.copies for r in mixing.taken(df, plan, 3).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((r.key, r.doc_id, r.tokens))
    for s, items in by.items():
        left = target[s]["target"] - target[s]["epochs"] * target[s]["tokens"]
        for _, doc, tokens in sorted(items):
            assert got[doc] == target[s]["epochs"] + (left > 0), (s, doc)
            left -= tokens


def test_defined_cases(spark):
    odd = [(None, None, "x y"), (None, None, "x y"), (900, None, None), (901, "empty", ""), (5, "a", "dup dup"), (5, "a", "dup dup")]
    df = docs(spark, {"a": 50, "b": 5}, odd).withColumn("copies", F.lit("clash"))
    out = mixing.mix(df, max_repetition=2.0).collect()
    assert len(out) == 61 and all(1 <= r.copies <= 3 for r in out)
    assert {r.copies for r in out if r.source == "empty"} == {1}
    assert len({r.copies for r in out if r.doc_id == 5 and r.text == "dup dup"}) == 1
    assert mixing.mix(df.limit(0), max_repetition=2.0).count() == 0


@pytest.mark.parametrize("target, limit", [(0.95, None), (None, 1.5), (0.99, 2.0), (None, None)])
def test_more_sources_than_are_broadcast(spark, monkeypatch, target, limit):
    """Joined by a shuffle and bisected by sums: the same exponent and the same copies."""
    df = docs(spark, {"a": 300, "b": 90, "c": 40, "d": 11, None: 5}, [(900, "empty", ""), (901, "empty", None)])
    found = []
    for bound in (mixing.BROADCAST_SOURCES, 2):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
        with Workspace(spark) as work:
            narrow = work.save(df.select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("tokens")))
            plan = mixing.plan(narrow, work, target, limit, seed=3)
            copies = {r.doc_id: r["copies"] for r in mixing.taken(df, plan, 3).collect()}
            found.append((pytest.approx(plan.exponent, abs=1e-12), plan.few, copies))
    assert found[0][1] and not found[1][1] and found[0][0] == found[1][0].expected and found[0][2] == found[1][2]
    assert set(found[1][2]) == {r.doc_id for r in df.collect()}
