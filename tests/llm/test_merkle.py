"""Manifests against trees built one node at a time, at sizes around the chunk of levels."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wakeline.llm import merkle, order
from wakeline.session import Workspace


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[at ^ 1] if at ^ 1 < len(nodes) else None, at % 2))
        at //= 2
    return out


def fold(h, siblings):
    for other, right in siblings:
        h = digest(h) if other is None else digest(other, h) if right else digest(h, other)
    return h


def run(spark, rows, tampered, part_rows):
    df = spark.createDataFrame(rows, "id long, grp string, text string, leaf long, root string, path int, tree long")
    df = df.select("id", "grp", merkle.leaf([F.col("id"), F.col("grp"), F.col("text")]).alias("leaf"),
                   F.when(F.col("id").isin(tampered), F.sha2("text", 256)).alias("changed"))
    with Workspace(spark) as work:
        found = merkle.verified(merkle.manifest(work, df, "grp", "id", part_rows), F.coalesce("changed", "leaf"))
        return found.select("id", "grp", "leaf", "subroot", "root", "folded_root", "verified",
                            merkle.path_digest(F.concat("path", "top_path")).alias("proof")).collect()


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 5), (1, 7, 8, 9), (17, 1, 33), (64, 65, 31, 2, 6)])
def test_manifest_equals_trees(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    groups = [None, "a", "B", "é", ""][:len(sizes)]
    rows, n = [], 0
    for g, size in zip(groups, sizes, strict=True):
        for _ in range(size):
            n += 1
            rows.append(((n * 37) % 1009, g, None if n % 5 == 0 else "é\n" * (n % 4), n, "r", n, n))
    tampered = [r[0] for r in rows if r[0] % 7 == 0 and r[2]]
    got = {r.id: r for r in run(spark, rows, tampered, part_rows=10)}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(r for r in rows if r[1] == g) for g in names}
    trees = {g: tree([leaf(r[:3]) for r in members[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    assert len(got) == len(rows)
    for k, g in enumerate(names):
        for i, r in enumerate(members[g]):
            siblings, have = path(trees[g], i) + path(top, k), got[r[0]]
            start = hashlib.sha256(r[2].encode()).hexdigest() if r[0] in tampered else leaf(r[:3])
            assert (have.leaf, have.subroot, have.root) == (leaf(r[:3]), trees[g][-1][0], top[-1][0])
            assert have.proof == digest(*[s for s, _ in siblings if s])
            assert have.folded_root == fold(start, siblings) and have.verified == (r[0] not in tampered)


def test_repeated_rows_nulls_and_an_empty_table(spark):
    rows = [(None, "a", "x", 1, "", 1, 1), (None, "a", None, 1, "", 1, 1), (3, "a", "x", 1, "", 1, 1), (3, "a", "x", 1, "", 1, 1)]
    got = run(spark, rows, [], 2)
    want = tree(sorted(leaf(r[:3]) for r in rows[:2]) + [leaf(r[:3]) for r in rows[2:]])[-1][0]
    assert len(got) == 4 and all(r.verified and r.root == r.subroot == want for r in got)
    assert run(spark, [], [], 2) == []


def test_a_long_text(spark):
    rows = [(1, "a", "é" * 3_000_000, 1, "", 1, 1)]
    assert run(spark, rows, [], 2)[0].root == leaf(rows[0][:3])


def test_positions_and_running_totals(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 4)
    df = spark.range(1000).select((F.col("id") % 3 * F.col("id") % 2).cast("string").alias("g"), F.xxhash64("id").alias("k"))
    with Workspace(spark) as work:
        got = order.positions(work, df, "g", ["k"], part_rows=50).collect()
    for g in {r.g for r in got}:
        assert [r.position for r in sorted((r for r in got if r.g == g), key=lambda r: r.k)] == list(range(sum(r.g == g for r in got)))
    sums = order.running_totals(spark.range(0, 40, 3).withColumn("v", F.col("id") + 1), "id", "v", "before").collect()
    assert all(r.before == sum(i + 1 for i in range(0, r.id, 3)) for r in sums) and len(sums) == 14
