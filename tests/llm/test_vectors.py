"""Nearest neighbours and embedding near-duplicates against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from wakeline.llm import ann, nndescent
from wakeline.session import Workspace

BAD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [])]


def vectors(seed=4):
    """Scattered vectors, near-duplicate clusters, chains, and many equal ones."""
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=16) for _ in range(300)]
    for n, spread in ((60, 0.03), (25, 0.05), (8, 0.02)):
        centre = rng.normal(size=16)
        x += [centre + spread * rng.normal(size=16) * np.linalg.norm(centre) / 4 for _ in range(n)]
    x += [x[0]] * 80 + [3 * x[1]] * 2
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_chi_square():
    assert abs(ann.chi_square_tail(15.507, 8) - 0.05) < 1e-4 and abs(ann.chi_square_bound(0.05, 8) - 15.507) < 1e-2


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + BAD + [(9100, [1.0, 2.0])], "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, cell_rows=32).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x, hits, total = np.array([v for _, v in rows]), 0, 0
    for q in range(0, len(rows), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = sorted((d[i], i) for i in range(len(rows)) if i != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(math.isclose(m[2], d[m[1]], rel_tol=1e-12, abs_tol=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {i for _, i in order})
        total += 10
        if all(m[1] == i for m, (_, i) in zip(mine, order, strict=True)):
            continue
    assert hits >= 0.95 * total
    assert 9100 not in got and set(got) == set(range(0, len(rows), 20))


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, F.col("id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in rows) == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def test_near_duplicates(spark):
    rows = vectors()
    label = {i: (None if i % 50 == 49 else i // 1000) for i, _ in rows}
    data = [(i, v, label[i]) for i, v in rows] + [(i, v, 0) for i, v in BAD]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert len(got) == len(data)
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ok = np.array([label[i] is not None for i, _ in rows])
    link = (u @ u.T >= 0.98) & ok[:, None] & ok[None, :]
    np.fill_diagonal(link, False)
    comp = np.arange(len(rows))
    while True:
        new = np.array([min(comp[i], comp[link[i]].min(initial=comp[i])) for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(link[i].sum()), int(comp[i]), bool(comp[i] == i)), i
    for i, _ in BAD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def dense_groups(seed=8, groups=2, n=20):
    """Groups of more than K near copies each; links between the groups are weaker than those inside."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    away = rng.normal(size=16)
    away -= (away @ centre) * centre
    away *= math.tan(math.acos(0.9855)) / np.linalg.norm(away)
    x = [centre + g * away + 0.003 * rng.normal(size=16) for g in range(groups) for _ in range(n)]
    return np.array(x)


def test_dense_groups_link_across(spark):
    x = dense_groups()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (u[:20] @ u[:20].T).min() > 0.999 and 0.98 < (u[:20] @ u[20:].T).min() and (u[:20] @ u[20:].T).max() < 0.99
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rows = nndescent.near_duplicates(df).collect()
    assert all((r.n_links, r.component_id, r.kept) == (39, 0, r.vec_id == 0) for r in rows)


def test_blocks_across_components(spark, monkeypatch):
    """Every pair of components that link is found, whether they fill blocks of their own or share them."""
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    x = np.concatenate([dense_groups(8), dense_groups(9, 3, 6), np.random.default_rng(1).normal(size=(30, 16))])
    parts = [20, 20, 6, 6, 6] + [1] * 30
    start = np.repeat(np.cumsum([0, *parts[:-1]]), parts)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    rows = [(i, 0, [float(c) for c in v], 1) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, label long, x array<double>, copies long")
    group = spark.createDataFrame([(i, int(start[i])) for i in range(len(x))], "node long, component long")
    got = nndescent._across(nodes.select("node"), nodes, group, 0.98, Workspace(spark, "across")).collect()
    want = {tuple(sorted((int(start[i]), int(start[j])))) for i, j in zip(*np.nonzero(link)) if start[i] != start[j]}
    assert want and {tuple(sorted((int(start[r.a]), int(start[r.b])))) for r in got} == want
    assert all(link[r.a, r.b] for r in got)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [1.0], None), (None, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    rows = {r.vec_id: r for r in nndescent.near_duplicates(df).collect()}
    assert rows[1].kept and rows[2].kept and not rows[None].kept and all(r.n_links == 0 for r in rows.values())
    assert nndescent.near_duplicates(df.limit(0)).count() == 0
