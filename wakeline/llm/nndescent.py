"""Embedding near-duplicates by NN-descent.

Equal vectors of one label are one node with a number of copies. Nodes get a first neighbour list from ``tables``
orders by random hyperplane signs: consecutive nodes of one label form a chunk, and every node keeps its ``k`` best
of each chunk. Then lists are refined: all nodes in the list of one node, or listing it, meet there and offer
themselves to each other (neighbours of neighbours), until a round changes few lists. Long reverse lists are dealt
in parts, none is cut off. Pairs at the threshold or above connect nodes to components.

A list in which all entries are links is saturated: there may be more, also in other components. Saturated nodes of
one label therefore meet those of its other components in blocks of ``BLOCK`` x ``BLOCK``, which numpy multiplies in
double precision; one link per pair of components leaves a block. Before links are counted, lists are enlarged to the
whole component in the same way, and only sums per node leave a block. Links of a vector lie in its component, so
counts are exact given the components. An audit compares the counts of ``AUDIT`` nodes, chosen by hash, with brute
force over their whole labels; below ``RECALL`` the search is repeated with twice as many orders, and from
``MOST_TABLES`` on all nodes of a label, saturated or not, meet in blocks, which is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; unequal lengths never link; repeated rows are equal vectors and link; different vectors under one id count
as one vector with the links of both; a null id has no component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from .graph import components
from .vectors import matrix, usable

K = 10
TABLES = 4
BITS = 24
CHUNK = 128
PART = 48  # members of a list part that meet at once
ROUNDS = 4
CHANGED = 0.01  # share of new list entries below which refining stops
EXPLORE = 0.5  # entries below this cosine are no path to a near-duplicate
BLOCK = 512
AUDIT = 256
RECALL = 0.99
MOST_TABLES = 64
SEED = 77


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best_pairs(node: np.ndarray, u: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, ...]:
    """(a, b, cosine) of the k best partners of each node in one group."""
    sim = u @ u.T
    sim[node[:, None] == node[None, :]] = -2
    k = min(k, len(node) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a, c = np.repeat(np.arange(len(node)), k), best.ravel()
    ok = sim[a, c] >= floor
    return node[a[ok]], node[c[ok]], sim[a[ok], c[ok]].astype(np.float32)


def _changes(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, limit: int | None = None) -> Iterator[pa.Table]:
    """Rows with equal leading key columns, at most ``limit`` consecutive ones at a time; rows arrive sorted."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cols = [held.column(i).to_numpy() for i in range(keys)]
        starts = _changes(*cols)
        for a, b in zip(starts, starts[1:], strict=False):
            yield from _cut(held.slice(int(a), int(b - a)), limit)
        held = held.slice(int(starts[-1]))
        while limit and held.num_rows > 2 * limit:
            yield held.slice(0, limit)
            held = held.slice(limit)
    if held is not None and held.num_rows:
        yield from _cut(held, limit)


def _cut(table: pa.Table, limit: int | None) -> Iterator[pa.Table]:
    step = limit or table.num_rows
    for at in range(0, table.num_rows, step):
        yield table.slice(at, step)


def _packed(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in range(len(names))], names=names)


def _neighbours(keys: int, k: int, floor: float, limit: int | None):
    """Offer all members of each group to each other; the columns after the keys are node and u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for table in _grouped(batches, keys, limit):
            found = _best_pairs(table.column(keys).to_numpy(), matrix(table.column(keys + 1)), k, floor)
            out.append(found)
            n += len(found[0])
            if n > 100_000:
                yield _packed(out, ["a", "b", "cos"])
                out, n = [], 0
        if out:
            yield _packed(out, ["a", "b", "cos"])

    return run


PAIRS = "a long, b long, cos float"


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """The k best distinct entries of each list."""
    order = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    best = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def _first_lists(nodes: DataFrame, width: int, tables: int, n: int) -> DataFrame:
    planes = np.random.default_rng(SEED).standard_normal((tables, width, BITS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = matrix(batch.column(2))
            for t in range(tables):
                key = ((u @ planes[t] > 0) @ (1 << np.arange(BITS))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), t, np.int64)), batch.column(0), pa.array(key), batch.column(1), batch.column(2)],
                    names=["table", "label", "key", "node", "u"])

    rows = nodes.select("label", "node", "u").mapInArrow(keys, "table long, label long, key long, node long, u array<float>")
    parts = max(1, -(-n * tables // 20_000))
    dealt = rows.repartitionByRange(parts, "table", "label", "key", "node").sortWithinPartitions("table", "label", "key", "node")
    return dealt.select("table", "label", "node", "u").mapInArrow(_neighbours(2, K, EXPLORE, CHUNK), PAIRS)


def _refined(lists: DataFrame, nodes: DataFrame, work: Workspace) -> DataFrame:
    """One round: the members around every node meet and offer themselves to each other."""
    around = lists.select(F.col("a").alias("centre"), F.col("b").alias("node")).union(
        lists.select(F.col("b").alias("centre"), F.col("a").alias("node"))).distinct()
    degree = work.save(around.groupBy("centre").agg(F.ceil(F.count("*") / PART).alias("parts")), "degrees")
    part = F.pmod(F.xxhash64("node", "centre"), F.col("parts"))
    around = around.join(degree, "centre").select("centre", part.alias("part"), "node")
    met = work.save(around, "around").join(nodes.select("node", "u"), "node").select("centre", "part", "node", "u")
    offers = met.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(
        _neighbours(2, K, EXPLORE, None), PAIRS)
    return work.save(_lists(lists.unionByName(offers), K), "lists")


def _counts(threshold: float):
    """Per pair of blocks: how many vectors, copies included, each node of the left block links in the right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            side, node = table.column("side").to_numpy(), table.column("node").to_numpy()
            copies, u = table.column("copies").to_numpy(), _unit(matrix(table.column("x")))
            left, right = side == 0, side == 1
            if not right.any():
                right = left  # a block with itself
            link = (u[left] @ u[right].T >= threshold) & (node[left][:, None] != node[right][None, :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[left], node[right]])),
                 pa.array(np.concatenate([link @ copies[right], (link.T @ copies[left]) * (right is not left)]).astype(np.int64))],
                names=["node", "links"])

    return run


def _links(nodes: DataFrame, group: DataFrame, threshold: float, work: Workspace) -> DataFrame:
    """``node, links``: links of each node to other nodes of its component, counted in blocks."""
    sizes = work.save(group.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "sizes")
    placed = group.join(sizes, "component").select(
        "node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "blocks")
    placed = work.save(placed, "blocks").join(nodes.select("node", "copies", "x"), "node")
    # A block is on the left of the pairs with itself and all later ones, and on the right of those with earlier ones.
    on_left = placed.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).select(
        "component", F.col("block").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), "node", "copies", "x")
    on_right = placed.filter("block > 0").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1))).select(
        "component", F.col("other").alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "node", "copies", "x")
    pair = ["component", "i", "j"]
    return on_left.unionByName(on_right).repartition(*pair).sortWithinPartitions(*pair).mapInArrow(
        _counts(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """Nodes whose lists are full of links."""
    return lists.filter(F.col("cos") >= threshold - 1e-5).groupBy("a").count().filter(F.col("count") >= K).select(F.col("a").alias("node"))


def _cross_links(threshold: float):
    """Per pair of blocks: one link of each pair of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            side, node, component = (table.column(c).to_numpy() for c in ("side", "node", "component"))
            u = _unit(matrix(table.column("x")))
            left, right = side == 0, side == 1
            if not right.any():
                right = left  # a block with itself
            link = (u[left] @ u[right].T >= threshold) & (component[left][:, None] != component[right][None, :])
            i, j = np.nonzero(link)
            if not len(i):
                continue
            _, one = np.unique(np.stack([component[left][i], component[right][j]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(node[left][i[one]]), pa.array(node[right][j[one]])], names=["a", "b"])

    return run


def _across(members: DataFrame, nodes: DataFrame, group: DataFrame, threshold: float, work: Workspace) -> DataFrame:
    """Links ``(a, b)`` that connect the components of each label between which ``members`` link."""
    members = members.join(nodes.select("node", "label"), "node").distinct().join(group, "node", "left").select(
        "node", "label", F.coalesce("component", "node").alias("component"))
    members = work.save(members, "members")
    # A component of more than a block has blocks of its own, which need not meet each other; the others share blocks.
    sizes = members.groupBy("label", "component").agg(F.count("*").alias("n"))
    sizes = work.save(sizes.withColumn("own", F.when(F.col("n") > BLOCK, F.col("component"))), "sizes")
    shared = sizes.filter("own IS NULL").groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).alias("shared"))
    placed = members.join(sizes, ["label", "component"]).join(shared, "label", "left").select(
        "label", "node", "component", "own", F.when(F.col("own").isNull(), F.pmod(F.xxhash64("component"), "shared"))
        .otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).alias("part"))
    placed = placed.withColumn("block", F.xxhash64("label", F.coalesce(F.col("own"), F.lit(0)), F.col("own").isNull(), "part"))
    placed = work.save(placed, "placed")
    block = work.save(placed.select("label", "block", "own").distinct(), "across_blocks")
    other = block.select("label", F.col("block").alias("j"), F.col("own").alias("own_j"))
    pairs = block.withColumnRenamed("block", "i").join(other, "label").filter("i <= j AND (own IS NULL OR own_j IS NULL OR own <> own_j)")
    pairs = work.save(pairs.select("label", "i", "j"), "across_pairs")
    x = placed.join(nodes.select("label", "node", "x"), ["label", "node"]).select("label", "block", "node", "component", "x")
    on_left = x.withColumnRenamed("block", "i").join(pairs, ["label", "i"]).withColumn("side", F.lit(0))
    on_right = x.withColumnRenamed("block", "j").join(pairs.filter("i < j"), ["label", "j"]).withColumn("side", F.lit(1))
    pair = ["label", "i", "j"]
    rows = on_left.unionByName(on_right).select(*pair, "side", "node", "component", "x")
    return rows.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(_cross_links(threshold), "a long, b long")


def _audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the links of sampled nodes that were counted."""
    sample = nodes.filter("node IS NOT NULL").orderBy(F.xxhash64("node"), "node").limit(AUDIT)
    rows = sample.join(links, "node", "left").select("node", "label", "x", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    if not rows.num_rows:
        return 1.0
    q, label, u = rows.column("node").to_numpy(), rows.column("label").to_numpy(), _unit(matrix(rows.column("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = np.zeros(len(q), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _unit(matrix(batch.column(3)))
                node, lab, n = (batch.column(i).to_numpy() for i in range(3))
                link = (u @ x.T >= threshold) & (label[:, None] == lab[None, :]) & (q[:, None] != node[None, :])
                true += link @ n
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(true)], names=["node", "true"])

    true = nodes.select("node", "label", "copies", "x").mapInArrow(run, "node long, true long").agg(F.sum("true")).first()[0]
    return float(rows.column("links").to_numpy().sum() / true) if true else 1.0


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", tables: int = TABLES, work: Workspace | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row."""
    work = work or Workspace(df.sparkSession, "nndescent")
    rows = usable(df, vec_id, embedding, label).filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("long"))
    key = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2")]
    rows = rows.select("id", "label", "x", *key)
    nodes = rows.groupBy("label", "h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.any_value("x").alias("x"))
    nodes = work.save(nodes, "nodes")
    found, group = [], []
    widths = [(r[0], r[1]) for r in nodes.groupBy(F.size("x").alias("w")).count().orderBy("w").collect()]
    for width, n in widths:
        g, c = _one_width(nodes.filter(F.size("x") == width), width, n, threshold, tables, work)
        group.append(g)
        found.append(c)
    if not found:
        base = df.select(F.col(vec_id).cast("long").alias("vec_id"))
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    group_, found_ = group[0], found[0]
    for g, c in zip(group[1:], found[1:], strict=True):
        group_, found_ = group_.unionByName(g), found_.unionByName(c)
    group_ = group_.groupBy("node").agg(F.min("component").alias("component"))
    of = nodes.groupBy("label", "h1", "h2").agg(F.min("node").alias("node"), F.sum("copies").alias("copies"))
    of = of.join(found_.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(group_, "node", "left")
    of = work.save(of.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "node").alias("component_id")), "results")
    # Rows that take no part keep a key of their own, so they do not gather in one task.
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    every = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                      F.coalesce(F.xxhash64(x), F.lit(0)).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"))
    met = every.join(of, ["label", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _one_width(nodes: DataFrame, width: int, n: int, threshold: float, tables: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Components and link counts of the nodes whose vectors have one length."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u = _unit(matrix(batch.column(2))).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * width, pa.int32()), pa.array(u.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["label", "node", "u"])

    unit = work.save(nodes.select("label", "node", "x").mapInArrow(units, "label long, node long, u array<float>"), "units")
    while True:
        lists = work.save(_lists(_first_lists(unit, width, tables, n), K), "lists")
        size = lists.count()
        for _ in range(ROUNDS):
            new = _refined(lists, unit, work)
            fresh = new.join(lists, ["a", "b"], "left_anti").count()
            lists = new
            if fresh <= CHANGED * max(1, size):
                break
            size = lists.count()
        # Candidates are in single precision: a margin keeps pairs at the threshold, the exact test follows in blocks.
        near = lists.filter(F.col("cos") >= threshold - 1e-5).select("a", "b")
        sure = work.save(_exact(near, nodes, threshold, work), "links")
        group = work.save(components(work, sure), "components")
        full = work.save(_saturated(lists, threshold), "saturated")
        if not full.isEmpty():
            group = _joined(full, nodes, group, threshold, work)
        links = work.save(_links(nodes, group, threshold, work), "counts")
        if _audit(nodes, links, threshold) >= RECALL:
            return group, links
        if tables >= MOST_TABLES:
            group = _joined(nodes.select("node"), nodes, group, threshold, work)
            return group, work.save(_links(nodes, group, threshold, work), "counts")
        tables *= 2


def _joined(members: DataFrame, nodes: DataFrame, group: DataFrame, threshold: float, work: Workspace) -> DataFrame:
    """Components with the links between ``members`` of different ones."""
    more = work.save(_across(members, nodes, group, threshold, work), "across")
    if more.isEmpty():
        return group
    stars = group.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return work.save(components(work, stars.unionByName(more)), "components")


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float, work: Workspace) -> DataFrame:
    """The pairs that reach the threshold in double precision."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("x").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("x").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = (_unit(matrix(batch.column(2))) * _unit(matrix(batch.column(3)))).sum(axis=1) >= threshold
                yield batch.select([0, 1]).filter(pa.array(ok))

    return once.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")
