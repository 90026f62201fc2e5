"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to ``DIMS`` dimensions with normal (2-stable) weights, so the squared projected distance of
two vectors over their true one follows a chi-square law with ``DIMS`` degrees of freedom. A kd-tree over the
projections cuts the rows into cells of about ``CELL_ROWS`` rows; its cuts come from a bounded sample of
``SAMPLE_ROWS`` rows in an order by hash, and every row is indexed.

A query first reads its own cell. Then it visits further cells in the order of their projected distance. A candidate
nearer than the k-th found so far would lie beyond projected distance r with a chance given by the law; cells
and points are read until that chance falls below ``MISS``. Both steps are joins: (query, cell) pairs that the
test leaves open, and per cell numpy takes candidates in ascending projected distance, in chunks, verifies their
true distances, and stops when the test holds.

Cells are bounded; a cell that holds more rows than expected, because of equal vectors, is dealt in slices. Queries
of a cell are handled in batches. Nothing is collected but the sample and the tree.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
unequal length are not compared; ties go to the smaller id; with fewer candidates than ``k`` all are returned;
rows with equal id are different candidates except for a query's own id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace
from .vectors import matrix, usable

DIMS = 8
CELL_ROWS = 512
SAMPLE_ROWS = 100_000
MISS = 0.01  # chance of missing a nearer candidate that the stopping test accepts
QUERY_BATCH = 1000  # queries that meet one piece of a cell in one task, about
CHUNK = 128  # candidates verified between two tests
SEED = 20_240_901


def chi_square_tail(x: float, dims: int) -> float:
    """P(chi-square > x) for an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def chi_square_bound(miss: float, dims: int) -> float:
    """x with P(chi-square > x) = miss."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dims) > miss else (low, mid)
    return high


def projection(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED + width).standard_normal((width, dims))


class Tree:
    """kd-tree in arrays: node i has children 2i+1 and 2i+2; leaves are numbered from the left."""

    def __init__(self, points: np.ndarray, cells: int):
        self.levels = max(0, math.ceil(math.log2(max(1, cells))))
        inner = 2**self.levels - 1
        self.axis, self.cut = np.zeros(inner, np.int64), np.zeros(inner)
        groups = [points]
        for level in range(self.levels):
            nxt = []
            for j, p in enumerate(groups):
                node = 2**level - 1 + j
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
                cut = float(np.median(p[:, axis])) if len(p) else 0.0
                self.axis[node], self.cut[node] = axis, cut
                left = p[:, axis] < cut
                nxt += [p[left], p[~left]]
            groups = nxt
        dims = points.shape[1]
        low, high = np.full((1, dims), -np.inf), np.full((1, dims), np.inf)
        for level in range(self.levels):
            node = 2**level - 1 + np.arange(2**level)
            a, c = self.axis[node], self.cut[node]
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left, right = np.arange(0, len(low), 2), np.arange(1, len(low), 2)
            high[left, a] = np.minimum(high[left, a], c)
            low[right, a] = np.maximum(low[right, a], c)
        self.low, self.high = low, high  # the box of each cell

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - (2**self.levels - 1)

    def near(self, point: np.ndarray, radius2: float) -> np.ndarray:
        """Cells whose box is within a squared distance."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap**2).sum(axis=1) <= radius2)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (piece, batch) at a time; they arrive sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        for start, stop in zip(edges, edges[1:], strict=False):
            if stop > start:
                if held and last != (a[start], b[start]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, stop - start))
                last = (a[start], b[start])
    if held:
        yield pa.Table.from_batches(held)


def _best(found_d: np.ndarray, found_i: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d, i = np.concatenate([found_d, d]), np.concatenate([found_i, i])
    take = np.lexsort((i, d))[:k]
    return d[take], i[take]


def _search_cells(k: int, bound: float):
    """Candidates (side 0) and queries (side 1) of pieces of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches):
            side = table.column("side").to_numpy()
            ids = table.column("id").to_numpy()
            limit = table.column("limit").to_numpy()
            x, p = matrix(table.column("x")), matrix(table.column("p"))
            c, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            out_q, out_i, out_d = [], [], []
            for at in q:
                near = ((p[c] - p[at]) ** 2).sum(axis=1)
                order = np.argsort(near, kind="stable")
                d, i = np.empty(0), np.empty(0, np.int64)
                reach = limit[at]  # k-th distance that other cells have found, if any
                for start in range(0, len(order), CHUNK):
                    # Beyond this projected distance a nearer candidate is too unlikely.
                    if near[order[start]] > bound * reach**2:
                        break
                    part = c[order[start:start + CHUNK]]
                    part = part[ids[part] != ids[at]]
                    d, i = _best(d, i, np.sqrt(((x[part] - x[at]) ** 2).sum(axis=1)), ids[part], k)
                    if len(d) == k:
                        reach = min(reach, float(d[-1]))
                out_q.append(np.full(len(d), ids[at]))
                out_i.append(i)
                out_d.append(d)
            if out_q:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_d))],
                    names=["query_id", "vec_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(df: DataFrame, queries, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
            miss: float = MISS, cell_rows: int = CELL_ROWS, work: Workspace | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of ``df`` for the rows of it where ``queries`` holds.

    ``queries`` is a condition on the column ``id``; ``score`` is the Euclidean distance.
    """
    spark = df.sparkSession
    work = work or Workspace(spark, "ann")
    rows = usable(df, vec_id, embedding)
    widths = [r[0] for r in rows.groupBy(F.size("x").alias("w")).count().orderBy("w").select("w").collect()]
    parts = [_one_width(rows.filter(F.size("x") == w), w, queries, k, miss, cell_rows, work) for w in widths]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_width(rows: DataFrame, width: int, queries, k: int, miss: float, cell_rows: int, work: Workspace) -> DataFrame:
    spark = rows.sparkSession
    weights = projection(width)
    bound = chi_square_bound(miss, DIMS)
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("x").toArrow()
    tree = spark.sparkContext.broadcast(Tree(matrix(sample.column("x")) @ weights, -(-n // cell_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = matrix(batch.column(1)) @ weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), DIMS).cast(pa.list_(pa.float64())),
                 pa.array(tree.value.cell(p))], names=["id", "x", "p", "cell"])

    placed = work.save(rows.select("id", "x").mapInArrow(place, "id long, x array<double>, p array<double>, cell long"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell_rows)).alias("slices"))
    sizes = work.save(sizes, "sizes")  # one row per cell
    asked = work.save(placed.filter(queries), "queries")
    batches_ = max(1, -(-asked.count() // QUERY_BATCH))
    piece = F.shiftleft("cell", 24).bitwiseOR(F.pmod(F.xxhash64("id"), F.col("slices"))).alias("piece")
    candidates = placed.join(F.broadcast(sizes), "cell").select(
        piece, F.lit(0).alias("side"), "id", "x", "p", F.lit(float("inf")).alias("limit"))

    def search(wanted: DataFrame) -> DataFrame:
        """Search (query, cell) pairs: ``wanted`` has cell, id, x, p and limit."""
        asks = wanted.join(F.broadcast(sizes), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        asks = asks.select(F.shiftleft("cell", 24).bitwiseOR(F.col("slice")).alias("piece"),
                           F.pmod(F.xxhash64("id"), F.lit(batches_)).alias("batch"), F.lit(1).alias("side"), "id", "x", "p", "limit")
        asks = work.save(asks, "asks")
        met = candidates.join(asks.select("piece", "batch").distinct(), "piece").unionByName(asks)
        return met.select("piece", "batch", "side", "id", "x", "p", "limit").repartition("piece", "batch") \
            .sortWithinPartitions("piece", "batch", "side").mapInArrow(_search_cells(k, bound), "query_id long, vec_id long, score double")

    home = work.save(_top(search(asked.withColumn("limit", F.lit(float("inf")))), k), "home")
    reach = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("limit"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, home_, limit = matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            row, cell = [], []
            for i in range(batch.num_rows):
                near = tree.value.near(p[i], bound * limit[i] ** 2)
                near = near[near != home_[i]]
                row.append(np.full(len(near), i))
                cell.append(near)
            at = pa.array(np.concatenate(row), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cell), pa.int64()), *(batch.column(i).take(at) for i in (0, 1, 2, 4))],
                names=["cell", "id", "x", "p", "limit"])

    known = asked.join(reach, asked["id"] == reach["query_id"], "left").select(
        "id", "x", "p", "cell", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    wanted = known.mapInArrow(route, "cell long, id long, x array<double>, p array<double>, limit double")
    away = search(wanted)
    best = _top(home.select("query_id", "vec_id", "score").unionByName(away), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
