"""Gradient-boosted trees as ``spark.ml`` grows them, counted by column instead of by row.

``GBTRegressor.fit`` adds every value of every row to its bin in a loop over objects. Here the rows are kept as blocks of
bins, one array per feature, and a level of a tree is one job in which every block adds a whole column at a time. Split
candidates, subsamples, order of sums and ties are those of ``spark.ml``, and so are the trees; in large tables sums may
be rounded otherwise, which decides between splits that part the rows alike. The result is an ordinary
``GBTRegressionModel``.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace, remove, shared_folder

BLOCK_ROWS = 100_000
CHUNK_ROWS = 32_768  # counted at once: index and weight arrays stay in the processor's cache
TASK_ROWS = 4_000_000  # a task holds no more, or one of as many tasks as run at a time
EXACT_ROWS = 1_000_000  # in larger tables the sums of one of two siblings are what the other leaves of their parent
CHECKPOINT_ROUNDS = 25  # a lost block is made again from at most that many rounds
SAMPLE_ROWS = 10_000  # spark.ml looks for split candidates in that many rows, or the square of the bins
EPSILON = 2.0**-52
_LOWEST = -1.7976931348623157e308  # gain of a split that may not be taken


# --- the generator behind spark.ml's subsamples --------------------------------------------------

def _murmur3(data: bytes, seed: int) -> int:
    h, mask = seed, 0xFFFFFFFF
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = (h << 13 | h >> 19) & mask
        h = (h * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def start_state(seed: int) -> int:
    """State of Spark's ``XORShiftRandom`` after ``setSeed``."""
    data = struct.pack(">q", seed)
    low = _murmur3(data, 0x3C074A61)
    return _murmur3(data, low) << 32 | low


def _next(state: np.ndarray) -> np.ndarray:
    state = state ^ state << np.uint64(21)
    state ^= state >> np.uint64(35)
    state ^= state << np.uint64(4)
    return state


class Jumps:
    """Maps of many calls of the generator at once: linear over bits, kept as tables of the eight bytes of a state."""

    def __init__(self):
        self.tables: dict[int, np.ndarray] = {}

    def of(self, steps: int) -> np.ndarray:
        if steps not in self.tables:
            bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
            if steps > 1:
                bits = self.after(steps // 2, self.after(steps // 2, bits))
            if steps % 2:
                bits = _next(bits)
            table = np.zeros((8, 256), dtype=np.uint64)
            for bit in range(8):
                table[:, 1 << bit:2 << bit] = table[:, :1 << bit] ^ bits[bit::8, None]
            self.tables[steps] = table
        return self.tables[steps]

    def after(self, steps: int, states: np.ndarray) -> np.ndarray:
        """The states that follow ``states`` after ``steps`` calls."""
        table, out = self.of(steps), np.zeros_like(states)
        for byte in range(8):
            out ^= table[byte][(states >> np.uint64(8 * byte) & np.uint64(255)).astype(np.intp)]
        return out


def picks(start: int, n: int, share: float, jumps: Jumps) -> tuple[np.ndarray, int]:
    """Whether ``nextDouble`` is below ``share``, ``n`` times from a state in parallel lanes, and the state after them."""
    first = np.array([start], dtype=np.uint64)
    length, state = max(1, -(-n // 2048)), first
    while len(state) * length < n:
        state = np.concatenate([state, jumps.after(2 * length * len(state), state)])
    out = np.empty((length, len(state)), dtype=bool)
    limit = np.uint64(math.ceil(share * 2.0**53))
    for i in range(length):
        high = _next(state)
        state = _next(high)
        out[i] = ((high & np.uint64(2**26 - 1)) << np.uint64(27)) + (state & np.uint64(2**27 - 1)) < limit
    return out.T.ravel()[:n], int(jumps.after(2 * n, first)[0])


# --- split candidates ----------------------------------------------------------------------------

def thresholds(values: np.ndarray, n_sampled: float, most: int) -> np.ndarray:
    """Split candidates of one feature, at most ``most``, about equally many rows apart.

    ``n_sampled`` is the expected size of the sample ``values`` come from; what it exceeds the other values by are zeros.
    """
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.empty(0)
    counts, n = counts.astype(float), int(counts.sum())
    if n_sampled - n > EPSILON * n * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, n_sampled - n)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = target = n_sampled / (most + 1)
    chosen, current = [], counts[0]
    for i in range(1, len(found)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


def _sampled(vectors: DataFrame, fraction: float, seed: int) -> np.ndarray:
    """The rows in which ``spark.ml`` looks for split candidates (all where ``fraction`` is 1), as a matrix."""
    if fraction < 1:
        first = int(_next(np.array([start_state(seed)], dtype=np.uint64))[0]) & 0xFFFFFFFF
        rows = vectors._jdf.javaRDD().sample(False, fraction, first - (first >> 31 << 32))
        spark = vectors.sparkSession
        vectors = DataFrame(spark._jsparkSession.createDataFrame(rows, vectors._jdf.schema()), spark)
    return np.array([r[0] for r in vectors.select(vector_to_array("features")).collect()])


# --- the rounds ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """What every task needs to know: the estimator's parameters and the split candidates of each feature."""

    rounds: int
    depth: int
    rate: float
    share: float
    seed: int
    min_rows: int
    min_gain: float
    exact: bool
    splits: list[np.ndarray]

    @property
    def bins(self) -> int:
        return max(len(s) for s in self.splits) + 1


@dataclass
class Node:
    """A node by its number in a full tree (the root is 1). ``stats`` are count, sum and sum of squares."""

    number: int
    stats: np.ndarray | None = None
    impurity: float = 0.0
    leaf: bool = False
    gain: float = -1.0
    feature: int = -1
    split: int = -1


def _impurity(stats: np.ndarray) -> np.ndarray:
    n, s, q = stats
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def _value(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


@dataclass
class Paths:
    """A tree as arrays by node number: the feature and bin where rows part, the left node below, and the value.

    Below a leaf is the leaf itself, and no bin is beyond its split."""

    feature: np.ndarray
    split: np.ndarray
    below: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node every row of a block (features × rows) comes to."""
        n = bins.shape[1]
        flat, column = bins.reshape(-1), np.arange(n)
        at = np.ones(n, dtype=np.intp)
        for _ in range(levels):
            value = flat[self.feature[at] * n + column]
            at = self.below[at] + (value > self.split[at])
        return at


def _paths(tree: dict[int, Node], plan: Plan) -> Paths:
    size = 2 ** (plan.depth + 1)
    out = Paths(np.zeros(size, np.intp), np.full(size, 255, np.uint8), np.arange(size), np.zeros(size))
    for n in tree.values():
        out.value[n.number] = 0.0 if n.stats is None else _value(n.stats)
        if n.feature >= 0:
            out.feature[n.number], out.split[n.number], out.below[n.number] = n.feature, n.split, 2 * n.number
    return out


def _first_state(blocks: Iterable[tuple], plan: Plan) -> Iterator[tuple]:
    return _next_state(((b, (np.zeros(b[1]).tobytes(), b"")) for b in blocks), plan, 0, None)


def _next_state(blocks: Iterable[tuple], plan: Plan, number: int, before: Paths | None) -> Iterator[tuple]:
    """Predictions with the tree ``before``, and which rows round ``number`` picks, for every block."""
    part, state, jumps = None, None, Jumps()
    for (block_part, n, _, bins), (prediction, _) in blocks:
        now = np.frombuffer(prediction)
        if before:
            nodes = before.nodes(np.frombuffer(bins, np.uint8).reshape(-1, n), plan.depth)
            now = now + before.value[nodes] * (1.0 if number == 1 else plan.rate)
        if part != block_part:
            part, state = block_part, start_state(plan.seed + number + block_part + 1)
        if plan.share < 1:
            picked, state = picks(state, n, plan.share, jumps)
        else:
            picked = np.ones(n, dtype=bool)
        yield now.tobytes(), picked.tobytes()


def _added(total: np.ndarray | None, sums: np.ndarray | None) -> np.ndarray | None:
    return sums if total is None else total + sums


def _level_sums(blocks: Iterable[tuple], plan: Plan, number: int, paths: Paths, depth: int, slots: np.ndarray) -> Iterator[bytes]:
    """Count, sum and sum of squares of the targets: 3 × open nodes × features × bins.

    ``slots`` gives each node number its place among the open nodes, -1 for others. Sums of a part grow row by row, also
    over blocks, so they are rounded as if its rows were added one after the other.
    """
    n_features, width = len(plan.splits), plan.bins
    cells = (int(slots.max()) + 1) * width
    total, part, sums = None, None, None
    for (block_part, n, label, raw), (prediction, picked) in blocks:
        if part != block_part:
            total = _added(total, sums)
            part, sums = block_part, np.zeros((3, n_features, cells))
        target = np.frombuffer(label)
        if number:
            target = 2.0 * (target - np.frombuffer(prediction))
        bins = np.frombuffer(raw, np.uint8).reshape(n_features, n)
        slot = slots[paths.nodes(bins, depth)]
        counted = np.flatnonzero((slot >= 0) & np.frombuffer(picked, bool))
        for at in range(0, len(counted), CHUNK_ROWS):
            rows = counted[at:at + CHUNK_ROWS]
            y, base = target[rows], slot[rows] * width
            index, values = np.empty(cells + len(rows), np.int64), np.empty(len(rows), np.int64)
            index[:cells] = np.arange(cells)
            weights = np.empty((2, cells + len(rows)))
            weights[0, cells:], weights[1, cells:] = y, y * y
            for f in range(n_features):
                np.copyto(values, bins[f][rows])
                np.add(base, values, out=index[cells:])
                weights[:, :cells] = sums[1:, f]  # so the sums go on where they were
                sums[0, f] += np.bincount(index[cells:], minlength=cells)
                sums[1, f] = np.bincount(index, weights[0], cells)
                sums[2, f] = np.bincount(index, weights[1], cells)
    if part is not None:
        yield _added(total, sums).tobytes()


def _split(node: Node, sums: np.ndarray, plan: Plan, last: bool) -> list[Node]:
    """Find the best split of a node from its sums (3 × features × bins); returns its children."""
    left = np.cumsum(sums, axis=2)
    right = left[:, :, -1:] - left
    n_splits = np.array([len(s) for s in plan.splits])
    if node.stats is None:
        first = int(np.argmax(n_splits > 0))  # the root is summed up from its first candidate
        node.stats = left[:, first, 0] + right[:, first, 0]
        node.impurity = float(_impurity(node.stats))
    n_left, n_right = left[0], right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        n = n_left + n_right
        gains = node.impurity - n_left / n * _impurity(left) - n_right / n * _impurity(right)
    gains[(n_left < plan.min_rows) | (n_right < plan.min_rows) | (gains < plan.min_gain)] = _LOWEST
    gains[np.arange(plan.bins) >= n_splits[:, None]] = -np.inf  # no candidates
    feature, split = divmod(int(np.argmax(gains)), plan.bins)
    gain = float(gains[feature, split])
    if gain <= 0:
        node.leaf = True
        if gain <= _LOWEST:
            node.impurity = -1.0  # as spark.ml marks it
        return []
    node.gain, node.feature, node.split = gain, feature, split
    children = []
    for side, stats in enumerate((left[:, feature, split], right[:, feature, split])):
        impurity = float(_impurity(stats))
        children.append(Node(2 * node.number + side, stats, impurity, last or abs(impurity) < EPSILON))
    return children


def _counted(level: list[Node], plan: Plan) -> list[Node]:
    """The nodes whose rows are added up: all, or in large tables not the larger of two siblings."""
    if plan.exact:
        return level
    sizes = {n.number: n.stats[0] for n in level if n.stats is not None}
    return [n for n in level if n.number ^ 1 not in sizes or (sizes[n.number], n.number) < (sizes[n.number ^ 1], n.number ^ 1)]


def _tree(blocks: RDD, plan: Plan, number: int) -> dict[int, Node]:
    level = [Node(1)]
    tree, sums = {1: level[0]}, {}
    for depth in range(plan.depth):
        counted, above = _counted(level, plan), sums
        slots = np.full(2 ** (plan.depth + 1), -1)
        slots[[n.number for n in counted]] = range(len(counted))
        task = partial(_level_sums, plan=plan, number=number, paths=_paths(tree, plan), depth=depth, slots=slots)
        total = None
        for text in blocks.mapPartitions(task).collect():
            total = _added(total, np.frombuffer(text).reshape(3, len(plan.splits), len(counted), plan.bins))
        sums = {n.number: total[:, :, i] for i, n in enumerate(counted)}
        sums |= {n.number: above[n.number // 2] - sums[n.number ^ 1] for n in level if n.number not in sums}
        level = [c for n in level for c in _split(n, sums[n.number], plan, depth + 1 == plan.depth)]
        tree |= {n.number: n for n in level}
        level = [n for n in level if not n.leaf]
        if not level:
            break
    return tree


def _trees(spark: SparkSession, held: RDD, plan: Plan) -> Iterator[dict[int, Node]]:
    """One tree per round. Predictions and picks of the rows are kept beside the blocks and replaced in every round."""
    state = _one_by_one(held.mapPartitions(partial(_first_state, plan=plan)))
    old_file = None
    for number in range(plan.rounds):
        state.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if number and number % CHECKPOINT_ROUNDS == 0:
            state.checkpoint()
        blocks = held.zip(state)
        tree = _tree(blocks, plan, number)
        if number:
            before.unpersist()
        if state.isCheckpointed():
            if old_file:
                remove(spark, old_file)
            old_file = state.getCheckpointFile()
        step = partial(_next_state, plan=plan, number=number + 1, before=_paths(tree, plan))
        before, state = state, _one_by_one(blocks.mapPartitions(step))
        yield tree
    before.unpersist()
    if old_file:
        remove(spark, old_file)


# --- in and out ----------------------------------------------------------------------------------

def _saved_nodes(number: int, tree: dict[int, Node], plan: Plan) -> list[tuple]:
    """The nodes in depth-first order as ``spark.ml`` stores them; leaves of one value are one leaf."""

    def pruned(at: int) -> bool:
        if not tree[at].leaf and all([pruned(2 * at), pruned(2 * at + 1)]):
            if _value(tree[2 * at].stats) == _value(tree[2 * at + 1].stats):
                tree[at].leaf = True
        return tree[at].leaf

    rows: list[tuple] = []

    def add(at: int) -> int:
        n, place = tree[at], len(rows)
        rows.append(())
        below = (-1, -1) if n.leaf else (add(2 * at), add(2 * at + 1))
        split = (-1, [], -1) if n.leaf else (n.feature, [float(plan.splits[n.feature][n.split])], -1)
        stats = [float(x) for x in n.stats]
        rows[place] = (place, _value(n.stats), n.impurity, stats, int(stats[0]), -1.0 if n.leaf else n.gain, *below, split)
        return place

    pruned(1)
    add(1)
    return [(number, r) for r in rows]


def _one_by_one(rdd: RDD) -> RDD:
    """Elements pickled one at a time: such tables are zipped without passing through Python."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _binned(batches: Iterable[pa.RecordBatch], splits: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: the partition they are in, their number, labels, and bins by feature."""
    part = TaskContext.get().partitionId()

    def block(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        label, bins = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows], axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(label)], pa.int32()), pa.array([label.tobytes()], pa.binary()),
             pa.array([bins.tobytes()], pa.binary())], ["part", "n", "label", "bins"])

    taken: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isfinite(values).all() or np.isnan(label).any():  # spark.ml refuses them too
                raise ValueError("features must not be NULL, NaN or infinite, labels must not be NULL or NaN")
            bins = np.stack([np.searchsorted(s, values[:, f]).astype(np.uint8) for f, s in enumerate(splits)])
            taken.append((label, bins))
        if sum(len(r[0]) for r in taken) >= BLOCK_ROWS:
            yield block(taken)
            taken = []
    if taken:
        yield block(taken)


def _model(spark: SparkSession, booster: GBTRegressor, nodes: list[tuple], n_features: int) -> GBTRegressionModel:
    """A model read from its stored form, whose layout is copied from a model of one leaf."""
    zeros = spark.range(2).select(
        array_to_vector(F.array_repeat(F.lit(0.0), n_features)).alias("features"), F.lit(0.0).alias(booster.getLabelCol())
    )
    with Workspace(spark, "model") as work:
        sample, path = work.path("sample"), work.path("trees")
        booster.copy({booster.maxIter: 1}).fit(zeros).write().save(sample)
        about = json.loads(spark.read.text(f"{sample}/metadata").first()[0])
        about["paramMap"]["maxIter"] = about["numTrees"] = booster.getMaxIter()
        text = json.dumps(about).replace("'", "''")
        spark.sql(f"SELECT r'{text}' AS value").coalesce(1).write.text(f"{path}/metadata")
        layout = spark.read.parquet(f"{sample}/data").schema
        spark.createDataFrame(nodes, layout).coalesce(1).write.parquet(f"{path}/data")
        trees = spark.read.parquet(f"{sample}/treesMetadata")
        one = trees.first()[1]
        weights = [(i, one, 1.0 if i == 0 else booster.getStepSize()) for i in range(booster.getMaxIter())]
        spark.createDataFrame(weights, trees.schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
        return GBTRegressionModel.load(path)


def fit(booster: GBTRegressor, vectors: DataFrame) -> GBTRegressionModel:
    """What ``booster.fit`` returns for its features and label in ``vectors``, which are read three times.

    With more bins than a byte holds, ``spark.ml`` fits itself.
    """
    spark = vectors.sparkSession
    columns = [booster.getFeaturesCol(), booster.getLabelCol()]
    vectors = vectors.select(*columns).toDF("features", "label")
    n = vectors.count()
    most = min(booster.getMaxBins(), n)
    if most > 256:
        return booster.fit(vectors.toDF(*columns))
    wanted = max(most * most, SAMPLE_ROWS)
    fraction = wanted / n if wanted < n else 1.0
    sample = _sampled(vectors, fraction, booster.getSeed())
    splits = [thresholds(sample[:, f], fraction * n, most - 1) for f in range(sample.shape[1])]
    plan = Plan(booster.getMaxIter(), booster.getMaxDepth(), booster.getStepSize(), booster.getSubsamplingRate(),
                booster.getSeed(), booster.getMinInstancesPerNode(), booster.getMinInfoGain(), n <= EXACT_ROWS, splits)
    shared_folder(spark)  # for checkpoints
    arrays = vectors.select(vector_to_array("features").alias("features"), F.col("label").cast("double").alias("label"))
    blocks = arrays.mapInArrow(partial(_binned, splits=splits), "part int, n int, label binary, bins binary").rdd
    # Starting a task in Python takes longer than adding up some ten thousand rows, so there are few tasks.
    blocks = blocks.coalesce(min(blocks.getNumPartitions(), max(spark.sparkContext.defaultParallelism, n // TASK_ROWS)))
    held = _one_by_one(blocks.map(lambda b: (b[0], b[1], bytes(b[2]), bytes(b[3])))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    nodes = [row for i, tree in enumerate(_trees(spark, held, plan)) for row in _saved_nodes(i, tree, plan)]
    held.unpersist()
    return _model(spark, booster, nodes, len(splits))
