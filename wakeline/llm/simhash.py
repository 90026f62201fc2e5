"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 majority bits of word-shingle hashes. Two fingerprints link at ``budget`` or fewer
differing bits. If the bits are cut into ``blocks`` runs, ``blocks - budget`` of them agree in every link, so
each choice of that many runs gives one trie in which the chosen bits come first: links of that trie lie below
one node at the depth of the chosen bits. From there, pairs of nodes are traversed together: children of equal
bits keep the number of differing bits, children of unequal bits add one, and pairs beyond the budget are
pruned. Spark traverses nodes with more than ``leaves`` fingerprints and distributes the remaining node pairs;
within a task numpy traverses all its pairs level by level. Each node pair reports its links as one edge per
fingerprint to the smallest of its connected group, so a group of near copies never becomes all its pairs.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal fingerprints are one
trie leaf; rows with the same id count as one document; rows without an id get a component only through
others; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace
from .bpe import _map_column
from .graph import components

SEED = 42


def _majority(text: str, size: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.encode().lower().split()  # ASCII only: A-Z and the six ASCII spaces
    if not words:
        return 0
    size = min(size, len(words))
    n = len(words) - size + 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for texts of any length
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[at:at + 65536], stops[at:at + 65536])),
                        "<u8", min(65536, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Add ``fp``, the signed 64-bit fingerprint of shingles of ``size`` words."""

    def make():
        return lambda values: [pa.array([_majority(v or "", size) for v in values], pa.int64())]

    return _map_column(df, text, [T.StructField("fp", T.LongType())], make)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _tries(blocks: int, budget: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Per trie: the number of leading exact bits, and the runs (shift, width) of the fingerprint in order."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    runs = [(64 - cut[i + 1], cut[i + 1] - cut[i]) for i in range(blocks)]
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - budget):
        order = [runs[i] for i in chosen] + [runs[i] for i in range(blocks) if i not in chosen]
        out.append((sum(runs[i][1] for i in chosen), order))
    return out


def _reordered(fp: Column, order: list[tuple[int, int]]) -> Column:
    """Bits of the fingerprint in the order of one trie."""
    out, left = None, 64
    for shift, width in order:
        left -= width
        piece = F.shiftleft(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)), left)
        out = piece if out is None else out.bitwiseOR(piece)
    return out


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = parent[x]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; the smaller index is the root."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        go = a != b
        low, high = np.minimum(a, b)[go], np.maximum(a, b)[go]
        np.minimum.at(parent, high, low)
        a, b = low, high


def _join_tries(keys: np.ndarray, pairs: np.ndarray, budget: int, parent: np.ndarray, chunk: int = 1 << 18) -> None:
    """Traverse node pairs together and unite the leaves of every link.

    ``keys`` holds sorted leaves of each node side by side. A row of ``pairs`` is (from, to, from, to, errors,
    depth): two ranges of leaves below one node each, equal for a node with itself.
    """
    todo = [pairs]
    while todo:
        p = todo.pop()
        if len(p) > chunk:
            todo += [p[i:i + chunk] for i in range(0, len(p), chunk)]
            continue
        a0, a1, b0, b1, err, depth = p.T
        na, nb = a1 - a0, b1 - b0
        same = a0 == b0
        few = na * nb <= 16  # test the leaves themselves
        if few.any():
            i = np.repeat(np.flatnonzero(few), (na * nb)[few])
            k = np.arange(len(i)) - np.repeat(np.cumsum((na * nb)[few]) - (na * nb)[few], (na * nb)[few])
            x, y = a0[i] + k // nb[i], b0[i] + k % nb[i]
            ok = (x < y) | ~same[i]
            x, y = x[ok], y[ok]
            link = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            _union(parent, x[link], y[link])
        p, same = p[~few], same[~few]
        if not len(p):
            continue
        bit = np.uint64(1) << (63 - p[:, 5]).astype(np.uint64)
        split_a = _cut(keys, p[:, 0], p[:, 1], bit)
        split_b = np.where(same, split_a, _cut(keys, p[:, 2], p[:, 3], bit))
        nxt = p[:, 5] + 1
        out = []
        for (l0, l1), (r0, r1), more in (
            ((p[:, 0], split_a), (p[:, 2], split_b), 0), ((split_a, p[:, 1]), (split_b, p[:, 3]), 0),
            ((p[:, 0], split_a), (split_b, p[:, 3]), 1), ((split_a, p[:, 1]), (p[:, 2], split_b), 1),
        ):
            keep = (l1 > l0) & (r1 > r0) & (p[:, 4] + more <= budget)
            if more and l0 is split_a:
                keep &= ~same  # mirror image of the other mixed pair
            if not more:
                keep &= ~(same & (l1 - l0 == 1))
            out.append(np.stack([l0, l1, r0, r1, p[:, 4] + more, nxt], axis=1)[keep])
        todo.append(np.concatenate(out))


def _cut(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First leaf of each sorted range that has the bit, by bisection."""
    lo, hi = low.copy(), high.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        has = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & has, mid, hi)
        lo = np.where(open_ & ~has, mid + 1, lo)


def _local_links(budget: int):
    """Links of the node pairs of one task; rows arrive sorted by node pair, side and key."""

    def changes(where, left, right) -> np.ndarray:
        new = (where[1:] != where[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1))

    def solve(where, left, right, side, key, doc, err, depth):
        start = changes(where, left, right)
        stop = np.append(start[1:], len(key))
        ones = np.concatenate(([0], np.cumsum(side)))
        mid = stop - (ones[stop] - ones[start])  # side 1 begins here; a node with itself has side 0 only
        alone = mid == stop
        pairs = np.stack([start, mid, np.where(alone, start, mid), stop, err[start], depth[start]], axis=1)
        parent = np.arange(len(key))
        _join_tries(key.view(np.uint64), pairs, budget, parent)
        root = _find(parent, np.arange(len(key)))
        linked = root != np.arange(len(key))
        return pa.RecordBatch.from_arrays([pa.array(doc[linked]), pa.array(doc[root[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            begin = int(changes(*held[:3])[-1])  # the last node pair may go on in the next batch
            if begin:
                yield solve(*(c[:begin] for c in held))
                held = [c[begin:] for c in held]
        if held is not None:
            yield solve(*held)

    return run


def links(work: Workspace, leaves: DataFrame, budget: int = 3, blocks: int | None = None,
          node_leaves: int = 1024, step: int = 4) -> DataFrame:
    """Edges ``(a, b)`` that connect all linked fingerprints; ``leaves`` has distinct ``fp`` and their ``doc``.

    ``blocks`` is chosen from the number of fingerprints so that a trie node holds few of them on average.
    Nodes with more than ``node_leaves`` are split ``step`` bits at a time.
    """
    if blocks is None:
        n = max(1, leaves.count())
        blocks = next((m for m in range(budget + 1, budget + 4)
                       if n / 2 ** (64 * (m - budget) // m) <= node_leaves / 2), budget + 3)
    tries = _tries(blocks, budget)
    depth = min(d for d, _ in tries)
    keyed = F.array(*[F.struct(F.lit(i).alias("trie"), _reordered(F.col("fp"), order).alias("key"))
                      for i, (_, order) in enumerate(tries)])
    keyed = leaves.select("doc", F.explode(keyed).alias("k")).select("doc", "k.trie", "k.key")

    def node(at: int) -> Column:
        return F.shiftrightunsigned("key", 64 - at) if at < 64 else F.col("key")

    count = keyed.groupBy("trie", node(depth).alias("node")).count().filter("count > 1")
    count = work.save(count, "nodes")
    pairs = count.select("trie", F.col("node").alias("left"), F.col("node").alias("right"),
                         F.lit(0).alias("err"), F.lit(depth).alias("depth"),
                         F.col("count").alias("n_left"), F.col("count").alias("n_right"))
    big = (F.col("n_left") + F.col("n_right") > 2 * node_leaves) & (F.col("depth") < 64)
    units = []
    while True:
        units.append((depth, pairs.filter(~big)))
        large = pairs.filter(big)
        if large.isEmpty():
            break
        # Traverse one step of the large nodes: their children, and the pairs of children within the budget.
        large = work.save(large.drop("n_left", "n_right", "depth"), "large")
        width = min(step, 64 - depth)
        nodes = large.select("trie", F.explode(F.array("left", "right")).alias("up")).distinct()
        child = (keyed.withColumn("up", node(depth)).join(nodes, ["trie", "up"], "left_semi")
                 .groupBy("trie", node(depth + width).alias("node")).count()
                 .withColumn("up", F.shiftrightunsigned("node", width)))
        child = work.save(child, "children")
        lower = child.select("trie", F.col("up").alias("left"), F.col("node").alias("l"), F.col("count").alias("nl"))
        upper = child.select("trie", F.col("up").alias("right"), F.col("node").alias("r"), F.col("count").alias("nr"))
        depth += width
        new = F.lit((1 << width) - 1)  # bits of this step; the ones before are counted in err
        pairs = (large.join(lower, ["trie", "left"]).join(upper, ["trie", "right"])
                 .filter((F.col("left") != F.col("right")) | (F.col("l") <= F.col("r")))
                 .withColumn("err", F.col("err") + F.bit_count(F.col("l").bitwiseXOR(F.col("r")).bitwiseAND(new)))
                 .filter(F.col("err") <= budget)
                 .select("trie", F.col("l").alias("left"), F.col("r").alias("right"), "err",
                         F.lit(depth).alias("depth"), F.col("nl").alias("n_left"), F.col("nr").alias("n_right"))
                 .filter("left <> right OR n_left > 1"))
        pairs = work.save(pairs, "pairs")
    parts = []
    first = F.struct(F.col("left").alias("node"), F.lit(0).alias("side"))
    second = F.struct(F.col("right").alias("node"), F.lit(1).alias("side"))
    for at, unit in units:
        # One row per node of a pair: side 0, and side 1 where the two nodes differ.
        sides = unit.select(
            "trie", "err", "depth", (F.col("trie") * 128 + F.col("depth")).cast("long").alias("place"), "left", "right",
            F.explode(F.when(F.col("left") == F.col("right"), F.array(first)).otherwise(F.array(first, second))).alias("s"),
        ).select("trie", "err", "depth", "place", "left", "right", "s.node", "s.side")
        parts.append(keyed.withColumn("node", node(at)).join(sides, ["trie", "node"]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("place", "left", "right", F.col("side").cast("long"), "key", "doc", F.col("err").cast("long"),
                       F.col("depth").cast("long"))
    pair = ["place", "left", "right"]
    ordered = rows.repartition(*pair).sortWithinPartitions(*pair, "side", F.shiftrightunsigned("key", 1),
                                                           F.col("key").bitwiseAND(F.lit(1)))
    return ordered.mapInArrow(_local_links(budget), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 3,
                    work: Workspace | None = None) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the smallest id reachable by links) of each row."""
    work = work or Workspace(df.sparkSession, "simhash")
    rows = work.save(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", size)
                     .drop("text"), "fingerprints")
    # Smallest id of each fingerprint, and of each id over its fingerprints.
    leaves = work.save(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc")), "leaves")
    # An id with several fingerprints joins them: edges from the smallest doc of each to the id.
    named = rows.filter("doc_id IS NOT NULL")
    several = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("doc_id")
    same = named.join(several, "doc_id").join(leaves, "fp").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    found = links(work, leaves, budget).unionByName(same)
    group = work.save(components(work, found), "components")
    of_fp = leaves.join(group, leaves["doc"] == group["node"], "left").select(
        "fp", F.coalesce("component", "doc").alias("component_id"))
    return rows.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")
