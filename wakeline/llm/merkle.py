"""Merkle manifest of a table: digests of rows, subroots per group, one root, and a proof for each row.

A leaf is the digest of a row's columns. The leaves of a group in their order are joined two by two, a last one
alone, until one digest is left: the group's subroot. The subroots, in the order of the groups, are joined alike into
the root. ``H`` is SHA-256 in lowercase hex of the concatenated inputs, digests among them as hex text.

Levels are built ``LEVELS`` at a time: ``2 ** LEVELS`` neighbours become one row with a bounded array, whose levels
are array expressions; the next round starts from the remaining nodes. Proofs come by pointer jumping: each node
begins with its sibling, the segment of the path to its parent. A round joins the table of nodes with itself, appends
to each segment that of the node it ends at, and so doubles its reach, until every leaf's segment ends at the top.
After each round only nodes at multiples of the reach are needed. Many leaves share one far ancestor; those are few,
and are broadcast after a check of their size, or else there are more keys than tasks.

Defined cases: a null column is written ``-``, so it differs from any value; a null group is a group of its own and
comes first; a null order value comes first, rows with equal order values are ordered by leaf; repeated rows are
leaves of their own; a group of one row has its leaf as subroot and an empty proof up to there; an empty table gives
an empty manifest; texts of any length are hashed whole inside the JVM; other columns never enter a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, at_most
from .order import positions

LEVELS = 10
BROADCAST_BYTES = 8_000_000
DIGEST_BYTES = 32
NODES = "array<struct<level: int, idx: long, sibling: binary>>"


def encoded(column: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    return digest(*map(encoded, columns))


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def _parents(nodes: Column) -> Column:
    """Digests of neighbours, two by two; the last one may be alone."""
    pairs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))))


def _node(nodes: Column, level: int, first: Column):
    """Of a node and its place in a chunk: level, number in the level, and the neighbour it is joined with."""
    return lambda x, i: F.struct(F.lit(level).alias("level"), (first + i).alias("idx"),
                                 F.unhex(F.get(nodes, i.bitwiseXOR(F.lit(1)))).alias("sibling"))


def build(work: Workspace, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``tree, idx, digest`` (hex; ``idx`` counts from 0 in each tree).

    Returns ``tree, root, height`` and, of all other nodes, ``tree, height, level, idx, sibling`` (binary; null where
    a node is alone)."""
    sizes = work.save(leaves.groupBy("tree").agg((F.max("idx") + 1).alias("size")), "sizes")
    height = F.ceil(F.log2(F.col("size").cast("double"))).cast("int")
    # The logarithm of a whole number may be off by a little: 2 ** height has to be at least size, and no more than needed.
    height = F.when(F.pow(F.lit(2.0), height) < F.col("size"), height + 1).when(
        F.pow(F.lit(2.0), height - 1) >= F.col("size"), height - 1).otherwise(height)
    sizes = sizes.select("tree", height.cast("int").alias("height"))
    few = at_most(sizes, 100_000)
    now = leaves.join(F.broadcast(sizes) if few else sizes, "tree").select("tree", "height", "idx", "digest")
    top, base, roots, siblings = sizes.agg(F.max("height")).first()[0] or 0, 0, [], []
    while True:
        chunk = F.shiftright("idx", LEVELS)
        rows = now.groupBy("tree", "height", chunk.alias("chunk")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("a0"))
        levels = min(LEVELS, max(top - base, 0))
        for k in range(1, levels + 1):
            rows = rows.withColumn(f"a{k}", F.when(F.col("height") >= base + k, _parents(F.col(f"a{k - 1}"))))
        rows = work.save(rows, "chunks")
        ends = F.array(*[F.col(f"a{k}") for k in range(levels + 1)])[F.col("height") - base]
        roots.append(rows.filter(F.col("height").between(base, base + levels)).select("tree", ends[0].alias("root"), "height"))
        found = []
        for k in range(levels):
            nodes = F.transform(F.col(f"a{k}"), _node(F.col(f"a{k}"), base + k, F.shiftleft("chunk", LEVELS - k)))
            found.append(F.when(F.col("height") > base + k, nodes).otherwise(F.array().cast(NODES)))
        if found:
            siblings.append(rows.select("tree", "height", F.explode(F.concat(*found)).alias("n")).select("tree", "height", "n.*"))
        base += LEVELS
        if top <= base:
            break
        now = rows.filter(F.col("height") > base).select("tree", "height", F.col("chunk").alias("idx"), F.col(f"a{LEVELS}")[0].alias("digest"))
    union = lambda tables: work.save(_union(tables), "trees")
    nodes = union(siblings) if siblings else work.save(rows.filter("false").selectExpr(
        "tree", "height", "0 AS level", "0L AS idx", "CAST(null AS BINARY) AS sibling"), "trees")
    return union(roots), nodes


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def proofs(work: Workspace, nodes: DataFrame) -> DataFrame:
    """``tree, idx, path`` of the leaves: siblings from the leaf up, null where a node is alone. A leaf that is its
    tree's root has no row."""
    top = nodes.agg(F.max("height")).first()[0] or 0
    now = nodes.withColumn("path", F.array("sibling")).drop("sibling")
    step = 1
    while step < top:
        low = now.filter(F.col("level") % (2 * step) == 0)
        far = now.filter(F.col("level") % (2 * step) == step).select(
            F.col("tree").alias("far_tree"), F.col("level").alias("far_level"), F.col("idx").alias("far_idx"),
            F.col("path").alias("rest"))
        few = at_most(far, BROADCAST_BYTES // (DIGEST_BYTES * 2 * step))
        met = low.join(F.broadcast(far) if few else far,
                       (F.col("tree") == F.col("far_tree")) & (F.col("level") + step == F.col("far_level"))
                       & (F.shiftright("idx", step) == F.col("far_idx")), "left")
        path = F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest"))
        now, step = work.save(met.select("tree", "height", "level", "idx", path.alias("path")), "jumps"), 2 * step
    return now.filter("level = 0").select("tree", "idx", "path")


def folded(start: Column, idx: Column, path: Column) -> Column:
    """The top that a node's digest (hex) and its siblings lead to."""
    state = F.struct(start.alias("h"), idx.cast("long").alias("i"))

    def step(s: Column, sibling: Column) -> Column:
        other = F.coalesce(_hex(sibling), F.lit(""))
        left = s["i"] % 2 == 1
        h = digest(F.when(left, other).otherwise(s["h"]), F.when(left, s["h"]).otherwise(other))
        return F.struct(h.alias("h"), F.shiftright(s["i"], 1).alias("i"))

    return F.aggregate(path, state, step, lambda s: s["h"])


def path_digest(path: Column) -> Column:
    """``H`` of the siblings of a path; where both have some, of the group's path and the path above it."""
    return digest(F.array_join(F.transform(F.filter(path, lambda x: x.isNotNull()), _hex), ""))


def manifest(work: Workspace, rows: DataFrame, group: str, order: str, part_rows: int = 200_000) -> DataFrame:
    """Add ``subroot``, ``root``, ``path`` (siblings up to the subroot), ``top_path`` (from there to the root), ``idx``
    and ``top_idx`` (places that say on which side a sibling stands) to ``rows``, which have a column ``leaf``."""
    rows = rows.withColumn("tree", encoded(F.col(group)))
    leaves = work.save(positions(work, rows, "tree", [order, "leaf"], "idx", part_rows), "leaves")
    subroots, nodes = build(work, leaves.select("tree", "idx", F.col("leaf").alias("digest")))
    paths = proofs(work, nodes)
    groups = work.save(leaves.select("tree", F.col(group).alias("_group")).distinct().join(subroots, "tree")
                       .select(F.lit("").alias("all"), F.col("tree").alias("name"), "_group", F.col("root").alias("digest")), "groups")
    groups = work.save(positions(work, groups, "all", ["_group"], "idx", part_rows), "groups")
    tops, above = build(work, groups.select(F.col("all").alias("tree"), "idx", "digest"))
    root = tops.first()
    above = proofs(work, above).select(F.col("idx").alias("top_idx"), F.col("path").alias("top_path"))
    none = F.array().cast("array<binary>")
    side = groups.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("idx").alias("top_idx")) \
        .join(above, "top_idx", "left").withColumn("top_path", F.coalesce("top_path", none))
    side = work.save(side, "groups")
    met = leaves.join(paths, ["tree", "idx"], "left").withColumn("path", F.coalesce("path", none))
    met = met.join(F.broadcast(side) if at_most(side, 10_000) else side, "tree")
    return met.withColumn("root", F.lit(root["root"] if root else None).cast("string")).drop("tree")


def verified(rows: DataFrame, leaf_column: Column) -> DataFrame:
    """Add ``folded_root``, recomputed from ``leaf_column`` and a row's siblings, and whether it is the root."""
    sub = folded(leaf_column, F.col("idx"), F.col("path"))
    return rows.withColumn("folded_root", folded(sub, F.col("top_idx"), F.col("top_path"))) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
