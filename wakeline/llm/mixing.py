"""Mixing sources by temperature, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected: it is the largest
one that reaches a target entropy, moved towards 1 until no source repeats more than a limit. Each source then has
a token target, and is read in epochs: every epoch is a permutation of the source's blocks, and of the documents in
each block, drawn by hash. All whole epochs are taken, and the last one up to the document that fills the target.

Where the last epoch stops is one key per source. It is found by summing tokens per block, then per part of the one
block in which the target falls, and only then per document, so no task orders a whole source. The documents
themselves are never shuffled: the table of sources (size checked) is broadcast.

Only DataFrame functions are used.

Defined cases: a null source is a source of its own; null texts have no tokens and follow their source's epochs;
rows of one id share a place in every permutation, so repeated rows are taken together; a source without tokens is
taken once; without a budget the least repeated source is kept whole exactly once and no document is lost; an
empty table gives an empty result; all other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Workspace, at_most

STEPS = 60  # of the bisection
HIGHEST = 1.0  # mixing only ever flattens the shares
DEPTHS = (3, 6, 9)  # leading digits of a key that the three rounds of sums look at; the first is the block
BROADCAST_SOURCES = 50_000
AT_ONCE = 6  # steps of the bisection that one round of sums decides


@dataclass
class Plan:
    """Exponent and token budget of a mixture, and its sources: ``source, tokens, weight, target, epochs, cut``."""

    exponent: float
    budget: float
    sources: DataFrame
    few: bool = True  # whether ``sources`` may be broadcast


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in one epoch of its source: three digits for its block, then its own."""
    block = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:block"), doc_id.cast("string"))), 1, 2)
    turn = F.concat_ws(":", F.lit(seed), epoch.cast("string"), block)
    own = F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), doc_id.cast("string")))
    return F.concat(F.substring(F.md5(turn), 1, 3), own)


def _bisect(shares: Column, wrong) -> Column:
    """Smallest exponent that is not ``wrong(exponent)``, which must hold below it only."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(HIGHEST).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc.lo + acc.hi) / 2
        bad = wrong(mid)
        return F.struct(F.when(bad, mid).otherwise(acc.lo).alias("lo"), F.when(bad, acc.hi).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc.hi)
    return F.when(wrong(F.lit(0.0)), found).otherwise(F.lit(0.0))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def _entropy(shares: Column, a: Column) -> Column:
    z = _sum(shares, lambda p: F.pow(p, a))
    return F.log(z) - a * _sum(shares, lambda p: F.pow(p, a) * F.log(p)) / z


def _halved(wrong_at) -> float:
    """The bisection of ``_bisect`` with ``wrong_at``, which judges a list of exponents at once."""
    if not wrong_at([0.0])[0]:
        return 0.0
    low, high, cells = 0.0, HIGHEST, 1 << AT_ONCE
    for _ in range(STEPS // AT_ONCE):
        bad = wrong_at([low + (high - low) * k / cells for k in range(1, cells)])
        a, b = 0, cells
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if bad[mid - 1] else (a, mid)
        low, high = low + (high - low) * a / cells, low + (high - low) * b / cells
    return high


def _exponent_by_sums(sources: DataFrame, entropy: float | None, max_repetition: float | None) -> tuple[float, float, float, float] | None:
    """``exponent`` for any number of sources: only sums over them reach the driver."""
    tokens = F.col("tokens").cast("double")
    real = sources.filter("tokens > 0")
    total, least, most, count = real.agg(F.sum(tokens), F.min(tokens), F.max(tokens), F.count("*")).first()
    if not count:
        return None
    p = tokens / total

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        powers = [F.pow(p, F.lit(e)) for e in exponents]
        row = real.agg(*[F.sum(x) for x in powers], *[F.sum(x * F.log(p)) for x in powers]).first()
        return list(zip(row[:len(exponents)], row[len(exponents):], strict=True))

    def too_even(exponents: list[float]) -> list[bool]:
        return [math.log(z) - e * s / z > entropy * math.log(count) for e, (z, s) in zip(exponents, sums(exponents), strict=True)]

    a = 0.0 if entropy is not None or max_repetition is not None else 1.0
    if entropy is not None:
        a = _halved(too_even)
    if max_repetition is not None:
        a = max(a, min(1.0, _halved(lambda exponents: [(least / most) ** (e - 1) > max_repetition for e in exponents])))
    return a, sums([a])[0][0], most / total, most


def exponent(sources: DataFrame, entropy: float | None, max_repetition: float | None) -> tuple[float, float, float] | None:
    """Exponent, its normaliser and the largest share, from one row of all token counts.

    ``entropy`` is a share of the largest possible one. The row holds one number per source.
    """
    row = sources.filter("tokens > 0").agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    row = row.withColumn("p", F.transform("t", lambda x: x / _sum(F.col("t"), lambda y: y)))
    a = F.lit(0.0 if entropy is not None or max_repetition is not None else 1.0)
    p = F.col("p")
    if entropy is not None:
        # Entropy falls with the exponent, so the largest exponent that reaches the target is where it fails.
        target = F.lit(entropy) * F.log(F.size(p).cast("double"))
        a = _bisect(p, lambda e: _entropy(p, e) > target)
    if max_repetition is not None:
        least, most = F.element_at(p, 1), F.element_at(p, -1)
        a = F.greatest(a, F.least(F.lit(1.0), _bisect(p, lambda e: F.pow(least / most, e - 1) > max_repetition)))
    row = row.filter(F.size("p") > 0).withColumn("a", a)
    found = row.select("a", _sum(p, lambda x: F.pow(x, F.col("a"))), F.element_at(p, -1), F.element_at("t", -1)).first()
    return tuple(found) if found else None


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _stops(docs: DataFrame, sources: DataFrame, work: Workspace, seed: int, few: bool) -> DataFrame:
    """``source, cut``: the first key that the last epoch no longer takes, for sources with a partial epoch."""
    wanted = sources.filter("rest > 0").select("source", "epochs", "rest")
    rows = docs.join(_small(wanted, few), docs["source"].eqNullSafe(wanted["source"])).select(
        docs["source"], order_key(F.col("doc_id"), F.col("epochs"), seed).alias("key"), "tokens", "rest")
    rows = work.save(rows, "keys")
    for depth in DEPTHS:
        part = F.substring("key", 1, depth).alias("part")
        sums = rows.groupBy("source", "rest", part).agg(F.sum("tokens").alias("tokens"))
        before = F.sum("tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("tokens")
        edge = sums.withColumn("before", before).filter("before < rest AND before + tokens >= rest")
        edge = work.save(edge.select(F.col("source").alias("s"), "part", "before"), "edge")
        inside = rows["source"].eqNullSafe(edge["s"]) & (F.substring(rows["key"], 1, depth) == edge["part"])
        rows = work.save(rows.join(_small(edge, few), inside).select(
            "source", "key", "tokens", (F.col("rest") - F.col("before")).alias("rest")), "keys")
    order = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.withColumn("through", F.sum("tokens").over(order)).filter("through >= rest")
    return last.groupBy("source").agg(F.min("key").alias("cut"))


def plan(docs: DataFrame, work: Workspace, entropy: float | None = None, max_repetition: float | None = None,
         budget: float | None = None, seed: int = 0) -> Plan:
    """``docs`` has ``doc_id``, ``source`` and ``tokens``."""
    sources = work.save(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    few = at_most(sources, BROADCAST_SOURCES)
    a, z, most, largest = (exponent if few else _exponent_by_sums)(sources, entropy, max_repetition) or (1.0, 1.0, 1.0, 0.0)
    total = largest / most if most else 0.0
    if budget is None:
        budget = _least_repeated(sources, a, z, total)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(a)) / z).otherwise(0.0)
    target = F.round(F.col("weight") * budget).cast("long")
    sources = sources.withColumn("weight", weight).withColumn("target", target)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1)
    sources = sources.withColumn("epochs", epochs.cast("long"))
    rest = F.when(F.col("tokens") > 0, F.col("target") - F.col("epochs") * F.col("tokens")).otherwise(0)
    sources = work.save(sources.withColumn("rest", rest), "targets")
    stops = work.save(_stops(docs, sources, work, seed, few).withColumnRenamed("source", "s"), "stops")
    met = sources.join(_small(stops, few), sources["source"].eqNullSafe(stops["s"]), "left").drop("s")
    return Plan(a, budget, work.save(met, "mixture"), few)


def _least_repeated(sources: DataFrame, a: float, z: float, total: float) -> float:
    """Budget at which the source with the fewest repetitions is read once."""
    need = F.col("tokens") * z / F.pow(F.col("tokens") / total, F.lit(a))
    return sources.filter("tokens > 0").agg(F.max(need)).first()[0] or 0.0


def taken(docs: DataFrame, mixture: Plan, seed: int = 0) -> DataFrame:
    """``docs`` with ``copies``, how often each document is read; rows read zero times stay with 0."""
    table = mixture.sources.select(F.col("source").alias("_source"), "epochs", "cut")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    met = rows.join(_small(table, mixture.few), rows["source"].eqNullSafe(table["_source"]))
    more = F.when(F.col("cut").isNotNull() & (order_key(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epochs"), seed) <= F.col("cut")), 1)
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copies"],
                      (F.col("epochs") + F.coalesce(more, F.lit(0))).cast("long").alias("copies"))


def mix(docs: DataFrame, entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None,
        seed: int = 0, text: str = "text", work: Workspace | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``source``, a text) with ``copies`` added."""
    work = work or Workspace(docs.sparkSession, "mixing")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = work.save(docs.select(key.alias("doc_id"), "source", n_tokens(F.col(text)).alias("tokens")), "tokens")
    return taken(docs, plan(narrow, work, entropy, max_repetition, budget, seed), seed)
