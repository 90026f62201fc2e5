"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

The filter is a table of blocks of 256 bits, one row per block that is in use. A URL's first hash picks its block,
its second hash eight bits in it, so one lookup by block decides whether a URL can be listed. Possible hits alone
go through an exact join on the canonical URL, which removes the false positives; all other rows are never
shuffled while the filter is below ``BROADCAST_BLOCKS`` blocks (its number of blocks is known from the list's
size, about 40 bytes each). Above that bound the filter is joined by block number instead.

Only DataFrame functions are used.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is never listed;
null list entries are ignored and repeated ones count once; an empty list allows everything no rule decides;
repeated rows are judged alike; all other columns pass through, and columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
PROBES = 8
BLOCK_BITS = 256
BROADCAST_BLOCKS = 1_000_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling per page: no scheme, ``www.`` or ``m.``, trailing slashes, fragment or ``utm_`` parameters;
    parameters sorted. Null where there is no host."""
    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    bare = F.regexp_replace(host(url), "^(www|m)[.]", "")
    text = F.concat(bare, F.rtrim(path(url), F.lit("/")), F.array_join(F.transform(kept, lambda x: F.concat(F.lit("?"), x)), ""))
    return F.when(host(url) != "", text)


def _rule(rules: list[tuple[str, str, str]], value) -> Column:
    """First fitting rule in order of length, longest first."""
    out = F.lit(None).cast("string")
    for name, start, act in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        out = F.when(fits, F.lit(value(name, start, act))).otherwise(out)
    return out


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and its bits in the block as four longs."""
    second = F.xxhash64(F.lit("bits"), url)
    words = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for i in range(PROBES):
            place = F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1))
            one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(place, 6) == w, one).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return F.pmod(F.xxhash64(url), F.lit(blocks)), words


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocks in use, ``(block, w0 .. w3)``, of the distinct ``canonical`` URLs."""
    block, words = _bits(F.col("canonical"), blocks)
    rows = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(len(words))])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``: the longest fitting rule's, else ``block`` where listed."""
    known = listed.select(canonical(F.col("url")).alias("canonical")).filter("canonical IS NOT NULL").distinct()
    blocks = max(1, -(-known.count() * BITS_PER_URL // BLOCK_BITS))
    filter_ = bloom(known, blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_ = F.broadcast(filter_)
    # The input row travels as one struct, so no column of it can clash with a working column.
    rows = pages.select(F.struct(*pages.columns).alias("row"), host(F.col(url)).alias("host"),
                        path(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rows = rows.withColumns({"rule": _rule(rules, lambda name, start, _: name + start),
                             "act": _rule(rules, lambda *r: r[2])})
    block, words = _bits(F.col("canonical"), blocks)
    # Rows that a rule decides, or without a URL, need no lookup.
    rows = rows.withColumn("place", F.when(F.col("act").isNull() & F.col("canonical").isNotNull(), block))
    maybe = F.lit(True)
    for i, w in enumerate(words):
        maybe = maybe & (F.col(f"w{i}").bitwiseAND(w) == w)
    probe = rows.join(filter_, F.col("place") == F.col("block"), "left")
    probe = probe.select("row", "host", "path", "canonical", "rule", "act", F.coalesce(maybe, F.lit(False)).alias("maybe"))
    exact = known.withColumnRenamed("canonical", "listed")
    possible = probe.filter("maybe").join(exact, F.col("canonical") == F.col("listed"), "left")
    possible = possible.withColumn("hit", F.col("listed").isNotNull()).drop("listed")
    rest = probe.filter("NOT maybe").withColumn("hit", F.lit(False))
    results = ["host", "path", "rule", "verdict"]
    return possible.unionByName(rest).select(
        *[F.col("row")[c].alias(c) for c in pages.columns if c not in results], "host", "path", "rule",
        F.coalesce("act", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
