"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word is a binary vector over (letter, how often it has occurred so far). One inserted or deleted letter changes one
place of the vector, one replaced letter at most two, so words one edit apart lie within a Hamming distance of two.
The places are dealt by hash to ``PARTS`` first-level parts of ``PIECES`` pieces each. Two differing places leave one
part with at most ``DISTANCE // PARTS`` of them, so all pieces of that part but as many agree: every choice of so many
pieces is hashed to a signature, and words that share one are compared. Signatures also carry the length that the
shorter word of a pair has, since lengths differ by one at most. Pairs are kept if their edit distance is one.

A signature that more than ``CROWD`` words share is not joined. Its words meet by windows instead: the edit lies in
one of at most ``WINDOWS`` stretches of the shorter word, so both words agree before and after that stretch, which is
an exact join again; stretches of one letter leave at most one group member for each letter of the alphabet.

A variant's form is its near word of most occurrences, if that has ``RATIO`` times its own; roots are found by
pointer jumping, since occurrences rise along the forms.

Defined cases: a null text has no words, an empty one too; a null id is written as an empty text in front of the
colon; texts and runs of any length are read whole, in pieces that end between runs; repeated rows count as often as
they occur; of several forms with equally many occurrences the first in code-point order is taken; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace, at_most
from .bpe import _slices

DISTANCE = 2
PARTS, PIECES = 1, 6
CROWD = 200
WINDOWS = 64
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SLIP = 199  # one of so many occurrences loses a letter
CHUNK_BYTES = 1_000_000
FLUSH_WORDS = 300_000
BROADCAST_CROWDS = 100_000

# The letters A-Z, a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_STOP = re.compile(rb"[\x00-@\[-`{-\x7f]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of about ``CHUNK_BYTES`` that end at an ASCII character which is no letter."""
    start = 0
    while len(data) - start > CHUNK_BYTES:
        stop = _STOP.search(data, start + CHUNK_BYTES)
        if stop is None:
            break
        yield data[start:stop.end()]
        start = stop.end()
    yield data[start:] if start else data


def slipped(run: bytes, crc: int) -> bytes:
    """A run without its code point number ``crc % length``."""
    text = run.decode()
    at = crc % len(text)
    return (text[:at] + text[at + 1:]).encode()


def occurrences(docs: DataFrame, least_bytes: int = 1) -> DataFrame:
    """``word, n`` of the runs of ``docs`` (``doc_id``, ``text``) after slips, of at least ``least_bytes`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in found.items() if n and len(w) >= least_bytes]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()).cast(pa.string()),
                                               pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in _slices(whole, "text"):
                ids = batch.column(0).to_pylist()
                for doc_id, text in zip(ids, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for piece in _pieces((text or b"").lower()):  # lower() of bytes changes A-Z alone
                        runs = _RUN.findall(piece)
                        found.update(runs)
                        for r in runs:
                            crc = zlib.crc32(r, seed)
                            if not crc % SLIP:
                                found[r] -= 1
                                found[slipped(r, crc)] += 1
                        if len(found) > FLUSH_WORDS:
                            yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _piece(number: int, pieces: int):
    """Folds the places that belong to one piece into a hash."""
    return lambda s, p: F.when(F.pmod(p, F.lit(pieces)) == number, F.xxhash64(s, p)).otherwise(s)


def _key(role: int):
    return lambda k: F.struct(k.alias("key"), F.lit(role).alias("role"))


def _hashed(words: DataFrame, count: int) -> DataFrame:
    """``word`` and ``pieces``, the hashes of a word's letters in each of ``count`` pieces. Every step is a column of its
    own, so that no expression is evaluated again inside another one."""
    letters = words.select("word", F.array_sort(F.split("word", "")).alias("letters"))
    # In sorted letters, a place less that of the first equal letter counts the letters before.
    places = letters.select("word", F.transform("letters", lambda c, i: F.xxhash64(c, i - F.array_position("letters", c))).alias("places"))
    return places.select("word", F.array(*[F.aggregate("places", F.lit(0).cast("long"), _piece(k, count)) for k in range(count)]).alias("pieces"))


def _signatures(distance: int, parts: int, pieces: int) -> list[tuple[Column, ...]]:
    """For vectors at most ``distance`` apart: of every choice of pieces, its number and the hashes of the pieces."""
    out = []
    for part in range(parts):
        for chosen in combinations(range(pieces), pieces - distance // parts):
            out.append((F.lit(len(out)), *[F.col("pieces")[part * pieces + k] for k in chosen]))
    return out


def _windows(word: Column, shorter: Column) -> Column:
    """Hashes of what stands around each of at most ``WINDOWS`` stretches of a word of ``shorter`` letters."""
    n = F.least(shorter, F.lit(WINDOWS))
    bound = lambda j: F.floor(j * shorter / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.xxhash64(
        shorter, j, F.substr(word, F.lit(1), bound(j)),
        F.substr(word, F.length(word) - (shorter - bound(j + 1)) + 1, shorter - bound(j + 1))))


def _matched(keys: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of words one edit apart that share a key; ``keys`` has ``key, word, role``: 0 if the word is
    compared with words of its own length, 1 as the shorter and 2 as the longer word of a pair."""
    left = keys.filter("role < 2").select("key", F.col("word").alias("a"), F.col("role").alias("ra"))
    right = keys.filter("role <> 1").select("key", F.col("word").alias("b"), F.col("role").alias("rb"))
    met = left.join(right, "key").filter("(ra = 0 AND rb = 0 AND a < b) OR (ra = 1 AND rb = 2)")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_words(work: Workspace, words: DataFrame, parts: int = PARTS, pieces: int = PIECES,
               crowd: int = CROWD) -> DataFrame:
    """All pairs ``a, b`` of distinct words (column ``word``) one edit apart, each pair once."""
    length = F.length("word")
    apart = {0: (DISTANCE, length), 1: (1, length), 2: (1, length - 1)}
    found = [F.struct(F.xxhash64(F.lit(distance), shorter, *hashes).alias("key"), F.lit(role).alias("role"))
             for role, (distance, shorter) in apart.items()
             for hashes in _signatures(distance, parts, pieces)]
    keys = work.save(_hashed(words, parts * pieces).select("word", F.explode(F.array(*found)).alias("k")).select("k.key", "k.role", "word"), "signatures")
    crowded = work.save(keys.groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        return _matched(keys).distinct()
    side = F.broadcast(crowded) if at_most(crowded, BROADCAST_CROWDS) else crowded
    members = work.save(keys.join(side, "key", "left_semi").select("word").distinct(), "members")
    around = [F.transform(_windows(F.col("word"), shorter), _key(role)) for role, (_, shorter) in apart.items()]
    around = members.select("word", F.explode(F.concat(*around)).alias("k")).select("k.key", "k.role", "word")
    calm = keys.join(side, "key", "left_anti")
    return _matched(calm).union(_matched(work.save(around, "windows"))).distinct()


def roots(work: Workspace, forms: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms that begins at each word of ``forms`` (``word, form``)."""
    now = work.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = work.save(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "roots")
        if met.filter("moved").isEmpty():
            return met.select("word", "root")
        now = met.select("word", "root")


def group(work: Workspace, docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
          ratio: int = RATIO, **signatures) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of the words of ``docs``."""
    words = occurrences(docs, least_length).filter(F.col("n") >= least_count)
    words = work.save(words.filter(F.length("word") >= least_length), "words")
    pairs = work.save(near_words(work, words.select("word"), **signatures), "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    near = near.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b"))).alias("best"))
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    found = work.save(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.b")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(work, found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
