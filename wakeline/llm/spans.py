"""Substring deduplication over sliding runs of sentences.

A sentence ends at ``.``, ``!``, ``?`` or a line break; one of more than ``LONG`` words is also cut after words
chosen by their hash, so text without punctuation still falls into the same pieces wherever it occurs. From each
sentence starts one run: the fewest sentences, ``min_sentences`` at least, that have ``min_words`` words. Runs are
compared by a 128-bit hash of their words in lower case. The first occurrence of a run by (id, position) stays;
sentences that any other occurrence covers go. Every removed sentence has an earlier equal one, so one copy of
every passage is kept.

First occurrences are combined before the shuffle, and hot runs only meet in a join that Spark can split.

Defined cases: a null text stays null and an empty one empty; texts with fewer words than a run are kept whole;
rows with the same id and text count as one occurrence and are cut alike; null ids come first in the order; an
empty table gives an empty result; all other columns pass through (a column named like a result is replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace

LONG = 40
_PIECE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
_WORD = re.compile(r"\s*\S+\s*")


def sentences(text: str) -> list[str]:
    """Pieces that concatenate to the text."""
    out = []
    for piece in _PIECE.findall(text):
        if piece.count(" ") < LONG:
            out.append(piece)
            continue
        start = 0
        for m in _WORD.finditer(piece):
            if zlib.crc32(m.group().strip().encode()) % 8 == 0:
                out.append(piece[start:m.end()])
                start = m.end()
        if start < len(piece):
            out.append(piece[start:])
    return out


def _runs(pieces: list[str], min_sentences: int, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first piece, pieces, hash) of each run. Pieces without a word belong to the run they stand in."""
    words = [p.lower().split() for p in pieces]
    at = [i for i, w in enumerate(words) if w]
    count = np.cumsum([0] + [len(words[i]) for i in at])
    stop = np.searchsorted(count, count[:-1] + min_words)  # sentences i .. stop-1 have the words
    line = [" ".join(words[i]) for i in at]
    out = []
    for i, j in enumerate(stop.tolist()):
        j = max(j, i + min_sentences)
        if j <= len(at):
            out.append((at[i], at[j - 1] - at[i] + 1, xxhash.xxh3_128_digest("\n".join(line[i:j]))))
    return out


def runs(df: DataFrame, text: str, key: list[str], min_sentences: int, min_words: int) -> DataFrame:
    """One row per run: the key columns, ``pos``, ``n`` and the hash as ``h1``, ``h2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                row, pos, n, hashes = [], [], [], []
                for i, t in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    for p, k, h in _runs(sentences(t or ""), min_sentences, min_words):
                        row.append(i)
                        pos.append(p)
                        n.append(k)
                        hashes.append(h)
                h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                keys = part.select(key).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(pos, pa.int32()), pa.array(n, pa.int32()),
                     pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                    names=[*key, "pos", "n", "h1", "h2"])

    fields = [df.schema[k] for k in key] + [T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()),
                                            T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    return df.mapInArrow(run, T.StructType(fields))


def _cut(text: str, covered: list) -> tuple[str, int, int]:
    """The text without the covered pieces; its pieces and how many of them went."""
    pieces = sentences(text)
    gone = np.zeros(len(pieces) + 1, np.int64)
    for pos, n in covered:
        gone[pos] += 1
        gone[min(pos + n, len(pieces))] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return "".join(p for p, k in zip(pieces, keep, strict=True) if k), len(pieces), int((~keep).sum())


def _removed(df: DataFrame) -> DataFrame:
    """Replace ``text`` by what its ``covered`` list leaves and add the two counts."""
    others = [f for f in df.schema.fields if f.name not in ("text", "covered")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, total, gone = [], [], []
            for t, c in zip(get["text"].to_pylist(), get["covered"].to_pylist(), strict=True):
                new, n, k = _cut(t or "", [(x["pos"], x["n"]) for x in c or []])
                texts.append(None if t is None else new)
                total.append(n)
                gone.append(k)
            yield pa.RecordBatch.from_arrays(
                [*(get[f.name] for f in others), pa.array(texts, pa.string()), pa.array(total, pa.int64()),
                 pa.array(gone, pa.int64())],
                names=[*(f.name for f in others), "text", "n_sentences", "n_removed"])

    return df.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType()),
                                            T.StructField("n_sentences", T.LongType()),
                                            T.StructField("n_removed", T.LongType())]))


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_sentences: int = 2,
                min_words: int = 25, work: Workspace | None = None) -> DataFrame:
    """``df`` with ``text`` shortened, and ``n_sentences`` and ``n_removed`` added."""
    work = work or Workspace(df.sparkSession, "spans")
    narrow = df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    found = work.save(runs(narrow, "text", ["id", "version"], min_sentences, min_words), "runs")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "version", "pos")).alias("first"),
                                          F.count("*").alias("copies"))
    # Written, so that the join below shuffles both sides and Spark can split hot runs.
    first = work.save(first.filter("copies > 1").select("h1", "h2", "first"), "first")
    place = F.struct("id", "version", "pos")
    later = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("id", "version").agg(F.collect_set(F.struct("pos", "n")).alias("covered"))
    covered = work.save(covered, "covered")
    work.drop(found)
    results = (text, "n_sentences", "n_removed")
    rows = df.select(F.struct(*[c for c in df.columns if c not in results]).alias("row"), F.col(doc_id).alias("id"),
                     F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    met = rows.alias("r").join(
        covered.alias("c"), F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.version") == F.col("c.version")), "left",
    ).select("row", "text", "covered")
    cut = _removed(met)
    order = [c for c in df.columns if c not in results[1:]]
    return cut.select(*[F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in order],
                      "n_sentences", "n_removed")
