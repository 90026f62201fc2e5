"""Best video per discussion by vector similarity.

``best_match`` has two exact plans. A candidate set proven small (row check) becomes one float32 matrix that
every task multiplies its Arrow batches with: no shuffle at all. A larger set is cut into blocks and the
discussions into slices; each (slice, block) cell is one bounded matrix product that returns one best
candidate per discussion, and a map-side-combined maximum joins the blocks. Neither plan emits the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from .. import fixed_values as V
from ..functions import text as tx
from ..session import at_most, scratch_path, settled

MATRIX_ROWS = 20_000
BLOCK_ROWS = 20_000
SLICE_ROWS = 20_000
SPARSE_BLOCK_ROWS = 50_000
_SLACK = 1e-4  # single precision over 384 terms of unit vectors: below 384 · 2⁻²³
_SCORES_AT_ONCE = 4_000_000


def video_text(title: Column, description: Column, video_id: Column) -> Column:
    """``title. description[:300]``."""
    t = F.coalesce(title, F.lit(""))
    d = tx.truncate(F.coalesce(description, F.lit("")), V.DESCRIPTION_MAX_CHARS)
    text = tx.strip(F.concat(t, F.lit(". "), d))
    return F.when(text != "", text).otherwise(tx.truthy(title, video_id))


def discussion_texts(comments: DataFrame) -> DataFrame:
    """Cleaned discussion texts long enough to compare."""
    out = comments.withColumn("clean_text", tx.strip_urls(F.coalesce("body", F.lit(""))))
    return out.where(F.length("clean_text") >= V.MIN_SEMANTIC_CHARS)


def _best(queries: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best row of ``matrix`` for every query, a bounded number of scores at a time."""
    at = np.zeros(len(queries), dtype=np.int64)
    score = np.zeros(len(queries))
    step = max(1, _SCORES_AT_ONCE // max(1, len(matrix)))
    for lo in range(0, len(queries), step):
        # Scores that agree to nine decimals are ties; the first candidate wins.
        s = np.round(np.clip(queries[lo : lo + step] @ matrix.T, 0.0, 1.0), 9)
        at[lo : lo + step] = s.argmax(axis=1)
        score[lo : lo + step] = s[np.arange(len(s)), at[lo : lo + step]]
    return at, score


def _rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column with equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def comparable(embedding: str, width: Column) -> Column:
    """Whether a vector can be compared: of the common length, every component there and finite (NaN is above any number)."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == width) & finite, F.lit(False))


def _width(candidates: DataFrame) -> int | None:
    """The most frequent length of the candidates' vectors."""
    return candidates.agg(F.mode(F.size("embedding"))).first()[0]


def _usable(df: DataFrame, width: int | None) -> DataFrame:
    return df.where(comparable("embedding", F.lit(width)))


def rejected(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """The error table of ``best_match``: rows whose vectors take no part."""
    return df.where(~comparable("embedding", F.lit(_width(candidates))))


def _match_in_matrix(discussions: DataFrame, candidates: DataFrame, key: str, key_type: str, id_type: str) -> DataFrame:
    rows = candidates.orderBy("video_id").toArrow()  # at most MATRIX_ROWS
    if not rows.num_rows:
        return discussions.select(
            key, F.lit(None).cast(id_type).alias("video_id"), F.lit(None).cast("double").alias("similarity")
        ).limit(0)
    ids = rows.column("video_id").combine_chunks()
    shared = discussions.sparkSession.sparkContext.broadcast(_rows_of(rows.column("embedding")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, score = _best(_rows_of(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), ids.take(pa.array(at)), pa.array(score)], [key, "video_id", "similarity"]
                )

    return discussions.select(key, "embedding").mapInArrow(
        run, f"{key} {key_type}, video_id {id_type}, similarity double"
    )


def _match_in_blocks(
    discussions: DataFrame, candidates: DataFrame, key: str, key_type: str, id_type: str, block: int, size: int
) -> DataFrame:
    blocks = max(1, -(-candidates.count() // block))
    slices = max(1, -(-discussions.count() // size))
    left = discussions.select(
        key, "embedding",
        F.pmod(F.xxhash64(key), F.lit(slices)).alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    right = candidates.select(
        "video_id", "embedding",
        F.pmod(F.xxhash64("video_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("slice"),
    )

    by = ["slice", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _cell(key), f"{key} {key_type}, video_id {id_type}, similarity double")


def best_match(
    discussions: DataFrame,
    candidates: DataFrame,
    threshold: float = V.SEMANTIC_THRESHOLD,
    key: str = "platform_id",
    matrix_rows: int = MATRIX_ROWS,
    block_rows: int = BLOCK_ROWS,
    slice_rows: int = SLICE_ROWS,
    index_cells: int | None = None,
    probes: int = 8,
) -> DataFrame:
    """The most similar candidate of each discussion, kept at or above ``threshold``.

    ``discussions(key, embedding)``, ``candidates(video_id, embedding)`` with unit vectors; both plans give one
    row per key, the best over all rows of that key. Vectors that are NULL, hold NULL, NaN or an infinite value, or
    differ in length from most candidates take no part (``rejected``). Ties go to the smallest video id. Scores are rounded to four decimals after the threshold test.

    With ``index_cells`` the search is approximate: candidates are dealt to so many cells of similar directions, and a
    discussion is compared with those of its ``probes`` nearest cells alone, so what is shuffled grows with the probes and
    not with the number of blocks. ``recall`` measures a result against the exact one.
    """
    key_type = discussions.schema[key].dataType.simpleString()
    id_type = candidates.schema["video_id"].dataType.simpleString()
    width = _width(candidates)
    candidates = _usable(candidates.select("video_id", "embedding"), width)
    discussions = _usable(discussions.select(key, "embedding"), width)
    if index_cells:
        found = _match_in_cells(discussions, candidates, key, key_type, id_type, index_cells, probes, block_rows, slice_rows)
    elif at_most(candidates, matrix_rows):
        found = _match_in_matrix(discussions, candidates, key, key_type, id_type)
    else:
        found = _match_in_blocks(discussions, candidates, key, key_type, id_type, block_rows, slice_rows)
    return _kept(found, key, threshold)


def _kept(found: DataFrame, key: str, threshold: float) -> DataFrame:
    """The best row of each key, where it reaches the threshold."""
    best = F.min_by(F.struct("video_id", "similarity"), F.struct(-F.col("similarity"), F.col("video_id")))
    found = found.groupBy(key).agg(best.alias("b")).select(key, "b.*")
    return found.where(F.col("similarity") >= threshold).select(
        key, "video_id", F.lit("semantic").alias("match_type"), round_to("similarity", 4).alias("similarity_score")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def centroids(candidates: DataFrame, cells: int, sample_rows: int = 50_000, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` groups of directions, from at most ``sample_rows`` candidates in an order by hash."""
    sample = candidates.orderBy(F.xxhash64("video_id", F.lit(17)), "video_id").limit(sample_rows).select("embedding").toArrow()
    x = _unit(_rows_of(sample.column("embedding"))) if sample.num_rows else np.zeros((0, 1))
    centre = x[np.random.default_rng(11).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centre)
    return centre


def _cells(df: DataFrame, key: str, shared, probes: int) -> DataFrame:
    """``key, embedding, cell``: one row for each of the ``probes`` nearest cells of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores = _rows_of(part.column(1)) @ shared.value.T
                n = min(probes, scores.shape[1])
                near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                rows = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], [key, "embedding", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, "embedding").mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, cell int")


def _match_in_cells(
    discussions: DataFrame, candidates: DataFrame, key: str, key_type: str, id_type: str, cells: int, probes: int, block: int, size: int
) -> DataFrame:
    """Each candidate lies in one cell; a discussion meets those of its nearest cells. A cell with many rows of either
    side is cut into blocks and slices, as many as that cell needs."""
    shared = discussions.sparkSession.sparkContext.broadcast(centroids(candidates, cells))
    right = settled(_cells(candidates, "video_id", shared, 1), "cells")
    left = settled(_cells(discussions, key, shared, probes), "probes")
    parts = lambda rows, name: F.ceil(F.col(name) / rows).cast("int")
    sizes = left.groupBy("cell").agg(F.count("*").alias("q")).join(right.groupBy("cell").agg(F.count("*").alias("c")), "cell")
    sizes = F.broadcast(sizes.select("cell", parts(size, "q").alias("slices"), parts(block, "c").alias("blocks")))  # one row a cell
    left = left.join(sizes, "cell").select(
        key, "embedding", "cell", F.pmod(F.xxhash64(key), F.col("slices")).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = right.join(sizes, "cell").select(
        "video_id", "embedding", "cell", F.pmod(F.xxhash64("video_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    by = ["cell", "slice", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        _cell(key), f"{key} {key_type}, video_id {id_type}, similarity double")


def _cell(key: str):
    """The best candidate of each discussion of one cell."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            none = {key: q.column(key).slice(0, 0), "video_id": c.column("video_id").slice(0, 0)}
            return pa.table({**none, "similarity": pa.array([], pa.float64())})
        c = c.sort_by("video_id")
        at, score = _best(_rows_of(q.column("embedding")), _rows_of(c.column("embedding")))
        best = c.column("video_id").combine_chunks().take(pa.array(at))
        return pa.table({key: q.column(key), "video_id": best, "similarity": pa.array(score)})

    return run


def recall(found: DataFrame, exact: DataFrame, key: str = "platform_id") -> float:
    """Share of the exact matches that were found with the same score."""
    both = exact.select(key, F.col("similarity_score").alias("s")).join(found.select(key, "similarity_score"), key, "left")
    row = both.agg(F.count("*"), F.count_if(F.col("similarity_score") == F.col("s"))).first()
    return row[1] / row[0] if row[0] else 1.0


def encode(
    texts: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], key: str, text: str = "clean_text"
) -> DataFrame:
    """Dense vectors from an injected encoder, loaded once per Python worker; blank texts encode ``' '``."""
    key_type = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for pdf in frames:
            vectors = np.asarray(encoder([t or " " for t in pdf[text]]), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = (vectors / np.where(norms == 0, 1.0, norms)).astype(np.float32)
            yield pd.DataFrame({key: pdf[key], "embedding": list(vectors)})

    return texts.select(key, text).mapInPandas(run, f"{key} {key_type}, embedding array<float>")


def tfidf_vectors(
    discussions: DataFrame, videos: DataFrame, size: int = V.EMBEDDING_SIZE, stop_words: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors over the joint corpus, for both sides, as ``embedding`` of ``indices`` and ``values`` that are not 0.

    ``discussions(platform_id, text)``, ``videos(video_id, text)``. The vocabulary is the ``size`` most
    frequent terms; weights are tf · (ln((1+n)/(1+df)) + 1), L2-normalised. Texts are read twice: for the
    vocabulary, with map-side combine, and for the counts of its terms, which are written once.
    """
    stop_words = stop_words or StopWordsRemover.loadDefaultStopWords("english")
    corpus = discussions.select("text").unionByName(videos.select("text"))
    words = PipelineModel([
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        StopWordsRemover(inputCol="tokens", outputCol="terms", stopWords=stop_words),
    ])
    # explode_outer: a plain explode would cut every text a second time for an inferred size filter.
    ranked = (
        words.transform(corpus).select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
        .groupBy("term").count().orderBy(F.desc("count"), "term").limit(size)
    )
    vocabulary = [r["term"] for r in ranked.collect()]  # at most `size` terms
    if not vocabulary:
        raise ValueError("no terms left to compare")
    prepare = PipelineModel([words, CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="tf")])
    sides = [settled(prepare.transform(df).select(key, "tf"), "counts")
             for df, key in ((discussions, "platform_id"), (videos, "video_id"))]
    idf = IDF(inputCol="tf", outputCol="_").fit(sides[0].select("tf").unionByName(sides[1].select("tf")))
    n = idf.numDocs
    weights = Vectors.dense([float(np.log((1 + n) / (1 + df)) + 1) for df in idf.docFreq])  # at most `size` values
    scale = ElementwiseProduct(inputCol="tf", outputCol="w", scalingVec=weights)
    unit = Normalizer(inputCol="w", outputCol="embedding", p=2.0)

    def vectors(counts: DataFrame) -> DataFrame:
        spark, key = counts.sparkSession, counts.schema[0]
        path = scratch_path(spark, "tfidf")
        unit.transform(scale.transform(counts)).select(key.name, "embedding").write.parquet(path)
        # Without the user type of a vector, its stored parts are plain columns.
        plain = f"{key.name} {key.dataType.simpleString()}, embedding struct<indices: array<int>, values: array<double>>"
        return spark.read.schema(plain).parquet(path)

    return vectors(sides[0]), vectors(sides[1])


def _dense(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Sparse vectors as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), size))
    indices, values = column.field("indices"), column.field("values")
    rows = np.repeat(np.arange(len(column)), indices.value_lengths().to_numpy(zero_copy_only=False))
    out[rows, indices.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def _best_unit(queries: np.ndarray, matrix: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries whose best row of ``matrix`` may reach ``threshold``, that row and its score, as ``_best`` has them.

    All rows have length 1 or 0. Products in single precision differ from the exact ones by less than ``_SLACK``; rows
    that near the best are compared in double precision."""
    found = []
    narrow = matrix.astype(np.float32)
    step = max(1, _SCORES_AT_ONCE // max(1, len(matrix)))
    for lo in range(0, len(queries), step):
        s = queries[lo : lo + step].astype(np.float32) @ narrow.T
        top = s.max(axis=1)
        row, at = np.nonzero((s >= (top - _SLACK)[:, None]) & (top >= threshold - _SLACK)[:, None])
        score = np.concatenate([
            np.einsum("ij,ij->i", queries[lo + row[i : i + 8192]], matrix[at[i : i + 8192]])
            for i in range(0, len(row), 8192)] or [np.zeros(0)])
        score = np.round(np.clip(score, 0.0, 1.0), 9)
        order = np.lexsort((at, -score, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        found.append((lo + row[first], at[first], score[first]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def match_sparse(
    discussions: DataFrame, candidates: DataFrame, threshold: float, size: int = V.EMBEDDING_SIZE,
    key: str = "platform_id", matrix_rows: int = MATRIX_ROWS, block_rows: int = SPARSE_BLOCK_ROWS, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``best_match`` for the vectors of ``tfidf_vectors``: unit or zero, none negative, ``size`` wide; exact as well.

    Candidates with equal vectors have equal scores, so the one with the smallest id stands for them. What is
    broadcast or shuffled are the sparse vectors; a cell of (slice, block) is made dense where it is multiplied."""
    key_type = discussions.schema[key].dataType.simpleString()
    id_type = candidates.schema["video_id"].dataType.simpleString()
    schema = f"{key} {key_type}, video_id {id_type}, similarity double"
    one = candidates.groupBy("embedding").agg(F.min(F.struct("video_id")).alias("v"))
    one = settled(one.select("v.video_id", "embedding"), "candidates")
    n = one.count()

    def rows(keys, vectors, ids, matrix: np.ndarray) -> pa.Table:
        at, best, score = _best_unit(_dense(vectors, size), matrix, threshold)
        return pa.table({key: keys.take(pa.array(at)), "video_id": ids.take(pa.array(best)), "similarity": pa.array(score)})

    if not n:
        found = discussions.select(key, F.lit(None).cast(id_type).alias("video_id"), F.lit(0.0).alias("similarity")).limit(0)
    elif n <= matrix_rows:
        small = one.orderBy("video_id").toArrow()  # at most `matrix_rows`
        ids = small.column("video_id").combine_chunks()
        shared = discussions.sparkSession.sparkContext.broadcast(small.column("embedding").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix = _dense(shared.value, size)
            for batch in batches:
                yield from rows(batch.column(0), batch.column(1), ids, matrix).to_batches()

        found = discussions.select(key, "embedding").mapInArrow(run, schema)
    else:
        blocks, slices = -(-n // block_rows), max(1, -(-discussions.count() // slice_rows))
        left = discussions.select(
            key, "embedding", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = one.select(
            "video_id", "embedding", F.pmod(F.xxhash64("video_id"), F.lit(blocks)).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

        def cell(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                none = {key: q.column(key).slice(0, 0), "video_id": c.column("video_id").slice(0, 0)}
                return pa.table({**none, "similarity": pa.array([], pa.float64())})
            c = c.take(pc.sort_indices(c.column("video_id"), null_placement="at_start"))
            return rows(q.column(key).combine_chunks(), q.column("embedding"), c.column("video_id").combine_chunks(), _dense(c.column("embedding"), size))

        by = ["slice", "block"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(cell, schema)
    return _kept(found, key, threshold)


def tfidf_match(
    comments: DataFrame, videos: DataFrame, threshold: float = V.SEMANTIC_THRESHOLD, stop_words: list[str] | None = None
) -> DataFrame:
    """Match comments to videos by text alone (``video_id, title, description``)."""
    d = discussion_texts(comments).select("platform_id", F.col("clean_text").alias("text"))
    v = videos.select(
        "video_id", video_text(F.col("title"), F.col("description"), F.col("video_id")).alias("text")
    )
    left, right = tfidf_vectors(d, v, stop_words=stop_words)
    return match_sparse(left, right, threshold)
