"""From raw documents to tokens: five stages, each of which keeps what the next one needs.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. The
caller may write each result and read it back, as ``run`` does, so a lost executor never repeats earlier stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import bpe, mixing, pii, simhash, toxicity
from wakeline.session import Workspace, at_most

RANKS = "byte_bpe_multi_50k.tiktoken"
MAX_REPETITION = 1.25  # how often the rarest source may be read; the most frequent one is read exactly once
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, Workspace(spark, "toxicity"))
    return model.score(docs).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints (three-word shingles, at most three differing bits)
    stays, the one with the smallest id. Rows of one id are one document; rows without an id are grouped by equal
    fingerprints, and one of them stays where no document with an id has theirs."""
    work = Workspace(spark, "simhash")
    group = work.save(simhash.near_duplicates(docs.select("doc_id", "text"), size=3, budget=3, work=work), "groups")
    gone = work.save(group.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if at_most(gone, BROADCAST_IDS) else gone, "doc_id", "left_anti")
    ids = group.agg(F.count("doc_id"), F.count_distinct("doc_id"), F.count("*")).first()
    named, nameless = kept.filter("doc_id IS NOT NULL"), kept.filter("doc_id IS NULL")
    if ids[0] > ids[1]:
        named = named.dropDuplicates(["doc_id"])
    if ids[2] > ids[0]:
        marked = simhash.fingerprints(nameless.withColumn("row", F.struct(*docs.columns)).select("row", "text"), "text", 3)
        taken = group.filter("doc_id IS NOT NULL").select("fp").distinct()
        marked = marked.join(taken, "fp", "left_anti").dropDuplicates(["fp"])
        return named.unionByName(marked.select("row.*"))
    return named


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by the name of its kind."""
    found = pii.find(docs, carry=docs.columns)
    spans = F.array_sort(F.concat("base", "added"))
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), spans)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rare sources are read more often, up to the limit; every document is read at least once."""
    mixed = mixing.mix(docs, max_repetition=MAX_REPETITION)
    return mixed.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text they decode to."""
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# Trained scores, component search, look-around patterns and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
