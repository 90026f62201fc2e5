"""Comment scoring: the lexicon engine in SQL, and a hook for any batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from ..functions import sentiment as sx
from ..functions import text as tx

# A model takes a list of texts and returns (label, score) pairs.
BatchModel = Callable[[list[str]], list[tuple[str, float]]]


def lexicon_scores(
    texts: DataFrame, lexicon: DataFrame, key: str = "text_key", body: str = "body", mode: str = "share",
    max_chars: int | None = None,
) -> DataFrame:
    """Score texts against ``lexicon(term, valence)``; whole texts, or their first ``max_chars`` characters.

    A text's tokens are joined and summed where they are exploded: the partial aggregate reduces every
    text to one row before the shuffle. Blank texts are neutral with score 0.
    """
    clean = F.lower(F.col(body) if max_chars is None else tx.truncate(F.col(body), max_chars))
    tokens = texts.select(key, F.explode_outer(F.split(clean, f"[^\\p{{L}}\\p{{N}}']+")).alias("term"))
    hits = tokens.join(lexicon.select("term", F.col("valence").cast("double")), "term", "left")
    v = F.coalesce("valence", F.lit(0.0))
    is_word = F.coalesce(F.col("term"), F.lit("")) != ""
    sums = hits.groupBy(key).agg(
        F.sum(v).alias("s"),
        F.sum(F.when(v > 0, v + 1).otherwise(0.0)).alias("p"),
        F.sum(F.when(v < 0, 1 - v).otherwise(0.0)).alias("g"),
        F.count_if(is_word & (v == 0)).alias("u"),
        F.count_if(is_word).alias("n_words"),
    )
    total = F.col("p") + F.col("g") + F.col("u")
    share = {c: F.when(total > 0, round_to(F.col(c) / total, 3)).otherwise(F.lit(0.0)) for c in ("p", "u", "g")}
    compound = round_to(F.col("s") / F.sqrt(F.col("s") * F.col("s") + 15), 4)
    scored = sums.select(
        key,
        compound.alias("compound"),
        share["p"].alias("positive"), share["u"].alias("neutral"), share["g"].alias("negative"),
        (F.col("n_words") == 0).alias("is_blank"),
    )
    conf = sx.confidence(F.col("compound"), F.col("positive"), F.col("neutral"), F.col("negative"), mode)
    return scored.select(
        key, "compound", "positive", "neutral", "negative",
        F.when(F.col("is_blank"), "neutral").otherwise(sx.label_of_compound(F.col("compound"))).alias("label"),
        F.when(F.col("is_blank"), 0.0).otherwise(conf).alias("score"),
    )


def model_scores(
    texts: DataFrame, load_model: Callable[[], BatchModel], key: str = "text_key", body: str = "body", batch: int = 32,
    max_chars: int | None = None,
) -> DataFrame:
    """Score texts with an injected model, loaded once per Python worker and fed in Arrow batches."""
    key_type = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in frames:
            bodies = [(b or "")[:max_chars] for b in pdf[body]]
            labels, scores = ["neutral"] * len(bodies), [0.0] * len(bodies)
            todo = [i for i, b in enumerate(bodies) if b.strip()]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                for i, (label, score) in zip(part, model([bodies[i] for i in part])):
                    labels[i], scores[i] = label, float(score)
            yield pd.DataFrame({key: pdf[key], "raw_label": labels, "score": scores})

    raw = texts.select(key, body).mapInPandas(run, f"{key} {key_type}, raw_label string, score double")
    return raw.select(key, sx.canonical_label(F.col("raw_label")).alias("label"), round_to("score", 4).alias("score"))


Scorer = Callable[[DataFrame], DataFrame]


def unprocessed(comments: DataFrame) -> DataFrame:
    return comments.where(~F.coalesce("sentiment_processed", F.lit(False)))


def scored_texts(comments: DataFrame, scorer: Scorer) -> DataFrame:
    """Score each distinct unlabelled text once. ``scorer`` maps (text_key, body) to (text_key, label, score).

    Texts are identified by SHA-256; copies are combined before the shuffle.
    """
    todo = comments.where(F.col("sentiment_label").isNull() & (F.coalesce("body", F.lit("")) != ""))
    distinct = todo.groupBy(F.sha2("body", 256).alias("text_key")).agg(F.first("body").alias("body"))
    return scorer(distinct).select("text_key", F.col("label").alias("live_label"), F.col("score").alias("live_score"))


def resolve_labels(
    comments: DataFrame, scorer: Scorer, engine: str = "lexicon", default_score: float | None = 0.5
) -> DataFrame:
    """Stored label where there is one, else the live label of the text, with provenance in ``engine``.

    Texts the scorer gives no answer for (blank ones) are neutral with ``default_score``.
    """
    live = scored_texts(comments, scorer)
    is_open = F.col("sentiment_label").isNull() & (F.coalesce("body", F.lit("")) != "")
    # Rows that need no live label never reach the shuffle.
    closed = comments.where(~is_open).select(
        *comments.columns, F.lit(None).cast("string").alias("live_label"), F.lit(None).cast("double").alias("live_score")
    )
    opened = comments.where(is_open).withColumn("text_key", F.sha2("body", 256)).join(live, "text_key", "left")
    out = closed.unionByName(opened.drop("text_key"))
    stored = F.col("sentiment_label").isNotNull()
    return out.select(
        *comments.columns,
        F.coalesce("sentiment_label", "live_label", F.lit("neutral")).alias("label"),
        F.when(stored, F.col("sentiment_score")).otherwise(F.coalesce("live_score", F.lit(default_score))).alias(
            "label_score"
        ),
        F.when(stored, "stored").when(F.col("live_label").isNotNull(), engine).otherwise("none").alias("engine"),
    )


def score_unprocessed(comments: DataFrame, scorer: Scorer, processed_at) -> DataFrame:
    """Rows to merge back (`upsert.set_fields`) for comments not scored yet."""
    todo = unprocessed(comments).withColumn("sentiment_label", F.lit(None).cast("string"))
    done = resolve_labels(todo, scorer, default_score=0.0)
    return done.select(
        "platform", "platform_id", "ingested_at",
        F.lit(True).alias("sentiment_processed"),
        processed_at.alias("sentiment_processed_at"),
        F.col("label").alias("sentiment_label"),
        F.col("label_score").alias("sentiment_score"),
    )
