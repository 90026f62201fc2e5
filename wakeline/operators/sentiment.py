"""Sentiment aggregates. Every one is a single conditional aggregate with map-side combine."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from ..functions import sentiment as sx
from ..functions import text as tx
from .ranking import top_per_group

ACCOUNT = ("platform", "parent_id")


def tally(comments: DataFrame, by: tuple[str, ...] = ACCOUNT, label: str = "sentiment_label") -> DataFrame:
    """Label counts and shares (four decimals) per account; accounts without labels get zeros."""
    counts = comments.groupBy(*by).agg(*sx.label_counts(F.col(label)))

    def pct(c: str):
        return F.when(F.col("n") > 0, round_to(F.col(c) / F.col("n"), 4)).otherwise(0.0)

    return counts.select(
        *by,
        F.col("n").alias("total_comments_analyzed"),
        pct("pos").alias("positive_pct"), pct("neu").alias("neutral_pct"), pct("neg").alias("negative_pct"),
    )


def breakdowns(comments: DataFrame, by: tuple[str, ...], label: str = "sentiment_label") -> DataFrame:
    """Struct ``breakdown`` (shares, dominant label, sample size) per group."""
    counts = comments.groupBy(*by).agg(*sx.label_counts(F.col(label)))
    return counts.select(*by, sx.breakdown(*(F.col(c) for c in ("n", "pos", "neu", "neg"))).alias("breakdown"))


def macro_average(scores: DataFrame, by: tuple[str, ...], digits: int = 4) -> DataFrame:
    """Average class shares of scored texts; ``positive, neutral, negative`` columns in, same out."""
    avg = scores.groupBy(*by).agg(*[F.avg(c).alias(c) for c in sx.LABELS])
    dominant = sx.top_label(F.col("positive"), F.col("neutral"), F.col("negative"))
    return avg.select(
        *by, *[round_to(c, digits).alias(c) for c in sx.LABELS], dominant.alias("dominant_label")
    )


def majority_label(labelled: DataFrame, by: tuple[str, ...], label: str = "sentiment_label") -> DataFrame:
    """Most frequent label per thread; ties positive, neutral, negative; no labels means neutral."""
    counts = labelled.groupBy(*by).agg(*sx.label_counts(F.col(label)))
    verdict = F.when(F.col("n") == 0, "neutral").otherwise(sx.top_label(F.col("pos"), F.col("neu"), F.col("neg")))
    return counts.select(*by, F.col("n").alias("labelled"), verdict.alias("thread_label"))


def facets(comments: DataFrame, by: tuple[str, ...] = ACCOUNT) -> DataFrame:
    """Total and per-label counts of each account in one pass."""
    return comments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *sx.label_counts(F.col("sentiment_label"))
    ).select(
        *by, "total",
        F.col("pos").alias("positive"), F.col("neg").alias("negative"), F.col("neu").alias("neutral"),
    )


def newest_bodies(comments: DataFrame, n: int, by: tuple[str, ...] = ACCOUNT) -> DataFrame:
    """The sample side of a facet: the newest ``n`` comments of each account."""
    narrow = comments.select(*by, "platform_id", "ingested_at", "body")
    return top_per_group(narrow, list(by), [F.desc("ingested_at"), F.asc("platform_id")], n)


def top_up(
    comments: DataFrame, by: tuple[str, ...], enough: int = 5, extra: int = 40, scorer=None
) -> DataFrame:
    """Labels used for a target: all stored ones, plus up to ``extra`` unlabelled texts where fewer than
    ``enough`` are stored. With ``scorer`` the added texts are scored, else they stay unlabelled.

    The number of stored labels is an aggregate joined back (small side: one row per target).
    """
    stored = comments.groupBy(*by).agg(F.count("sentiment_label").alias("n_stored"))
    thin = stored.where(F.col("n_stored") < enough).select(*by)
    labelled = comments.where(F.col("sentiment_label").isNotNull()).withColumn("source", F.lit("stored"))
    is_open = F.col("sentiment_label").isNull() & (F.coalesce("body", F.lit("")) != "")
    added = top_per_group(
        comments.where(is_open).join(thin, list(by), "left_semi"),
        list(by), [F.desc("ingested_at"), F.asc("platform_id")], extra,
    ).drop("rank").withColumn("source", F.lit("live"))
    if scorer is not None:
        from .scoring import resolve_labels

        base = added.columns
        added = resolve_labels(added, scorer).withColumn("sentiment_label", F.col("label")).select(*base)
    return labelled.unionByName(added)


class Source(NamedTuple):
    """Texts that may be scored for targets with few labels: at most ``extra`` of a target, newest first, and only while
    it has fewer than ``enough`` labels. ``texts`` has the target columns, ``platform_id``, ``body`` and ``ingested_at``."""

    name: str
    texts: DataFrame
    enough: int
    extra: int


def fill(labelled: DataFrame, sources: list[Source], by: tuple[str, ...], scorer) -> DataFrame:
    """Labels used for each target, ``by`` columns, ``sentiment_label`` and ``source``: all of ``labelled``, then the
    sources in their order, each only for targets that the ones before left short.

    What a source has for a target is counted once, so all decisions come from one narrow table of counts: running sums
    over the sources say which of them a target draws on. Only the texts drawn on are scored, equal ones once.
    """
    from .scoring import resolve_labels

    by = list(by)
    stored = labelled.where(F.col("sentiment_label").isNotNull()).select(*by, "sentiment_label", F.lit("stored").alias("source"))
    offered = None
    for number, source in enumerate(sources, 1):
        some = top_per_group(
            source.texts.where(tx.strip(F.coalesce("body", F.lit(""))) != "").select(*by, "platform_id", "body", "ingested_at"),
            by, [F.desc("ingested_at"), F.asc("platform_id")], source.extra,
        ).select(*by, "body", F.lit(number).alias("_number"), F.lit(source.name).alias("source"))
        offered = some if offered is None else offered.unionByName(some)
    if offered is None:
        return stored
    counts = stored.select(*by, F.lit(0).alias("_number")).unionByName(offered.select(*by, "_number")).groupBy(*by).agg(
        *[F.count_if(F.col("_number") == n).alias(f"_n{n}") for n in range(len(sources) + 1)])
    have, drawn = F.col("_n0"), []
    for number, source in enumerate(sources, 1):
        short = have < source.enough
        drawn.append(F.when(short, F.lit(number)))
        have = have + F.when(short, F.col(f"_n{number}")).otherwise(0)
    drawn = counts.select(*by, F.explode(F.array_compact(F.array(*drawn))).alias("_number"))
    # Targets without a value are targets too.
    on = [F.col(f"o.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*by, "_number")]
    used = offered.alias("o").join(drawn.alias("d"), reduce(lambda a, b: a & b, on), "left_semi")
    null = F.lit(None)
    used = used.withColumns({"sentiment_label": null.cast("string"), "sentiment_score": null.cast("double")})
    return stored.unionByName(resolve_labels(used, scorer).select(*by, F.col("label").alias("sentiment_label"), "source"))


def with_gap(df: DataFrame, digits: int = 2) -> DataFrame:
    """Add ``sentiment_gap``, ``divergence`` and ``low_sample`` to rows with both breakdowns."""
    yt, rd = F.col("youtube_sentiment"), F.col("reddit_sentiment")
    out = df.withColumn("sentiment_gap", sx.gap(yt, rd, digits))
    return out.withColumn("divergence", sx.divergence(F.col("sentiment_gap"))).withColumn(
        "low_sample", sx.low_sample(yt, rd)
    )


def both_sides(
    youtube: DataFrame, reddit: DataFrame, key: str, how: str = "full_outer"
) -> DataFrame:
    """Join two breakdown tables on a target; a missing side becomes the empty breakdown."""
    zero = F.lit(0).cast("bigint")
    empty = sx.breakdown(zero, zero, zero, zero)
    y = youtube.select(key, F.col("breakdown").alias("_y"))
    r = reddit.select(key, F.col("breakdown").alias("_r"))
    return y.join(r, key, how).select(
        key,
        F.coalesce("_y", empty).alias("youtube_sentiment"),
        F.coalesce("_r", empty).alias("reddit_sentiment"),
    )


def effective_sentiment(primary: DataFrame, fallback: DataFrame, key: str = "video_id") -> DataFrame:
    """Video breakdowns where either side has samples, else the comparison's, else empty; gap to 3 decimals."""
    p = primary.select(key, F.col("youtube_sentiment").alias("py"), F.col("reddit_sentiment").alias("pr"))
    f = fallback.select(key, F.col("youtube_sentiment").alias("fy"), F.col("reddit_sentiment").alias("fr"),
                        F.col("sentiment_gap").alias("fg"))
    j = p.join(f, key, "left")
    has_p = (F.col("py.sample_size") > 0) | (F.col("pr.sample_size") > 0)
    has_f = F.coalesce((F.col("fy.sample_size") > 0) | (F.col("fr.sample_size") > 0), F.lit(False))
    zero = F.lit(0).cast("bigint")
    empty = sx.breakdown(zero, zero, zero, zero)

    def pick(a: str, b: str):
        return F.when(has_p, F.col(a)).when(has_f, F.col(b)).otherwise(empty)

    raw_gap = round_to(F.col("py.positive") - F.col("pr.positive"), 3)
    return j.select(
        key,
        pick("py", "fy").alias("youtube_sentiment"),
        pick("pr", "fr").alias("reddit_sentiment"),
        F.when(has_p, raw_gap).when(has_f, F.col("fg")).otherwise(0.0).alias("sentiment_gap"),
        F.when(has_p, "engagement").when(has_f, "comparison").otherwise("empty").alias("source"),
    )


def newest_batch_share(comments: DataFrame, by: tuple[str, ...] = ACCOUNT) -> DataFrame:
    """Shares of the most recent scoring batch only (rows with the account's latest processed time)."""
    w = Window.partitionBy(*by)
    counts = comments.groupBy(*by, "sentiment_processed_at").agg(*sx.label_counts(F.col("sentiment_label")))
    latest = counts.withColumn("_last", F.max("sentiment_processed_at").over(w)).where(
        F.col("sentiment_processed_at") == F.col("_last")
    )
    return latest.select(*by, "n", *[round_to(F.col(c) / F.col("n"), 4).alias(c) for c in ("pos", "neu", "neg")])
