"""Audience comparisons, engagement indices and the correlation summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from ..functions import metrics as mx
from ..functions import sentiment as sx
from ..operators import fingerprint, keywords, sentiment


def _judged(sides: DataFrame) -> DataFrame:
    out = sides.withColumn("sentiment_gap", sx.gap(F.col("youtube_sentiment"), F.col("reddit_sentiment")))
    return out.withColumn(
        "summary",
        sx.comparison_summary(F.col("youtube_sentiment"), F.col("reddit_sentiment"), F.col("sentiment_gap")),
    )


def _labels(comments: DataFrame, by: str, scorer) -> DataFrame:
    return sentiment.breakdowns(sentiment.top_up(comments, (by,), scorer=scorer), (by,))


def compare_subreddits(comments: DataFrame, scorer=None, subreddit: str | None = None) -> DataFrame:
    """Each subreddit's audience against all YouTube comments; with ``subreddit`` only that one.

    Targets with fewer than five stored labels are topped up with scored texts when a scorer is given.
    """
    reddit = comments.where(F.col("platform") == "reddit").withColumn("target", F.lower("parent_id"))
    if subreddit:
        reddit = reddit.where(F.col("target") == subreddit.lower())
    youtube = comments.where(F.col("platform") == "youtube").withColumn("target", F.lit("youtube"))
    rd = _labels(reddit, "target", scorer)
    yt = _labels(youtube, "target", scorer).select(F.col("breakdown").alias("_y"))
    # One row of YouTube shares is attached to every subreddit row.
    zero = F.lit(0).cast("bigint")
    empty = sx.breakdown(zero, zero, zero, zero)
    sides = rd.withColumn("_one", F.lit(1)).join(F.broadcast(yt.withColumn("_one", F.lit(1))), "_one", "left").select(
        "target", F.coalesce("_y", empty).alias("youtube_sentiment"), F.col("breakdown").alias("reddit_sentiment")
    )
    return _judged(sides)


def compare_videos(comments: DataFrame, videos: DataFrame, scorer=None) -> DataFrame:
    """Both audiences of every video: Reddit comments that contain its id, YouTube comments under it."""
    reddit = comments.where(F.col("platform") == "reddit")
    # Comment ids are unique per platform, so they identify the rows to join back.
    hits = fingerprint.id_matches(reddit.where(F.col("body").isNotNull()), videos, "platform_id", "body")
    rd_rows = hits.select("platform_id", F.col("video_id").alias("target")).join(reddit, "platform_id")
    known = videos.select(F.col("video_id").alias("target"))
    youtube = comments.where(F.col("platform") == "youtube")
    yt_rows = _by_video(youtube, known)
    return _judged(sentiment.both_sides(
        _labels(yt_rows, "target", scorer), _labels(rd_rows, "target", scorer), "target"
    )).withColumnRenamed("target", "video_id")


def _by_video(youtube: DataFrame, known: DataFrame) -> DataFrame:
    """YouTube comments with ``target``: the video id, or the parent id where that is the known video."""
    direct = youtube.join(known, F.col("video_id") == F.col("target"), "left")
    legacy = direct.where(F.col("target").isNull()).drop("target").join(known, F.col("parent_id") == F.col("target"))
    return direct.where(F.col("target").isNotNull()).unionByName(legacy)


def engagement_comparison(accounts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Index of every tracked account, ordered by platform and name (accounts without a snapshot score 0)."""
    stats = payloads.select("platform", "platform_id", "stats")
    joined = accounts.join(stats, ["platform", "platform_id"], "left")
    return joined.select(
        "platform", F.col("platform_id").alias("account_id"), "display_name",
        F.struct(F.col("stats.*")).alias("raw_engagement"),
        mx.engagement_index(F.col("platform"), F.col("stats")).alias("normalised_score"),
    ).orderBy("platform", "display_name", "account_id")


def topic_correlation(
    comments: DataFrame, videos: DataFrame, subreddit: str | None = None, n: int = 12
) -> DataFrame:
    """Shared and leading topics of Reddit discussions and video titles."""
    reddit = comments.where(F.col("platform") == "reddit")
    if subreddit:
        reddit = reddit.where(F.lower("parent_id") == subreddit.lower())
    rd = keywords.top_keywords(reddit, n, "topic", "body", [F.col("platform_id")])
    yt = keywords.top_keywords(videos, n, "topic", "title", [F.col("video_id")])
    return keywords.correlate_topics(rd, yt)


def correlation_summary(
    shared: DataFrame, engagement: DataFrame, gap: DataFrame, scoped: bool = False
) -> DataFrame:
    """One row of headline numbers.

    ``shared`` from the shared-video plan, ``engagement`` from ``engagement_comparison``, ``gap`` a table
    with ``sentiment_gap``. The top video is the first of the list order (shares when scoped, else recency).
    """
    if scoped:
        order = F.struct("total_reddit_shares", F.coalesce("youtube_views", F.lit(0)), "video_id")
    else:
        order = F.struct("last_ingested_at", "video_id")
    top = F.max_by(F.struct("video_id", "title", "total_reddit_shares"), order)
    videos = shared.agg(
        F.count(F.lit(1)).alias("total_cross_platform_videos"),
        F.coalesce(round_to(F.avg("propagation_delay_hours"), 2), F.lit(0.0)).alias("avg_propagation_lag_hours"),
        F.coalesce(F.sum("total_reddit_shares"), F.lit(0)).alias("total_discussions_linked"),
        top.alias("top"),
    )
    yt, rd = F.col("platform") == "youtube", F.col("platform") == "reddit"
    score = F.col("normalised_score")
    index = engagement.agg(
        F.count_if(yt).alias("total_tracked_youtube_channels"),
        F.count_if(rd).alias("total_tracked_subreddits"),
        F.coalesce(round_to(F.avg(F.when(yt, score)), 2), F.lit(0.0)).alias("avg_youtube_engagement_score"),
        F.coalesce(round_to(F.avg(F.when(rd, score)), 2), F.lit(0.0)).alias("avg_reddit_engagement_score"),
    )
    first_gap = gap.agg(F.coalesce(F.max("sentiment_gap"), F.lit(0.0)).alias("sentiment_gap"))
    one = F.lit(1).alias("_one")
    joined = index.select("*", one).join(videos.select("*", one), "_one").join(first_gap.select("*", one), "_one")
    return joined.select(
        "total_tracked_youtube_channels", "total_tracked_subreddits",
        "avg_youtube_engagement_score", "avg_reddit_engagement_score",
        "total_cross_platform_videos", "avg_propagation_lag_hours", "sentiment_gap",
        F.col("top.video_id").alias("top_shared_video_id"), F.col("top.title").alias("top_shared_video_title"),
        F.coalesce("top.total_reddit_shares", F.lit(0)).alias("top_shared_video_reddit_shares"),
        "total_discussions_linked",
    )
