"""Linking comments to videos by URL, and joining both sides' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentiment as sx
from ..functions import text as tx


def link_by_url(comments: DataFrame, target: str | None = None) -> DataFrame:
    """One row per (comment, linked video). A narrow transformation: extract ids, explode."""
    out = comments.withColumn("linked_video", F.explode_outer(tx.video_ids(F.col("body")))).where(
        F.col("linked_video").isNotNull()
    )
    if target:
        out = out.where(F.col("linked_video") == target)
    return out.drop("video_id").withColumnRenamed("linked_video", "video_id").withColumn(
        "match_type", F.lit("url")
    ).withColumn("similarity_score", F.lit(1.0))


def without_url(comments: DataFrame, target: str | None = None) -> DataFrame:
    """Comments ``link_by_url`` has no row for. Same result as an anti join on the comment key (equal keys
    carry equal bodies), without the shuffle."""
    ids = tx.video_ids(F.coalesce("body", F.lit("")))
    return comments.where(F.size(ids) == 0 if target is None else ~F.array_contains(ids, target))


def youtube_label_counts(comments: DataFrame, video_ids: DataFrame) -> DataFrame:
    """Label counts of YouTube comments per video.

    A comment belongs to its ``video_id``; when that is no known video, to ``parent_id`` if that is one.
    Comments are counted per (video_id, parent_id, label) before the two lookups, so the joins see one row
    per combination instead of one per comment.
    """
    counted = (
        comments.where((F.col("platform") == "youtube") & F.col("sentiment_label").isNotNull())
        .groupBy("video_id", "parent_id", "sentiment_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = video_ids.select(F.col("video_id").alias("known_id")).distinct()
    direct = counted.join(known, counted.video_id == known.known_id, "left")
    resolved = direct.where(F.col("known_id").isNotNull()).select("known_id", "sentiment_label", "n")
    legacy = direct.where(F.col("known_id").isNull()).drop("known_id")
    legacy = legacy.join(known, legacy.parent_id == known.known_id).select("known_id", "sentiment_label", "n")
    both = resolved.unionByName(legacy)
    return both.groupBy(F.col("known_id").alias("video_id")).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("sentiment_label") == x, F.col("n")).otherwise(0)).alias(x[:3]) for x in sx.LABELS],
    )


def video_facts(snapshots: DataFrame, listing: DataFrame) -> DataFrame:
    """Video metadata: the stored snapshot first, the fresh listing second; 0 and '' count as missing."""
    s, f = snapshots.alias("s"), listing.alias("f")
    j = s.join(f, F.col("s.platform_id") == F.col("f.video_id"), "full_outer")
    return j.select(
        F.coalesce("s.platform_id", "f.video_id").alias("video_id"),
        tx.truthy(F.col("s.title"), F.col("f.title")).alias("title"),
        F.col("f.channel_title").alias("channel_title"),
        F.col("f.thumbnail_url").alias("thumbnail_url"),
        tx.truthy(F.col("s.stats.views"), F.col("f.views")).alias("views"),
        tx.truthy(F.col("s.stats.likes"), F.col("f.likes")).alias("likes"),
        F.coalesce("f.comment_count", "s.stats.comment_count").alias("comment_count"),
        F.coalesce("f.published_at", "s.ingested_at").alias("published_at"),
        F.coalesce("f.tags", F.array().cast("array<string>")).alias("tags"),
    )


def overall_match(has_url, has_semantic):
    return F.when(has_url & has_semantic, "hybrid").when(has_semantic, "semantic").otherwise("url")


def account_metrics(accounts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Account card: attributes, latest snapshot statistics, and the later of both timestamps."""
    # Subreddit ids match case-insensitively, channel ids exactly.
    def key(prefix: str):
        pid = F.col(f"{prefix}.platform_id")
        return F.when(F.col(f"{prefix}.platform") == "reddit", F.lower(pid)).otherwise(pid)

    a, p = accounts.alias("a"), payloads.alias("p")
    j = a.join(p, (F.col("a.platform") == F.col("p.platform")) & (key("a") == key("p")), "left")
    return j.select(
        "a.platform", "a.platform_id", "a.display_name", "a.subscriber_count",
        F.col("p.stats").alias("stats"),
        F.col("p.stats.views").alias("total_views"),
        F.col("p.stats.likes").alias("total_likes"),
        F.col("p.stats.video_count").alias("total_videos"),
        F.greatest("a.updated_at", "p.ingested_at").alias("last_ingested_at"),
    )
