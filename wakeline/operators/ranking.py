"""Per-group top-k, paging, table sorts and de-duplication.

Every per-group rank is filtered with an upper bound, so Spark prunes rows on the map side
(WindowGroupLimit) and a hot group never travels whole to one task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_per_target(comments: DataFrame, n: int, by: tuple[str, ...] = ("platform", "parent_id")) -> DataFrame:
    return top_per_group(comments, list(by), [F.desc("ingested_at"), F.asc("platform_id")], n)


def page_of_target(
    comments: DataFrame, platform: str, parent_id: str, page: int, size: int, label: str | None = None
) -> DataFrame:
    """One page, newest first; the label filter is applied before paging."""
    out = comments.where((F.col("platform") == platform) & (F.lower("parent_id") == parent_id.lower()))
    if label:
        out = out.where(F.col("sentiment_label") == label)
    return out.orderBy(F.desc("ingested_at"), "platform_id").offset((page - 1) * size).limit(size)


def page_after(
    comments: DataFrame, platform: str, parent_id: str, size: int, after: tuple[datetime, str] | None = None,
    label: str | None = None,
) -> DataFrame:
    """The page that follows the row ``after`` (its ``ingested_at`` and ``platform_id``), newest first.

    However deep the page, only rows from there on are read (the bound on the time is pushed into the scan) and only
    ``size`` of them are kept by each task. Pages do not shift when newer comments arrive."""
    out = comments.where((F.col("platform") == platform) & (F.lower("parent_id") == parent_id.lower()))
    if label:
        out = out.where(F.col("sentiment_label") == label)
    if after:
        time, key = F.lit(after[0]), F.lit(after[1])
        out = out.where((F.col("ingested_at") <= time) & ((F.col("ingested_at") < time) | (F.col("platform_id") > key)))
    return out.orderBy(F.desc("ingested_at"), "platform_id").limit(size)


def cursor(page: DataFrame) -> tuple[datetime, str] | None:
    """Where the next page begins; None after an empty page."""
    last = page.orderBy("ingested_at", F.desc("platform_id")).select("ingested_at", "platform_id").first()
    return (last[0], last[1]) if last else None


def page_of_every_target(
    comments: DataFrame, page: int, size: int, by: tuple[str, ...] = ("platform", "parent_id")
) -> DataFrame:
    ranked = latest_per_target(comments, page * size, by)
    return ranked.where(F.col("rank") > (page - 1) * size)


def sample_caps(
    listing: DataFrame, comments: DataFrame, videos_per_channel: int, used_videos: int, comments_per_video: int
) -> DataFrame:
    """Sampling caps of an ingest run: listed videos per channel, used videos, comments per used video."""
    order = [F.desc("published_at"), F.asc("video_id")]
    used = top_per_group(listing, ["channel_id"], order, min(videos_per_channel, used_videos), "video_rank")
    kept = comments.join(used.select("channel_id", "video_id"), "video_id")
    return top_per_group(
        kept, ["video_id"], [F.desc("like_count"), F.asc("comment_id")], comments_per_video, "comment_rank"
    )


def sort_videos(videos: DataFrame, by: str = "reddit_shares", descending: bool | None = None) -> DataFrame:
    """Table sorts of the linked-video list. Missing delays count as 9999 hours."""
    keys = {
        "reddit_shares": F.coalesce("total_reddit_shares", F.lit(0)),
        "views": F.coalesce("youtube_views", F.lit(0)),
        "propagation": F.coalesce("propagation_delay_hours", F.lit(9999.0)),
        "sentiment_diff": F.abs(
            F.coalesce("youtube_sentiment.positive", F.lit(0.0)) - F.coalesce("reddit_sentiment.positive", F.lit(0.0))
        ),
    }
    if descending is None:
        descending = by != "propagation"
    key = keys[by]
    return videos.orderBy(key.desc() if descending else key.asc(), "video_id")


def search_videos(videos: DataFrame, query: str = "", semantic_only: bool = False) -> DataFrame:
    """Title or channel contains the query; optionally only videos with semantic links."""
    out = videos
    if semantic_only:
        out = out.where(F.col("match_type").isin("semantic", "hybrid"))
    if query.strip():
        q = query.lower()
        hit = F.lower(F.coalesce("title", F.lit(""))).contains(q) | F.lower(
            F.coalesce("channel_title", F.lit(""))
        ).contains(q)
        out = out.where(hit)
    return out


def shared_order(videos: DataFrame, scoped: bool) -> DataFrame:
    """A scoped list is ordered by shares, then views; the global list by most recent ingestion."""
    if scoped:
        return videos.orderBy(F.desc("total_reddit_shares"), F.desc(F.coalesce("youtube_views", F.lit(0))), "video_id")
    return videos.orderBy(F.desc("last_ingested_at"), "video_id")


def top_videos_for_topic(videos: DataFrame, topic: str, n: int = 10) -> DataFrame:
    """Most viewed videos whose title contains the topic."""
    if n < 1:
        raise ValueError("n must be at least 1")
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(topic.lower())
    return videos.where(hit).orderBy(F.desc(F.coalesce("views", F.lit(0))), "video_id").limit(n)


def active_first(accounts: DataFrame, active: str | None, n: int = 6) -> DataFrame:
    """Accounts in list order with the active one (id equal or name containing it) in front."""
    order = [F.col("display_name"), F.col("platform_id")]
    if active:
        a = active.lower()
        hit = (F.lower("platform_id") == a) | F.lower("display_name").contains(a)
        order.insert(0, F.when(hit, 0).otherwise(1))
    return accounts.orderBy(*order).limit(n)


def recently_tracked(session_videos: DataFrame, stored_videos: DataFrame, n: int = 5) -> DataFrame:
    """Session list first, then stored videos that are not in it. Both need ``video_id`` and ``position``."""
    session = session_videos.select("video_id", "position", F.lit(0).alias("source"))
    stored = stored_videos.select("video_id", "position", F.lit(1).alias("source")).join(
        session.select("video_id"), "video_id", "left_anti"
    )
    return session.unionByName(stored).orderBy("source", "position", "video_id").limit(n)


def first_source_wins(sources: list[DataFrame], key: str = "platform_id") -> DataFrame:
    """Union of discussion sources, the earliest source keeps a duplicated key.

    ``min_by`` combines on the map side, so a key copied many times stays cheap.
    """
    tagged = None
    for i, df in enumerate(sources):
        df = df.withColumn("source_rank", F.lit(i))
        tagged = df if tagged is None else tagged.unionByName(df, allowMissingColumns=True)
    payload = F.struct(*[c for c in tagged.columns if c != key])
    picked = tagged.groupBy(key).agg(F.min_by(payload, F.col("source_rank")).alias("_row"))
    return picked.select(key, "_row.*")


def union_ids(*parts: DataFrame, key: str = "video_id") -> DataFrame:
    """Distinct ids over several sources."""
    out = parts[0].select(key)
    for p in parts[1:]:
        out = out.unionByName(p.select(key))
    return out.distinct()


def last_turns(conversations: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    return top_per_group(conversations, ["conv_id"], [F.desc("turn")], n)
