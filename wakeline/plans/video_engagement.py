"""Engagement of every video across communities, from text evidence in comments and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as mx
from ..functions import sentiment as sx
from ..functions import text as tx
from ..session import settled
from ..operators import fingerprint, keywords, linking, ranking, sentiment
from .shared_videos import distinct_per_video

TOP_COMMENTS = 10
TOP_THREADS = 10


def best_comments(comments: DataFrame, n: int | None = TOP_COMMENTS) -> DataFrame:
    """The ``n`` highest scored worthy comments of each post."""
    worthy = comments.where(
        (F.col("platform") == "reddit") & tx.is_worthy_comment(F.col("author"), F.col("body"))
    )
    if n is None:
        return worthy
    return ranking.top_per_group(worthy, ["post_id"], [F.desc("score"), F.asc("platform_id")], n, "comment_rank")


def spoken(comments: DataFrame) -> DataFrame:
    """Community comments with a text."""
    return comments.where((F.col("platform") == "reddit") & (F.coalesce("body", F.lit("")) != ""))


def matched_discussions(
    comments: DataFrame, prints: DataFrame, accepted: DataFrame | None = None, per_post: int | None = None,
    own: DataFrame | None = None,
) -> DataFrame:
    """(video, comment) rows: comments that carry evidence themselves, then worthy comments of accepted posts,
    all of them or the best ``per_post``.

    A comment found both ways counts once, with its own evidence (``own``, where it is known already).
    """
    reddit = spoken(comments)
    own = fingerprint.verify(reddit, prints, key="platform_id", text="body") if own is None else own
    own = own.select("platform_id", "video_id", "match_type", "similarity_score").withColumn("source_rank", F.lit(0))
    found = own
    if accepted is not None:
        top = best_comments(comments, per_post).select("post_id", "platform_id")
        via = accepted.select("post_id", "video_id", "match_type", "similarity_score").join(top, "post_id")
        found = own.unionByName(via.drop("post_id").withColumn("source_rank", F.lit(1)))
    evidence = F.struct("source_rank", "match_type", "similarity_score")
    # Narrow rows that the report reads three times.
    first = settled(found.groupBy("video_id", "platform_id").agg(F.min(evidence).alias("e")), "evidence")
    facts = reddit.drop("video_id", "match_type", "similarity_score")
    return first.select("video_id", "platform_id", "e.match_type", "e.similarity_score").join(facts, "platform_id")


def threads(accepted: DataFrame, posts: DataFrame, comments: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Top ten accepted posts of each video by score, each with its majority label and best comments."""
    top = ranking.top_per_group(
        accepted, ["video_id"], [F.desc("score"), F.asc("post_id")], TOP_THREADS, "thread_rank"
    ).select("video_id", "post_id", "thread_rank", "match_type", "similarity_score")
    best = best_comments(comments)
    best = best.withColumn(label, F.coalesce(F.col(label), F.lit("neutral")))
    cards = best.groupBy("post_id").agg(
        F.array_sort(
            F.collect_list(F.struct("comment_rank", "platform_id", "author", "score", F.col(label).alias("label")))
        ).alias("top_comments")
    )
    mood = sentiment.majority_label(best, ("post_id",), label)
    facts = posts.select("post_id", F.lower("subreddit").alias("subreddit"), "title", "score", "num_comments")
    return (
        top.join(facts, "post_id").join(cards, "post_id", "left").join(mood, "post_id", "left")
        .withColumn("thread_label", F.coalesce("thread_label", F.lit("neutral")))
    )


def video_engagement(
    discussions: DataFrame,
    comments: DataFrame,
    facts: DataFrame,
    accepted: DataFrame | None = None,
    label: str = "sentiment_label",
) -> DataFrame:
    """One row per video with discussions or accepted posts.

    Upvotes and comment totals come from accepted posts; posts known only through a comment contribute the
    scores of their matched comments instead.
    """
    label_col = F.coalesce(F.col(label), F.lit("neutral"))
    post = F.coalesce("post_id", "platform_id")
    d = discussions.select(
        "video_id", post.alias("post_id"), F.lower("parent_id").alias("subreddit"), F.col("score"),
        label_col.alias("label"), "published_at",
    )
    if accepted is not None:
        known = accepted.select("video_id", "post_id").withColumn("_known", F.lit(True))
        d = d.join(known, ["video_id", "post_id"], "left")
        p = accepted.select("video_id", "post_id", F.lower("subreddit").alias("subreddit"), "score", "num_comments")
        null = lambda t: F.lit(None).cast(t)
        rows = d.select(
            "video_id", "post_id", "subreddit",
            F.when(F.col("_known").isNull(), F.col("score")).alias("votes"),
            null("bigint").alias("num_comments"), "label", "published_at", F.lit(1).alias("is_comment"),
        ).unionByName(p.select(
            "video_id", "post_id", "subreddit", F.col("score").alias("votes"), "num_comments",
            null("string").alias("label"), null("timestamp").cast(d.schema["published_at"].dataType).alias("published_at"),
            F.lit(0).alias("is_comment"),
        ))
    else:
        rows = d.select("video_id", "post_id", "subreddit", F.col("score").alias("votes"),
                        F.lit(None).cast("bigint").alias("num_comments"), "label", "published_at",
                        F.lit(1).alias("is_comment"))
    rows = rows.withColumn("subreddit", F.nullif("subreddit", F.lit("")))
    pairs = settled(rows.groupBy("video_id", "post_id", "subreddit").agg(
        F.sum("is_comment").alias("discussions"), F.sum(F.coalesce("votes", F.lit(0))).alias("votes"),
        F.sum(F.coalesce("num_comments", F.lit(0))).alias("comments"), F.min("published_at").alias("first"),
        F.max("published_at").alias("latest"), *sx.label_counts(F.col("label")),
    ), "pairs")
    rolled = pairs.groupBy("video_id").agg(
        F.sum("discussions").alias("total_reddit_discussions"), F.sum("votes").alias("reddit_total_upvotes"),
        F.sum("comments").alias("reddit_total_comments"), F.min("first").alias("reddit_first_shared_at"),
        F.max("latest").alias("reddit_latest_shared_at"), *[F.sum(c).alias(c) for c in ("n", "pos", "neu", "neg")],
    )
    for column, name in (("subreddit", "subreddits_count"), ("post_id", "reddit_posts_count")):
        rolled = rolled.join(distinct_per_video(pairs, column, name), "video_id", "left")
    rolled = rolled.withColumn("subreddits_count", F.coalesce("subreddits_count", F.lit(0)))
    yt = linking.youtube_label_counts(comments, rolled.select("video_id"))
    yt = yt.select("video_id", *[F.col(c).alias(f"y_{c}") for c in ("n", "pos", "neu", "neg")])
    narrow = discussions.select("video_id", "ingested_at", "platform_id", "body")
    order = [(-F.unix_micros(F.col("ingested_at").cast("timestamp"))), F.col("platform_id")]
    topics = keywords.keyword_lists(
        keywords.top_keywords_per(narrow, ["video_id"], 6, "topic", order=order), ["video_id"]
    )
    out = rolled.join(yt, "video_id", "left").join(facts, "video_id", "left").join(topics, "video_id", "left")
    y = [F.coalesce(f"y_{c}", F.lit(0)) for c in ("n", "pos", "neu", "neg")]
    yt_b, rd_b = F.col("youtube_sentiment"), F.col("reddit_sentiment")
    out = (
        out.withColumn("youtube_sentiment", sx.breakdown(*y))
        .withColumn("reddit_sentiment", sx.breakdown(*(F.col(c) for c in ("n", "pos", "neu", "neg"))))
        .withColumn("propagation_delay_hours",
                    mx.delay_hours(F.col("published_at"), F.col("reddit_first_shared_at")))
        .withColumn("sentiment_gap", sx.gap(yt_b, rd_b))
    )
    return out.select(
        "video_id",
        F.coalesce("title", F.concat(F.lit("Video "), F.col("video_id"))).alias("title"),
        "channel_title",
        F.col("views").alias("youtube_views"), F.col("likes").alias("youtube_likes"),
        F.col("comment_count").alias("youtube_comment_count"),
        "subreddits_count", "total_reddit_discussions", "reddit_posts_count",
        "reddit_total_upvotes", "reddit_total_comments",
        "reddit_first_shared_at", "reddit_latest_shared_at", "propagation_delay_hours",
        mx.delay_class(F.col("propagation_delay_hours"), F.col("reddit_first_shared_at"), "Community Discovered")
        .alias("propagation_speed"),
        "youtube_sentiment", "reddit_sentiment", "sentiment_gap",
        sx.video_note(yt_b, rd_b, F.col("sentiment_gap"), F.col("subreddits_count")).alias("sentiment_disparity_note"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )
