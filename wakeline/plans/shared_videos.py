"""Videos shared in community discussions, with propagation, audience contrast and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import metrics as mx
from ..functions import sentiment as sx
from ..operators import keywords, linking, semantic
from ..session import settled


def linked_discussions(
    comments: DataFrame,
    candidates: DataFrame | None = None,
    subreddit: str | None = None,
    target: str | None = None,
    threshold: float = V.SEMANTIC_THRESHOLD,
    vectors: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per (video, Reddit comment): links by URL, then text similarity for comments without one.

    ``candidates(video_id, title, description)`` switches the similarity step on (TF-IDF vectors, or the
    precomputed ``vectors`` pair).
    """
    reddit = comments.where(F.col("platform") == "reddit")
    if subreddit:
        reddit = reddit.where(F.lower("parent_id") == subreddit.lower())
    by_url = linking.link_by_url(reddit, target)
    if candidates is None and vectors is None:
        return by_url
    rest = linking.without_url(reddit, target)
    if target and candidates is not None:
        candidates = candidates.where(F.col("video_id") == target)
    if vectors is not None:
        found = semantic.best_match(vectors[0], vectors[1], threshold)
    else:
        found = semantic.tfidf_match(rest, candidates, threshold)
    drop = ["video_id", "match_type", "similarity_score"]
    return by_url.unionByName(rest.drop(*drop).join(found, "platform_id"), allowMissingColumns=True)


def _of_post(label: Column) -> list[Column]:
    """What one post and community of a video add up to."""
    is_semantic = F.col("match_type") == "semantic"
    return [
        F.count(F.lit(1)).alias("shares"),
        F.sum(F.coalesce("score", F.lit(0))).alias("votes"),
        F.min("published_at").alias("first"),
        F.max("published_at").alias("latest"),
        F.max("ingested_at").alias("ingested"),
        F.max("similarity_score").alias("similarity"),
        F.bool_or(~is_semantic).alias("url"),
        F.bool_or(is_semantic).alias("sem"),
        *[c for c in sx.label_counts(label)],
    ]


def per_post(linked: DataFrame, label: Column) -> DataFrame:
    """``video_id, post_id, subreddit`` and sums: one narrow row per post and community of a video.

    All sums and all distinct counts of a video come from these rows, which are written once, so the links are
    grouped a single time and a hot video reaches the last step as partial sums."""
    post = F.coalesce("post_id", "platform_id").alias("post_id")
    pairs = linked.withColumn("post_id", post).withColumn("subreddit", F.nullif("parent_id", F.lit("")))
    return settled(pairs.groupBy("video_id", "post_id", "subreddit").agg(*_of_post(label)), "pairs")


def distinct_per_video(pairs: DataFrame, column: str, name: str) -> DataFrame:
    """How many different values of a column a video has; absent values count as none."""
    return pairs.select("video_id", column).where(F.col(column).isNotNull()).distinct().groupBy("video_id").agg(
        F.count("*").alias(name))


def post_comment_totals(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """Sum of the comment counts of a video's distinct posts (``video_id, post_id``)."""
    return pairs.select("video_id", "post_id").distinct().join(posts.select("post_id", "num_comments"), "post_id").groupBy(
        "video_id").agg(F.sum(F.coalesce("num_comments", F.lit(0))).alias("post_comments"))


def shared_videos(
    linked: DataFrame,
    comments: DataFrame,
    facts: DataFrame,
    posts: DataFrame | None = None,
    label: str = "sentiment_label",
    with_topics: bool = True,
) -> DataFrame:
    """One row per linked video.

    Every per-video value is a combining aggregate; discussions themselves stay rows (``linked_discussions``)
    and are never collected into one value. Unlabelled discussions count as neutral.
    """
    label_col = F.coalesce(F.col(label), F.lit("neutral"))
    pairs = per_post(linked, label_col)
    rolled = pairs.groupBy("video_id").agg(
        F.sum("shares").alias("total_reddit_shares"), F.sum("votes").alias("upvotes"),
        F.min("first").alias("reddit_first_shared_at"), F.max("latest").alias("reddit_latest_shared_at"),
        F.max("ingested").alias("last_ingested_at"), F.max("similarity").alias("similarity_score"),
        F.bool_or("url").alias("_url"), F.bool_or("sem").alias("_sem"),
        *[F.sum(c).alias(c) for c in ("n", "pos", "neu", "neg")],
    )
    for column, name in (("post_id", "reddit_posts"), ("subreddit", "reddit_subreddits")):
        rolled = rolled.join(distinct_per_video(pairs, column, name), "video_id", "left")
    rolled = rolled.withColumn("reddit_subreddits", F.coalesce("reddit_subreddits", F.lit(0)))
    yt = linking.youtube_label_counts(comments, rolled.select("video_id"))
    yt = yt.select("video_id", *[F.col(c).alias(f"y_{c}") for c in ("n", "pos", "neu", "neg")])
    out = rolled.join(yt, "video_id", "left").join(facts, "video_id", "left")
    if posts is not None:
        out = out.join(post_comment_totals(pairs, posts), "video_id", "left")
    else:
        out = out.withColumn("post_comments", F.lit(None).cast("bigint"))
    if with_topics:
        narrow = linked.select("video_id", "ingested_at", "platform_id", "body")
        order = [(-F.unix_micros(F.col("ingested_at").cast("timestamp"))), F.col("platform_id")]
        ranked = keywords.top_keywords_per(narrow, ["video_id"], 4, "topic", order=order)
        out = out.join(keywords.keyword_lists(ranked, ["video_id"], "_terms"), "video_id", "left")
    else:
        out = out.withColumn("_terms", F.lit(None).cast("array<string>"))
    y = [F.coalesce(f"y_{c}", F.lit(0)) for c in ("n", "pos", "neu", "neg")]
    out = out.withColumn("youtube_sentiment", sx.breakdown(*y)).withColumn(
        "reddit_sentiment", sx.breakdown(*(F.col(c) for c in ("n", "pos", "neu", "neg")))
    )
    first = F.col("reddit_first_shared_at")
    out = out.withColumn("propagation_delay_hours", mx.delay_hours(F.col("published_at"), first)).withColumn(
        "sentiment_gap", sx.gap(F.col("youtube_sentiment"), F.col("reddit_sentiment"))
    )
    return out.select(
        "video_id", "title", "channel_title",
        F.col("views").alias("youtube_views"), F.col("likes").alias("youtube_likes"),
        F.col("published_at").alias("youtube_published_at"),
        F.slice("tags", 1, 6).alias("youtube_tags"),
        "total_reddit_shares", "reddit_posts", "reddit_subreddits",
        F.when(F.col("upvotes") != 0, F.col("upvotes")).alias("reddit_total_upvotes"),
        F.when(F.coalesce("post_comments", F.lit(0)) != 0, F.col("post_comments"))
        .otherwise(F.col("total_reddit_shares")).alias("reddit_total_comments"),
        "reddit_first_shared_at", "reddit_latest_shared_at", "last_ingested_at",
        "propagation_delay_hours",
        mx.delay_class(F.col("propagation_delay_hours"), first, "Recent Community Discovery").alias("propagation_speed"),
        "youtube_sentiment", "reddit_sentiment", "sentiment_gap",
        sx.list_note(F.col("youtube_sentiment"), F.col("reddit_sentiment"), F.col("sentiment_gap"))
        .alias("sentiment_disparity_note"),
        keywords.video_topics(F.col("tags"), F.col("_terms")).alias("topics"),
        linking.overall_match(F.col("_url"), F.col("_sem")).alias("match_type"),
        "similarity_score",
    )
