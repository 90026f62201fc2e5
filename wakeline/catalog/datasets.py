"""Social tables derived from the supplied star-schema tables.

The supplied data has no social tables, so comments, videos, posts, accounts and post histories are
expressed as projections of whole supplied tables. Video 0 receives a third of all linked comments: the
hot key every per-video query has to survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

_LETTERS = ("0123456789", "abcdefghij")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def video_id(number):
    """Eleven characters, like every video id."""
    return F.concat(F.lit("v"), F.lpad(number.cast("string"), 10, "0"))


def letters(number):
    """A number spelled with letters: words that text rules can find."""
    return F.translate(F.lpad(number.cast("string"), 9, "0"), *_LETTERS)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels as YouTube and Reddit comments."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return comments_from(d.join(lab, "doc_id", "left"))


def comments_from(d: DataFrame) -> DataFrame:
    no = F.when(F.col("n_chars") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("doc_id") / 10)).cast("bigint")
    video = video_id(no)
    link = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit(" https://youtu.be/"), video)).when(
        F.col("n_chars") % 5 == 1, F.concat(F.lit(" www.youtube.com/watch?x=1&v="), video)
    )
    mention = F.when(
        F.col("n_chars") % 5 == 2,
        F.concat(F.lit(" the studio "), letters(no), F.lit(" made take "), letters(no), F.lit(" again")),
    )
    is_yt = F.col("doc_id") % 2 == 0
    published = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").when(
        F.col("quality") == 0, "neutral"
    )
    return d.select(
        F.when(is_yt, "youtube").otherwise("reddit").alias("platform"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("platform_id"),
        F.lower("source").alias("parent_id"),
        F.when(is_yt, video).alias("video_id"),
        F.when(~is_yt, F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))).alias("post_id"),
        F.when(F.col("n_chars") % 11 == 0, "[deleted]").when(F.col("n_chars") % 13 == 0, "AutoModerator")
        .otherwise(F.concat(F.lit("user"), F.floor(F.col("doc_id") / 3).cast("string"))).alias("author"),
        F.concat("text", F.coalesce(link, mention, F.lit(""))).alias("body"),
        F.when(~is_yt, F.concat(F.lit("/r/x/comments/"), F.col("doc_id").cast("string"))).alias("permalink"),
        F.when(is_yt, F.col("n_chars") % 50).alias("like_count"),
        F.when(~is_yt, F.col("n_chars") % 100 - 5).alias("score"),
        published.alias("published_at"),
        F.timestamp_seconds(F.unix_timestamp(published) + F.col("n_chars") % 3600).alias("ingested_at"),
        label.alias("sentiment_label"),
        F.when(label.isNotNull(), F.lit(0.9)).alias("sentiment_score"),
        label.isNotNull().alias("sentiment_processed"),
        F.col("n_chars"),
    )


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a video listing."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        video_id(k).alias("video_id"),
        F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" [take "), letters(k), F.lit("]")).alias("title"),
        F.concat(F.lit("studio "), letters(k)).alias("channel_title"),
        F.concat(F.lit("A "), F.col("p_name"), F.lit(" of "), F.col("p_brand")).alias("description"),
        F.lower("p_brand").alias("channel_id"),
        F.split("p_name", " ").alias("tags"),
        F.lit(None).cast("string").alias("thumbnail_url"),
        F.floor(F.col("p_retailprice") * 1000).cast("bigint").alias("views"),
        (F.col("p_size") * 100).cast("bigint").alias("likes"),
        (F.col("p_size") * 7).cast("bigint").alias("comment_count"),
        F.timestamp_seconds(F.lit(1703980800) + k * 7200).alias("published_at"),
        k.alias("video_no"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos(spark, sf_dir).select(
        "video_id", "title", "channel_title", "thumbnail_url", "views", "likes", "comment_count", "published_at", "tags"
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as Reddit submissions. Some link a video, some name a studio and a take or title words."""
    p = table(spark, sf_dir, "pages")
    n = F.length("html")
    no = F.when(n % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("page_id") / 5)).cast("bigint")
    link = F.concat(F.lit(" https://youtu.be/"), video_id(no))
    named = F.concat(F.lit(" the studio "), letters(no))
    text = (
        F.when(n % 4 == 0, link)
        .when(n % 4 == 1, F.concat(named, F.lit(" and take "), letters(no)))
        .when(n % 4 == 2, F.concat(named, F.lit(" small ring economy "), letters(no)))
        .otherwise("")
    )
    return p.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("post_id"),
        F.when(n % 7 == 0, "spam_corner").otherwise(F.concat(F.lit("Sub"), (n % 9).cast("string"))).alias("subreddit"),
        F.concat(F.lit("Post "), F.col("page_id").cast("string")).alias("title"),
        F.concat("html", text).alias("selftext"),
        F.when(n % 5 == 0, F.concat(F.lit("https://i.redd.it/"), F.col("page_id").cast("string")))
        .otherwise(F.col("url")).alias("url"),
        (n % 90 - 4).cast("bigint").alias("score"),
        (n % 40).cast("bigint").alias("num_comments"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600 - n % 5 * 86400).alias("created_at"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per (platform, parent_id) of the comments."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    is_yt = F.col("doc_id") % 2 == 0
    published = F.lit(1704067200) + F.col("doc_id") * 3600
    grouped = d.groupBy(
        F.when(is_yt, "youtube").otherwise("reddit").alias("platform"), F.lower("source").alias("platform_id")
    ).agg(
        F.sum("n_chars").alias("subscriber_count"),
        F.timestamp_seconds(F.min(published)).alias("created_at"),
        F.timestamp_seconds(F.max(published)).alias("updated_at"),
    )
    return grouped.select(
        F.concat_ws(":", "platform", "platform_id").alias("id"), "platform", "platform_id",
        F.concat(F.lit("Name "), F.upper("platform_id")).alias("display_name"),
        F.lit(None).cast("string").alias("description"), "subscriber_count",
        F.lit(None).cast("string").alias("profile_image_url"),
        F.create_map(F.lit("origin"), F.lit("import")).alias("extra_metadata"),
        "created_at", "updated_at",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account snapshots: totals of the comments under each account."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    is_yt = F.col("doc_id") % 2 == 0
    g = d.groupBy(
        F.when(is_yt, "youtube").otherwise("reddit").alias("platform"), F.lower("source").alias("platform_id")
    ).agg(
        F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars") % 50).alias("likes"),
        F.timestamp_seconds(F.max(F.lit(1704067200) + F.col("doc_id") * 3600 + 600)).alias("ingested_at"),
    )
    yt = F.col("platform") == "youtube"
    null = F.lit(None).cast("bigint")
    return g.select(
        "platform", "platform_id", F.concat(F.lit("Name "), F.upper("platform_id")).alias("title"),
        F.struct(
            F.when(yt, F.col("chars")).alias("views"), F.when(yt, F.col("likes")).alias("likes"),
            F.when(yt, F.col("n")).alias("video_count"), F.when(yt, F.col("n") * 2).alias("comment_count"),
            F.when(~yt, F.col("n")).alias("comments"), null.alias("comments_sampled"),
            null.alias("comment_likes_sampled"), F.when(~yt, F.col("chars")).alias("members"),
            null.alias("subscribers"), null.alias("upvotes"),
        ).alias("stats"),
        F.struct(F.lit("").alias("description")).alias("raw"),
        "ingested_at",
    )


def post_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as posts, one channel per customer (1 to 25 posts each; some customers have none)."""
    o = table(spark, sf_dir, "orders")
    views = F.floor(F.col("o_totalprice") / 10).cast("double")
    mood = (F.col("o_orderkey") % 10).cast("double") / 10
    word = F.when(F.col("o_orderstatus") == "F", "a python tutorial, python code").when(
        F.col("o_orderstatus") == "O", "live concert and album review"
    ).otherwise("breaking world news")
    return o.select(
        F.col("o_custkey").alias("channel_id"),
        F.col("o_orderkey").alias("post_id"),
        F.col("o_orderdate").alias("published_at"),
        F.concat(word, F.lit(" "), F.lower("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Videogames")
        .when(F.col("o_orderpriority") == "5-LOW", "unlisted").alias("category"),
        F.struct(
            views.alias("views"), F.floor(views * 0.06).cast("double").alias("likes"),
            F.floor(views * 0.01).cast("double").alias("comments"),
            (F.col("o_orderkey") % 40).cast("double").alias("shares"), F.lit(0.0).alias("saves"),
        ).alias("engagement_metrics"),
        F.struct(mood.alias("positive"), ((1 - mood) / 2).alias("neutral"), ((1 - mood) / 2).alias("negative"))
        .alias("sentiment"),
        (F.col("o_orderkey") % 7).cast("int").alias("topic_encoded"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as channels with category metadata."""
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("channel_id"),
        F.when((seg == "MACHINERY") & (F.col("c_nationkey") < 5), "technology").alias("explicit_category"),
        F.when((seg == "FURNITURE") & (F.col("c_nationkey") < 9), "vlog").when(seg == "BUILDING", "diy")
        .alias("category"),
        F.col("c_name").alias("title"),
        F.when(seg == "HOUSEHOLD", "learn how to cook").alias("description"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """embeddings: rows with label 0 to 4 as discussions, 5 to 9 as candidate videos."""
    e = table(spark, sf_dir, "embeddings")
    d = e.where(F.col("label") < 5).select(F.col("vec_id").alias("platform_id"), "embedding")
    v = e.where(F.col("label") >= 5).select(F.col("vec_id").alias("video_id"), "embedding")
    return d, v
