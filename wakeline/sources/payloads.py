"""API payloads as JSON text → typed rows. Bad units go to an error table, the rest continue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

_CORRUPT = "_corrupt_record"


def _count(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def _thumbnail(thumbs: Column) -> Column:
    return F.coalesce(
        *[F.nullif(thumbs[size]["url"], F.lit("")) for size in ("high", "medium", "default")]
    )


def parse_json(df: DataFrame, json_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows that parse (column ``payload``) and rows that do not."""
    with_flag = f"{schema}, {_CORRUPT} STRING"
    parsed = df.withColumn(
        "payload", F.from_json(json_col, with_flag, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    )
    bad = F.col("payload").isNull() | F.col(f"payload.{_CORRUPT}").isNotNull()
    good = parsed.where(~bad).withColumn("payload", F.col("payload").dropFields(_CORRUPT))
    return good, parsed.where(bad).drop("payload")


def _parsed(df: DataFrame, json_col: str | None, schema: str) -> DataFrame:
    """Rows that parse; without ``json_col``, ``df`` is landed and has its ``payload`` already."""
    return df if json_col is None else parse_json(df, json_col, schema)[0]


def _items(df: DataFrame, json_col: str | None, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    good = _parsed(df, json_col, schema)
    return good.select(*keep, "payload", F.explode("payload.items").alias("item"))


def videos(df: DataFrame, json_col: str | None = "json") -> DataFrame:
    """Video resources: string counters to numbers, best thumbnail, tags default to an empty list."""
    s, st = F.col("item.snippet"), F.col("item.statistics")
    return _items(df, json_col, schemas.VIDEO_LIST_JSON).select(
        F.col("item.id").alias("video_id"),
        F.coalesce(s["title"], F.lit("")).alias("title"),
        s["description"].alias("description"),
        s["channelId"].alias("channel_id"),
        F.coalesce(s["channelTitle"], F.lit("")).alias("channel_title"),
        _thumbnail(s["thumbnails"]).alias("thumbnail_url"),
        tx.parse_iso(s["publishedAt"]).alias("published_at"),
        F.coalesce(s["tags"], F.array().cast("array<string>")).alias("tags"),
        _count(st["viewCount"]).alias("views"),
        _count(st["likeCount"]).alias("likes"),
        _count(st["commentCount"]).alias("comment_count"),
    )


def channels(df: DataFrame, json_col: str | None = "json") -> DataFrame:
    s, st = F.col("item.snippet"), F.col("item.statistics")
    return _items(df, json_col, schemas.CHANNEL_LIST_JSON).select(
        F.col("item.id").alias("channel_id"),
        F.coalesce(s["title"], F.col("item.id")).alias("display_name"),
        F.coalesce(s["description"], F.lit("")).alias("description"),
        _thumbnail(s["thumbnails"]).alias("thumbnail_url"),
        _count(st["subscriberCount"]).alias("subscriber_count"),
        _count(st["viewCount"]).alias("views"),
        _count(st["videoCount"]).alias("video_count"),
    )


def video_listing(df: DataFrame, json_col: str | None = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Search listings of a channel, one row per video, with paging facts."""
    s = F.col("item.snippet")
    return _items(df, json_col, schemas.VIDEO_SEARCH_JSON, keep).select(
        *keep,
        F.col("item.id.videoId").alias("video_id"),
        s["title"].alias("title"),
        s["description"].alias("description"),
        tx.parse_iso(s["publishedAt"]).alias("published_at"),
        _thumbnail(s["thumbnails"]).alias("thumbnail_url"),
        F.col("payload.nextPageToken").alias("next_page_token"),
        F.col("payload.pageInfo.totalResults").alias("total_results"),
    ).where(F.col("video_id").isNotNull())


def comment_threads(df: DataFrame, json_col: str | None = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Top-level comments; the trimmed text has to be longer than five characters."""
    top = F.col("item.snippet.topLevelComment")
    return _items(df, json_col, schemas.COMMENT_THREADS_JSON, keep).select(
        *keep,
        F.coalesce(top["id"], F.col("item.id")).alias("comment_id"),
        F.col("item.snippet.videoId").alias("video_id"),
        top["snippet"]["authorDisplayName"].alias("author"),
        tx.strip(top["snippet"]["textDisplay"]).alias("body"),
        F.coalesce(top["snippet"]["likeCount"], F.lit(0).cast("bigint")).alias("like_count"),
        tx.parse_iso(top["snippet"]["publishedAt"]).alias("published_at"),
    ).where(F.length("body") > 5)


def submissions(df: DataFrame, json_col: str | None = "json") -> DataFrame:
    """Reddit submissions; a ``self`` thumbnail means none."""
    good = _parsed(df, json_col, schemas.SUBMISSION_JSON)
    p = F.col("payload")
    return good.select(
        p["id"].alias("post_id"),
        F.coalesce(p["title"], F.lit("")).alias("title"),
        F.coalesce(p["selftext"], F.lit("")).alias("selftext"),
        F.coalesce(p["author"], F.lit("[deleted]")).alias("author"),
        p["subreddit"].alias("subreddit"),
        F.coalesce(p["score"], F.lit(0).cast("bigint")).alias("score"),
        p["upvote_ratio"].alias("upvote_ratio"),
        F.coalesce(p["num_comments"], F.lit(0).cast("bigint")).alias("num_comments"),
        tx.parse_epoch(p["created_utc"]).alias("created_at"),
        tx.permalink_url(p["permalink"]).alias("permalink"),
        p["url"].alias("url"),
        F.nullif(p["thumbnail"], F.lit("self")).alias("thumbnail_url"),
    )


def reddit_comments(df: DataFrame, json_col: str | None = "json") -> DataFrame:
    """Reddit comments as comment-table rows; empty, deleted and removed bodies are dropped."""
    good = _parsed(df, json_col, schemas.REDDIT_COMMENT_JSON)
    p = F.col("payload")
    body = F.coalesce(p["body"], F.lit(""))
    return good.where(~body.isin("", "[deleted]", "[removed]")).select(
        F.lit("reddit").alias("platform"),
        p["id"].alias("platform_id"),
        tx.clean_subreddit(p["subreddit"]).alias("parent_id"),
        p["post_id"].alias("post_id"),
        p["author"].alias("author"),
        p["body"].alias("body"),
        F.coalesce(p["score"], F.lit(0).cast("bigint")).alias("score"),
        tx.parse_epoch(p["created_utc"]).alias("published_at"),
        p["permalink"].alias("permalink"),
    )


# Schema and reader of each shape of payload.
SHAPES = {
    "videos": (schemas.VIDEO_LIST_JSON, videos),
    "channels": (schemas.CHANNEL_LIST_JSON, channels),
    "video_listing": (schemas.VIDEO_SEARCH_JSON, video_listing),
    "comment_threads": (schemas.COMMENT_THREADS_JSON, comment_threads),
    "submissions": (schemas.SUBMISSION_JSON, submissions),
    "reddit_comments": (schemas.REDDIT_COMMENT_JSON, reddit_comments),
}


def land(df: DataFrame, shape: str, folder: str, json_col: str = "json") -> dict[str, int]:
    """Parse the units of one shape once and write them under ``folder``: parsed ones with their ``payload``, bad ones
    as they came. Returns how many were ``good`` and ``bad``, counted by the same pass."""
    schema = f"{SHAPES[shape][0]}, {_CORRUPT} STRING"
    text = F.col(json_col)
    parsed = df.withColumn("payload", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    bad = F.col("payload").isNull() | F.col(f"payload.{_CORRUPT}").isNotNull()
    units = parsed.withColumn("bad", bad).withColumn(json_col, F.when(F.col("bad"), text)).withColumn(
        "payload", F.when(~F.col("bad"), F.col("payload").dropFields(_CORRUPT)))
    seen = Observation()
    units = units.observe(seen, F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    units.write.mode("overwrite").partitionBy("bad").parquet(folder)
    return seen.get


def landed(spark: SparkSession, shape: str, folder: str, **options) -> tuple[DataFrame, DataFrame]:
    """Rows of the parsed units of a landed folder, and its bad units."""
    units, bad = spark.read.parquet(folder), F.col("bad").cast("string") == "true"
    return SHAPES[shape][1](units.where(~bad), None, **options), units.where(bad).drop("payload", "bad")
