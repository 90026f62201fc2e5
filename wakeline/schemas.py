"""Explicit schemas (DDL) of the logical tables and of the API payloads that land as JSON."""

COMMENTS = (
    "platform STRING, platform_id STRING, parent_id STRING, video_id STRING, post_id STRING, "
    "author STRING, body STRING, permalink STRING, like_count BIGINT, score BIGINT, "
    "published_at TIMESTAMP, ingested_at TIMESTAMP, sentiment_processed BOOLEAN, "
    "sentiment_processed_at TIMESTAMP, sentiment_label STRING, sentiment_score DOUBLE, "
    "match_type STRING, similarity_score DOUBLE"
)
STATS = (
    "views: BIGINT, likes: BIGINT, video_count: BIGINT, comment_count: BIGINT, comments: BIGINT, "
    "comments_sampled: BIGINT, comment_likes_sampled: BIGINT, members: BIGINT, subscribers: BIGINT, upvotes: BIGINT"
)
PAYLOADS = (
    "platform STRING, platform_id STRING, title STRING, "
    f"stats STRUCT<{STATS}>, raw STRUCT<description: STRING>, ingested_at TIMESTAMP"
)
ACCOUNTS = (
    "id STRING, platform STRING, platform_id STRING, display_name STRING, description STRING, "
    "subscriber_count BIGINT, profile_image_url STRING, extra_metadata MAP<STRING, STRING>, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
POST_HISTORY = (
    "channel_id STRING, post_id STRING, published_at TIMESTAMP, title STRING, category STRING, "
    "engagement_metrics STRUCT<views: DOUBLE, likes: DOUBLE, comments: DOUBLE, shares: DOUBLE, saves: DOUBLE>, "
    "engagement STRUCT<views: DOUBLE, likes: DOUBLE, comments: DOUBLE, shares: DOUBLE, saves: DOUBLE>, "
    "sentiment STRUCT<positive: DOUBLE, neutral: DOUBLE, negative: DOUBLE>, topic_encoded INT"
)
SENTIMENT_SUMMARY = (
    "positive_pct DOUBLE, neutral_pct DOUBLE, negative_pct DOUBLE, total_comments_analyzed BIGINT, "
    "model STRING, analyzed_at STRING"
)

_THUMBS = (
    "thumbnails: STRUCT<high: STRUCT<url: STRING>, medium: STRUCT<url: STRING>, `default`: STRUCT<url: STRING>>"
)
VIDEO_LIST_JSON = (
    "items ARRAY<STRUCT<id: STRING, snippet: STRUCT<title: STRING, description: STRING, channelId: STRING, "
    f"channelTitle: STRING, publishedAt: STRING, tags: ARRAY<STRING>, {_THUMBS}>, "
    "statistics: STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>>>"
)
CHANNEL_LIST_JSON = (
    f"items ARRAY<STRUCT<id: STRING, snippet: STRUCT<title: STRING, description: STRING, {_THUMBS}>, "
    "statistics: STRUCT<subscriberCount: STRING, viewCount: STRING, videoCount: STRING>>>"
)
VIDEO_SEARCH_JSON = (
    "nextPageToken STRING, pageInfo STRUCT<totalResults: BIGINT>, items ARRAY<STRUCT<id: STRUCT<videoId: STRING>, "
    f"snippet: STRUCT<title: STRING, description: STRING, publishedAt: STRING, {_THUMBS}>>>"
)
COMMENT_THREADS_JSON = (
    "nextPageToken STRING, items ARRAY<STRUCT<id: STRING, snippet: STRUCT<videoId: STRING, topLevelComment: "
    "STRUCT<id: STRING, snippet: STRUCT<textDisplay: STRING, authorDisplayName: STRING, likeCount: BIGINT, "
    "publishedAt: STRING>>>>>"
)
SUBMISSION_JSON = (
    "id STRING, title STRING, selftext STRING, author STRING, subreddit STRING, score BIGINT, upvote_ratio DOUBLE, "
    "num_comments BIGINT, created_utc DOUBLE, permalink STRING, url STRING, thumbnail STRING"
)
REDDIT_COMMENT_JSON = (
    "id STRING, post_id STRING, subreddit STRING, author STRING, body STRING, score BIGINT, created_utc DOUBLE, "
    "permalink STRING"
)
