"""Time-series features per channel: lags, rolling statistics, calendar columns.

Post order inside a channel is needed, but a channel may hold a large share of all posts, so no window runs
over a whole channel. Positions are counted in two levels (inside a time bucket, plus the sizes of the
buckets before), then windows run over chunks of consecutive positions; every chunk also receives the few
rows before it that its first rows look back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V

CHUNK_ROWS = 50_000
LAGGED = (*V.ENGAGEMENT_METRICS, *V.SENTIMENT_METRICS)
CALENDAR = ("day_of_week", "hour_of_day", "month", "is_weekend")
LAG_COLUMNS = [f"{c}_lag{k}" for k in range(1, V.LAG_STEPS + 1) for c in LAGGED]
ROLLING_COLUMNS = [
    f"{c}_roll{w}_{s}" for w in V.ROLLING_WINDOWS for c in V.ENGAGEMENT_METRICS for s in ("mean", "std")
]
FEATURE_COLUMNS = [*LAGGED, "topic_encoded", *CALENDAR, *LAG_COLUMNS, *ROLLING_COLUMNS]


def flatten(history: DataFrame) -> DataFrame:
    """Nested post records to flat numeric columns; missing values are 0, ``engagement`` is the fallback key."""
    eng = F.coalesce("engagement_metrics", "engagement") if "engagement" in history.columns else F.col(
        "engagement_metrics"
    )
    metrics = [F.coalesce(eng[c].cast("double"), F.lit(0.0)).alias(c) for c in V.ENGAGEMENT_METRICS]
    moods = [
        F.coalesce(F.col("sentiment")[c.split("_")[1]].cast("double"), F.lit(0.0)).alias(c)
        for c in V.SENTIMENT_METRICS
    ]
    return history.select(
        "channel_id", "post_id", "published_at", *metrics, *moods,
        F.coalesce(F.col("topic_encoded").cast("int"), F.lit(0)).alias("topic_encoded"),
    )


def calendar(ts: Column) -> list[Column]:
    """Monday-based weekday, hour, month and weekend flag, with the defaults for an unknown time."""
    dow = F.coalesce(F.weekday(ts), F.lit(0))
    return [
        dow.alias("day_of_week"),
        F.coalesce(F.hour(ts), F.lit(12)).alias("hour_of_day"),
        F.coalesce(F.month(ts), F.lit(1)).alias("month"),
        (dow >= 5).cast("int").alias("is_weekend"),
    ]


def temporal_features(flat: DataFrame) -> DataFrame:
    return flat.select("*", *calendar(F.col("published_at")))


def with_positions(df: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``position`` (1-based, by time then post id) and ``n_posts`` of the channel."""
    bucket = F.coalesce(F.floor(F.unix_timestamp(F.col("published_at").cast("timestamp")) / bucket_seconds), F.lit(-1))
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy("channel_id", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy("channel_id")
    before = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "channel_id", "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(w).alias("n_posts"),
    )
    inside = Window.partitionBy("channel_id", "_bucket").orderBy("published_at", "post_id")
    placed = keyed.withColumn("_in", F.row_number().over(inside)).join(offsets, ["channel_id", "_bucket"])
    return placed.withColumn("position", F.col("_offset") + F.col("_in")).drop("_bucket", "_offset", "_in")


def in_chunks(df: DataFrame, look_back: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_halo``: rows copied into the next chunk only to be looked back to."""
    home = F.floor((F.col("position") - 1) / chunk_rows)
    is_tail = (F.col("position") - 1) % chunk_rows >= chunk_rows - look_back
    has_next = (home + 1) * chunk_rows < F.col("n_posts")
    targets = F.when(is_tail & has_next, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(targets)).withColumn(
        "_halo", F.col("_chunk") != F.col("_home")
    ).drop("_home")


def _chunk_window():
    return Window.partitionBy("channel_id", "_chunk").orderBy("position")


def feature_matrix(history: DataFrame, chunk_rows: int = CHUNK_ROWS, bucket_seconds: int = 86_400) -> DataFrame:
    """All features of every post that has enough history.

    Channels with more than five posts lose their first five rows; shorter ones keep all rows, with lags
    back-filled from the next row that has one and 0 otherwise. Rolling frames only contain kept rows.
    """
    steps = V.LAG_STEPS
    flat = temporal_features(flatten(history))
    placed = in_chunks(with_positions(flat, bucket_seconds), steps, chunk_rows)
    w = _chunk_window()
    short = F.col("n_posts") <= steps
    kept = short | (F.col("position") > steps)

    def lagged(c: str, k: int) -> Column:
        # In a short channel the first row with a k-step lag is row k+1, whose lag is the first value.
        backfill = F.when(short & (F.col("n_posts") > k), F.first(c).over(w)).otherwise(F.lit(0.0))
        return F.coalesce(F.lag(c, k).over(w), backfill).alias(f"{c}_lag{k}")

    rolling = []
    for size in V.ROLLING_WINDOWS:
        frame = w.rowsBetween(-(size - 1), 0)
        for c in V.ENGAGEMENT_METRICS:
            value = F.when(kept, F.col(c))
            rolling.append(F.avg(value).over(frame).alias(f"{c}_roll{size}_mean"))
            rolling.append(F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0)).alias(f"{c}_roll{size}_std"))
    wide = placed.select(
        "*", *[lagged(c, k) for k in range(1, steps + 1) for c in LAGGED], *rolling
    )
    return wide.where(kept & ~F.col("_halo")).select(
        "channel_id", "post_id", "position", "n_posts", *FEATURE_COLUMNS
    )


def last_posts(history: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` posts of each channel, ``age`` 1 is the newest."""
    from .ranking import top_per_group

    return top_per_group(history, ["channel_id"], [F.desc_nulls_last("published_at"), F.desc("post_id")], n, "age")


def trailing_mean(flat: DataFrame, n: int = 5) -> DataFrame:
    """Mean views, likes and comments of the last min(n, N) posts."""
    return last_posts(flat, n).groupBy("channel_id").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("views", "likes", "comments")]
    )


def engagement_ratios(flat: DataFrame) -> DataFrame:
    """Mean of per-post likes/views and comments/views over posts with views, with the default ratios."""
    seen = F.col("views") > 0
    sums = flat.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_posts"),
        F.avg("views").alias("mean_all_views"),
        F.count_if(seen).alias("n_ratio"),
        F.sum(F.when(seen, F.col("likes") / F.col("views"))).alias("sum_likes_ratio"),
        F.sum(F.when(seen, F.col("comments") / F.col("views"))).alias("sum_comments_ratio"),
    )
    return sums.withColumn(
        "likes_per_view", F.coalesce(F.try_divide("sum_likes_ratio", "n_ratio"), F.lit(V.DEFAULT_LIKES_PER_VIEW))
    ).withColumn(
        "comments_per_view",
        F.coalesce(F.try_divide("sum_comments_ratio", "n_ratio"), F.lit(V.DEFAULT_COMMENTS_PER_VIEW)),
    )
