"""Forecasts of the next posts of every channel at once.

All engines work on one row of facts per channel: post counts and ratio sums are aggregates, and the model
engine keeps the last ten posts as a bounded array, so the recursive steps are narrow transformations without a
window or a shuffle. The state is written once per step, so a plan never holds the steps before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from .. import fixed_values as V
from ..session import settled
from .features import FEATURE_COLUMNS, LAGGED, calendar, engagement_ratios, flatten, last_posts, trailing_mean
from .priors import category_forecast, detect_category, warmup_posts

MIN_POSTS = V.LAG_STEPS + 1
STATE_POSTS = 10  # five lags and a five-row frame never look further back


def baseline_forecast(flat: DataFrame, steps: int = 5, noise_seed: int | None = None) -> DataFrame:
    """Trailing mean with one per cent growth per step; ±20 % interval; optional seeded ±5 % noise."""
    noise = F.lit(1.0) if noise_seed is None else 0.95 + 0.1 * F.rand(noise_seed)
    grown = trailing_mean(flat).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), noise.alias("_noise")
    )
    factor = F.col("_noise") * (1 + F.col("step") * 0.01)
    v = F.greatest(F.lit(0.0), F.col("mean_views") * factor)
    return grown.select(
        "channel_id", "step",
        round_to(v, 1).alias("predicted_views"),
        round_to(F.greatest(F.lit(0.0), F.col("mean_likes") * factor), 1).alias("predicted_likes"),
        round_to(F.greatest(F.lit(0.0), F.col("mean_comments") * factor), 1).alias("predicted_comments"),
        round_to(v * 0.8, 1).alias("ci_low"),
        round_to(v * 1.2, 1).alias("ci_high"),
        F.lit("baseline_moving_avg").alias("engine"),
    )


def _state(flat: DataFrame) -> DataFrame:
    """One row per channel: the last posts (oldest first), the post count and the running ratio sums."""
    fields = ["age", *LAGGED, "topic_encoded", "published_at"]
    recent = last_posts(flat, STATE_POSTS).groupBy("channel_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("recent")
    )
    keep = ("n_posts", "n_ratio", "sum_likes_ratio", "sum_comments_ratio")
    return recent.join(engagement_ratios(flat).select("channel_id", *keep), "channel_id")


def _frame_sum(size: int, term: Callable[[int], str]) -> str:
    """SQL sum of ``term`` over the last ``_width`` posts, oldest first (0 is the newest)."""
    return " + ".join(["0D", *[f"IF({k} < _width{size}, {term(k)}, 0D)" for k in range(size - 1, -1, -1)]])


def _with_latest_features(state: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns and the feature columns of the newest post (more than five posts in total).

    Means and deviations are sums over single fields of the last posts, each layer a projection of its own: inside a
    lambda over the array Spark would compute the mean anew for every element.
    """
    last = state.selectExpr(
        *carried, *[f"try_element_at(recent, {-1 - k}) AS _back{k}" for k in range(V.LAG_STEPS + 1)],
        *[f"least({n}, CAST(n_posts - {V.LAG_STEPS} AS INT), size(recent)) AS _width{n}" for n in V.ROLLING_WINDOWS],
    )
    rolls = [(size, c, f"{c}_roll{size}") for size in V.ROLLING_WINDOWS for c in V.ENGAGEMENT_METRICS]
    means = last.select(
        "*", *[f"_back0.{c}" for c in (*LAGGED, "topic_encoded")], *calendar(F.col("_back0.published_at")),
        *[F.expr(f"coalesce(_back{k}.{c}, 0D) AS {c}_lag{k}") for k in range(1, V.LAG_STEPS + 1) for c in LAGGED],
        *[F.expr(f"({_frame_sum(n, lambda k: f'_back{k}.{c}')}) / _width{n} AS {r}_mean") for n, c, r in rolls],
    )

    def deviation(size: int, c: str, r: str) -> str:
        off = lambda k: f"(_back{k}.{c} - {r}_mean)"
        squares = _frame_sum(size, lambda k: f"{off(k)} * {off(k)}")  # large counters would cancel in Σx² − n·mean²
        return f"IF(_width{size} > 1, sqrt(({squares}) / (_width{size} - 1)), 0D) AS {r}_std"

    helpers = [c for c in last.columns if c not in carried]
    return means.selectExpr("*", *[deviation(*r) for r in rolls]).drop(*helpers)


def model_forecast(history: DataFrame, model, as_of: Column, steps: int = 5, target: str = "views") -> DataFrame:
    """Recursive forecast: predict from the newest post, append the prediction as a post, repeat.

    ``model`` is a fitted ``spark.ml`` model or pipeline (features → ``prediction``). Channels need six posts
    (see ``with_warmup``). Predicted posts carry the time ``as_of`` and the fixed mood 0.5 / 0.4 / 0.1.
    """
    state = _state(flatten(history)).where(F.col("n_posts") >= MIN_POSTS)
    carried = ["channel_id", "recent", "n_posts", "n_ratio", "sum_likes_ratio", "sum_comments_ratio", "done"]
    none = F.array().cast("array<struct<step:int,views:double,likes:double,comments:double>>")
    state = state.withColumn("done", none)
    post_type = state.schema["recent"].dataType.elementType.simpleString()
    for step in range(1, steps + 1):
        scored = model.transform(_with_latest_features(state, carried))
        v = F.col("prediction")
        ratio = lambda s, d: F.coalesce(F.try_divide(F.col(s), F.col("n_ratio")), F.lit(d))
        likes = v * ratio("sum_likes_ratio", V.DEFAULT_LIKES_PER_VIEW)
        comments = v * ratio("sum_comments_ratio", V.DEFAULT_COMMENTS_PER_VIEW)
        scored = scored.select(*carried, v.alias("_v"), likes.alias("_l"), comments.alias("_c"))
        post = F.struct(
            F.lit(0).alias("age"), F.col("_v").alias("views"), F.col("_l").alias("likes"),
            F.col("_c").alias("comments"), F.lit(0.0).alias("shares"), F.lit(0.0).alias("saves"),
            F.lit(0.5).alias("sentiment_positive"), F.lit(0.4).alias("sentiment_neutral"),
            F.lit(0.1).alias("sentiment_negative"), F.lit(0).alias("topic_encoded"), as_of.alias("published_at"),
        ).cast(post_type)
        seen = F.col("_v") > 0
        grow = lambda s, x: F.when(
            seen, F.coalesce(F.col(s), F.lit(0.0)) + F.col(x) / F.col("_v")
        ).otherwise(F.col(s)).alias(s)
        result = F.struct(
            F.lit(step).alias("step"), F.col("_v").alias("views"), F.col("_l").alias("likes"),
            F.col("_c").alias("comments"),
        )
        state = scored.select(
            "channel_id",
            F.slice(F.array_append("recent", post), -F.least(F.lit(STATE_POSTS), F.size("recent") + 1), STATE_POSTS)
            .alias("recent"),
            (F.col("n_posts") + 1).alias("n_posts"),
            (F.col("n_ratio") + seen.cast("int")).alias("n_ratio"),
            grow("sum_likes_ratio", "_l"), grow("sum_comments_ratio", "_c"),
            F.array_append("done", result).alias("done"),
        )
        state = settled(state, "forecast")  # else every step would plan all steps before it again
    out = state.select("channel_id", F.explode("done").alias("f"))
    return out.select(
        "channel_id", "f.step",
        round_to("f.views", 1).alias("predicted_views"), round_to("f.likes", 1).alias("predicted_likes"),
        round_to("f.comments", 1).alias("predicted_comments"),
        round_to(F.col("f.views") * 0.8, 1).alias("ci_low"), round_to(F.col("f.views") * 1.2, 1).alias("ci_high"),
        F.lit("model").alias("engine"),
    )


def with_warmup(history: DataFrame, categories: DataFrame, priors: DataFrame) -> DataFrame:
    """Histories of one to five posts, extended to six with synthetic earlier posts."""
    facts = history.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("published_at").alias("anchor"),
        F.avg(F.coalesce("engagement_metrics.views", F.lit(0.0))).alias("scale_views"),
    ).where(F.col("n") < MIN_POSTS)
    sparse = facts.join(categories, "channel_id").withColumn("needed", F.lit(MIN_POSTS) - F.col("n"))
    extra = warmup_posts(sparse, priors)
    real = history.withColumn("post_id", F.col("post_id").cast("string"))
    return real.unionByName(extra.select(*[c for c in extra.columns if c in real.columns]), allowMissingColumns=True)


def blended_forecast(
    channels: DataFrame, history: DataFrame, priors: DataFrame, steps: int = 5,
    channel_forecast: DataFrame | None = None,
) -> DataFrame:
    """Forecast of every channel by the regime its history allows.

    No posts: category forecast. One to five posts: channel and category forecasts mixed with weight N/5.
    Six or more: the channel forecast alone. ``channel_forecast`` replaces the moving average.
    """
    categories = detect_category(channels, history)
    flat = flatten(history)
    own = channel_forecast if channel_forecast is not None else baseline_forecast(flat, steps)
    scales = engagement_ratios(flat).select(
        "channel_id", "n_posts",
        F.col("mean_all_views").alias("scale_views"),
        F.col("likes_per_view").alias("likes_ratio"), F.col("comments_per_view").alias("comments_ratio"),
    )
    known = categories.join(scales, "channel_id", "left").withColumn("n_posts", F.coalesce("n_posts", F.lit(0)))
    n = F.col("n_posts")
    prior = category_forecast(known.where(n < MIN_POSTS), priors, steps).drop("prior_weight", "engine", "category")
    grid = known.select("channel_id", "category", "n_posts", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    values = ["predicted_views", "predicted_likes", "predicted_comments", "ci_low", "ci_high"]
    j = (
        grid.join(own.select("channel_id", "step", "engine", *[F.col(c).alias(f"o_{c}") for c in values]),
                  ["channel_id", "step"], "left")
        .join(prior.select("channel_id", "step", *[F.col(c).alias(f"p_{c}") for c in values]),
              ["channel_id", "step"], "left")
    )
    weight = F.when(n == 0, 0.0).when(n < MIN_POSTS, F.least(F.lit(1.0), n / F.lit(5.0))).otherwise(1.0)
    j = j.withColumn("_w", weight)

    def mixed(c: str) -> Column:
        mix = round_to(F.col("_w") * F.coalesce(f"o_{c}", F.lit(0.0))
                      + (1 - F.col("_w")) * F.coalesce(f"p_{c}", F.lit(0.0)), 1)
        return F.when(n == 0, F.col(f"p_{c}")).when(n < MIN_POSTS, mix).otherwise(F.col(f"o_{c}")).alias(c)

    return j.select(
        "channel_id", "step", "n_posts", "category", *[mixed(c) for c in values],
        F.when(n == 0, "category_benchmark").when(n < MIN_POSTS, "transfer_learning").otherwise(F.col("engine"))
        .alias("engine"),
        F.when(n == 0, 1.0).when(n < MIN_POSTS, round_to(1 - F.col("_w"), 2)).otherwise(0.0).alias("prior_weight"),
    )


MODEL_FEATURES = [c for c in FEATURE_COLUMNS if c != "views"]
