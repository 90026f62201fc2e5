"""Category priors: lookup, detection, closed-form forecasts and warm-up posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from .. import fixed_values as V
from ..session import inline_table
from .ranking import top_per_group

CATEGORIES = [row[0] for row in V.CATEGORY_PRIORS]
_COLUMNS = [
    "category", "display_name", "base_views", "views_std", "likes_per_view", "comments_per_view", "shares_per_view",
    "growth_rate_per_post", "positive", "neutral", "negative", "weekend_multiplier", "weekday_multiplier",
]


def category_priors(spark: SparkSession) -> DataFrame:
    """The seven prior rows (a local relation: Spark broadcasts it by its size)."""
    rows = [(*row, V.CATEGORY_KEYWORDS.get(row[0], [""]), i) for i, row in enumerate(V.CATEGORY_PRIORS)]
    table = inline_table(spark, [*_COLUMNS, "keywords", "registry_order"], rows)
    return table.withColumn("keywords", F.filter("keywords", lambda k: k != "")).withColumn(
        "sentiment_prior",
        F.create_map(*[x for c in ("positive", "neutral", "negative") for x in (F.lit(c), F.col(c))]),
    )


def canonical_category(c: Column) -> Column:
    """Category name of a name or alias; NULL when unknown."""
    clean = F.lower(F.trim(c))
    aliases = F.create_map(*[F.lit(x) for pair in V.CATEGORY_ALIASES.items() for x in pair])
    return F.when(clean.isin(CATEGORIES), clean).otherwise(F.try_element_at(aliases, clean))


def benchmark_lookup(names: DataFrame, priors: DataFrame, name: str = "name") -> DataFrame:
    """Prior row of each (alias) name; unknown names get the general row."""
    canon = F.coalesce(canonical_category(F.col(name)), F.lit("general"))
    return names.withColumn("category", canon).join(priors, "category")


def keyword_hits(text: Column) -> list[Column]:
    """Whole-word keyword hits per category, in registry order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return [
        F.regexp_count(low, F.lit(r"(?U)\b(?:" + "|".join(V.CATEGORY_KEYWORDS[c]) + r")\b")).alias(f"hits_{c}")
        for c in CATEGORIES if c in V.CATEGORY_KEYWORDS
    ]


NAMED_BY = ("category", "topic", "subreddit")  # the first of these that says anything names the category
CHANNEL_TEXTS = ("title", "description", "display_name")
POST_TEXTS = ("title", "description", "body", "text")


def _named(df: DataFrame) -> Column:
    """Category by the first field of ``NAMED_BY`` that is there and not empty."""
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in NAMED_BY if c in df.columns]
    return canonical_category(F.coalesce(*fields, F.lit(None).cast("string")))


def _texts(df: DataFrame, fields: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *[c for c in fields if c in df.columns])


def detect_category(channels: DataFrame, history: DataFrame, rows: int = 10) -> DataFrame:
    """Category of each channel.

    Order of evidence: explicit category, category of the channel, category of the first ``rows`` posts,
    most keyword hits over channel and post texts (registry order on ties), else general.
    ``channels(channel_id, explicit_category)`` and ``history(channel_id, post_id, published_at)`` have any of the fields
    that name a category and of the texts; the ones they lack say nothing.
    """
    scored = [c for c in CATEGORIES if c in V.CATEGORY_KEYWORDS]
    first = top_per_group(
        history.select("channel_id", "post_id", "published_at", _named(history).alias("_canon"), _texts(history, POST_TEXTS).alias("_text")),
        ["channel_id"], [F.asc("published_at"), F.asc("post_id")], rows,
    )
    per_post = first.select("channel_id", "rank", "_canon", *keyword_hits(F.col("_text")))
    evidence = per_post.groupBy("channel_id").agg(
        F.min_by("_canon", F.when(F.col("_canon").isNotNull(), F.col("rank"))).alias("_from_posts"),
        *[F.sum(f"hits_{c}").alias(f"p_{c}") for c in scored],
    )
    base = channels.select(
        "channel_id",
        canonical_category(F.col("explicit_category")).alias("_explicit"),
        _named(channels).alias("_meta"),
        *keyword_hits(_texts(channels, CHANNEL_TEXTS)),
    ).join(evidence, "channel_id", "left")
    total = {c: F.col(f"hits_{c}") + F.coalesce(f"p_{c}", F.lit(0)) for c in scored}
    best = F.greatest(*total.values())
    by_words = F.coalesce(*[F.when((best > 0) & (total[c] == best), F.lit(c)) for c in scored])
    return base.select(
        "channel_id", F.coalesce("_explicit", "_meta", "_from_posts", by_words, F.lit("general")).alias("category")
    )


def category_forecast(channels: DataFrame, priors: DataFrame, steps: int = 5) -> DataFrame:
    """Compound growth from the category base, or from a channel's own scale and ratios.

    ``channels(channel_id, category[, scale_views, likes_ratio, comments_ratio])``; one row per step.
    """
    def own(name: str, default: str, positive: bool = False) -> Column:
        if name not in channels.columns:
            return F.col(default)
        c = F.col(name)
        return F.when(c > 0 if positive else c.isNotNull() & (c != 0), c).otherwise(F.col(default))

    p = priors.select("category", *_COLUMNS[2:8])
    base = channels.join(p, "category").select(
        "channel_id", "category",
        own("scale_views", "base_views", True).alias("_base"),
        own("likes_ratio", "likes_per_view").alias("_l"),
        own("comments_ratio", "comments_per_view").alias("_c"),
        (1 + F.col("growth_rate_per_post")).alias("_g"),
        F.least(F.lit(0.35), F.greatest(F.lit(0.15), F.col("views_std") / F.col("base_views"))).alias("_spread"),
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
    )
    views = F.col("_base") * F.pow("_g", F.col("step").cast("double"))
    return base.withColumn("_v", views).select(
        "channel_id", "category", "step",
        round_to("_v", 1).alias("predicted_views"),
        round_to(F.col("_v") * F.col("_l"), 1).alias("predicted_likes"),
        round_to(F.col("_v") * F.col("_c"), 1).alias("predicted_comments"),
        round_to(F.col("_v") * (1 - F.col("_spread")), 1).alias("ci_low"),
        round_to(F.col("_v") * (1 + F.col("_spread")), 1).alias("ci_high"),
        F.lit("category_benchmark").alias("engine"),
        F.lit(1.0).alias("prior_weight"),
    )


def warmup_posts(channels: DataFrame, priors: DataFrame) -> DataFrame:
    """Synthetic posts before a channel's first one, three days apart, shrinking by the category growth.

    ``channels(channel_id, category, needed, anchor, scale_views)``; ``needed`` rows each.
    """
    p = priors.select("category", *_COLUMNS[2:11])
    scale = F.when(F.col("scale_views") > 0, F.col("scale_views")).otherwise(F.col("base_views"))
    rows = channels.where(F.col("needed") > 0).join(p, "category").select(
        "channel_id", "category", "anchor", "likes_per_view", "comments_per_view", "shares_per_view",
        "positive", "neutral", "negative",
        F.explode(F.expr("sequence(CAST(needed AS INT), 1, -1)")).alias("back"),
        scale.alias("_scale"), (1 + F.col("growth_rate_per_post")).alias("_g"),
    )
    v = F.greatest(F.lit(1.0), F.col("_scale") / F.pow("_g", F.col("back").cast("double")))
    rows = rows.withColumn("_v", v)

    def part(ratio: str, name: str) -> Column:
        return round_to(F.col("_v") * F.col(ratio), 1).alias(name)

    return rows.select(
        "channel_id",
        F.concat(F.lit("warmup-"), F.col("back").cast("string")).alias("post_id"),
        (F.col("anchor") - F.make_dt_interval(days=F.col("back") * 3)).alias("published_at"),
        "category",
        F.struct(
            round_to("_v", 1).alias("views"), part("likes_per_view", "likes"), part("comments_per_view", "comments"),
            part("shares_per_view", "shares"), F.lit(0.0).alias("saves"),
        ).alias("engagement_metrics"),
        F.struct("positive", "neutral", "negative").alias("sentiment"),
        F.lit(0).alias("topic_encoded"),
        F.lit(True).alias("is_warmup_prior"),
    )
