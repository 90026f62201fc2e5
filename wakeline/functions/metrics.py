"""Engagement and propagation measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_to
from .text import truthy


def _clamp(score: Column) -> Column:
    return round_to(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2)


def engagement_index(platform: Column, stats: Column) -> Column:
    """0–100 index of an account from its statistics struct."""

    def at_least(low: int, *names: str) -> Column:
        picked = truthy(*[stats[n] for n in names]) if len(names) > 1 else stats[names[0]]
        return F.greatest(F.lit(low).cast("bigint"), F.coalesce(picked, F.lit(0)).cast("bigint")).cast("double")

    views, likes = at_least(1, "views"), at_least(0, "likes")
    yt_comments = at_least(0, "comments", "comment_count")
    youtube = F.log10(views) / 7 * (
        F.least(likes / views, F.lit(1.0)) * 50 + F.least(yt_comments / views, F.lit(1.0)) * 50
    )
    reach, talk = at_least(1, "upvotes", "members", "subscribers"), at_least(0, "comments")
    ratio = F.least(talk / F.greatest(F.lit(1.0), reach + talk), F.lit(1.0))
    reddit = F.log10(reach) / 6 * F.when(talk > 0, 50 + ratio * 50).otherwise(F.lit(50.0))
    return F.when(platform == "youtube", _clamp(youtube)).when(platform == "reddit", _clamp(reddit)).otherwise(0.0)


def delay_hours(published: Column, first_shared: Column) -> Column:
    """Hours from publication to the first share, one decimal, never negative."""
    micros = F.unix_micros(first_shared.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))
    # greatest() skips NULL, so an unknown time has to be kept out of it.
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), round_to(micros / 1_000_000 / 3600.0, 1)))


def delay_class(delay: Column, first_shared: Column, undated: str) -> Column:
    """Speed class; ``undated`` names videos that were shared but have no publish date."""
    days = F.floor(delay / 24).cast("string")
    return (
        F.when(delay <= 6, "Rapid (< 6h)")
        .when(delay <= 24, "Moderate (6-24h)")
        .when(delay <= 72, "Delayed (1-3d)")
        .when(delay.isNotNull(), F.concat(F.lit("Archival ("), days, F.lit("d lag)")))
        .when(first_shared.isNotNull(), undated)
    )


def growth_velocity(subscribers: Column, created_at: Column, as_of: Column) -> Column:
    """Subscribers per whole day alive (at least one day)."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(created_at)) / 86400)
    return F.coalesce(subscribers, F.lit(0)) / F.greatest(days, F.lit(1))


def later_of(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def answer_budget(question: Column) -> Column:
    """Length class of an answer by the number of words asked."""
    n = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return F.when(n <= 10, 400).when(n <= 25, 700).otherwise(1200)
