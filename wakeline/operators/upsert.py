"""Idempotent writes expressed as table-to-table merges.

All of them combine duplicate keys with map-side aggregates (``max_by`` / ``min_by``), never with an
unbounded window, so one key holding a large part of the input does not land in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT_KEY = ("platform", "platform_id")


def set_fields(
    existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = COMMENT_KEY, order: tuple[str, ...] = ("ingested_at",)
) -> DataFrame:
    """Field-wise upsert: for every column the newest value that is present wins.

    Incoming rows beat stored ones whatever their time; columns an incoming row lacks keep the stored value.
    """
    both = existing.withColumn("_src", F.lit(0)).unionByName(
        incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True
    )
    return of_states(field_states(both, key, ("_src", *order)), key).select(*[c for c in both.columns if c != "_src"])


def field_states(rows: DataFrame, key: tuple[str, ...] = COMMENT_KEY, order: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    """Per key and field the newest present value, with its order: ``struct(<order>, value)``, null where none is present.

    Equal orders are settled by the larger value (maps, which have no order, by chance)."""

    def newest(c: str) -> Column:
        if rows.schema[c].dataType.typeName() == "map":
            return F.struct(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias("value")).alias(c)
        return F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("value")))).alias(c)

    return rows.groupBy(*key).agg(*[newest(c) for c in rows.columns if c not in (*key, "_src")])


def merged_states(states: DataFrame, key: tuple[str, ...] = COMMENT_KEY) -> DataFrame:
    """States of the same keys, from any number of merges in any order, as one state each."""
    return states.groupBy(*key).agg(*[F.max(c).alias(c) for c in states.columns if c not in key])


def of_states(states: DataFrame, key: tuple[str, ...] = COMMENT_KEY) -> DataFrame:
    """The rows that states stand for."""
    return states.select(*key, *[F.col(c)["value"].alias(c) for c in states.columns if c not in key])


def insert_only(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = COMMENT_KEY) -> DataFrame:
    """Rows to append: keys that are not stored yet, one row per key (the first by content order)."""
    fresh = incoming.join(existing.select(*key), list(key), "left_anti")
    row = F.struct(*[c for c in incoming.columns if c not in key])
    return fresh.groupBy(*key).agg(F.min(row).alias("_row")).select(*key, "_row.*").select(*incoming.columns)


def replace_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Payload snapshots: the newest incoming row of a key replaces the stored one whole, missing fields included."""
    row = F.struct("ingested_at", *[c for c in incoming.columns if c not in (*COMMENT_KEY, "ingested_at")])
    newest = incoming.groupBy(*COMMENT_KEY).agg(F.max(row).alias("_row")).select(*COMMENT_KEY, "_row.*")
    kept = existing.join(newest.select(*COMMENT_KEY), list(COMMENT_KEY), "left_anti")
    return kept.unionByName(newest.select(*incoming.columns), allowMissingColumns=True).select(*existing.columns)


def upsert_accounts(accounts: DataFrame, incoming: DataFrame, key: tuple[str, ...] = COMMENT_KEY) -> DataFrame:
    """Update attributes; an account that exists keeps its ``id``, ``created_at`` and metadata."""
    row = F.struct("updated_at", *[c for c in incoming.columns if c not in (*key, "updated_at")])
    newest = incoming.groupBy(*key).agg(F.max_by(row, F.col("updated_at")).alias("n"))
    joined = accounts.alias("o").join(newest.alias("u"), list(key), "full_outer")
    keep_old = {"id", "created_at", "extra_metadata"}
    have = set(incoming.columns)

    def pick(c: str) -> Column:
        old = F.col(f"o.{c}")
        if c not in have:
            return old.alias(c)
        new = F.col(f"n.{c}")
        return (F.coalesce(old, new) if c in keep_old else F.coalesce(new, old)).alias(c)

    return joined.select(*[F.col(c) if c in key else pick(c) for c in accounts.columns])


def merge_sentiment(
    accounts: DataFrame, summaries: DataFrame, key: tuple[str, ...] = COMMENT_KEY, model: str | None = None,
    analyzed_at: Column | None = None,
) -> DataFrame:
    """Write the ``sentiment`` entry of the metadata map; all other entries survive.

    The entry names the ``model`` and the time of the analysis, which is also the account's ``updated_at``.
    """
    at = F.lit(None).cast("timestamp") if analyzed_at is None else analyzed_at
    block = F.to_json(F.struct(
        "positive_pct", "neutral_pct", "negative_pct", "total_comments_analyzed", F.lit(model).cast("string").alias("model"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("analyzed_at"),
    ))
    fresh = summaries.select(*key, block.alias("_block"))
    old = F.coalesce("extra_metadata", F.create_map().cast("map<string,string>"))
    others = F.map_filter(old, lambda k, v: k != "sentiment")
    merged = F.when(F.col("_block").isNull(), F.col("extra_metadata")).otherwise(
        F.map_concat(others, F.create_map(F.lit("sentiment"), F.col("_block")))
    )
    out = accounts.join(fresh, list(key), "left").withColumn("extra_metadata", merged)
    if analyzed_at is not None and "updated_at" in accounts.columns:
        out = out.withColumn("updated_at", F.when(F.col("_block").isNotNull(), at).otherwise(F.col("updated_at")))
    return out.select(*accounts.columns)


def sentiment_block(accounts: DataFrame) -> DataFrame:
    """The stored sentiment entry back as a struct (NULL when an account was never analysed)."""
    from ..schemas import SENTIMENT_SUMMARY

    entry = F.try_element_at("extra_metadata", F.lit("sentiment"))
    return accounts.withColumn("sentiment", F.from_json(entry, SENTIMENT_SUMMARY))
