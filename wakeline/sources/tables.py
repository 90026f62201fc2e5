"""Scans over the stored tables (comments, payload snapshots, accounts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def scan_comments(
    comments: DataFrame,
    platform: str | None = None,
    parent_id: str | None = None,
    label: str | None = None,
    columns: list[str] | None = None,
    newest: int | None = None,
) -> DataFrame:
    """Filter, project and optionally keep the newest rows. Filters reach the scan."""
    out = comments
    if platform:
        out = out.where(F.col("platform") == platform)
    if parent_id:
        out = out.where(F.lower("parent_id") == parent_id.lower())
    if label:
        out = out.where(F.col("sentiment_label") == label)
    if newest is not None:
        out = out.orderBy(F.desc("ingested_at"), "platform_id").limit(newest)
    return out.select(*columns) if columns else out


def scan_payloads(payloads: DataFrame, platform: str, keys: DataFrame | None = None) -> DataFrame:
    """Snapshots of one platform; with ``keys(platform_id)`` only those."""
    out = payloads.where(F.col("platform") == platform)
    return out if keys is None else out.join(keys.select("platform_id"), "platform_id", "left_semi")


def newest_payloads(payloads: DataFrame, platform: str, n: int) -> DataFrame:
    """The ``n`` most recently ingested snapshots (candidate set of a scoped match)."""
    return payloads.where(F.col("platform") == platform).orderBy(F.desc("ingested_at"), "platform_id").limit(n)


def scan_accounts(accounts: DataFrame, platform: str | None = None, newest_first: bool = False) -> DataFrame:
    out = accounts if platform is None else accounts.where(F.col("platform") == platform)
    if newest_first:
        return out.orderBy(F.desc("updated_at"), "platform", "platform_id")
    return out.orderBy("platform", "display_name", "platform_id")


def tracked(requests: DataFrame, accounts: DataFrame, is_tracked: bool = True) -> DataFrame:
    """Requests whose account is stored (semi join), or those that have none (anti join)."""
    key = ["platform", "platform_id"]
    keyed = accounts.select("platform", F.lower("platform_id").alias("_k")).distinct()
    req = requests.withColumn("_k", F.lower("platform_id"))
    how = "left_semi" if is_tracked else "left_anti"
    return req.join(keyed, ["platform", "_k"], how).select(*key, *[c for c in requests.columns if c not in key])


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Clean the requested id and say whether it is well formed for its platform."""
    yt = F.col("platform") == "youtube"
    clean = F.when(yt, tx.strip(F.col("request"))).otherwise(tx.clean_subreddit(F.col("request")))
    return requests.withColumn("platform_id", clean).withColumn(
        "is_valid",
        F.when(yt, tx.is_channel_id(F.col("platform_id"))).otherwise(tx.is_subreddit_name(F.col("platform_id"))),
    )
