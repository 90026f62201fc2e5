"""Keyword and topic ranking.

Terms are counted with map-side combine; only (group, term) rows are shuffled, never texts. Equal counts
keep the order of first appearance, which is the smallest (document order, token position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranking import top_per_group


def term_counts(
    texts: DataFrame, rule: str, body: str = "body", by: list[str] | None = None, order: list[Column] | None = None
) -> DataFrame:
    """``term, frequency, first_seen`` per group. ``order`` gives the document order (first one seen first)."""
    by = by or []
    seen = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order or [])], F.lit(0).alias("_"))
    docs = texts.select(*by, seen.alias("doc_order"), tx.words(F.col(body), rule).alias("_words"))
    # posexplode_outer: a plain one would tokenise twice, for an inferred size filter.
    terms = docs.select(*by, "doc_order", F.posexplode_outer("_words").alias("pos", "term")).where(
        tx.is_keyword(F.col("term"), rule)
    )
    return terms.groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("frequency"), F.min(F.struct("doc_order", "pos")).alias("first_seen")
    )


def _ranking() -> list[Column]:
    return [F.desc("frequency"), F.asc("first_seen")]


def top_keywords(
    texts: DataFrame, n: int, rule: str = "trend", body: str = "body", order: list[Column] | None = None
) -> DataFrame:
    """The ``n`` most frequent keywords of a whole corpus, ranked."""
    best = term_counts(texts, rule, body, order=order).orderBy(*_ranking()).limit(n)
    # n rows are left, so the global rank is cheap.
    return best.select(
        F.row_number().over(Window.orderBy(*_ranking())).alias("rank"), F.col("term").alias("keyword"), "frequency"
    )


def top_keywords_per(
    texts: DataFrame, by: list[str], n: int, rule: str = "topic", body: str = "body", order: list[Column] | None = None
) -> DataFrame:
    counts = term_counts(texts, rule, body, by, order)
    return top_per_group(counts, by, _ranking(), n).select(*by, "rank", F.col("term").alias("keyword"), "frequency")


def keyword_lists(ranked: DataFrame, by: list[str], name: str = "topics") -> DataFrame:
    """Ranked keywords as one array per group (bounded by the n used before)."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    return ranked.groupBy(*by).agg(F.transform(pairs, lambda p: p["keyword"]).alias(name))


def correlate_topics(reddit: DataFrame, youtube: DataFrame, size: int = 8) -> DataFrame:
    """Topic table from two ranked keyword lists (``rank, keyword``, 12 rows each).

    Shared topics are Reddit's order restricted to YouTube's; without any, the first three of each side cut
    to four. Then the first four of each side follow; the first ``size`` distinct topics are kept.
    """
    r = reddit.select("keyword", F.col("rank").alias("rd"))
    y = youtube.select("keyword", F.col("rank").alias("yt"))
    both = r.join(y, "keyword", "full_outer")
    shared = F.col("rd").isNotNull() & F.col("yt").isNotNull()
    # At most 24 rows are left here, so a window over all of them is one small task.
    everything = Window.partitionBy()
    rows = both.select(
        "*", F.max(shared.cast("int")).over(everything).alias("any_shared"), F.count("rd").over(everything).alias("n_rd")
    )
    first_reddit = F.least("n_rd", F.lit(3))
    from_youtube = first_reddit + F.col("yt")
    fallback = F.when(F.col("rd") <= 3, F.col("rd")).when(
        (F.col("yt") <= 3) & (from_youtube <= 4), from_youtube
    )

    def place(group: int, at: Column) -> Column:
        return F.struct(F.lit(group).alias("group"), at.cast("int").alias("at"))

    key = (
        F.when((F.col("any_shared") == 1) & shared, place(0, F.col("rd")))
        .when((F.col("any_shared") == 0) & fallback.isNotNull(), place(0, fallback))
        .when(F.col("rd") <= 4, place(1, F.col("rd")))
        .when(F.col("yt") <= 4, place(2, F.col("yt")))
    )
    kept = rows.withColumn("_key", key).where(F.col("_key").isNotNull()).orderBy("_key").limit(size)
    return kept.select(
        F.row_number().over(Window.orderBy("_key")).alias("position"),
        F.col("keyword").alias("topic"),
        (F.col("_key.group") == 0).alias("is_shared"),
        F.when(F.col("yt").isNotNull(), "High").otherwise("Medium").alias("youtube_relevance"),
        F.when(F.col("rd").isNotNull(), "High").otherwise("Medium").alias("reddit_discussion_volume"),
    )


def video_topics(tags: Column, discussion_terms: Column) -> Column:
    """First four tags, then the discussion terms; distinct, first six."""
    none = F.array().cast("array<string>")
    joined = F.concat(F.slice(F.coalesce(tags, none), 1, 4), F.coalesce(discussion_terms, none))
    return F.slice(F.array_distinct(joined), 1, 6)
