"""Registered queries. Each takes (spark, sf_dir) and returns a flat DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rounding import round_to
from .. import fixed_values as V
from ..functions import metrics as mx
from ..functions import sentiment as sx
from ..functions import text as tx
from ..operators import (
    context,
    features,
    fingerprint,
    forecast,
    keywords,
    linking,
    models,
    priors,
    ranking,
    scoring,
    semantic,
    sentiment,
    upsert,
)
from ..plans import comparison
from ..plans import shared_videos as shared_plan
from ..plans import video_engagement as engagement_plan
from ..session import inline_table, scratch_path, settled
from ..sources import payloads as payload_source
from ..sources import stored
from ..sources import tables as table_source
from ..streaming import comments as streams
from . import datasets as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Valences of frequent words of the supplied prose; the engine takes any lexicon table.
LEXICON = [
    ("the", 0.4), ("and", 0.2), ("der", -0.5), ("la", 1.1), ("de", -0.3), ("que", -1.4), ("und", 0.9),
    ("les", -0.8), ("was", -1.9), ("with", 1.3), ("die", -0.6), ("le", 0.7), ("this", 0.5), ("von", -0.2),
]
AS_OF = "2030-01-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def ts(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def big(c, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or c)


def dbl(c: str):
    """Nullable counters leave as doubles, so NULL has one representation."""
    return F.col(c).cast("double").alias(c)


def joined(c: str, name: str | None = None):
    return F.array_join(c, "|").alias(name or c)


def parts(c: str, prefix: str):
    return [
        *[F.col(f"{c}.{f}").alias(f"{prefix}_{f}") for f in ("positive", "neutral", "negative", "dominant_label")],
        F.col(f"{c}.sample_size").alias(f"{prefix}_n"),
    ]


def lexicon(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ["term", "valence"], LEXICON)


def scorer(spark: SparkSession) -> scoring.Scorer:
    lex = lexicon(spark)
    return lambda texts: scoring.lexicon_scores(texts, lex)


# --- linking and propagation ---------------------------------------------------

@query
def shared_videos(spark, sf):
    c = D.comments(spark, sf)
    out = shared_plan.shared_videos(shared_plan.linked_discussions(c), c, D.facts(spark, sf), D.posts(spark, sf))
    return _shared_columns(out)


def _shared_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "video_id", "title", dbl("youtube_views"), dbl("youtube_likes"), "total_reddit_shares", "reddit_posts",
        "reddit_subreddits", dbl("reddit_total_upvotes"), "reddit_total_comments",
        ts("reddit_first_shared_at"), ts("reddit_latest_shared_at"), "propagation_delay_hours", "propagation_speed",
        *parts("youtube_sentiment", "yt"), *parts("reddit_sentiment", "rd"), "sentiment_gap",
        "sentiment_disparity_note", joined("topics"), "match_type", "similarity_score",
    )


@query
def shared_videos_hybrid(spark, sf):
    """The report with both kinds of links: URLs, and vectors of the comments that hold none."""
    c = D.comments(spark, sf)
    d, v = D.vectors(spark, sf)
    d = d.withColumn("platform_id", F.concat(F.lit("c"), F.col("platform_id").cast("string")))
    v = v.withColumn("video_id", D.video_id(F.floor(F.col("video_id") / 5).cast("bigint")))
    linked = shared_plan.linked_discussions(c, vectors=(d, v), threshold=0.3)
    out = shared_plan.shared_videos(linked, c, D.facts(spark, sf), D.posts(spark, sf))
    return _shared_columns(out).withColumn("similarity_score", round_to("similarity_score", 3))


@query
def video_search(spark, sf):
    """Videos found by text similarity whose title or channel holds a word, with their watch pages."""
    c = D.comments(spark, sf)
    d, v = D.vectors(spark, sf)
    d = d.withColumn("platform_id", F.concat(F.lit("c"), F.col("platform_id").cast("string")))
    v = v.withColumn("video_id", D.video_id(F.floor(F.col("video_id") / 5).cast("bigint")))
    linked = shared_plan.linked_discussions(c, vectors=(d, v), threshold=0.3)
    out = shared_plan.shared_videos(linked, c, D.facts(spark, sf), with_topics=False)
    found = ranking.search_videos(out, "RiNg", semantic_only=True)
    return found.select("video_id", tx.watch_url(F.col("video_id")).alias("watch_url"), "title", "channel_title", "match_type")


@query
def propagation(spark, sf):
    linked = shared_plan.linked_discussions(D.comments(spark, sf))
    first = linked.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("shares"), F.min("published_at").alias("first_shared_at"),
        F.max("published_at").alias("last_shared_at"),
    )
    return streams.share_delays(first, D.videos(spark, sf)).select(
        "video_id", "shares", ts("first_shared_at"), ts("last_shared_at"), "propagation_delay_hours",
        "propagation_speed",
    )


@query
def unmatched_comments(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    return linking.without_url(c).select("platform_id", "parent_id")


@query
def video_engagement_url(spark, sf):
    """Engagement from explicit ids only, over the comments."""
    c, v = D.comments(spark, sf), D.videos(spark, sf)
    reddit = c.where(F.col("platform") == "reddit")
    hits = fingerprint.id_matches(reddit, v, "platform_id", "body")
    d = reddit.drop("video_id").join(hits, "platform_id")
    out = engagement_plan.video_engagement(d, c, D.facts(spark, sf))
    return _engagement_columns(out)


def _engagement_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "video_id", "title", dbl("youtube_views"), "subreddits_count", "total_reddit_discussions", "reddit_posts_count",
        "reddit_total_upvotes", "reddit_total_comments", ts("reddit_first_shared_at"),
        ts("reddit_latest_shared_at"), "propagation_delay_hours", "propagation_speed",
        *parts("youtube_sentiment", "yt"), *parts("reddit_sentiment", "rd"), "sentiment_gap",
        "sentiment_disparity_note", joined("topics"),
    )


@query
def video_engagement(spark, sf):
    """Engagement from all three tiers, over comments and posts."""
    c, v, p = D.comments(spark, sf), D.videos(spark, sf), D.posts(spark, sf)
    prints = settled(fingerprint.fingerprints(v), "prints")
    posts = fingerprint.post_text(p, c)
    of_posts, of_comments = fingerprint.verify_together(posts, engagement_plan.spoken(c), prints)
    accepted = settled(fingerprint.collect_by_tier(posts, v, prints, found=of_posts), "accepted")
    d = engagement_plan.matched_discussions(c, prints, accepted, own=of_comments)
    return _engagement_columns(engagement_plan.video_engagement(d, c, D.facts(spark, sf), accepted))


@query
def video_fingerprint(spark, sf):
    return fingerprint.fingerprints(D.videos(spark, sf)).select(
        "video_id", joined("creator_variants"), joined("topic_words"), joined("distinctive_phrases"),
        joined("tag_phrases"), "full_text",
    )


@query
def verify_tiers(spark, sf):
    p = fingerprint.post_text(D.posts(spark, sf))
    return fingerprint.verify(p, settled(fingerprint.fingerprints(D.videos(spark, sf)), "prints"))


@query
def accepted_posts(spark, sf):
    v = D.videos(spark, sf)
    p = fingerprint.post_text(D.posts(spark, sf), D.comments(spark, sf))
    return fingerprint.collect_by_tier(p, v, settled(fingerprint.fingerprints(v), "prints")).select(
        "video_id", "post_id", "match_type", "similarity_score", "score", big("tier")
    )


@query
def top_threads(spark, sf):
    c, v, p = D.comments(spark, sf), D.videos(spark, sf), D.posts(spark, sf)
    hits = fingerprint.id_matches(fingerprint.post_text(p), v)
    accepted = hits.join(p.select("post_id", "score"), "post_id").select(
        "video_id", "post_id", "score", F.lit("url").alias("match_type"), F.lit(1.0).alias("similarity_score")
    )
    out = engagement_plan.threads(accepted, p, c)
    ids = F.transform("top_comments", lambda x: x["platform_id"])
    return out.select(
        "video_id", big("thread_rank"), "post_id", "subreddit", "score", "thread_label",
        F.coalesce(F.array_join(ids, "|"), F.lit("")).alias("top_comments"),
    )


@query
def overall_match_type(spark, sf):
    """URL links and vector matches of the same discussions, combined per video."""
    d, v = D.vectors(spark, sf)
    sem = semantic.best_match(d, v, threshold=0.2)
    vid = (F.col("platform_id") % 25).cast("bigint")
    url = d.select(vid.alias("video_no"), F.lit("url").alias("match_type"), F.lit(1.0).alias("s"))
    both = url.unionByName(
        sem.select((F.col("video_id") % 50).cast("bigint").alias("video_no"), "match_type",
                   F.col("similarity_score").alias("s"))
    )
    is_sem = F.col("match_type") == "semantic"
    g = both.groupBy("video_no").agg(F.bool_or(~is_sem).alias("u"), F.bool_or(is_sem).alias("m"), F.max("s").alias("s"))
    return g.select(
        "video_no", linking.overall_match(F.col("u"), F.col("m")).alias("match_type"),
        round_to("s", 3).alias("similarity_score"),
    )


@query
def semantic_best_match(spark, sf):
    d, v = D.vectors(spark, sf)
    return semantic.best_match(d, v, threshold=0.3).select(
        big("platform_id"), big("video_id"), "match_type", round_to("similarity_score", 3).alias("similarity_score")
    )


@query
def tfidf_match(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    return semantic.tfidf_match(
        linking.without_url(c), D.videos(spark, sf), threshold=0.1, stop_words=V.TREND_STOP_WORDS
    )


# --- sentiment -----------------------------------------------------------------

@query
def sentiment_tally(spark, sf):
    return sentiment.tally(D.comments(spark, sf))


@query
def sentiment_breakdown(spark, sf):
    out = sentiment.breakdowns(D.comments(spark, sf), ("platform", "parent_id"))
    return out.select("platform", "parent_id", *parts("breakdown", "b"))


@query
def sentiment_gap(spark, sf):
    c = D.comments(spark, sf)
    side = lambda p: sentiment.breakdowns(c.where(F.col("platform") == p), ("parent_id",))
    out = sentiment.with_gap(sentiment.both_sides(side("youtube"), side("reddit"), "parent_id"))
    note = sx.list_note(F.col("youtube_sentiment"), F.col("reddit_sentiment"), F.col("sentiment_gap"))
    return out.select("parent_id", "sentiment_gap", "divergence", "low_sample", note.alias("note"))


@query
def thread_majority(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    return sentiment.majority_label(c, ("post_id",))


@query
def account_facet(spark, sf):
    c = D.comments(spark, sf)
    newest = sentiment.newest_bodies(c, 30).groupBy("platform", "parent_id").agg(
        F.count(F.lit(1)).alias("sampled"), F.min("ingested_at").alias("oldest_sampled")
    )
    return sentiment.facets(c).join(newest, ["platform", "parent_id"]).select(
        "platform", "parent_id", "total", "positive", "negative", "neutral", "sampled", ts("oldest_sampled")
    )


@query
def effective_sentiment(spark, sf):
    c, v = D.comments(spark, sf), D.videos(spark, sf)
    reddit = c.where(F.col("platform") == "reddit")
    linked = linking.link_by_url(reddit)
    by_post = sentiment.breakdowns(linked, ("video_id",))
    yt = linking.youtube_label_counts(c, v)
    yt = yt.select("video_id", sx.breakdown(*(F.col(x) for x in ("n", "pos", "neu", "neg"))).alias("breakdown"))
    primary = sentiment.both_sides(yt, by_post, "video_id")
    every = v.select("video_id").join(primary, "video_id", "left")
    zero = F.lit(0).cast("bigint")
    empty = sx.breakdown(zero, zero, zero, zero)
    every = every.select("video_id", F.coalesce("youtube_sentiment", empty).alias("youtube_sentiment"),
                         F.coalesce("reddit_sentiment", empty).alias("reddit_sentiment"))
    fallback = comparison.compare_videos(c, v)
    out = sentiment.effective_sentiment(every, fallback)
    return out.select("video_id", "source", "sentiment_gap", *parts("youtube_sentiment", "yt"),
                      *parts("reddit_sentiment", "rd"))


@query
def lexicon_score(spark, sf):
    c = D.comments(spark, sf).select(F.col("platform_id").alias("text_key"), "body")
    return scoring.lexicon_scores(c, lexicon(spark)).select(
        F.col("text_key").alias("platform_id"), "compound", "positive", "neutral", "negative", "label", "score"
    )


@query
def lexicon_score_compound(spark, sf):
    """Scores whose confidence is the absolute compound value."""
    c = D.comments(spark, sf).select(F.col("platform_id").alias("text_key"), "body")
    return scoring.lexicon_scores(c, lexicon(spark), mode="compound").select(
        F.col("text_key").alias("platform_id"), "label", "score"
    )


@query
def label_canonical(spark, sf):
    """Raw model labels of any spelling as the three classes; unknown and missing ones are neutral."""
    raw = F.array(*[F.lit(x) for x in ("LABEL_0", "label_2", "Neg", "POS", "2", "0", "neutral", "odd", "", None)])
    d = D.table(spark, sf, "documents").select("doc_id", F.get(raw, (F.col("n_chars") % 10).cast("int")).alias("raw"))
    return d.select("doc_id", "raw", sx.canonical_label(F.col("raw")).alias("label"))


@query
def time_texts(spark, sf):
    """Times of the events in twelve spellings, good and bad, read back."""
    e = D.table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    spell = lambda f: F.date_format("t", f)
    texts = F.array(
        spell("yyyy-MM-dd'T'HH:mm:ss'Z'"), spell("yyyy-MM-dd HH:mm:ss"), spell("yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        spell("yyyyMMdd'T'HHmmss'Z'"), spell("yyyy-MM-dd"), spell("yyyy-MM-dd'T'HH:mm"), spell("HH:mm"),
        spell("'T'HH:mm:ss"), spell("yyyy"), spell("yyyy-MM"), spell("'on 'yyyy-MM-dd"), F.lit(None).cast("string"),
    )
    text = F.get(texts, (F.col("event_id") % 12).cast("int"))
    return e.select("event_id", text.alias("text"), ts(tx.parse_iso(text), "parsed"))


@query
def sentiment_macro_avg(spark, sf):
    c = D.comments(spark, sf)
    scores = scoring.lexicon_scores(c.select(F.col("platform_id").alias("text_key"), "body"), lexicon(spark))
    j = scores.join(c.select(F.col("platform_id").alias("text_key"), "platform", "parent_id"), "text_key")
    return sentiment.macro_average(j, ("platform", "parent_id"))


@query
def label_resolution(spark, sf):
    c = D.comments(spark, sf)
    return scoring.resolve_labels(c, scorer(spark)).select("platform_id", "label", "label_score", "engine")


@query
def unprocessed_scored(spark, sf):
    c = D.comments(spark, sf)
    rows = scoring.score_unprocessed(c, scorer(spark), F.to_timestamp(F.lit(AS_OF)))
    merged = upsert.set_fields(c.select("platform", "platform_id", "ingested_at", "parent_id", "sentiment_label",
                                        "sentiment_score", "sentiment_processed"), rows)
    return merged.select("platform", "platform_id", "sentiment_label", "sentiment_score", "sentiment_processed")


@query
def topup_labels(spark, sf):
    c = D.comments(spark, sf)
    used = sentiment.top_up(c, ("platform", "post_id"))
    return used.groupBy("platform", "post_id").agg(
        F.count_if(F.col("source") == "stored").alias("stored"), F.count_if(F.col("source") == "live").alias("live")
    )


@query
def sentiment_comparison_subreddit(spark, sf):
    out = comparison.compare_subreddits(D.comments(spark, sf))
    return out.select("target", "sentiment_gap", "summary", *parts("youtube_sentiment", "yt"),
                      *parts("reddit_sentiment", "rd"))


@query
def sentiment_comparison_video(spark, sf):
    out = comparison.compare_videos(D.comments(spark, sf), D.videos(spark, sf))
    return out.select("video_id", "sentiment_gap", "summary", *parts("youtube_sentiment", "yt"),
                      *parts("reddit_sentiment", "rd"))


@query
def filled_breakdowns(spark, sf):
    """Labels of each post: the stored ones, then its own unlabelled comments, then texts of a second source (the video
    comments next to it), each scored only while labels are missing."""
    c = D.comments(spark, sf).withColumn("target", F.coalesce("post_id", F.concat(
        F.lit("p"), F.floor(F.substring("platform_id", 2, 20).cast("bigint") / 4).cast("string"))))
    reddit, live = c.where(F.col("platform") == "reddit"), c.where(F.col("platform") == "youtube")
    sources = [sentiment.Source("unlabelled", reddit.where(F.col("sentiment_label").isNull()), 2, 1),
               sentiment.Source("live", live, 3, 2)]
    used = sentiment.fill(reddit, sources, ("target",), scorer(spark))
    counts = used.groupBy("target").agg(*sx.label_counts(F.col("sentiment_label")), *[
        F.count_if(F.col("source") == x).alias(x) for x in ("stored", "unlabelled", "live")])
    counts = counts.withColumn("b", sx.breakdown(*[F.col(x) for x in ("n", "pos", "neu", "neg")]))
    return counts.select("target", "stored", "unlabelled", "live", *parts("b", "b"))


@query
def disparity_note(spark, sf):
    c = D.comments(spark, sf)
    side = lambda p: sentiment.breakdowns(c.where(F.col("platform") == p), ("parent_id",))
    subs = c.where(F.col("platform") == "reddit").groupBy("parent_id").agg(F.count_distinct("post_id").alias("k"))
    out = sentiment.with_gap(sentiment.both_sides(side("youtube"), side("reddit"), "parent_id")).join(subs, "parent_id")
    yt, rd, g = F.col("youtube_sentiment"), F.col("reddit_sentiment"), F.col("sentiment_gap")
    return out.select(
        "parent_id", sx.video_note(yt, rd, g, F.col("k")).alias("video_note"),
        sx.comparison_summary(yt, rd, g).alias("summary"),
    )


# --- keywords and topics -------------------------------------------------------

def _doc_order():
    return [F.col("published_at"), F.col("platform_id")]


@query
def keywords_top(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    return keywords.top_keywords(c, 20, "trend", order=_doc_order()).select(big("rank"), "keyword", "frequency")


@query
def topics_top(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    return keywords.top_keywords_per(c, ["parent_id"], 8, "topic", order=_doc_order()).select(
        "parent_id", big("rank"), "keyword", "frequency"
    )


@query
def context_keywords(spark, sf):
    c = D.comments(spark, sf)
    return keywords.top_keywords(c, 8, "context", order=_doc_order()).select(big("rank"), "keyword", "frequency")


@query
def topic_correlation(spark, sf):
    return comparison.topic_correlation(D.comments(spark, sf), D.videos(spark, sf)).select(
        big("position"), "topic", "is_shared", "youtube_relevance", "reddit_discussion_volume"
    )


# --- engagement ----------------------------------------------------------------

@query
def engagement_comparison(spark, sf):
    out = comparison.engagement_comparison(D.accounts(spark, sf), D.payloads(spark, sf))
    return out.select("platform", "account_id", "display_name", "normalised_score")


@query
def engagement_index(spark, sf):
    v = D.videos(spark, sf)
    stats = F.struct("views", "likes", F.col("comment_count"), F.lit(None).cast("bigint").alias("comments"),
                     F.lit(None).cast("bigint").alias("upvotes"), F.lit(None).cast("bigint").alias("members"),
                     F.lit(None).cast("bigint").alias("subscribers"))
    return v.select("video_id", mx.engagement_index(F.lit("youtube"), stats).alias("idx"))


@query
def account_metrics(spark, sf):
    return linking.account_metrics(D.accounts(spark, sf), D.payloads(spark, sf)).select(
        "platform", "platform_id", "display_name", "subscriber_count", dbl("total_views"), dbl("total_likes"),
        dbl("total_videos"),
        ts("last_ingested_at"),
    )


@query
def tracked_accounts(spark, sf):
    """Requested names, cleaned and validated, with whether the account is stored."""
    c = D.table(spark, sf, "documents")
    req = c.select(F.lit("reddit").alias("platform"),
                   F.concat(F.lit("/r/"), F.upper("source"), F.when(F.col("n_chars") % 2 == 0, F.lit(" "))
                            .otherwise(F.lit("x"))).alias("request")).distinct()
    req = table_source.normalise_requests(req)
    acc = D.accounts(spark, sf)
    yes = table_source.tracked(req, acc).withColumn("is_tracked", F.lit(True))
    no = table_source.tracked(req, acc, False).withColumn("is_tracked", F.lit(False))
    return yes.unionByName(no).select("request", "platform_id", "is_valid", "is_tracked")


@query
def correlation_summary(spark, sf):
    c = D.comments(spark, sf)
    shared = shared_plan.shared_videos(
        shared_plan.linked_discussions(c), c, D.facts(spark, sf), with_topics=False
    )
    both = sentiment.both_sides(
        sentiment.breakdowns(c.where(F.col("platform") == "youtube"), ("sentiment_processed",)),
        sentiment.breakdowns(c.where(F.col("platform") == "reddit"), ("sentiment_processed",)),
        "sentiment_processed",
    )
    gap = both.where("sentiment_processed").select(
        sx.gap(F.col("youtube_sentiment"), F.col("reddit_sentiment")).alias("sentiment_gap")
    )
    eng = comparison.engagement_comparison(D.accounts(spark, sf), D.payloads(spark, sf))
    return comparison.correlation_summary(shared, eng, gap)


@query
def growth_velocity(spark, sf):
    acc = upsert.merge_sentiment(
        D.accounts(spark, sf),
        sentiment.tally(D.comments(spark, sf)).withColumnRenamed("parent_id", "platform_id"),
    )
    return models.growth_rows(acc, F.to_timestamp(F.lit(AS_OF))).select(
        "platform", "platform_id", "subscriber_count", "positive_pct", "neutral_pct", "negative_pct",
        "total_comments_analyzed", round_to("growth_velocity", 6).alias("growth_velocity"),
    )


@query
def engagement_ratios(spark, sf):
    flat = features.flatten(D.post_history(spark, sf))
    return features.engagement_ratios(flat).select(
        "channel_id", "n_posts", round_to("likes_per_view", 8).alias("likes_per_view"),
        round_to("comments_per_view", 8).alias("comments_per_view"),
    )


@query
def trailing_mean(spark, sf):
    flat = features.flatten(D.post_history(spark, sf))
    return features.trailing_mean(flat).select(
        "channel_id", *[round_to(f"mean_{c}", 4).alias(f"mean_{c}") for c in ("views", "likes", "comments")]
    )


@query
def ingest_rollup(spark, sf):
    """Sampling caps of an ingest run over the whole listing, then the channel totals."""
    listing = D.videos(spark, sf)
    c = D.comments(spark, sf).where(F.col("platform") == "youtube").select(
        F.col("platform_id").alias("comment_id"), "video_id", "like_count"
    )
    used = ranking.top_per_group(listing, ["channel_id"], [F.desc("published_at"), F.asc("video_id")], 5, "video_rank")
    totals = used.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("videos_used"), F.sum("likes").alias("likes"), F.sum("comment_count").alias("comments")
    )
    every = listing.select("channel_id", "video_id", "published_at")
    caps = ranking.sample_caps(every, c, 10, 5, 50).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("like_count").alias("cl")
    )
    return totals.join(caps, "channel_id", "left").select(
        "channel_id", "videos_used", "likes", "comments", F.coalesce("n", F.lit(0)).alias("comments_sampled"),
        F.coalesce("cl", F.lit(0)).alias("comment_likes_sampled"),
    )


# --- features and forecasts ----------------------------------------------------

@query
def temporal_features(spark, sf):
    out = features.temporal_features(features.flatten(D.post_history(spark, sf)))
    return out.select(
        big("post_id"), *[big(c) for c in features.CALENDAR], big("topic_encoded"), "views", "sentiment_neutral"
    )


@query
def feature_matrix(spark, sf):
    out = features.feature_matrix(D.post_history(spark, sf))
    lags = ["views_lag1", "views_lag5", "likes_lag2", "comments_lag3", "shares_lag4"]
    roll = [f"{c}_roll{w}_{s}" for c in ("views", "shares") for w in (3, 5) for s in ("mean", "std")]
    return out.select(
        "channel_id", "post_id", big("position"), "views", *lags,
        round_to("sentiment_positive_lag1", 3).alias("sentiment_positive_lag1"),
        *[round_to(c, 3).alias(c) for c in roll],
    )


@query
def category_detect(spark, sf):
    return priors.detect_category(D.channels(spark, sf), D.post_history(spark, sf))


@query
def category_evidence(spark, sf):
    """Categories from the fall-back fields: topic and subreddit names, display names, bodies and texts of posts."""
    k, o = F.col("channel_id"), F.col("post_id")
    channels = D.channels(spark, sf).select(
        "channel_id", F.lit(None).cast("string").alias("explicit_category"), F.when(k % 6 == 0, "").alias("category"),
        F.when(k % 6 == 1, "Esports").alias("topic"), F.when(k % 6 < 3, " Film ").alias("subreddit"),
        F.when(k % 5 == 0, "Album artist").alias("display_name"), F.when(k % 5 == 1, "xbox").alias("description"))
    history = D.post_history(spark, sf).select(
        "channel_id", "post_id", "published_at", F.when(o % 9 == 0, "unlisted").alias("topic"),
        F.when(o % 18 == 9, "music").when(o % 31 == 0, "coding").alias("subreddit"),
        F.when(o % 4 == 0, "software tutorial").alias("body"), F.when(o % 4 == 1, "Breaking world news").alias("text"),
        F.when(o % 4 == 2, "a song, an Album").alias("description"))
    return priors.detect_category(channels, history)


@query
def category_forecast(spark, sf):
    ch = D.channels(spark, sf)
    cats = priors.detect_category(ch, D.post_history(spark, sf))
    return priors.category_forecast(cats, priors.category_priors(spark)).select(
        "channel_id", "category", big("step"), "predicted_views", "predicted_likes", "predicted_comments", "ci_low",
        "ci_high",
    )


@query
def benchmark_lookup(spark, sf):
    names = D.channels(spark, sf).groupBy(F.coalesce("explicit_category", "category", F.lit("none")).alias("name")).agg(
        F.count(F.lit(1)).alias("channels")
    )
    return priors.benchmark_lookup(names, priors.category_priors(spark)).select(
        "name", "channels", "category", "display_name", "base_views", "weekend_multiplier",
        F.element_at("sentiment_prior", "positive").alias("prior_positive"), big(F.size("keywords"), "n_keywords"),
    )


@query
def warmup(spark, sf):
    h = D.post_history(spark, sf)
    cats = priors.detect_category(D.channels(spark, sf), h)
    all_posts = forecast.with_warmup(h, cats, priors.category_priors(spark))
    return all_posts.where(F.col("post_id").cast("string").startswith("warmup")).select(
        "channel_id", "post_id", ts("published_at"), "category", "engagement_metrics.*"
    )


@query
def baseline_forecast(spark, sf):
    flat = features.flatten(D.post_history(spark, sf))
    return forecast.baseline_forecast(flat).select(
        "channel_id", big("step"), "predicted_views", "predicted_likes", "predicted_comments", "ci_low", "ci_high"
    )


@query
def blended_forecast(spark, sf):
    out = forecast.blended_forecast(D.channels(spark, sf), D.post_history(spark, sf), priors.category_priors(spark))
    return out.select(
        "channel_id", big("step"), "n_posts", "category", "predicted_views", "predicted_likes", "predicted_comments",
        "ci_low", "ci_high", "engine", "prior_weight",
    )


@query
def model_forecast(spark, sf):
    h = D.post_history(spark, sf).withColumn("post_id", F.col("post_id").cast("string"))
    cats = settled(priors.detect_category(D.channels(spark, sf), h), "categories")  # the forecast reads its posts twice
    model = models.train_post_model(h)
    longer = forecast.with_warmup(h, cats, priors.category_priors(spark))
    return forecast.model_forecast(longer, model, F.to_timestamp(F.lit(AS_OF)))


@query
def growth_model(spark, sf):
    acc = upsert.merge_sentiment(
        D.accounts(spark, sf),
        sentiment.tally(D.comments(spark, sf)).withColumnRenamed("parent_id", "platform_id"),
    )
    _, metrics = models.train_growth_model(acc, F.to_timestamp(F.lit(AS_OF)))
    return metrics.select("n_train", "n_test", "rmse", joined("feature_order"))


# --- ranking, sets -------------------------------------------------------------

@query
def page_comments(spark, sf):
    return ranking.page_of_every_target(D.comments(spark, sf), 2, 5).select(
        "platform", "parent_id", "platform_id", big("rank")
    )


@query
def page_by_label(spark, sf):
    """The second page of the positive comments of one channel."""
    page = ranking.page_of_target(D.comments(spark, sf), "youtube", "SRC0", 2, 5, label="positive")
    return page.select("platform_id", "sentiment_label", ts("ingested_at"))


@query
def page_by_cursor(spark, sf):
    """The third page of a community's comments, reached from the last row of each page before."""
    c, after = D.comments(spark, sf), None
    for _ in range(2):
        after = ranking.cursor(ranking.page_after(c, "reddit", "SRC1", 4, after))
    return ranking.page_after(c, "reddit", "SRC1", 4, after).select("platform_id", ts("ingested_at"))


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    v = D.videos(spark, sf)
    return v.select(F.lit("youtube").alias("platform"), F.col("video_id").alias("platform_id"), "title", "views", "likes",
                    F.col("published_at").alias("ingested_at"))


@query
def payload_scan(spark, sf):
    """Stored snapshots of the videos that discussions link."""
    reddit = D.comments(spark, sf).where(F.col("platform") == "reddit")
    linked = linking.link_by_url(reddit).select(F.col("video_id").alias("platform_id"))
    return table_source.scan_payloads(_snapshots(spark, sf), "youtube", linked).select("platform_id", "title", "views")


@query
def newest_payloads(spark, sf):
    """The 40 snapshots ingested last."""
    return table_source.newest_payloads(_snapshots(spark, sf), "youtube", 40).select("platform_id", ts("ingested_at"))


@query
def snapshot_replace(spark, sf):
    """Two newer copies of every second snapshot; the later one replaces the stored row, NULL likes included."""
    old = _snapshots(spark, sf)
    again = old.where(F.col("likes") % 200 == 0)
    copies = [again.withColumns({"title": F.concat("title", F.lit(f" v{n}")), "likes": F.lit(None if n == 2 else n).cast("bigint"),
                                 "ingested_at": F.col("ingested_at") + F.expr(f"INTERVAL {n} DAY")}) for n in (2, 1)]
    return upsert.replace_snapshots(old, copies[0].unionByName(copies[1])).select(
        "platform_id", "title", "views", dbl("likes"), ts("ingested_at")
    )


@query
def latest_n(spark, sf):
    return ranking.latest_per_target(D.comments(spark, sf), 3).select(
        "platform", "parent_id", "platform_id", ts("ingested_at"), big("rank")
    )


@query
def top_videos(spark, sf):
    return ranking.top_videos_for_topic(D.videos(spark, sf), "ring", 25).select("video_id", "title", "views")


@query
def table_sorts(spark, sf):
    """The engagement table by views, with the search filter."""
    v = ranking.search_videos(D.videos(spark, sf), "small")
    v = v.select("video_id", F.col("views").alias("youtube_views"), F.col("likes").alias("total_reddit_shares"))
    return ranking.sort_videos(v, "views")


@query
def active_first(spark, sf):
    a = D.accounts(spark, sf).where(F.col("platform") == "youtube")
    return ranking.active_first(a, "src7").select("platform_id", "display_name")


@query
def recently_tracked(spark, sf):
    v = D.videos(spark, sf)
    session = v.orderBy(F.desc("views"), "video_id").limit(3).select("video_id", F.col("video_no").alias("position"))
    stored = v.select("video_id", F.col("video_no").alias("position"))
    return ranking.recently_tracked(session, stored).select("video_id", big("source"))


@query
def dedupe_union(spark, sf):
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    stored = c.where(F.col("sentiment_processed")).select("platform_id", "score", "author")
    fresh = c.select("platform_id", "score", F.lit("fresh").alias("author"))
    return ranking.first_source_wins([stored, fresh]).select("platform_id", "score", "author", big("source_rank"))


@query
def candidate_ids(spark, sf):
    linked = linking.link_by_url(D.comments(spark, sf))
    return ranking.union_ids(D.videos(spark, sf), linked)


# --- upserts -------------------------------------------------------------------

def _incoming(c: DataFrame) -> DataFrame:
    """YouTube comments fetched again: new author spelling and time, no sentiment fields."""
    return c.where(F.col("platform") == "youtube").select(
        "platform", "platform_id", "parent_id", F.upper("author").alias("author"),
        (F.col("like_count") + 1000).alias("like_count"),
        (F.col("ingested_at") + F.expr("INTERVAL 1 DAY")).alias("ingested_at"),
    )


@query
def upsert_last_wins(spark, sf):
    c = D.comments(spark, sf)
    return upsert.set_fields(c, _incoming(c)).select(
        "platform", "platform_id", "author", dbl("like_count"), dbl("score"), "sentiment_label", ts("ingested_at")
    )


@query
def insert_only(spark, sf):
    c = D.comments(spark, sf).select("platform", "platform_id", "author")
    stored = c.where(F.col("author") != "[deleted]")
    fresh = c.unionByName(c)
    return upsert.insert_only(stored, fresh)


@query
def account_upsert(spark, sf):
    a = D.accounts(spark, sf)
    fresh = a.select(
        "platform", F.concat("platform_id", F.when(F.col("subscriber_count") % 2 == 0, "").otherwise("new"))
        .alias("platform_id"),
        F.lit("fresh-id").alias("id"), F.concat(F.lit("Fresh "), F.col("display_name")).alias("display_name"),
        (F.col("subscriber_count") + 5).alias("subscriber_count"),
        F.to_timestamp(F.lit(AS_OF)).alias("created_at"), F.to_timestamp(F.lit(AS_OF)).alias("updated_at"),
    )
    return upsert.upsert_accounts(a, fresh).select(
        "platform", "platform_id", "id", "display_name", "subscriber_count", ts("created_at"), ts("updated_at")
    )


@query
def metadata_merge(spark, sf):
    acc = upsert.merge_sentiment(
        D.accounts(spark, sf),
        sentiment.tally(D.comments(spark, sf)).withColumnRenamed("parent_id", "platform_id"),
        model="lexicon", analyzed_at=F.to_timestamp(F.lit(AS_OF)),
    )
    out = upsert.sentiment_block(acc)
    return out.select(
        "platform", "platform_id", F.element_at("extra_metadata", "origin").alias("origin"), "sentiment.*", ts("updated_at")
    )


# --- payloads ------------------------------------------------------------------

def video_json(spark: SparkSession, sf: str) -> DataFrame:
    """part as video-list responses; some texts are cut short and do not parse."""
    p = D.table(spark, sf, "part")
    item = F.struct(
        F.concat(F.lit("v"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("id"),
        F.struct(
            F.col("p_name").alias("title"), F.col("p_brand").alias("channelTitle"),
            F.lit("2024-05-10T12:00:00Z").alias("publishedAt"),
            F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")).alias("tags"),
            F.struct(
                F.when(F.col("p_size") % 3 == 0, F.struct(F.concat(F.lit("h/"), F.col("p_type")).alias("url"))).alias("high"),
                F.struct(F.concat(F.lit("d/"), F.col("p_type")).alias("url")).alias("default"),
            ).alias("thumbnails"),
        ).alias("snippet"),
        F.struct(
            F.floor(F.col("p_retailprice") * 1000).cast("bigint").cast("string").alias("viewCount"),
            F.when(F.col("p_size") % 5 != 0, (F.col("p_size") * 100).cast("string")).alias("likeCount"),
        ).alias("statistics"),
    )
    text = F.to_json(F.struct(F.array(item).alias("items")))
    broken = F.substring(text, 1, 40)
    return p.select("p_partkey", F.when(F.col("p_size") % 10 == 7, broken).otherwise(text).alias("json"))


def video_units(spark, sf):
    """Whole video payloads."""
    return video_json(spark, sf).where(F.col("p_partkey").isNotNull() & F.col("json").endswith("}")).select(
        F.col("p_partkey").alias("key"), "json")


@query
def normalise_video_json(spark, sf):
    out = payload_source.videos(video_json(spark, sf))
    return out.select("video_id", "title", "channel_title", "thumbnail_url", ts("published_at"), joined("tags"),
                      "views", "likes", "comment_count")


@query
def quarantine(spark, sf):
    from ..schemas import VIDEO_LIST_JSON

    _, bad = payload_source.parse_json(video_json(spark, sf), "json", VIDEO_LIST_JSON)
    return bad.select("p_partkey", "json")


def comment_units(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("key"), F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("id"),
        F.struct(
            F.lit("vid").alias("videoId"),
            F.struct(
                F.concat(F.lit("k"), F.col("page_id").cast("string")).alias("id"),
                F.struct(
                    F.when(F.col("page_id") % 9 == 0, " abcde ").otherwise(F.concat(F.lit("  "), F.col("url"))).alias("textDisplay"),
                    F.lit("someone").alias("authorDisplayName"), F.col("page_id").alias("likeCount"),
                    F.lit("2024-01-02T03:04:05Z").alias("publishedAt"),
                ).alias("snippet"),
            ).alias("topLevelComment"),
        ).alias("snippet"),
    )).alias("items"))).alias("json"))


@query
def normalise_comment_json(spark, sf):
    return payload_source.comment_threads(comment_units(spark, sf)).select(
        "comment_id", "video_id", "author", "body", "like_count", ts("published_at")
    )


def submission_units(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("key"), F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url"), F.col("html").alias("selftext"),
        F.concat(F.lit("/r/x/"), F.col("page_id").cast("string")).alias("permalink"),
        F.lit("SubX").alias("subreddit"), (F.col("page_id") * 3).alias("score"),
        (F.col("page_id") * 3600.0 + 1704067200.0).alias("created_utc"),
        F.when(F.col("page_id") % 2 == 0, "self").otherwise("t.jpg").alias("thumbnail"),
    )).alias("json"))


@query
def normalise_submission_json(spark, sf):
    return payload_source.submissions(submission_units(spark, sf)).select(
        "post_id", "permalink", "author", "subreddit", "score", "num_comments", ts("created_at"), "thumbnail_url",
        big(F.length("selftext"), "body_chars"),
    )


def reddit_comment_units(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("key"), F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.lit("p1").alias("post_id"),
        F.concat(F.lit("r/"), F.upper("source")).alias("subreddit"),
        F.when(F.col("doc_id") % 8 == 0, "[deleted]").when(F.col("doc_id") % 8 == 1, "").otherwise(F.col("text")).alias("body"),
        (F.col("doc_id") * 3600.0 + 1704067200.0).alias("created_utc"), F.col("n_chars").alias("score"),
    )).alias("json"))


@query
def normalise_reddit_comment_json(spark, sf):
    return payload_source.reddit_comments(reddit_comment_units(spark, sf)).select(
        "platform", "platform_id", "parent_id", "post_id", "score", ts("published_at"),
        F.sha2("body", 256).alias("body_sha"),
    )


def channel_units(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("UC"), F.col("c_custkey").cast("string")).alias("id"),
        F.struct(F.col("c_name").alias("title")).alias("snippet"),
        F.struct(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string")).alias("subscriberCount"))
        .alias("statistics"),
    )).alias("items"))).alias("json"))


@query
def normalise_channel_json(spark, sf):
    return payload_source.channels(channel_units(spark, sf)).select("channel_id", "display_name", "description", "subscriber_count", "views")


def listing_units(spark, sf):
    p = D.table(spark, sf, "part")
    hit = F.struct(
        F.struct(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("videoId")).alias("id"),
        F.struct(F.col("p_name").alias("title"), F.lit("2026-01-01T00:00:00Z").alias("publishedAt")).alias("snippet"),
    )
    return p.select(F.col("p_partkey").alias("key"), F.to_json(F.struct(
        F.col("p_brand").alias("nextPageToken"), F.struct(F.col("p_size").alias("totalResults")).alias("pageInfo"),
        F.array(hit).alias("items"),
    )).alias("json"))


@query
def normalise_listing_json(spark, sf):
    return payload_source.video_listing(listing_units(spark, sf), keep=("key",)).select(
        F.col("key").alias("p_partkey"), "video_id", "title", ts("published_at"), "next_page_token", "total_results"
    )


@query
def payload_errors(spark, sf):
    """Units of all six shapes, every tenth of them cut off: counts of the landing pass, rows read back, and bad units."""
    shapes = {"videos": video_units, "channels": channel_units, "video_listing": listing_units, "comment_threads": comment_units,
              "submissions": submission_units, "reddit_comments": reddit_comment_units}
    out = []
    for shape, units in shapes.items():
        folder = scratch_path(spark, "landed")
        raw = units(spark, sf).withColumn("json", F.when(F.col("key") % 10 == 7, F.substring("json", 1, 20)).otherwise(F.col("json")))
        seen = payload_source.land(raw, shape, folder)
        rows, bad = payload_source.landed(spark, shape, folder)
        both = rows.select(F.lit(1).alias("row"), F.lit(None).cast("bigint").alias("key")).unionByName(
            bad.select(F.lit(0).alias("row"), F.col("key").cast("bigint")))
        counts = both.agg(big(F.sum("row"), "rows"), F.count("key").alias("kept_bad"), F.sum("key").alias("bad_keys"))
        out.append(counts.select(F.lit(shape).alias("shape"), F.lit(seen["good"]).cast("bigint").alias("good"),
                                 F.lit(seen["bad"]).cast("bigint").alias("bad"), "rows", "kept_bad", "bad_keys"))
    return reduce(DataFrame.unionByName, out)


@query
def account_list(spark, sf):
    out = table_source.scan_accounts(D.accounts(spark, sf), "reddit", newest_first=True)
    return out.select("platform_id", "display_name", ts("updated_at"))


@query
def video_facts(spark, sf):
    """Stored snapshots first, the fresh listing second; small counters are missing in the snapshots."""
    v = D.videos(spark, sf)
    snap = v.select(
        F.col("video_id").alias("platform_id"), F.when(F.col("likes") > 1000, F.concat(F.lit("S "), "title")).alias("title"),
        F.struct(
            F.when(F.col("likes") > 2000, F.col("views") + 1).otherwise(0).alias("views"),
            F.when(F.col("likes") > 3000, F.col("likes") + 1).alias("likes"), F.col("comment_count"),
        ).alias("stats"),
        F.col("published_at").alias("ingested_at"),
    )
    return linking.video_facts(snap, v).select("video_id", "title", "views", "likes", "comment_count", ts("published_at"))


# --- text and ids --------------------------------------------------------------

@query
def clean_subreddit(spark, sf):
    d = D.table(spark, sf, "documents")
    raw = F.concat(F.lit(" //r/"), F.initcap("source"), F.when(F.col("n_chars") % 2 == 0, "r/x ").otherwise("\t"))
    return d.select("doc_id", tx.clean_subreddit(raw).alias("name"),
                    tx.is_subreddit_name(tx.clean_subreddit(raw)).alias("is_valid"))


@query
def validate_ids(spark, sf):
    d = D.table(spark, sf, "documents")
    raw = F.concat(F.lit("UC"), F.substring(F.md5("text"), 1, (F.lit(20) + F.col("n_chars") % 4).cast("int")))
    return d.select(
        "doc_id", tx.is_channel_id(raw).alias("is_channel"),
        tx.canonical_video_id(F.concat(F.substring(F.md5("text"), 1, 8), F.lit(", "),
                                       F.substring("source", 1, 3), F.lit("!"))).alias("raw_id"),
        tx.is_valid_question(F.col("text")).alias("is_question"),
    )


@query
def url_clean(spark, sf):
    c = D.comments(spark, sf)
    t = tx.strip_urls(F.col("body"))
    return c.select("platform_id", F.sha2(t, 256).alias("clean_sha"), big(F.length(t), "n"),
                    joined_ids().alias("ids"), tx.truncate(t, 20).alias("head"))


def joined_ids():
    return F.array_join(tx.video_ids(F.col("body")), "|")


@query
def number_format(spark, sf):
    o = D.table(spark, sf, "orders")
    n = F.when(F.col("o_orderkey") % 50 != 0, F.floor(F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 6)))
    return o.select("o_orderkey", tx.human_number(n).alias("shown"))


@query
def comment_quality(spark, sf):
    """Row predicates over comments and posts: worthy comments, spam communities, image posts, links."""
    c = D.comments(spark, sf).where(F.col("platform") == "reddit")
    worthy = c.select("platform_id", "post_id", tx.permalink_url(F.col("permalink")).alias("link"),
                      tx.is_worthy_comment(F.col("author"), F.col("body")).alias("worthy"))
    p = D.posts(spark, sf).select("post_id", tx.is_spam_subreddit(F.col("subreddit")).alias("spam"),
                                  tx.is_image_url(F.col("url")).alias("image"))
    return worthy.join(p, "post_id", "left").select("platform_id", "link", "worthy", "spam", "image")


# --- context -------------------------------------------------------------------

@query
def conv_window(spark, sf):
    return ranking.last_turns(D.table(spark, sf, "conversations")).select("conv_id", "turn", "role", big("rank"))


@query
def answer_budget(spark, sf):
    c = D.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", big(mx.answer_budget(F.col("text")), "budget"))


@query
def fact_sheet(spark, sf):
    sheets = [
        context.account_sheets(D.accounts(spark, sf), D.payloads(spark, sf), D.comments(spark, sf), p)
        for p in ("youtube", "reddit")
    ]
    return sheets[0].unionByName(sheets[1]).select("platform", "platform_id", "sheet")


@query
def platform_sheet(spark, sf):
    out = None
    for p in ("youtube", "reddit"):
        sheets = context.account_sheets(D.accounts(spark, sf), D.payloads(spark, sf), D.comments(spark, sf), p)
        one = context.platform_sheet(sheets, p, "src7")
        out = one if out is None else out.unionByName(one)
    return out


@query
def shared_video_sheet(spark, sf):
    c = D.comments(spark, sf)
    shared = shared_plan.shared_videos(shared_plan.linked_discussions(c), c, D.facts(spark, sf))
    return context.shared_video_lines(shared).select(big("position"), "video_id", "lines")


# --- streams -------------------------------------------------------------------

def _feed(spark: SparkSession, sf: str) -> tuple[str, StructType, int]:
    """Comments as files that arrive in four portions; the last one brings every fifth comment a second time, a day
    later. Folder, schema, and files of a portion."""
    c = D.comments(spark, sf).drop("sentiment_processed", "sentiment_label", "sentiment_score")
    hour = F.unix_timestamp("published_at") / 3600
    portion = (hour % 3).cast("int")
    copies = c.where((hour.cast("bigint") % 5) == 0).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 DAY"))
    rows = c.withColumn("portion", portion).unionByName(copies.withColumn("portion", F.lit(3)))
    path = scratch_path(spark, "feed")
    rows.write.partitionBy("portion").parquet(path)
    return path, c.schema, max(1, len(spark.read.parquet(path).inputFiles()) // 4)


@query
def stream_ingest(spark, sf):
    """Comments landed by a stream in several batches and by a second run, compacted on the way, each scored once, read
    back as the current state."""
    feed, schema, files = _feed(spark, sf)
    log, scores = scratch_path(spark, "log"), scratch_path(spark, "scores")
    for run in ("one", "two"):
        source = streams.read_stream(spark, f"{feed}/*", schema, files_per_batch=files)
        streams.ingest(source, log, scratch_path(spark, run), compact_every=2).awaitTermination()
        source = streams.read_stream(spark, f"{feed}/*", schema, files_per_batch=files)
        streams.score_once(source, scores, scorer(spark), scratch_path(spark, run)).awaitTermination()
    times = spark.read.parquet(scores).groupBy(*streams.KEY).agg(F.count("*").alias("times_scored"))
    state = streams.comment_state(spark, log, scores).join(times, streams.KEY, "left")
    return state.select("platform", "platform_id", "sentiment_label", "sentiment_score", "sentiment_processed",
                        ts("ingested_at"), "times_scored")


@query
def stream_distribution(spark, sf):
    """Label counts of distinct comments, from several batches and a second run."""
    feed, schema, files = _feed(spark, sf)
    log = scratch_path(spark, "dist")
    for _ in range(2):
        stream = streams.read_stream(spark, f"{feed}/*", schema, files_per_batch=files).withColumn(
            "sentiment_label", F.when(F.col("n_chars") % 3 == 0, "positive").when(F.col("n_chars") % 3 == 1, "neutral"))
        streams.run_updates(streams.running_distribution(stream), log, scratch_path(spark, "cp")).awaitTermination()
    return streams.newest_update(spark.read.parquet(log), ["platform", "parent_id"])


@query
def stream_first_share(spark, sf):
    """Shares of distinct comments, joined to the videos in the stream, from several batches and a second run."""
    feed, schema, files = _feed(spark, sf)
    log = scratch_path(spark, "shares")
    for _ in range(2):
        stream = streams.read_stream(spark, f"{feed}/*", schema, files_per_batch=files)
        found = streams.share_delays(streams.running_shares(stream), D.videos(spark, sf))
        streams.run_updates(found, log, scratch_path(spark, "cp")).awaitTermination()
    return streams.newest_update(spark.read.parquet(log), ["video_id"]).select(
        "video_id", "shares", ts("first_shared_at"), "propagation_delay_hours", "propagation_speed")


MERGE_BUCKETS = 16


@query
def stored_merge(spark, sf):
    """Comments merged into a stored table, twice the same; how many rows each bucket has and whether it was rewritten."""
    c = D.comments(spark, sf)
    folder = scratch_path(spark, "stored")
    stored.create(c, folder, buckets=MERGE_BUCKETS)
    before = stored.layout(spark, folder)
    incoming = _incoming(c).where(stored.bucket_of(["platform", "platform_id"], MERGE_BUCKETS) % 3 == 0)
    for _ in range(2):
        stored.merge(incoming, folder)
    after = stored.layout(spark, folder)
    changed = [b for b in after if after[b] != before.get(b)]
    rows = stored.load(spark, folder).withColumn("bucket", stored.bucket_of(["platform", "platform_id"], MERGE_BUCKETS))
    return rows.groupBy(big("bucket")).agg(
        F.count("*").alias("rows"), F.sum("like_count").cast("bigint").alias("likes"), F.max(ts("ingested_at")).alias("newest"),
        F.count_if(F.col("author") == F.upper("author")).alias("upper_authors"),
    ).withColumn("rewritten", F.col("bucket").isin(changed))
