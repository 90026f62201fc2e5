"""End-to-end reports over small seeded records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wakeline.operators import context, fingerprint, linking, ranking, scoring, sentiment
from wakeline.plans import comparison
from wakeline.plans import shared_videos as sv
from wakeline.plans import video_engagement as ve

COLS = ("platform string, platform_id string, parent_id string, video_id string, post_id string, author string, "
        "body string, score bigint, published string, sentiment_label string")
RICK = "dQw4w9WgXcQ"


def comments(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    t = F.to_timestamp("published")
    return df.select(
        "*", t.alias("published_at"), (t + F.expr("INTERVAL 5 MINUTES")).alias("ingested_at"),
        F.lit(None).cast("double").alias("sentiment_score"), F.lit(None).cast("string").alias("match_type"),
        F.lit(None).cast("double").alias("similarity_score"),
    )


def reddit(i, sub, post, body, score=1, at="2024-05-10T12:00:00Z", label=None, author="someone"):
    return ("reddit", i, sub, None, post, author, body, score, at, label)


def facts(spark, title="Never Gonna Give You Up", views=1_500_000_000, published=None, tags=()):
    df = spark.createDataFrame(
        [(RICK, title, "Rick Astley", views, 18_000_000, 500_000, published, list(tags))],
        "video_id string, title string, channel_title string, views bigint, likes bigint, comment_count bigint, "
        "p string, tags array<string>")
    return df.withColumn("published_at", F.to_timestamp("p")).drop("p")


def test_shared_by_url(spark):
    c = comments(spark, [
        reddit("c1", "gaming", "p1", f"Check out this great gameplay: https://youtu.be/{RICK} it is awesome!", 45, label="positive"),
        reddit("c2", "gaming", "p2", f"Here is the link https://www.youtube.com/watch?v={RICK} again.", 12,
               "2024-05-10T15:30:00Z", "neutral"),
    ])
    rows = sv.shared_videos(sv.linked_discussions(c), c, facts(spark)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["video_id"], r["total_reddit_shares"], r["youtube_views"]) == (RICK, 2, 1_500_000_000)
    assert (r["reddit_total_upvotes"], r["reddit_posts"], r["reddit_subreddits"]) == (57, 2, 1)
    assert r["reddit_total_comments"] == 2
    assert r["reddit_sentiment"].asDict() == {
        "positive": 0.5, "neutral": 0.5, "negative": 0.0, "dominant_label": "positive", "sample_size": 2}
    assert str(r["reddit_first_shared_at"]).endswith("12:00:00") and str(r["reddit_latest_shared_at"]).endswith("15:30:00")
    assert r["propagation_speed"] == "Recent Community Discovery" and r["propagation_delay_hours"] is None
    assert r["match_type"] == "url" and r["similarity_score"] == 1.0


def test_shared_semantic_and_hybrid(spark):
    cand = spark.createDataFrame([(RICK, "Rick Astley - Never Gonna Give You Up (Official Music Video)",
                                   "The official video for Never Gonna Give You Up by Rick Astley")],
                                 "video_id string, title string, description string")
    said = "Rick Astley's Never Gonna Give You Up is the greatest 80s pop song ever made honestly."
    c = comments(spark, [reddit("c_sem", "music", "p", said, 85, label="positive")])
    f = facts(spark, published="2024-05-10T10:00:00Z")
    r = sv.shared_videos(sv.linked_discussions(c, cand, threshold=0.3), c, f).first()
    assert r["match_type"] == "semantic" and r["similarity_score"] >= 0.3
    assert (r["propagation_delay_hours"], r["propagation_speed"]) == (2.0, "Rapid (< 6h)")
    c = comments(spark, [reddit("c_url", "pop", "p", f"Direct link: https://youtu.be/{RICK} enjoy!", 10),
                         reddit("c_sem", "pop", "p", said, 25)])
    r = sv.shared_videos(sv.linked_discussions(c, cand, "pop", threshold=0.3), c, f).first()
    assert (r["match_type"], r["total_reddit_shares"]) == ("hybrid", 2)
    assert sv.linked_discussions(c, cand, "elsewhere").count() == 0


def test_video_engagement_totals(spark):
    c = comments(spark, [
        reddit("comm_1", "gaming", "p_game", f"Check https://www.youtube.com/watch?v={RICK} very cool", 50, label="positive"),
        reddit("comm_2", "technology", "p_tech", f"Here is https://youtu.be/{RICK} for context.", 25,
               "2024-05-10T14:00:00Z", "neutral"),
        reddit("other", "misc", "p_x", "nothing to see", 9),
    ])
    prints = fingerprint.fingerprints(facts(spark))
    d = ve.matched_discussions(c, prints)
    r = ve.video_engagement(d, c, facts(spark)).first()
    assert (r["subreddits_count"], r["total_reddit_discussions"], r["reddit_total_upvotes"]) == (2, 2, 75)
    assert (r["reddit_posts_count"], r["youtube_views"], r["title"]) == (2, 1_500_000_000, "Never Gonna Give You Up")


def test_posts_and_threads(spark):
    posts = spark.createDataFrame(
        [("p1", "Gaming", "a title", f"see {RICK} now", "u", 40, 7), ("p2", "tech", "t", "unrelated", "https://i.redd.it/x", 3, 1)],
        "post_id string, subreddit string, title string, selftext string, url string, score bigint, num_comments bigint",
    ).withColumn("created_at", F.to_timestamp(F.lit("2024-05-11T00:00:00Z")))
    c = comments(spark, [
        reddit("k1", "gaming", "p1", "great stuff here", 5, label="positive"),
        reddit("k2", "gaming", "p1", "terrible stuff", 9, label="negative"),
        reddit("k3", "gaming", "p1", "whatever this", 2, label="negative"),
        reddit("k4", "gaming", "p1", "robot words", 99, author="AutoModerator"),
        reddit("k5", "tech", "p2", f"this is {RICK}", 1),
    ])
    v = facts(spark)
    prints = fingerprint.fingerprints(v)
    accepted = fingerprint.collect_by_tier(fingerprint.post_text(posts, c), v, prints)
    assert {r["post_id"] for r in accepted.collect()} == {"p1", "p2"}  # p2 by the comment of the image post
    cards = ve.threads(accepted, posts, c).orderBy("thread_rank").collect()
    assert [(t["post_id"], t["thread_label"]) for t in cards] == [("p1", "negative"), ("p2", "neutral")]
    assert [x["platform_id"] for x in cards[0]["top_comments"]] == ["k2", "k1", "k3"]
    d = ve.matched_discussions(c, prints, accepted)
    r = ve.video_engagement(d, c, v, accepted).first()
    assert (r["total_reddit_discussions"], r["reddit_posts_count"]) == (4, 2)
    assert (r["reddit_total_upvotes"], r["reddit_total_comments"]) == (43, 8)


def test_subreddit_comparison(spark):
    c = comments(spark, [
        ("reddit", None, "gaming", None, None, None, None, None, None, "positive"),
        ("reddit", None, "gaming", None, None, None, None, None, None, "negative"),
        ("youtube", None, "ch1", None, None, None, None, None, None, "positive"),
    ])
    r = comparison.compare_subreddits(c, subreddit="Gaming").first()
    assert r["reddit_sentiment"]["dominant_label"] == "positive" and r["reddit_sentiment"]["sample_size"] == 2
    assert (r["youtube_sentiment"]["positive"], r["sentiment_gap"]) == (1.0, 0.5)
    assert r["summary"].startswith("YouTube reception is notably more positive (100%)")


def test_top_up_scores_thin_targets_only(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    rows = [reddit(f"a{i}", "thin", "p", "good " * (i + 1), label=None) for i in range(3)]
    rows += [reddit(f"b{i}", "thick", "p", "bad", label="neutral") for i in range(5)] + [reddit("b9", "thick", "p", "bad")]
    used = sentiment.top_up(comments(spark, rows), ("parent_id",), scorer=lambda t: scoring.lexicon_scores(t, lex))
    got = {(r["parent_id"], r["sentiment_label"], r["source"]): r["count"] for r in
           used.groupBy("parent_id", "sentiment_label", "source").count().collect()}
    assert got == {("thin", "positive", "live"): 3, ("thick", "neutral", "stored"): 5}


def test_sources_fill_what_is_short(spark):
    """Each source is used while labels are missing: none, the first, both, with limits, blanks and a target without a name."""
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    at = dt.datetime(2024, 5, 10)
    text = lambda t, i, body: (t, f"{t}{i}", body, at + dt.timedelta(hours=i))
    schema = "target string, platform_id string, body string, ingested_at timestamp"
    labelled = spark.createDataFrame([("full", "neutral")] * 3 + [("one", "neutral")] * 2 + [(None, "negative")], "target string, sentiment_label string")
    first = spark.createDataFrame([text("full", 1, "good"), text("one", 1, "good"), text("both", 1, " "), text("both", 2, "bad"),
                                   text("both", 3, "good"), text("both", 4, "good"), text(None, 1, "good")], schema)
    second = spark.createDataFrame([text(t, i, "bad") for t in ("full", "one", "both", None, "only") for i in range(5)], schema)
    used = sentiment.fill(labelled, [sentiment.Source("first", first, 3, 2), sentiment.Source("second", second, 3, 4)], ("target",),
                          lambda t: scoring.lexicon_scores(t, lex))
    got = {(r["target"], r["source"], r["sentiment_label"]): r["count"] for r in used.groupBy("target", "source", "sentiment_label").count().collect()}
    assert got == {
        ("full", "stored", "neutral"): 3, ("one", "stored", "neutral"): 2, ("one", "first", "positive"): 1,
        ("both", "first", "positive"): 2, ("both", "second", "negative"): 4, ("only", "second", "negative"): 4,
        (None, "stored", "negative"): 1, (None, "first", "positive"): 1, (None, "second", "negative"): 4}
    assert sentiment.fill(labelled, [], ("target",), None).count() == 6


def test_pages_by_cursor_equal_pages_by_number(spark):
    c = comments(spark, [reddit(f"c{i:02d}", "X", "p", "b", at=f"2024-05-10T12:00:{i // 3:02d}Z") for i in range(20)])
    after, pages = None, []
    for number in range(1, 6):
        page = ranking.page_after(c, "reddit", "x", 6, after)
        assert [r["platform_id"] for r in page.collect()] == [r["platform_id"] for r in ranking.page_of_target(c, "reddit", "x", number, 6).collect()]
        pages.append(page.count())
        after = ranking.cursor(page) or after
    assert pages == [6, 6, 6, 2, 0] and ranking.cursor(page) is None
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=6" in plan


def test_lexicon_and_model_scorers(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "term string, valence double")
    t = spark.createDataFrame([("a", "Good, good day"), ("b", "  "), ("c", "bad"), ("d", None)], "text_key string, body string")
    got = {r["text_key"]: r for r in scoring.lexicon_scores(t, lex).collect()}
    assert got["a"]["compound"] == round(4 / (16 + 15) ** 0.5, 4) and got["a"]["label"] == "positive"
    assert got["a"]["positive"] == round(6 / 7, 3)
    assert [(got[k]["label"], got[k]["score"]) for k in ("b", "c", "d")] == [("neutral", 0.0), ("negative", 1.0), ("neutral", 0.0)]

    def load():
        return lambda texts: [("LABEL_2" if "good" in x.lower() else "odd", 0.75) for x in texts]

    got = {r["text_key"]: (r["label"], r["score"]) for r in scoring.model_scores(t, load).collect()}
    assert got == {"a": ("positive", 0.75), "b": ("neutral", 0.0), "c": ("neutral", 0.75), "d": ("neutral", 0.0)}


def test_label_resolution(spark):
    lex = spark.createDataFrame([("good", 2.0)], "term string, valence double")
    c = comments(spark, [reddit("a", "x", "p", "good", label="negative"), reddit("b", "x", "p", "good"),
                         reddit("c", "x", "p", "good"), reddit("d", "x", "p", "")])
    out = {r["platform_id"]: (r["label"], r["label_score"], r["engine"]) for r in
           scoring.resolve_labels(c, lambda t: scoring.lexicon_scores(t, lex)).collect()}
    assert out == {"a": ("negative", None, "stored"), "b": ("positive", 1.0, "lexicon"),
                   "c": ("positive", 1.0, "lexicon"), "d": ("neutral", 0.5, "none")}


def test_engagement_comparison_without_snapshots(spark):
    a = spark.createDataFrame([("youtube", "UC_A", "Channel A"), ("reddit", "python", "Python")],
                              "platform string, platform_id string, display_name string")
    stats = "views bigint, likes bigint, comments bigint, comment_count bigint, upvotes bigint, members bigint, subscribers bigint"
    p = spark.createDataFrame([], f"platform string, platform_id string, stats struct<{stats.replace(' ', ': ')}>".replace(",: ", ", "))
    rows = comparison.engagement_comparison(a, p).collect()
    assert [(r["platform"], r["normalised_score"]) for r in rows] == [("reddit", 0.0), ("youtube", 0.0)]


def test_video_facts_prefer_the_snapshot(spark):
    s = spark.createDataFrame([("v1", "Stored", (0, 5, None), None), ("v2", "", (7, None, 3), None)],
                              "platform_id string, title string, stats struct<views: bigint, likes: bigint, comment_count: bigint>, ingested_at timestamp")
    f = spark.createDataFrame([("v1", "Fresh", "ch", "t", 9, 8, 1, None, ["x"])],
                              "video_id string, title string, channel_title string, thumbnail_url string, views bigint, likes bigint, comment_count bigint, published_at timestamp, tags array<string>")
    a, b = linking.video_facts(s, f).orderBy("video_id").collect()
    assert (a["title"], a["views"], a["likes"], a["comment_count"], a["tags"]) == ("Stored", 9, 5, 1, ["x"])
    assert (b["title"], b["views"], b["comment_count"], b["tags"]) == (None, 7, 3, [])


def test_paging_and_sorts(spark):
    c = comments(spark, [reddit(f"c{i}", "X", "p", "b", at=f"2024-05-10T12:00:{i:02d}Z", label="positive" if i % 2 else None)
                         for i in range(10)])
    ids = lambda df: [r["platform_id"] for r in df.collect()]
    assert ids(ranking.page_of_target(c, "reddit", "x", 2, 3)) == ["c6", "c5", "c4"]
    assert ids(ranking.page_of_target(c, "reddit", "x", 1, 2, "positive")) == ["c9", "c7"]
    v = spark.createDataFrame([("a", 5, None, 0.2, 0.9), ("b", 1, 3.0, 0.5, 0.5), ("c", 9, 1.0, 0.0, 0.1)],
                              "video_id string, total_reddit_shares bigint, propagation_delay_hours double, y double, r double")
    v = v.withColumn("youtube_views", F.col("total_reddit_shares") * 2).withColumn(
        "youtube_sentiment", F.struct(F.col("y").alias("positive"))).withColumn("reddit_sentiment", F.struct(F.col("r").alias("positive")))
    order = lambda by: [r["video_id"] for r in ranking.sort_videos(v, by).collect()]
    assert order("reddit_shares") == ["c", "a", "b"] and order("propagation") == ["c", "b", "a"]
    assert order("sentiment_diff") == ["a", "c", "b"] and order("views") == ["c", "a", "b"]


def test_video_block_text(spark):
    c = comments(spark, [reddit("c", "gaming", "p", f"https://youtu.be/{RICK} gameplay walkthrough", 50, label="positive")])
    d = ve.matched_discussions(c, fingerprint.fingerprints(facts(spark)))
    text = context.video_block(ve.video_engagement(d, c, facts(spark))).first()["block"]
    assert "1.5B views | 18.0M likes | 500.0K comments" in text
    assert "Reddit Community Sentiment: 100% Positive" in text and "1 posts/threads, 50 total upvotes" in text


@pytest.mark.parametrize("q", ["", "ASTLEY", "gonna"])
def test_video_search(spark, q):
    v = facts(spark).withColumn("match_type", F.lit("url"))
    assert ranking.search_videos(v, q).count() == 1
    assert ranking.search_videos(v, q, semantic_only=True).count() == 0
