"""Fact sheets: one text per account, per platform and for the cross-platform view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_to
from ..functions import sentiment as sx
from ..functions import text as tx
from . import keywords, ranking, sentiment

# Per platform: sample size, keyword count, and the wording of the sheet.
_RULES = {
    "youtube": {"sample": 30, "keywords": 5, "word_line": "    Top Keywords in Comments: "},
    "reddit": {"sample": 40, "keywords": 8, "word_line": "    Top Trending Keywords: "},
}
_NEWLINE = "\n"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _head(platform: str) -> list[Column]:
    stats = F.col("stats")
    if platform == "youtube":
        return [
            _text("  Channel: ", F.col("display_name"), " (ID: ", F.col("platform_id"), ")"),
            _text("    Subscribers: ",
                  tx.human_number(tx.truthy(stats["subscribers"], F.col("subscriber_count")))),
            _text("    Total Views: ", tx.human_number(stats["views"])),
            _text("    Total Likes: ", tx.human_number(stats["likes"])),
            _text("    Total Videos: ", tx.human_number(stats["video_count"])),
            _text("    Tracked Comments: ", tx.human_number(F.col("total"))),
        ]
    members = tx.truthy(F.coalesce(stats["members"], stats["subscribers"]), F.col("subscriber_count"))
    return [
        _text("  r/", F.col("display_name"), " (internal ID: ", F.col("platform_id"), ")"),
        _text("    Members: ", tx.human_number(members)),
        _text("    Tracked Comments in DB: ", tx.human_number(F.col("total"))),
    ]


def account_sheets(accounts: DataFrame, payloads: DataFrame, comments: DataFrame, platform: str) -> DataFrame:
    """One fact sheet per account: metrics, label counts, dominant label, top keywords of the newest comments."""
    rule = _RULES[platform]
    mine = comments.where(F.col("platform") == platform)
    counts = sentiment.facets(mine).drop("platform")
    sample = sentiment.newest_bodies(mine.where(F.coalesce("body", F.lit("")) != ""), rule["sample"])
    words = keywords.keyword_lists(
        keywords.top_keywords_per(sample, ["parent_id"], rule["keywords"], "context", order=[F.col("rank")]),
        ["parent_id"], "words",
    )
    stats = payloads.where(F.col("platform") == platform).select("platform_id", "stats")
    base = (
        accounts.where(F.col("platform") == platform)
        .withColumn("display_name", F.coalesce("display_name", "platform_id"))
        .join(stats, "platform_id", "left")
        .join(counts.withColumnRenamed("parent_id", "platform_id"), "platform_id", "left")
        .join(words.withColumnRenamed("parent_id", "platform_id"), "platform_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
    )
    pos, neu, neg = (F.coalesce(c, F.lit(0)) for c in ("positive", "neutral", "negative"))
    n = pos + neu + neg
    labelled = F.concat_ws(
        _NEWLINE,
        _text("    Sentiment (", n.cast("string"), " analyzed): ✅ ", pos.cast("string"), " positive | ⚪ ",
              neu.cast("string"), " neutral | ❌ ", neg.cast("string"), " negative"),
        _text("    Dominant Sentiment: ", sx.top_label(pos, neu, neg)),
    )
    mood = (
        F.when(n > 0, labelled)
        .when(F.col("total") > 0, _text("    Sentiment: ", F.col("total").cast("string"),
                                        " comments tracked (classification queued)"))
        .otherwise("    Sentiment: No comments ingested yet")
    )
    word_line = F.when(F.size("words") > 0, _text(rule["word_line"], F.array_join("words", ", ")))
    return base.select(
        F.lit(platform).alias("platform"), "platform_id", "display_name", "total",
        F.concat_ws(_NEWLINE, *_head(platform), mood, word_line).alias("sheet"),
    )


def platform_sheet(sheets: DataFrame, platform: str, active: str | None = None, n: int = 6) -> DataFrame:
    """Header with the number of tracked accounts, then up to ``n`` account sheets, the active one first."""
    title = {"youtube": "TRACKED YOUTUBE CHANNELS", "reddit": "TRACKED SUBREDDITS"}[platform]
    shown = {"youtube": "", "reddit": "r/"}[platform]
    total = sheets.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).alias("pos"), _text(title + " (", F.col("n").cast("string"), " total):").alias("sheet")
    )
    picked = ranking.active_first(sheets, active, n)
    hit = F.lit(1)
    if active:
        a = active.lower()
        is_active = (F.lower("platform_id") == a) | F.lower("display_name").contains(a)
        hit = F.when(is_active, 0).otherwise(1)
    # n rows are left, so numbering them in one task is fine.
    order = Window.orderBy(hit, "display_name", "platform_id")
    body = picked.select(F.row_number().over(order).alias("pos"), "sheet")
    parts = total.unionByName(body)
    if active:
        note = sheets.sparkSession.range(1).select(
            F.lit(0).alias("pos"), F.lit(f"  [User is currently viewing: {shown}{active}]").alias("sheet")
        )
        parts = parts.unionByName(note)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sheet")))
    return parts.agg(
        F.array_join(F.transform(ordered, lambda s: s["sheet"]), _NEWLINE).alias("sheet")
    ).select(F.lit(platform).alias("platform"), "sheet")


def video_block(v: DataFrame) -> DataFrame:
    """The "currently analysed video" block for rows of the engagement plan."""
    def mood(c: str, label: str, extra: Column) -> Column:
        b = F.col(c)
        pct = lambda f: round_to(b[f] * 100).cast("int").cast("string")
        return F.when(b["sample_size"] > 0, _text(
            f"  • {label}: ", pct("positive"), "% Positive | ", pct("neutral"), "% Neutral | ", pct("negative"),
            "% Negative (", tx.human_number(b["sample_size"]), " comments analyzed", extra, ", Dominant: ",
            b["dominant_label"], ")"))

    subs = F.when(F.col("subreddits_count") > 0,
                  _text(" across ", F.col("subreddits_count").cast("string"), " subreddits")).otherwise("")
    title = F.coalesce("title", "video_id")
    return v.select("video_id", F.concat_ws(
        _NEWLINE,
        _text("=== CURRENTLY ANALYZED VIDEO (ACTIVE IN DASHBOARD): ", F.col("video_id"), " ==="),
        _text('Title: "', title, '" (Channel: ', F.coalesce("channel_title", F.lit("Unknown")), ")"),
        _text("YouTube Performance: ", tx.human_number(F.col("youtube_views")), " views | ",
              tx.human_number(F.col("youtube_likes")), " likes | ",
              tx.human_number(F.col("youtube_comment_count")), " comments"),
        mood("youtube_sentiment", "YouTube Audience Sentiment", F.lit("")),
        mood("reddit_sentiment", "Reddit Community Sentiment", subs),
        _text("Reddit Discussion Stats: ", F.col("reddit_posts_count").cast("string"), " posts/threads, ",
              tx.human_number(F.col("reddit_total_upvotes")), " total upvotes, ",
              tx.human_number(F.col("reddit_total_comments")), " comments"),
        F.when(F.col("propagation_speed").isNotNull(), _text("Propagation Speed: ", F.col("propagation_speed"))),
        F.when(F.size("topics") > 0, _text("Discussion Topics & Keywords: ", F.array_join("topics", ", "))),
    ).alias("block"))


def shared_video_lines(shared: DataFrame, n: int = 6) -> DataFrame:
    """Lines of the first ``n`` linked videos (most recently discussed first)."""
    first = ranking.shared_order(shared, scoped=False).limit(n)
    lines = F.concat_ws(
        _NEWLINE,
        _text('  • Video: "', F.coalesce("title", "video_id"), '" (ID: ', F.col("video_id"), ")"),
        _text("    Reddit Discussions: ", F.col("total_reddit_shares").cast("string"), " shares/threads, ",
              F.col("reddit_total_comments").cast("string"), " comments, ",
              F.coalesce("reddit_total_upvotes", F.lit(0)).cast("string"), " upvotes"),
        F.when(F.col("propagation_speed").isNotNull(), _text("    Propagation Speed: ", F.col("propagation_speed"))),
        _text("    YouTube Sentiment: ", F.col("youtube_sentiment.dominant_label")),
        _text("    Reddit Sentiment: ", F.col("reddit_sentiment.dominant_label")),
        F.when(F.size("topics") > 0, _text("    Discussion Topics: ", F.array_join(F.slice("topics", 1, 5), ", "))),
    )
    order = Window.orderBy(F.desc("last_ingested_at"), "video_id")
    return first.select(F.row_number().over(order).alias("position"), "video_id", lines.alias("lines"))


def answer_context(conversations: DataFrame, turns: int = 6) -> DataFrame:
    """Last turns of each conversation with the answer budget of user questions."""
    from ..functions.metrics import answer_budget

    recent = ranking.last_turns(conversations, turns)
    is_question = (F.col("role") == "user") & tx.is_valid_question(F.col("text"))
    return recent.withColumn("answer_budget", F.when(is_question, answer_budget(F.col("text"))))
