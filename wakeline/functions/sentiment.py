"""Sentiment rules as expressions: labels, shares, gaps and the sentences built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_to
from .. import fixed_values as V

LABELS = ("positive", "neutral", "negative")


def label_of_compound(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def confidence(compound: Column, pos: Column, neu: Column, neg: Column, mode: str = "share") -> Column:
    """``share``: share of the winning class; ``compound``: absolute compound, four decimals."""
    if mode == "compound":
        return round_to(F.abs(compound), 4)
    return F.when(compound >= 0.05, pos).when(compound <= -0.05, neg).otherwise(neu)


def canonical_label(raw: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in V.LABEL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, F.lower(raw)), F.lit("neutral"))


def top_label(pos: Column, neu: Column, neg: Column) -> Column:
    """Largest of three values; ties resolve positive, then neutral, then negative."""
    p, u, n = (F.coalesce(c, F.lit(0)) for c in (pos, neu, neg))
    return F.when((p >= u) & (p >= n), "positive").when(u >= n, "neutral").otherwise("negative")


def label_counts(label: Column) -> list[Column]:
    """One-pass tallies: ``n`` labelled rows and one count per class."""
    return [
        F.count(label).alias("n"),
        *[F.count_if(label == name).alias(name[:3]) for name in LABELS],
    ]


def breakdown(n: Column, pos: Column, neu: Column, neg: Column, digits: int = 3) -> Column:
    """Shares, dominant label and sample size. Ties: positive, then negative, then neutral."""
    share = [F.when(n > 0, round_to(c / n, digits)).otherwise(F.lit(0.0)) for c in (pos, neu, neg)]
    p, u, g = share
    dominant = (
        F.when(F.coalesce(n, F.lit(0)) == 0, "neutral")
        .when((p >= u) & (p >= g), "positive")
        .when((g >= p) & (g >= u), "negative")
        .otherwise("neutral")
    )
    return F.struct(
        p.alias("positive"), u.alias("neutral"), g.alias("negative"),
        dominant.alias("dominant_label"), F.coalesce(n, F.lit(0)).cast("bigint").alias("sample_size"),
    )


def gap(yt: Column, rd: Column, digits: int = 2) -> Column:
    """Positive share on YouTube minus Reddit; 0 unless both sides have samples."""
    both = (yt["sample_size"] > 0) & (rd["sample_size"] > 0)
    return F.when(both, round_to(yt["positive"] - rd["positive"], digits)).otherwise(F.lit(0.0))


def _pct(c: Column) -> Column:
    return (c * 100).cast("int").cast("string")


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def list_note(yt: Column, rd: Column, gap_: Column) -> Column:
    """Sentence for the table of linked videos; thresholds are inclusive."""
    n_yt, n_rd = yt["sample_size"], rd["sample_size"]
    return (
        F.when((n_yt == 0) & (n_rd > 0), _say(
            "Reddit discussion sentiment is ", _pct(rd["positive"]), "% positive (", n_rd.cast("string"),
            " comments analyzed). No YouTube comments for this video have been ingested yet — "
            "analyze the video above for a full YouTube-vs-Reddit comparison."))
        .when((n_rd == 0) & (n_yt > 0), _say(
            "YouTube audience sentiment is ", _pct(yt["positive"]), "% positive (", n_yt.cast("string"),
            " comments analyzed). No Reddit discussions found for this video yet."))
        .when((n_yt == 0) & (n_rd == 0), "No sentiment comments found for this video yet.")
        .when(gap_ >= 0.20, _say("YouTube audience response is ", _pct(gap_),
                                 "% more positive than the Reddit discussion."))
        .when(gap_ <= -0.20, _say("Reddit discussion is ", _pct(F.abs(gap_)),
                                  "% more positive than YouTube reception."))
        .otherwise("Audience sentiment is broadly consistent across YouTube and Reddit.")
    )


def video_note(yt: Column, rd: Column, gap_: Column, n_subreddits: Column) -> Column:
    """Sentence for one video; thresholds are strict and the subreddit count is named."""
    n_yt, n_rd = yt["sample_size"], rd["sample_size"]
    across = F.when(n_subreddits > 0, _say(" across ", n_subreddits.cast("string"), " subreddits")).otherwise("")
    both = (n_yt > 0) & (n_rd > 0)
    return (
        F.when(both & (gap_ > 0.15), _say(
            "YouTube audience is significantly more positive (+", _pct(gap_), "% gap; ", _pct(yt["positive"]),
            "% positive on YouTube vs ", _pct(rd["positive"]), "% on Reddit", across,
            "). Reddit discussions reflect deeper critical debate and community skepticism."))
        .when(both & (gap_ < -0.15), _say(
            "Reddit discussion is significantly more positive (+", _pct(F.abs(gap_)), "% gap; ",
            _pct(rd["positive"]), "% positive on Reddit vs ", _pct(yt["positive"]),
            "% on YouTube). The Reddit community responded notably more favorably than YouTube comment threads."))
        .when(both, _say(
            "Sentiment is well aligned between YouTube (", _pct(yt["positive"]), "% pos) and Reddit (",
            _pct(rd["positive"]), "% pos", across, ")."))
        .when(n_yt > 0, _say(
            "YouTube audience sentiment is ", _pct(yt["positive"]), "% positive (", n_yt.cast("string"),
            " comments). No Reddit discussions were found that reference this specific video "
            "(checked by video URL, bare ID, and exact title). The metrics above reflect real data — "
            "0 Reddit discussions, 0 subreddits."))
        .when(n_rd > 0, _say(
            "Reddit discussion sentiment is ", _pct(rd["positive"]), "% positive (", n_rd.cast("string"),
            " comments analyzed)."))
    )


def comparison_summary(yt: Column, rd: Column, gap_: Column) -> Column:
    """Sentence for a target's two audiences; thresholds are strict at 0.10."""
    n_yt, n_rd = yt["sample_size"], rd["sample_size"]
    return (
        F.when((n_yt == 0) & (n_rd == 0),
               "No sentiment comments found for this query yet. Try scanning an active subreddit or video.")
        .when(n_yt == 0, _say("Reddit discussion sentiment is ", _pct(rd["positive"]), "% positive (",
                              n_rd.cast("string"), " comments analyzed)."))
        .when(n_rd == 0, _say("YouTube audience sentiment is ", _pct(yt["positive"]), "% positive (",
                              n_yt.cast("string"), " comments analyzed). "
                              "No Reddit community discussions found for this video yet."))
        .when(gap_ > 0.10, _say(
            "YouTube reception is notably more positive (", _pct(yt["positive"]),
            "%) than Reddit community discussion (", _pct(rd["positive"]),
            "%). Reddit discussions show deeper critical debate and contrarian perspectives."))
        .when(gap_ < -0.10, _say("Reddit discussion is more positive (", _pct(rd["positive"]),
                                 "%) than YouTube audience (", _pct(yt["positive"]), "%)."))
        .otherwise(_say("Audience response is closely aligned between YouTube (", _pct(yt["positive"]),
                        "% pos) and Reddit (", _pct(rd["positive"]), "% pos)."))
    )


def divergence(gap_: Column) -> Column:
    size = F.abs(gap_)
    return F.when(size < 0.05, "aligned").when(size < 0.20, "moderate").otherwise("polarised")


def low_sample(yt: Column, rd: Column) -> Column:
    has_data = (yt["sample_size"] > 0) | (rd["sample_size"] > 0)
    return has_data & ((yt["sample_size"] < 5) | (rd["sample_size"] < 5))
