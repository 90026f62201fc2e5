"""Text, identifier and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .rounding import round_to


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WS_CHARS))


def clean_subreddit(c: Column) -> Column:
    """Trim, drop leading slashes, delete every ``r/`` (case-sensitively), lower-case last."""
    body = F.replace(F.regexp_replace(strip(c), "^/+", ""), F.lit("r/"), F.lit(""))
    return F.lower(strip(body))


def is_channel_id(c: Column) -> Column:
    return F.coalesce(c.rlike(V.CHANNEL_ID_RE), F.lit(False))


def is_subreddit_name(c: Column) -> Column:
    return F.coalesce(c.rlike(V.SUBREDDIT_NAME_RE), F.lit(False))


def video_ids(body: Column) -> Column:
    """Distinct video ids linked in a text, in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(V.VIDEO_URL_RE), F.lit(1)))
    # Most texts hold no link at all; a plain search settles those.
    return F.when(F.contains(body, F.lit("youtu")), found).otherwise(F.array().cast("array<string>"))


def canonical_video_id(c: Column) -> Column:
    """Video id of a URL or of a raw id; any text that leaves exactly 11 id characters counts as one."""
    linked = F.regexp_extract(c, V.VIDEO_URL_RE, 1)
    raw = F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "")
    return F.when(linked != "", linked).when(F.length(raw) == 11, raw)


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; text without an offset is UTC, bad text is NULL.

    A date is complete, in the extended form or in the compact one; a time of day needs a date.
    """
    wide = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    wide = F.regexp_replace(wide, r"^(\S{10}[T ]\d{2})(\d{2})(\d{2})(?=$|[.,Z+-])", "$1:$2:$3")
    wide = F.regexp_replace(wide, r"^(\S{10}[T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2")
    wide = F.regexp_replace(wide, r"^(\S{10}[T ]\d{2})(?=$|[Z+-])", "$1:00")
    wide = F.regexp_replace(wide, r"(:\d{2}|[.,]\d+)([+-]\d{2})(\d{2})$", "$1$2:$3")
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}(?::\d{2})?)?)?$"
    return F.when(wide.rlike(shape), F.try_to_timestamp(F.translate(wide, ",", ".")))


def parse_epoch(c: Column) -> Column:
    return F.when(c != 0, F.timestamp_seconds(c))


def strip_urls(c: Column) -> Column:
    """Drop URLs and collapse white space."""
    no_urls = F.regexp_replace(c, f"https?://[^{V.WS}]+|www\\.[^{V.WS}]+", " ")
    return strip(F.regexp_replace(no_urls, f"[{V.WS}]+", " "))


def truncate(c: Column, size: int) -> Column:
    return F.substring(c, 1, size)


def human_number(c: Column) -> Column:
    n = c.cast("bigint")

    def scaled(unit: int, suffix: str) -> Column:
        return F.format_string(f"%.1f{suffix}", round_to(n / F.lit(float(unit)), 1))

    return (
        F.when(n.isNull(), "N/A")
        .when(n >= 1_000_000_000, scaled(1_000_000_000, "B"))
        .when(n >= 1_000_000, scaled(1_000_000, "M"))
        .when(n >= 1_000, scaled(1_000, "K"))
        .otherwise(n.cast("string"))
    )


def permalink_url(c: Column) -> Column:
    """Absolute URL of a permalink."""
    slash = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(c.rlike("(?i)^https?://"), c).otherwise(
        F.concat(F.lit("https://reddit.com"), slash)
    )


def watch_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def truthy(*cols: Column) -> Column:
    """First value that is neither NULL, nor 0, nor empty text (Python's ``a or b``)."""
    return F.coalesce(*[F.when(c.cast("string").isin("", "0", "0.0"), None).otherwise(c) for c in cols])


def mentions(body: Column, video_id: Column) -> Column:
    return F.contains(F.lower(body), F.lower(video_id))


def is_spam_subreddit(c: Column) -> Column:
    return F.coalesce(c.rlike(V.SPAM_SUBREDDIT_RE), F.lit(False))


def is_image_url(c: Column) -> Column:
    return F.coalesce(c.rlike(V.IMAGE_HOST_RE), F.lit(False))


def is_worthy_comment(author: Column, body: Column) -> Column:
    """Keep human authors with at least five characters of real text."""
    text = strip(F.coalesce(body, F.lit("")))
    who = F.lower(F.coalesce(author, F.lit("[deleted]")))
    return ~who.isin("automoderator", "[deleted]") & ~text.isin("[deleted]", "[removed]") & (F.length(text) >= 5)


def in_publish_window(post_ts: Column, video_ts: Column, days: int = V.PUBLISH_GRACE_DAYS) -> Column:
    return video_ts.isNull() | (post_ts >= video_ts - F.expr(f"INTERVAL {days} DAYS"))


def is_valid_question(c: Column) -> Column:
    return F.coalesce(F.length(c).between(3, 1000), F.lit(False))


def _spaced(c: Column, delete: str = "") -> Column:
    """Every white-space character becomes a plain space and the characters of ``delete`` go, in one pass."""
    return F.translate(c, V.WS_CHARS + delete, " " * len(V.WS_CHARS))


def runs(c: Column) -> Column:
    """White-space separated runs of a text (with empty strings between adjacent separators)."""
    return F.split(_spaced(c), " ")


def words(text: Column, rule: str) -> Column:
    """Raw words of a text under one of the three tokenising rules, before length and stop-list filters
    (empty words included).

    ``trend``   URLs become spaces, lower, ASCII punctuation deleted
    ``topic``   URLs deleted, punctuation and digits deleted, lower
    ``context`` lower, ``http…`` runs deleted, punctuation deleted
    """
    not_ws = f"[^{V.WS}]"
    if rule == "trend":
        clean = F.regexp_replace(text, f"(?i)https?://{not_ws}+|www\\.{not_ws}+", " ")
        clean = _spaced(F.lower(clean), V.ASCII_PUNCTUATION)
    elif rule == "topic":
        clean = F.regexp_replace(text, f"https?://{not_ws}+|www\\.{not_ws}+", "")
        clean = F.lower(_spaced(clean, V.ASCII_PUNCTUATION + V.DIGITS))
    elif rule == "context":
        clean = F.regexp_replace(F.lower(text), f"http{not_ws}+", "")
        clean = _spaced(clean, V.ASCII_PUNCTUATION)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return F.split(clean, " ")


STOP_WORDS = {
    "trend": V.TREND_STOP_WORDS,
    "topic": V.TOPIC_STOP_WORDS,
    "context": V.CONTEXT_STOP_WORDS,
}


def is_keyword(term: Column, rule: str) -> Column:
    return (F.length(term) > 3) & ~term.isin(STOP_WORDS[rule])
