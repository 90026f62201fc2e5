"""DuckDB SQL with the same result as each registered query. Shared views are common table expressions."""

from __future__ import annotations

import re

from .. import fixed_values as V
from .registry import AS_OF, LEXICON

URL_RE = V.VIDEO_URL_PATTERN
WS = V.WS


def q(text: str) -> str:
    return text.replace("'", "''")


def words_in(items: list[str]) -> str:
    return ", ".join(f"'{q(w)}'" for w in items)


PUNCT = q(V.ASCII_PUNCTUATION)
_LETTERS = "translate(lpad(CAST({0} AS VARCHAR), 9, '0'), '0123456789', 'abcdefghij')"


def letters(x: str) -> str:
    return _LETTERS.format(x)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def breakdown(prefix: str, n: str, pos: str, neu: str, neg: str) -> str:
    p, u, g = (f"CASE WHEN {n} > 0 THEN round({c} / {n}, 3) ELSE 0.0 END" for c in (pos, neu, neg))
    return (
        f"{p} AS {prefix}_positive, {u} AS {prefix}_neutral, {g} AS {prefix}_negative, "
        f"CASE WHEN coalesce({n}, 0) = 0 THEN 'neutral' WHEN {p} >= {u} AND {p} >= {g} THEN 'positive' "
        f"WHEN {g} >= {p} AND {g} >= {u} THEN 'negative' ELSE 'neutral' END AS {prefix}_dominant_label, "
        f"CAST(coalesce({n}, 0) AS BIGINT) AS {prefix}_n"
    )


COUNTS = (
    "CAST(count({0}) AS BIGINT) AS n, CAST(count_if({0} = 'positive') AS BIGINT) AS pos, "
    "CAST(count_if({0} = 'neutral') AS BIGINT) AS neu, CAST(count_if({0} = 'negative') AS BIGINT) AS neg"
)


def counts(label: str) -> str:
    return COUNTS.format(label)


def top_label(p: str, u: str, g: str) -> str:
    return f"CASE WHEN {p} >= {u} AND {p} >= {g} THEN 'positive' WHEN {u} >= {g} THEN 'neutral' ELSE 'negative' END"


def pct(x: str) -> str:
    return f"CAST(CAST(trunc(({x}) * 100) AS INTEGER) AS VARCHAR)"


GAP = "CASE WHEN yt_n > 0 AND rd_n > 0 THEN round(yt_positive - rd_positive, 2) ELSE 0.0 END"


def delay(pub: str, first: str) -> str:
    hours = f"greatest(0.0, round((epoch_us({first}) - epoch_us({pub})) / 1000000.0 / 3600.0, 1))"
    return f"CASE WHEN {pub} IS NOT NULL AND {first} IS NOT NULL THEN {hours} END"


def speed(d: str, first: str, undated: str) -> str:
    return (
        f"CASE WHEN {d} <= 6 THEN 'Rapid (< 6h)' WHEN {d} <= 24 THEN 'Moderate (6-24h)' "
        f"WHEN {d} <= 72 THEN 'Delayed (1-3d)' WHEN {d} IS NOT NULL THEN "
        f"'Archival (' || CAST(CAST(floor({d} / 24) AS BIGINT) AS VARCHAR) || 'd lag)' "
        f"WHEN {first} IS NOT NULL THEN '{undated}' END"
    )


def human(x: str) -> str:
    n = f"CAST({x} AS BIGINT)"
    return (
        f"CASE WHEN {n} IS NULL THEN 'N/A' WHEN {n} >= 1000000000 THEN printf('%.1fB', round({n} / 1000000000.0, 1)) "
        f"WHEN {n} >= 1000000 THEN printf('%.1fM', round({n} / 1000000.0, 1)) "
        f"WHEN {n} >= 1000 THEN printf('%.1fK', round({n} / 1000.0, 1)) ELSE CAST({n} AS VARCHAR) END"
    )


LIST_NOTE = f"""CASE
 WHEN yt_n = 0 AND rd_n > 0 THEN 'Reddit discussion sentiment is ' || {pct('rd_positive')} || '% positive (' || rd_n ||
  ' comments analyzed). No YouTube comments for this video have been ingested yet — analyze the video above for a full YouTube-vs-Reddit comparison.'
 WHEN rd_n = 0 AND yt_n > 0 THEN 'YouTube audience sentiment is ' || {pct('yt_positive')} || '% positive (' || yt_n ||
  ' comments analyzed). No Reddit discussions found for this video yet.'
 WHEN rd_n = 0 AND yt_n = 0 THEN 'No sentiment comments found for this video yet.'
 WHEN sentiment_gap >= 0.20 THEN 'YouTube audience response is ' || {pct('sentiment_gap')} || '% more positive than the Reddit discussion.'
 WHEN sentiment_gap <= -0.20 THEN 'Reddit discussion is ' || {pct('abs(sentiment_gap)')} || '% more positive than YouTube reception.'
 ELSE 'Audience sentiment is broadly consistent across YouTube and Reddit.' END"""


def video_note(subs: str) -> str:
    across = f"(CASE WHEN {subs} > 0 THEN ' across ' || {subs} || ' subreddits' ELSE '' END)"
    return f"""CASE
 WHEN yt_n > 0 AND rd_n > 0 AND sentiment_gap > 0.15 THEN 'YouTube audience is significantly more positive (+' || {pct('sentiment_gap')} ||
  '% gap; ' || {pct('yt_positive')} || '% positive on YouTube vs ' || {pct('rd_positive')} || '% on Reddit' || {across} ||
  '). Reddit discussions reflect deeper critical debate and community skepticism.'
 WHEN yt_n > 0 AND rd_n > 0 AND sentiment_gap < -0.15 THEN 'Reddit discussion is significantly more positive (+' || {pct('abs(sentiment_gap)')} ||
  '% gap; ' || {pct('rd_positive')} || '% positive on Reddit vs ' || {pct('yt_positive')} ||
  '% on YouTube). The Reddit community responded notably more favorably than YouTube comment threads.'
 WHEN yt_n > 0 AND rd_n > 0 THEN 'Sentiment is well aligned between YouTube (' || {pct('yt_positive')} || '% pos) and Reddit (' ||
  {pct('rd_positive')} || '% pos' || {across} || ').'
 WHEN yt_n > 0 THEN 'YouTube audience sentiment is ' || {pct('yt_positive')} || '% positive (' || yt_n ||
  ' comments). No Reddit discussions were found that reference this specific video (checked by video URL, bare ID, and exact title). The metrics above reflect real data — 0 Reddit discussions, 0 subreddits.'
 WHEN rd_n > 0 THEN 'Reddit discussion sentiment is ' || {pct('rd_positive')} || '% positive (' || rd_n || ' comments analyzed).' END"""


SUMMARY = f"""CASE
 WHEN yt_n = 0 AND rd_n = 0 THEN 'No sentiment comments found for this query yet. Try scanning an active subreddit or video.'
 WHEN yt_n = 0 THEN 'Reddit discussion sentiment is ' || {pct('rd_positive')} || '% positive (' || rd_n || ' comments analyzed).'
 WHEN rd_n = 0 THEN 'YouTube audience sentiment is ' || {pct('yt_positive')} || '% positive (' || yt_n || ' comments analyzed). No Reddit community discussions found for this video yet.'
 WHEN sentiment_gap > 0.10 THEN 'YouTube reception is notably more positive (' || {pct('yt_positive')} || '%) than Reddit community discussion (' || {pct('rd_positive')} || '%). Reddit discussions show deeper critical debate and contrarian perspectives.'
 WHEN sentiment_gap < -0.10 THEN 'Reddit discussion is more positive (' || {pct('rd_positive')} || '%) than YouTube audience (' || {pct('yt_positive')} || '%).'
 ELSE 'Audience response is closely aligned between YouTube (' || {pct('yt_positive')} || '% pos) and Reddit (' || {pct('rd_positive')} || '% pos).' END"""


def ordered_distinct(arr: str) -> str:
    return f"list_filter({arr}, lambda x, i: list_position({arr}, x) = i)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


SQL: dict[str, str] = {}


def add(name: str, sql: str, *needs: str) -> None:
    order: list[str] = []

    def visit(v: str) -> None:
        for n in VIEWS[v][0]:
            visit(n)
        if v not in order:
            order.append(v)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{v} AS (\n{VIEWS[v][1]}\n)" for v in order)
    SQL[name] = (f"WITH {head}\n" if head else "") + sql


# --- views -----------------------------------------------------------------------

view("comments", f"""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'youtube' ELSE 'reddit' END AS platform,
 'c' || doc_id AS platform_id, lower(source) AS parent_id,
 CASE WHEN doc_id % 2 = 0 THEN vid END AS video_id,
 CASE WHEN doc_id % 2 = 1 THEN 'p' || (doc_id // 4) END AS post_id,
 CASE WHEN n_chars % 11 = 0 THEN '[deleted]' WHEN n_chars % 13 = 0 THEN 'AutoModerator' ELSE 'user' || (doc_id // 3) END AS author,
 text || CASE n_chars % 5 WHEN 0 THEN ' https://youtu.be/' || vid WHEN 1 THEN ' www.youtube.com/watch?x=1&v=' || vid
  WHEN 2 THEN ' the studio ' || {letters('no')} || ' made take ' || {letters('no')} || ' again' ELSE '' END AS body,
 CASE WHEN doc_id % 2 = 1 THEN '/r/x/comments/' || doc_id END AS permalink,
 CASE WHEN doc_id % 2 = 0 THEN n_chars % 50 END AS like_count,
 CASE WHEN doc_id % 2 = 1 THEN n_chars % 100 - 5 END AS score,
 make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS published_at,
 make_timestamp((1704067200 + doc_id * 3600 + n_chars % 3600) * 1000000) AS ingested_at,
 CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'neutral' END AS sentiment_label,
 doc_id, n_chars
FROM (SELECT *, 'v' || lpad(CAST(no AS VARCHAR), 10, '0') AS vid FROM (
 SELECT d.doc_id, d.text, d.source, d.n_chars, l.quality, l.toxic,
  CASE WHEN d.n_chars % 3 = 0 THEN 0 ELSE d.doc_id // 10 END AS no
 FROM documents d LEFT JOIN labels l USING (doc_id)))""")

view("videos", f"""
SELECT 'v' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS video_id,
 p_name || ' ' || lower(p_type) || ' [take ' || {letters('p_partkey')} || ']' AS title,
 'studio ' || {letters('p_partkey')} AS channel_title, lower(p_brand) AS channel_id,
 string_split(p_name, ' ') AS tags, 'A ' || p_name || ' of ' || p_brand AS description,
 CAST(floor(p_retailprice * 1000) AS BIGINT) AS views, CAST(p_size * 100 AS BIGINT) AS likes,
 CAST(p_size * 7 AS BIGINT) AS comment_count,
 make_timestamp((1703980800 + p_partkey * 7200) * 1000000) AS published_at, p_partkey AS video_no
FROM part""")

view("posts", f"""
SELECT 'p' || page_id AS post_id,
 CASE WHEN n % 7 = 0 THEN 'spam_corner' ELSE 'Sub' || (n % 9) END AS subreddit, 'Post ' || page_id AS title,
 html || CASE n % 4 WHEN 0 THEN ' https://youtu.be/v' || lpad(CAST(no AS VARCHAR), 10, '0')
  WHEN 1 THEN ' the studio ' || {letters('no')} || ' and take ' || {letters('no')}
  WHEN 2 THEN ' the studio ' || {letters('no')} || ' small ring economy ' || {letters('no')} ELSE '' END AS selftext,
 CASE WHEN n % 5 = 0 THEN 'https://i.redd.it/' || page_id ELSE url END AS url,
 CAST(n % 90 - 4 AS BIGINT) AS score, CAST(n % 40 AS BIGINT) AS num_comments,
 make_timestamp((1704067200 + page_id * 3600 - n % 5 * 86400) * 1000000) AS created_at
FROM (SELECT *, length(html) AS n, CASE WHEN length(html) % 3 = 0 THEN 0 ELSE page_id // 5 END AS no FROM pages)""")

view("accounts", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'youtube' ELSE 'reddit' END AS platform, lower(source) AS platform_id,
 CAST(sum(n_chars) AS BIGINT) AS subscriber_count, 'Name ' || upper(lower(source)) AS display_name,
 make_timestamp(min(1704067200 + doc_id * 3600) * 1000000) AS created_at,
 make_timestamp(max(1704067200 + doc_id * 3600) * 1000000) AS updated_at
FROM documents GROUP BY 1, 2, 4""")

view("payloads", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'youtube' ELSE 'reddit' END AS platform, lower(source) AS platform_id,
 CAST(sum(n_chars) AS BIGINT) AS chars, count(*) AS n, CAST(sum(n_chars % 50) AS BIGINT) AS likes,
 make_timestamp(max(1704067200 + doc_id * 3600 + 600) * 1000000) AS ingested_at
FROM documents GROUP BY 1, 2""")

view("history", """
SELECT o_custkey AS channel_id, o_orderkey AS post_id, o_orderdate AS published_at,
 CASE o_orderstatus WHEN 'F' THEN 'a python tutorial, python code' WHEN 'O' THEN 'live concert and album review'
  ELSE 'breaking world news' END || ' ' || lower(o_orderpriority) AS title,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Videogames' WHEN '5-LOW' THEN 'unlisted' END AS category,
 floor(o_totalprice / 10) AS views, floor(floor(o_totalprice / 10) * 0.06::DOUBLE) AS likes,
 floor(floor(o_totalprice / 10) * 0.01::DOUBLE) AS comments, CAST(o_orderkey % 40 AS DOUBLE) AS shares,
 CAST(o_orderkey % 10 AS DOUBLE) / 10 AS mood, CAST(o_orderkey % 7 AS BIGINT) AS topic_encoded
FROM orders""")

view("links", f"""
SELECT c.* EXCLUDE (video_id), u.video_id FROM comments c,
 (SELECT DISTINCT platform_id AS pid, unnest(regexp_extract_all(body, '{URL_RE}', 1)) AS video_id FROM comments
  WHERE platform = 'reddit') u
WHERE c.platform = 'reddit' AND c.platform_id = u.pid""", "comments")

view("yt_counts", f"""
SELECT v.video_id, {counts('c.sentiment_label')} FROM videos v JOIN comments c ON c.video_id = v.video_id
WHERE c.platform = 'youtube' AND c.sentiment_label IS NOT NULL GROUP BY 1""", "videos", "comments")


def tokens(src: str, cols: str, rule: str, body: str = "body", where: str = "true") -> str:
    nws = f"[^{WS}]"
    stops = {"trend": V.TREND_STOP_WORDS, "topic": V.TOPIC_STOP_WORDS, "context": V.CONTEXT_STOP_WORDS}[rule]
    if rule == "trend":
        clean = f"translate(lower(regexp_replace({body}, '(?i)https?://{nws}+|www\\.{nws}+', ' ', 'g')), '{PUNCT}', '')"
    elif rule == "topic":
        clean = f"lower(translate(regexp_replace({body}, 'https?://{nws}+|www\\.{nws}+', '', 'g'), '{PUNCT}0123456789', ''))"
    else:
        clean = f"translate(regexp_replace(lower({body}), 'http{nws}+', '', 'g'), '{PUNCT}', '')"
    return f"""
SELECT {cols}, term, pos FROM (
 SELECT {cols}, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
  SELECT {cols}, string_split_regex({clean}, '[{WS}]+') AS w FROM {src} WHERE {where}))
WHERE length(term) > 3 AND term NOT IN ({words_in(stops)})"""


# --- linking and propagation -------------------------------------------------------

def shared_views(p: str) -> None:
    """Views of the shared-video report over ``<p>links``."""
    view(f"{p}yt_link_counts", f"""
SELECT v.video_id, {counts('c.sentiment_label')} FROM (SELECT DISTINCT video_id FROM {p}links) v
JOIN comments c ON c.video_id = v.video_id
WHERE c.platform = 'youtube' AND c.sentiment_label IS NOT NULL GROUP BY 1""", f"{p}links", "comments")
    view(f"{p}video_terms", tokens(f"{p}links", "video_id, ingested_at, platform_id", "topic"), f"{p}links")
    view(f"{p}video_topics", f"""
SELECT video_id, list(term ORDER BY r) AS terms FROM (
 SELECT video_id, term, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, k) AS r FROM (
  SELECT video_id, term, count(*) AS n, min(row(-epoch_us(ingested_at), platform_id, pos)) AS k
  FROM {p}video_terms GROUP BY ALL))
WHERE r <= 4 GROUP BY 1""", f"{p}video_terms")
    view(f"{p}rolled", f"""
SELECT video_id, count(*) AS shares, count(DISTINCT post_id) AS posts, count(DISTINCT parent_id) AS subs,
 CAST(sum(score) AS BIGINT) AS votes, min(published_at) AS first_at, max(published_at) AS last_at,
 max(ingested_at) AS last_ingested, {counts("coalesce(sentiment_label, 'neutral')")}
FROM {p}links GROUP BY 1""", f"{p}links")
    view(f"{p}shared", f"""
SELECT *, CASE WHEN yt_n > 0 AND rd_n > 0 THEN round(yt_positive - rd_positive, 2) ELSE 0.0 END AS sentiment_gap FROM (
SELECT r.video_id, v.title, v.views, v.likes, v.tags, v.published_at, r.shares, r.posts, r.subs,
 CASE WHEN r.votes <> 0 THEN r.votes END AS votes, r.first_at, r.last_at, r.last_ingested, pc.post_comments,
 {delay('v.published_at', 'r.first_at')} AS delay_h,
 {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')}, {breakdown('rd', 'r.n', 'r.pos', 'r.neu', 'r.neg')}
FROM {p}rolled r LEFT JOIN videos v USING (video_id) LEFT JOIN {p}yt_link_counts y USING (video_id)
LEFT JOIN (SELECT video_id, CAST(sum(num_comments) AS BIGINT) AS post_comments FROM
 (SELECT DISTINCT video_id, post_id FROM {p}links) JOIN posts USING (post_id) GROUP BY 1) pc USING (video_id))""",
         f"{p}rolled", "videos", f"{p}yt_link_counts", "posts")


shared_views("")

TOPICS = ordered_distinct("list_concat(list_slice(coalesce(tags, []), 1, 4), coalesce(terms, []))")
YT_RD = ("yt_positive, yt_neutral, yt_negative, yt_dominant_label, yt_n, "
         "rd_positive, rd_neutral, rd_negative, rd_dominant_label, rd_n")

def shared_report(p: str, match: str, score: str) -> str:
    return f"""
SELECT video_id, title, CAST(views AS DOUBLE) AS youtube_views, CAST(likes AS DOUBLE) AS youtube_likes, shares AS total_reddit_shares,
 posts AS reddit_posts, subs AS reddit_subreddits, CAST(votes AS DOUBLE) AS reddit_total_upvotes,
 CASE WHEN coalesce(post_comments, 0) <> 0 THEN post_comments ELSE shares END AS reddit_total_comments,
 {ts('first_at')} AS reddit_first_shared_at, {ts('last_at')} AS reddit_latest_shared_at,
 delay_h AS propagation_delay_hours, {speed('delay_h', 'first_at', 'Recent Community Discovery')} AS propagation_speed,
 {YT_RD}, sentiment_gap, {LIST_NOTE} AS sentiment_disparity_note,
 array_to_string(list_slice({TOPICS}, 1, 6), '|') AS topics, {match} AS match_type, {score} AS similarity_score
FROM {p}shared LEFT JOIN {p}video_topics USING (video_id)"""


add("shared_videos", shared_report("", "'url'", "1.0::DOUBLE"), "shared", "video_topics")

add("propagation", f"""
SELECT video_id, shares, {ts('first_at')} AS first_shared_at, {ts('last_at')} AS last_shared_at,
 delay_h AS propagation_delay_hours, {speed('delay_h', 'first_at', 'Recent Community Discovery')} AS propagation_speed
FROM shared""", "shared")

add("unmatched_comments", """
SELECT platform_id, parent_id FROM comments WHERE platform = 'reddit'
AND platform_id NOT IN (SELECT platform_id FROM links)""", "links")

view("id_hits", """
SELECT c.* EXCLUDE (video_id), v.video_id FROM comments c JOIN videos v ON contains(lower(c.body), lower(v.video_id))
WHERE c.platform = 'reddit'""", "comments", "videos")


def engagement(discussions: str, accepted: str | None) -> str:
    """Engagement report over a discussions view and an accepted-posts view."""
    acc = (
        f"UNION ALL SELECT video_id, post_id, lower(subreddit), score, num_comments, NULL, NULL, 0 FROM {accepted}"
        if accepted else ""
    )
    known = f"NOT EXISTS (SELECT 1 FROM {accepted} a WHERE a.video_id = d.video_id AND a.post_id = d.post_id)" if accepted else "true"
    return f"""
, erows AS (
 SELECT video_id, post_id, lower(parent_id) AS subreddit, CASE WHEN {known} THEN score END AS votes,
  NULL::BIGINT AS num_comments, coalesce(sentiment_label, 'neutral') AS label, published_at, 1 AS is_comment FROM {discussions} d
 {acc}
), er AS (
 SELECT video_id, count(DISTINCT subreddit) AS subs, count(DISTINCT post_id) AS posts, CAST(sum(is_comment) AS BIGINT) AS nd,
  CAST(sum(coalesce(votes, 0)) AS BIGINT) AS votes, CAST(sum(coalesce(num_comments, 0)) AS BIGINT) AS nc,
  min(published_at) AS first_at, max(published_at) AS last_at, {counts('label')}
 FROM erows GROUP BY 1
), et AS ({tokens(discussions, 'video_id, ingested_at, platform_id', 'topic')}
), etop AS (
 SELECT video_id, array_to_string(list(term ORDER BY r), '|') AS topics FROM (
  SELECT video_id, term, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, k) AS r FROM (
   SELECT video_id, term, count(*) AS n, min(row(-epoch_us(ingested_at), platform_id, pos)) AS k FROM et GROUP BY ALL))
 WHERE r <= 6 GROUP BY 1
), e0 AS (
 SELECT er.*, v.title, v.views, v.published_at, etop.topics, {delay('v.published_at', 'er.first_at')} AS delay_h,
 {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')}, {breakdown('rd', 'er.n', 'er.pos', 'er.neu', 'er.neg')}
 FROM er LEFT JOIN videos v USING (video_id) LEFT JOIN yt_counts y USING (video_id) LEFT JOIN etop USING (video_id)
), e1 AS (SELECT *, {GAP} AS sentiment_gap FROM e0)
SELECT video_id, coalesce(title, 'Video ' || video_id) AS title, CAST(views AS DOUBLE) AS youtube_views, subs AS subreddits_count,
 nd AS total_reddit_discussions, posts AS reddit_posts_count, votes AS reddit_total_upvotes, nc AS reddit_total_comments,
 {ts('first_at')} AS reddit_first_shared_at, {ts('last_at')} AS reddit_latest_shared_at, delay_h AS propagation_delay_hours,
 {speed('delay_h', 'first_at', 'Community Discovered')} AS propagation_speed, {YT_RD}, sentiment_gap,
 {video_note('subs')} AS sentiment_disparity_note, coalesce(topics, '') AS topics
FROM e1"""


add("video_engagement_url", engagement("id_hits", None), "id_hits", "yt_counts")

# Fingerprints. The supplied names hold one bracketed phrase, one segment and no separators.
view("prints", f"""
SELECT video_id, title, channel_title, published_at, tags,
 [{letters('video_no')}] AS variants,
 list_transform(list_sort(list_transform({ordered_distinct("regexp_extract_all(lower(title), '[a-zA-Z]{3,}')")},
  lambda w, i: row(-length(w), i, w))), lambda s: s[3]) AS words0,
 [regexp_extract(title, '\\[([^\\[\\]]*)\\]', 1), {strip("regexp_replace(title, '[\\(\\[\\*].*?[\\)\\]\\*]', '', 'g')")}] AS phrases
FROM videos""", "videos")
view("fp", f"""
SELECT * EXCLUDE (words0), list_filter(words0, lambda w: w NOT IN ({words_in(V.TITLE_STOP_WORDS)})) AS words
FROM prints""", "prints")

add("video_fingerprint", """
SELECT video_id, array_to_string(variants, '|') AS creator_variants, array_to_string(words, '|') AS topic_words,
 array_to_string(phrases, '|') AS distinctive_phrases, array_to_string(list_transform(tags, lambda t: lower(t)), '|') AS tag_phrases,
 title || ' ' || channel_title || ' ' || array_to_string(tags, ' ') AS full_text
FROM fp""", "fp")


def verified(src: str, key: str, text: str, where: str = "true") -> str:
    """Nested-loop form of the three tiers."""
    return f"""
SELECT {key}, video_id, CASE WHEN has_id THEN 'url' WHEN has_phrase THEN 'phrase_match' ELSE 'title_match' END AS match_type,
 CASE WHEN has_id THEN 1.0::DOUBLE WHEN has_phrase THEN 0.9::DOUBLE
  ELSE round(least(0.80::DOUBLE + 0.05::DOUBLE * greatest(m - 3, 0), 0.95::DOUBLE), 3) END AS similarity_score
FROM (
 SELECT {key}, video_id, has_id, n, has_name AND len(list_filter(phrases, lambda p: contains(t, lower(p)))) > 0 AS has_phrase, has_name,
  CASE WHEN has_name THEN len(list_filter(words, lambda w: contains(t, w))) ELSE 0 END AS m
 FROM (SELECT p.{key}, f.video_id, p.t, f.phrases, f.words, len(f.words) AS n, contains(p.t, lower(f.video_id)) AS has_id,
   contains(p.t, f.variants[1]) AS has_name
  FROM (SELECT {key}, lower({text}) AS t FROM {src} WHERE {where}) p, fp f)
 WHERE has_id OR has_name)
WHERE has_id OR has_phrase OR (has_name AND n >= 3 AND m >= 3 AND m / n >= 0.60)"""


view("post_texts0", "SELECT *, concat_ws(' ', nullif(url, ''), nullif(selftext, ''), nullif(title, ''), nullif(subreddit, '')) AS text FROM posts", "posts")
add("verify_tiers", verified("post_texts0", "post_id", "text"), "post_texts0", "fp")

view("post_texts", f"""
SELECT p.* EXCLUDE (text), concat_ws(' ', text, b.bodies) AS text FROM post_texts0 p LEFT JOIN (
 SELECT post_id, string_agg(body, ' ' ORDER BY published_at, platform_id) AS bodies FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY published_at, platform_id) AS r FROM comments
  WHERE post_id IS NOT NULL AND {strip('body')} NOT IN ('', '[deleted]', '[removed]'))
 WHERE r <= 10 GROUP BY 1) b ON b.post_id = p.post_id AND regexp_matches(p.url, '{V.IMAGE_HOST_RE}')""",
     "post_texts0", "comments")
view("post_hits", verified("post_texts", "post_id", "text", f"NOT regexp_matches(subreddit, '{V.SPAM_SUBREDDIT_RE}')"), "post_texts", "fp")
view("kept", """
SELECT h.*, p.subreddit, p.score, p.num_comments,
 CASE h.match_type WHEN 'url' THEN 1 WHEN 'phrase_match' THEN 2 ELSE 3 END AS tier
FROM post_hits h JOIN posts p USING (post_id) JOIN videos v USING (video_id)
WHERE (p.score >= 0 OR h.match_type = 'url') AND (v.published_at IS NULL OR p.created_at >= v.published_at - INTERVAL 3 DAY)""",
     "post_hits", "posts", "videos")
view("accepted", """
SELECT * FROM (SELECT *, count_if(tier = 1) OVER (PARTITION BY video_id) AS n1, count_if(tier <= 2) OVER (PARTITION BY video_id) AS n2 FROM kept)
WHERE CASE tier WHEN 2 THEN n1 WHEN 3 THEN n2 ELSE 0 END < 10""", "kept")
add("accepted_posts", "SELECT video_id, post_id, match_type, similarity_score, score, CAST(tier AS BIGINT) AS tier FROM accepted", "accepted")

WORTHY = f"""platform = 'reddit' AND lower(author) NOT IN ('automoderator', '[deleted]')
 AND {strip('body')} NOT IN ('[deleted]', '[removed]') AND length({strip('body')}) >= 5"""
view("worthy_comments", f"SELECT * FROM comments WHERE {WORTHY}", "comments")
view("best_comments", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, platform_id) AS comment_rank
 FROM comments WHERE {WORTHY}) WHERE comment_rank <= 10""", "comments")
view("comment_hits", verified("comments", "platform_id", "body", "platform = 'reddit' AND body <> ''"), "comments", "fp")
view("discussions", """
SELECT c.* EXCLUDE (video_id), d.video_id FROM (
 SELECT video_id, platform_id FROM comment_hits
 UNION SELECT a.video_id, b.platform_id FROM accepted a JOIN worthy_comments b USING (post_id)) d
JOIN comments c USING (platform_id)""", "comment_hits", "accepted", "worthy_comments", "comments")
add("video_engagement", engagement("discussions", "accepted"), "discussions", "yt_counts")

add("top_threads", f"""
SELECT t.video_id, CAST(t.r AS BIGINT) AS thread_rank, t.post_id, lower(p.subreddit) AS subreddit, p.score,
 coalesce(m.thread_label, 'neutral') AS thread_label, coalesce(m.ids, '') AS top_comments
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, post_id) AS r FROM (
  SELECT v.video_id, p.post_id, p.score FROM post_texts0 p JOIN videos v ON contains(lower(p.text), lower(v.video_id)))) t
JOIN posts p USING (post_id)
LEFT JOIN (SELECT post_id, {top_label("count_if(l = 'positive')", "count_if(l = 'neutral')", "count_if(l = 'negative')")} AS thread_label,
  string_agg(platform_id, '|' ORDER BY comment_rank) AS ids
 FROM (SELECT *, coalesce(sentiment_label, 'neutral') AS l FROM best_comments) GROUP BY 1) m USING (post_id)
WHERE t.r <= 10""", "post_texts0", "videos", "posts", "best_comments")

view("cosines", """
SELECT d.vec_id AS did, v.vec_id AS vid,
 least(greatest(list_dot_product(d.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0.0), 1.0) AS s
FROM embeddings d, embeddings v WHERE d.label < 5 AND v.label >= 5""")
view("sem_best", """
SELECT did, vid, s FROM (SELECT *, row_number() OVER (PARTITION BY did ORDER BY s DESC, vid) AS r FROM cosines) WHERE r = 1""", "cosines")
add("semantic_best_match", """
SELECT did AS platform_id, vid AS video_id, 'semantic' AS match_type, round(round(s, 4), 3) AS similarity_score
FROM sem_best WHERE s >= 0.3""", "sem_best")
add("overall_match_type", """
SELECT k AS video_no, CASE WHEN bool_or(u) AND bool_or(NOT u) THEN 'hybrid' WHEN bool_or(NOT u) THEN 'semantic' ELSE 'url' END AS match_type,
 round(max(s), 3) AS similarity_score FROM (
 SELECT vec_id % 25 AS k, true AS u, 1.0::DOUBLE AS s FROM embeddings WHERE label < 5
 UNION ALL SELECT vid % 50, false, round(s, 4) FROM sem_best WHERE s >= 0.2) GROUP BY 1""", "sem_best")

view("hlinks", """
SELECT *, true AS by_url, 1.0::DOUBLE AS match_score FROM links
UNION ALL
SELECT c.* EXCLUDE (video_id), 'v' || lpad(CAST(vid // 5 AS VARCHAR), 10, '0') AS video_id, false, round(s, 4)
FROM sem_best JOIN comments c ON c.platform_id = 'c' || did AND c.platform = 'reddit'
WHERE s >= 0.3 AND c.platform_id NOT IN (SELECT platform_id FROM links)""", "links", "sem_best", "comments")
shared_views("h")
view("hmatch", """
SELECT video_id, CASE WHEN bool_and(by_url) THEN 'url' WHEN bool_or(by_url) THEN 'hybrid' ELSE 'semantic' END AS m, max(match_score) AS s
FROM hlinks GROUP BY 1""", "hlinks")
add("shared_videos_hybrid", shared_report("h", "m", "round(s, 3)") + " JOIN hmatch USING (video_id)", "hshared", "hvideo_topics", "hmatch")

add("video_search", """
SELECT video_id, 'https://www.youtube.com/watch?v=' || video_id AS watch_url, title, channel_title, m AS match_type
FROM hmatch JOIN videos USING (video_id) WHERE m <> 'url' AND (contains(lower(title), 'ring') OR contains(lower(channel_title), 'ring'))""", "hmatch", "videos")

view("url_free", f"""
SELECT platform_id, {strip(f"regexp_replace(regexp_replace(body, 'https?://[^{WS}]+|www\\.[^{WS}]+', ' ', 'g'), '[{WS}]+', ' ', 'g')")} AS t,
 regexp_extract_all(body, '{URL_RE}', 1) AS ids FROM comments""", "comments")

# TF-IDF over the joint corpus, then the best video of each comment.
view("corpus", f"""
SELECT 'd' AS side, platform_id AS id, t FROM url_free WHERE length(t) >= 15 AND len(ids) = 0
 AND platform_id IN (SELECT platform_id FROM comments WHERE platform = 'reddit')
UNION ALL SELECT 'v', video_id, title || '. ' || substr(description, 1, 300) FROM videos""", "url_free", "comments", "videos")
view("corpus_tf", f"""
SELECT side, id, term, count(*) AS tf FROM (
 SELECT side, id, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM corpus)
WHERE term NOT IN ({words_in(V.TREND_STOP_WORDS)}) GROUP BY ALL""", "corpus")
view("vocabulary", "SELECT term, count(*) AS df FROM corpus_tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 384", "corpus_tf")
view("weights", """
SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS u FROM (
 SELECT side, id, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1) AS w FROM corpus_tf JOIN vocabulary USING (term))""",
     "corpus", "corpus_tf", "vocabulary")
add("tfidf_match", """
SELECT platform_id, video_id, 'semantic' AS match_type, round(s, 4) AS similarity_score FROM (
 SELECT *, row_number() OVER (PARTITION BY platform_id ORDER BY s DESC, video_id) AS r FROM (
  SELECT d.id AS platform_id, v.id AS video_id, round(least(sum(d.u * v.u), 1.0), 9) AS s
  FROM weights d JOIN weights v USING (term) WHERE d.side = 'd' AND v.side = 'v' GROUP BY 1, 2)) WHERE r = 1 AND s >= 0.1""", "weights")

# --- sentiment -----------------------------------------------------------------------

view("tally", f"""
SELECT platform, parent_id, {counts('sentiment_label')} FROM comments GROUP BY 1, 2""", "comments")
PCTS = ", ".join(
    f"CASE WHEN n > 0 THEN round({c} / n, 4) ELSE 0.0 END AS {x}_pct"
    for c, x in (("pos", "positive"), ("neu", "neutral"), ("neg", "negative"))
)
add("sentiment_tally", f"SELECT platform, parent_id, n AS total_comments_analyzed, {PCTS} FROM tally", "tally")
add("sentiment_breakdown", f"SELECT platform, parent_id, {breakdown('b', 'n', 'pos', 'neu', 'neg')} FROM tally", "tally")

view("sides0", f"""
SELECT coalesce(y.parent_id, r.parent_id) AS parent_id, {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')},
 {breakdown('rd', 'r.n', 'r.pos', 'r.neu', 'r.neg')}
FROM (SELECT * FROM tally WHERE platform = 'youtube') y FULL JOIN (SELECT * FROM tally WHERE platform = 'reddit') r
ON y.parent_id = r.parent_id""", "tally")
view("sides", f"SELECT *, {GAP} AS sentiment_gap FROM sides0", "sides0")
add("sentiment_gap", f"""
SELECT parent_id, sentiment_gap, CASE WHEN abs(sentiment_gap) < 0.05 THEN 'aligned' WHEN abs(sentiment_gap) < 0.20 THEN 'moderate'
 ELSE 'polarised' END AS divergence, (yt_n > 0 OR rd_n > 0) AND (yt_n < 5 OR rd_n < 5) AS low_sample, {LIST_NOTE} AS note
FROM sides""", "sides")
add("disparity_note", f"""
SELECT parent_id, {video_note('k')} AS video_note, {SUMMARY} AS summary FROM sides JOIN (
 SELECT parent_id, count(DISTINCT post_id) AS k FROM comments WHERE platform = 'reddit' GROUP BY 1) USING (parent_id)""",
    "sides", "comments")
add("thread_majority", f"""
SELECT post_id, n AS labelled, CASE WHEN n = 0 THEN 'neutral' ELSE {top_label('pos', 'neu', 'neg')} END AS thread_label
FROM (SELECT post_id, {counts('sentiment_label')} FROM comments WHERE platform = 'reddit' GROUP BY 1)""", "comments")
add("account_facet", f"""
SELECT platform, parent_id, count(*) AS total, CAST(count_if(sentiment_label = 'positive') AS BIGINT) AS positive,
 CAST(count_if(sentiment_label = 'negative') AS BIGINT) AS negative, CAST(count_if(sentiment_label = 'neutral') AS BIGINT) AS neutral,
 CAST(count_if(r <= 30) AS BIGINT) AS sampled, {ts('min(ingested_at) FILTER (r <= 30)')} AS oldest_sampled
FROM (SELECT *, row_number() OVER (PARTITION BY platform, parent_id ORDER BY ingested_at DESC, platform_id) AS r FROM comments)
GROUP BY 1, 2""", "comments")

_compare_video = f"""
SELECT coalesce(y.video_id, r.video_id) AS video_id, {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')},
 {breakdown('rd', 'r.n', 'r.pos', 'r.neu', 'r.neg')}
FROM yt_used y FULL JOIN (SELECT video_id, {counts('sentiment_label')} FROM id_hits GROUP BY 1) r ON y.video_id = r.video_id"""
# Targets whose comments are all unlabelled keep an empty side, whichever rows were added.
view("yt_used", f"SELECT v.video_id, {counts('c.sentiment_label')} FROM videos v JOIN comments c ON c.video_id = v.video_id WHERE c.platform = 'youtube' GROUP BY 1", "videos", "comments")
view("vsides0", _compare_video, "yt_used", "id_hits")
view("vsides", f"SELECT *, {GAP} AS sentiment_gap FROM vsides0", "vsides0")
add("sentiment_comparison_video", f"SELECT video_id, sentiment_gap, {SUMMARY} AS summary, {YT_RD} FROM vsides", "vsides")

add("sentiment_comparison_subreddit", f"""
, s0 AS (SELECT r.parent_id AS target, {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')}, {breakdown('rd', 'r.n', 'r.pos', 'r.neu', 'r.neg')}
 FROM (SELECT * FROM tally WHERE platform = 'reddit') r,
 (SELECT {counts('sentiment_label')} FROM comments WHERE platform = 'youtube') y),
s1 AS (SELECT *, {GAP} AS sentiment_gap FROM s0)
SELECT target, sentiment_gap, {SUMMARY} AS summary, {YT_RD} FROM s1""", "tally", "comments")

add("effective_sentiment", f"""
, yl AS (SELECT v.video_id, {counts('c.sentiment_label')} FROM videos v JOIN comments c ON c.video_id = v.video_id
 WHERE c.platform = 'youtube' AND c.sentiment_label IS NOT NULL GROUP BY 1),
rl AS (SELECT video_id, {counts('sentiment_label')} FROM links GROUP BY 1),
pr AS (SELECT v.video_id, {breakdown('yt', 'y.n', 'y.pos', 'y.neu', 'y.neg')}, {breakdown('rd', 'r.n', 'r.pos', 'r.neu', 'r.neg')}
 FROM videos v LEFT JOIN yl y USING (video_id) LEFT JOIN rl r USING (video_id)),
pick AS (SELECT p.video_id, p.yt_n > 0 OR p.rd_n > 0 AS hp, coalesce(f.yt_n > 0 OR f.rd_n > 0, false) AS hf, p AS p, f AS f
 FROM pr p LEFT JOIN vsides f USING (video_id))
SELECT video_id, CASE WHEN hp THEN 'engagement' WHEN hf THEN 'comparison' ELSE 'empty' END AS source,
 CASE WHEN hp THEN round(p.yt_positive - p.rd_positive, 3) WHEN hf THEN f.sentiment_gap ELSE 0.0 END AS sentiment_gap,
 """ + ", ".join(
    f"CASE WHEN hp THEN p.{s}_{c} WHEN hf THEN f.{s}_{c} ELSE {z} END AS {s}_{c}"
    for s in ("yt", "rd")
    for c, z in (("positive", "0.0"), ("neutral", "0.0"), ("negative", "0.0"), ("dominant_label", "'neutral'"), ("n", "0"))
) + " FROM pick", "videos", "comments", "links", "vsides")

_lex = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON)
view("lexicon", f"SELECT * FROM (VALUES {_lex}) AS t(term, valence)")
view("lex_words", """
SELECT platform_id, unnest(string_split_regex(lower(body), '[^\\p{L}\\p{N}'']+')) AS term FROM comments""", "comments")
view("lex_sums", """
SELECT platform_id, sum(coalesce(valence, 0)) AS s, sum(CASE WHEN valence > 0 THEN valence + 1 ELSE 0.0 END) AS p,
 sum(CASE WHEN valence < 0 THEN 1 - valence ELSE 0.0 END) AS g, count_if(w.term <> '' AND coalesce(valence, 0) = 0) AS u,
 count_if(w.term <> '') AS nw
FROM lex_words w LEFT JOIN lexicon USING (term) GROUP BY 1""", "lex_words", "lexicon")
view("lex", """
SELECT *, CASE WHEN compound >= 0.05 THEN positive WHEN compound <= -0.05 THEN negative ELSE neutral END AS share,
 CASE WHEN nw = 0 THEN 'neutral' WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label
FROM (SELECT platform_id, nw, round(s / sqrt(s * s + 15), 4) AS compound,
 CASE WHEN p + g + u > 0 THEN round(p / (p + g + u), 3) ELSE 0.0 END AS positive,
 CASE WHEN p + g + u > 0 THEN round(u / (p + g + u), 3) ELSE 0.0 END AS neutral,
 CASE WHEN p + g + u > 0 THEN round(g / (p + g + u), 3) ELSE 0.0 END AS negative FROM lex_sums)""", "lex_sums")
add("lexicon_score", """
SELECT platform_id, compound, positive, neutral, negative, label, CASE WHEN nw = 0 THEN 0.0 ELSE share END AS score FROM lex""", "lex")
add("lexicon_score_compound", """
SELECT platform_id, label, CASE WHEN nw = 0 THEN 0.0 ELSE abs(compound) END AS score FROM lex""", "lex")
add("label_canonical", """
SELECT doc_id, raw, CASE raw WHEN 'LABEL_0' THEN 'negative' WHEN 'label_2' THEN 'positive' WHEN 'Neg' THEN 'negative'
 WHEN 'POS' THEN 'positive' WHEN '2' THEN 'positive' WHEN '0' THEN 'negative' ELSE 'neutral' END AS label
FROM (SELECT doc_id, ['LABEL_0', 'label_2', 'Neg', 'POS', '2', '0', 'neutral', 'odd', '', NULL][(n_chars % 10) + 1] AS raw FROM documents)""")
add("time_texts", """
SELECT event_id, CASE k WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
 WHEN 2 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+02:00') WHEN 3 THEN strftime(t, '%Y%m%dT%H%M%SZ') WHEN 4 THEN strftime(t, '%Y-%m-%d')
 WHEN 5 THEN strftime(t, '%Y-%m-%dT%H:%M') WHEN 6 THEN strftime(t, '%H:%M') WHEN 7 THEN strftime(t, 'T%H:%M:%S')
 WHEN 8 THEN strftime(t, '%Y') WHEN 9 THEN strftime(t, '%Y-%m') WHEN 10 THEN strftime(t, 'on %Y-%m-%d') END AS text,
 strftime(CASE k WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t - INTERVAL 2 HOUR WHEN 3 THEN t WHEN 4 THEN date_trunc('day', t)
  WHEN 5 THEN date_trunc('minute', t) END, '%Y-%m-%d %H:%M:%S') AS parsed
FROM (SELECT event_id, date_trunc('second', ts) AS t, event_id % 12 AS k FROM events)""")
add("sentiment_macro_avg", f"""
SELECT platform, parent_id, round(p, 4) AS positive, round(u, 4) AS neutral, round(g, 4) AS negative, {top_label('p', 'u', 'g')} AS dominant_label
FROM (SELECT platform, parent_id, avg(positive) AS p, avg(neutral) AS u, avg(negative) AS g FROM lex JOIN comments USING (platform_id) GROUP BY 1, 2)""",
    "lex", "comments")
add("label_resolution", """
SELECT platform_id, coalesce(sentiment_label, label) AS label,
 CASE WHEN sentiment_label IS NOT NULL THEN 0.9::DOUBLE WHEN nw = 0 THEN 0.0 ELSE share END AS label_score,
 CASE WHEN sentiment_label IS NOT NULL THEN 'stored' ELSE 'lexicon' END AS engine
FROM comments JOIN lex USING (platform_id)""", "comments", "lex")
_SCORED = """
SELECT platform, platform_id, coalesce(sentiment_label, label) AS sentiment_label,
 CASE WHEN sentiment_label IS NOT NULL THEN 0.9::DOUBLE WHEN nw = 0 THEN 0.0 ELSE share END AS sentiment_score, true AS sentiment_processed
FROM comments JOIN lex USING (platform_id)"""
add("unprocessed_scored", _SCORED, "comments", "lex")
add("topup_labels", """
SELECT platform, post_id, CAST(s AS BIGINT) AS stored, CAST(CASE WHEN s < 5 THEN least(o, 40) ELSE 0 END AS BIGINT) AS live FROM (
 SELECT platform, post_id, count(sentiment_label) AS s, count_if(sentiment_label IS NULL AND body <> '') AS o FROM comments GROUP BY 1, 2)
WHERE s > 0 OR (post_id IS NOT NULL AND o > 0)""", "comments")

# --- keywords ---------------------------------------------------------------------------

view("trend_terms", tokens("comments", "published_at, platform_id, parent_id", "trend", where="platform = 'reddit'"), "comments")
view("topic_terms", tokens("comments", "published_at, platform_id, parent_id", "topic", where="platform = 'reddit'"), "comments")
view("context_terms", tokens("comments", "published_at, platform_id, parent_id", "context"), "comments")
view("title_terms", tokens("videos", "video_id", "topic", body="title"), "videos")


def top_terms(src: str, n: int) -> str:
    return f"""
SELECT CAST(r AS BIGINT) AS rank, term AS keyword, frequency FROM (
 SELECT term, frequency, row_number() OVER (ORDER BY frequency DESC, k) AS r FROM (
  SELECT term, count(*) AS frequency, min(row(published_at, platform_id, pos)) AS k FROM {src} GROUP BY 1)) WHERE r <= {n}"""


add("keywords_top", top_terms("trend_terms", 20), "trend_terms")
add("context_keywords", top_terms("context_terms", 8), "context_terms")
add("topics_top", """
SELECT parent_id, CAST(r AS BIGINT) AS rank, term AS keyword, frequency FROM (
 SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY frequency DESC, k) AS r FROM (
  SELECT parent_id, term, count(*) AS frequency, min(row(published_at, platform_id, pos)) AS k FROM topic_terms GROUP BY 1, 2)) WHERE r <= 8""",
    "topic_terms")
add("topic_correlation", """
, rd AS (SELECT term, row_number() OVER (ORDER BY n DESC, k) AS r FROM (
  SELECT term, count(*) AS n, min(row(platform_id, pos)) AS k FROM topic_terms GROUP BY 1) QUALIFY r <= 12),
yt AS (SELECT term, row_number() OVER (ORDER BY n DESC, k) AS r FROM (
  SELECT term, count(*) AS n, min(row(video_id, pos)) AS k FROM title_terms GROUP BY 1) QUALIFY r <= 12),
common AS (SELECT rd.term, rd.r AS k FROM rd JOIN yt USING (term)),
fallback AS (SELECT term, row_number() OVER (ORDER BY side, r) AS k FROM (
  SELECT term, 0 AS side, r FROM rd WHERE r <= 3 UNION ALL SELECT term, 1, r FROM yt WHERE r <= 3) QUALIFY k <= 4),
chosen AS (SELECT * FROM common UNION ALL SELECT * FROM fallback WHERE NOT EXISTS (SELECT 1 FROM common)),
listed AS (SELECT term, min(row(g, k)) AS o, min(g) = 0 AS is_shared FROM (
  SELECT term, 0 AS g, k FROM chosen UNION ALL SELECT term, 1, r FROM rd WHERE r <= 4 UNION ALL SELECT term, 2, r FROM yt WHERE r <= 4) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY o) AS BIGINT) AS position, term AS topic, is_shared,
 CASE WHEN term IN (SELECT term FROM yt) THEN 'High' ELSE 'Medium' END AS youtube_relevance,
 CASE WHEN term IN (SELECT term FROM rd) THEN 'High' ELSE 'Medium' END AS reddit_discussion_volume
FROM listed QUALIFY row_number() OVER (ORDER BY o) <= 8""", "topic_terms", "title_terms")

# --- engagement ---------------------------------------------------------------------------

view("indexed", """
SELECT a.platform, a.platform_id AS account_id, a.display_name, a.subscriber_count, a.updated_at, p.chars, p.n, p.likes, p.ingested_at,
 CASE WHEN a.platform = 'youtube' THEN round(least(greatest(log10(greatest(1, chars)) / 7 * (
   least(p.likes / greatest(1, chars), 1.0) * 50 + least(n * 2 / greatest(1, chars), 1.0) * 50), 0.0), 100.0), 2)
  ELSE round(least(greatest(log10(greatest(1, chars)) / 6 * CASE WHEN n > 0 THEN 50 + least(n / greatest(1, greatest(1, chars) + n), 1.0) * 50 ELSE 50 END, 0.0), 100.0), 2) END
  AS normalised_score
FROM accounts a LEFT JOIN payloads p USING (platform, platform_id)""", "accounts", "payloads")
add("engagement_comparison", "SELECT platform, account_id, display_name, normalised_score FROM indexed", "indexed")
add("engagement_index", """
SELECT video_id, round(least(greatest(log10(greatest(1, views)) / 7 * (least(likes / greatest(1, views), 1.0) * 50
 + least(comment_count / greatest(1, views), 1.0) * 50), 0.0), 100.0), 2) AS idx FROM videos""", "videos")
add("account_metrics", f"""
SELECT platform, account_id AS platform_id, display_name, subscriber_count,
 CAST(CASE WHEN platform = 'youtube' THEN chars END AS DOUBLE) AS total_views, CAST(CASE WHEN platform = 'youtube' THEN likes END AS DOUBLE) AS total_likes,
 CAST(CASE WHEN platform = 'youtube' THEN n END AS DOUBLE) AS total_videos, {ts('greatest(updated_at, ingested_at)')} AS last_ingested_at FROM indexed""", "indexed")
add("tracked_accounts", """
SELECT request, platform_id, regexp_full_match(platform_id, '[A-Za-z0-9_]{2,24}') AS is_valid,
 platform_id IN (SELECT platform_id FROM accounts WHERE platform = 'reddit') AS is_tracked FROM (
 SELECT DISTINCT '/r/' || upper(source) || CASE WHEN n_chars % 2 = 0 THEN ' ' ELSE 'x' END AS request,
  lower(source) || CASE WHEN n_chars % 2 = 0 THEN '' ELSE 'x' END AS platform_id FROM documents)""", "accounts")
add("correlation_summary", f"""
, t AS (SELECT * FROM shared ORDER BY last_ingested DESC, video_id DESC LIMIT 1),
lab AS (SELECT {breakdown('yt', "count(sentiment_label) FILTER (platform = 'youtube')", "count_if(platform = 'youtube' AND sentiment_label = 'positive')", "0", "0")},
 {breakdown('rd', "count(sentiment_label) FILTER (platform = 'reddit')", "count_if(platform = 'reddit' AND sentiment_label = 'positive')", "0", "0")} FROM comments)
SELECT (SELECT count(*) FROM indexed WHERE platform = 'youtube') AS total_tracked_youtube_channels,
 (SELECT count(*) FROM indexed WHERE platform = 'reddit') AS total_tracked_subreddits,
 (SELECT round(avg(normalised_score), 2) FROM indexed WHERE platform = 'youtube') AS avg_youtube_engagement_score,
 (SELECT round(avg(normalised_score), 2) FROM indexed WHERE platform = 'reddit') AS avg_reddit_engagement_score,
 (SELECT count(*) FROM shared) AS total_cross_platform_videos,
 (SELECT coalesce(round(avg(delay_h), 2), 0.0) FROM shared) AS avg_propagation_lag_hours,
 (SELECT {GAP} FROM lab) AS sentiment_gap,
 (SELECT video_id FROM t) AS top_shared_video_id, (SELECT title FROM t) AS top_shared_video_title,
 (SELECT shares FROM t) AS top_shared_video_reddit_shares,
 (SELECT CAST(sum(shares) AS BIGINT) FROM shared) AS total_discussions_linked""", "shared", "indexed", "comments")
view("growth", f"""
SELECT a.platform, a.platform_id, CAST(a.subscriber_count AS DOUBLE) AS subscriber_count, {PCTS},
 CAST(n AS DOUBLE) AS total_comments_analyzed,
 round(a.subscriber_count / greatest(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(a.created_at)) / 86400), 1), 6) AS growth_velocity
FROM accounts a JOIN tally t ON a.platform = t.platform AND a.platform_id = t.parent_id""", "accounts", "tally")
add("growth_velocity", "SELECT * FROM growth", "growth")
view("ratios", """
SELECT channel_id, count(*) AS n_posts, avg(views) AS mv,
 coalesce(avg(CASE WHEN views > 0 THEN likes / views END), 0.06::DOUBLE) AS lr,
 coalesce(avg(CASE WHEN views > 0 THEN comments / views END), 0.008::DOUBLE) AS cr FROM history GROUP BY 1""", "history")
add("engagement_ratios", "SELECT channel_id, n_posts, round(lr, 8) AS likes_per_view, round(cr, 8) AS comments_per_view FROM ratios", "ratios")
view("trail", """
SELECT channel_id, avg(views) AS v, avg(likes) AS l, avg(comments) AS c FROM (
 SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, post_id DESC) AS age FROM history) WHERE age <= 5 GROUP BY 1""", "history")
add("trailing_mean", "SELECT channel_id, round(v, 4) AS mean_views, round(l, 4) AS mean_likes, round(c, 4) AS mean_comments FROM trail", "trail")
add("ingest_rollup", """
, used AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id) AS r FROM videos) WHERE r <= 5),
cs AS (SELECT u.channel_id, c.like_count, row_number() OVER (PARTITION BY c.video_id ORDER BY c.like_count DESC, c.platform_id) AS r
 FROM used u JOIN comments c ON c.video_id = u.video_id WHERE c.platform = 'youtube'),
ca AS (SELECT channel_id, count(*) AS n, sum(like_count) AS s FROM cs WHERE r <= 50 GROUP BY 1)
SELECT u.channel_id, count(*) AS videos_used, CAST(sum(u.likes) AS BIGINT) AS likes, CAST(sum(u.comment_count) AS BIGINT) AS comments,
 CAST(coalesce(any_value(ca.n), 0) AS BIGINT) AS comments_sampled, CAST(coalesce(any_value(ca.s), 0) AS BIGINT) AS comment_likes_sampled
FROM used u LEFT JOIN ca USING (channel_id) GROUP BY 1""", "videos", "comments")

# --- features and forecasts -----------------------------------------------------------------

add("temporal_features", """
SELECT post_id, isodow(published_at) - 1 AS day_of_week, CAST(hour(published_at) AS BIGINT) AS hour_of_day,
 CAST(month(published_at) AS BIGINT) AS month, CAST(isodow(published_at) >= 6 AS BIGINT) AS is_weekend,
 topic_encoded, views, (1 - mood) / 2 AS sentiment_neutral FROM history""", "history")


def lag(c: str, k: int, name: str | None = None) -> str:
    w = "PARTITION BY channel_id ORDER BY published_at, post_id"
    return (f"coalesce(lag({c}, {k}) OVER ({w}), CASE WHEN n <= 5 AND n > {k} THEN first({c}) OVER ({w}) ELSE 0.0 END) "
            f"AS {name or f'{c}_lag{k}'}")


_frames = ", ".join(
    f"round(avg({c}) OVER w{w}, 3) AS {c}_roll{w}_mean, round(coalesce(stddev_samp({c}) OVER w{w}, 0.0), 3) AS {c}_roll{w}_std"
    for c in ("views", "shares") for w in (3, 5)
)
add("feature_matrix", f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at, post_id) AS position,
  count(*) OVER (PARTITION BY channel_id) AS n FROM history),
g AS (SELECT *, {lag('views', 1)}, {lag('views', 5)}, {lag('likes', 2)}, {lag('comments', 3)}, {lag('shares', 4)},
  {lag('mood', 1, 'mlag')} FROM f)
SELECT channel_id, post_id, position, views, views_lag1, views_lag5, likes_lag2, comments_lag3, shares_lag4,
 round(mlag, 3) AS sentiment_positive_lag1, {_frames}
FROM g WHERE n <= 5 OR position > 5
WINDOW w3 AS (PARTITION BY channel_id ORDER BY position ROWS 2 PRECEDING), w5 AS (PARTITION BY channel_id ORDER BY position ROWS 4 PRECEDING)""",
    "history")

_prior_rows = ", ".join(
    "(" + ", ".join(f"'{q(x)}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row)
    + f", {len(V.CATEGORY_KEYWORDS.get(row[0], []))}::BIGINT)" for row in V.CATEGORY_PRIORS
)
view("priors", f"""
SELECT * FROM (VALUES {_prior_rows}) AS t(category, display_name, base_views, views_std, lpv, cpv, spv, growth, pos, neu, neg, weekend, weekday, n_keywords)""")
_alias_rows = ", ".join(f"('{a}', '{c}')" for a, c in [*V.CATEGORY_ALIASES.items(), *[(r[0], r[0]) for r in V.CATEGORY_PRIORS]])
view("canon", f"SELECT * FROM (VALUES {_alias_rows}) AS t(alias, canonical)")
view("chans", """
SELECT c_custkey AS channel_id, CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey < 5 THEN 'technology' END AS explicit_category,
 CASE WHEN c_mktsegment = 'FURNITURE' AND c_nationkey < 9 THEN 'vlog' WHEN c_mktsegment = 'BUILDING' THEN 'diy' END AS category,
 c_name || CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' learn how to cook' ELSE '' END AS words FROM customer""")


def hits(cat: str, text: str) -> str:
    pat = "|".join(V.CATEGORY_KEYWORDS[cat])
    return f"len(regexp_extract_all(lower({text}), '\\b(?:{pat})\\b'))"


_cats = [r[0] for r in V.CATEGORY_PRIORS if r[0] in V.CATEGORY_KEYWORDS]
view("first_posts", """
SELECT h.*, k.canonical FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at, post_id) AS r FROM history) h
LEFT JOIN canon k ON k.alias = lower(h.category) WHERE r <= 10""", "history", "canon")
view("cats", f"""
SELECT channel_id, coalesce(e.canonical, m.canonical, fp, CASE
 {" ".join(f"WHEN greatest({', '.join('s_' + x for x in _cats)}) > 0 AND s_{c} = greatest({', '.join('s_' + x for x in _cats)}) THEN '{c}'" for c in _cats)} END, 'general') AS category
FROM (SELECT c.*, p.fp, {", ".join(f"{hits(c, 'c.words')} + coalesce(p.h_{c}, 0) AS s_{c}" for c in _cats)} FROM chans c LEFT JOIN (
  SELECT channel_id, arg_min(canonical, r) FILTER (canonical IS NOT NULL) AS fp, {", ".join(f"sum({hits(c, 'title')}) AS h_{c}" for c in _cats)}
  FROM first_posts GROUP BY 1) p USING (channel_id)) x
LEFT JOIN canon e ON e.alias = x.explicit_category LEFT JOIN canon m ON m.alias = x.category""", "chans", "first_posts", "canon")
add("category_detect", "SELECT channel_id, category FROM cats", "cats")


view("chans2", """
SELECT c_custkey AS channel_id, CASE WHEN c_custkey % 6 = 1 THEN 'esports' WHEN c_custkey % 6 < 3 THEN 'film' END AS name,
 concat_ws(' ', CASE WHEN c_custkey % 5 = 1 THEN 'xbox' END, CASE WHEN c_custkey % 5 = 0 THEN 'Album artist' END) AS words FROM customer""")
view("posts2", """
SELECT h.channel_id, r, words, k.canonical FROM (
 SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY published_at, post_id) AS r,
  CASE WHEN post_id % 9 = 0 THEN 'unlisted' WHEN post_id % 18 = 9 THEN 'music' WHEN post_id % 31 = 0 THEN 'coding' END AS name,
  CASE post_id % 4 WHEN 0 THEN 'software tutorial' WHEN 1 THEN 'Breaking world news' WHEN 2 THEN 'a song, an Album' ELSE '' END AS words
 FROM history) h LEFT JOIN canon k ON k.alias = h.name WHERE r <= 10""", "history", "canon")
view("cats2", f"""
SELECT channel_id, coalesce(m.canonical, fp, CASE
 {" ".join(f"WHEN greatest({', '.join('s_' + x for x in _cats)}) > 0 AND s_{c} = greatest({', '.join('s_' + x for x in _cats)}) THEN '{c}'" for c in _cats)} END, 'general') AS category
FROM (SELECT c.*, p.fp, {", ".join(f"{hits(c, 'c.words')} + coalesce(p.h_{c}, 0) AS s_{c}" for c in _cats)} FROM chans2 c LEFT JOIN (
  SELECT channel_id, arg_min(canonical, r) FILTER (canonical IS NOT NULL) AS fp, {", ".join(f"sum({hits(c, 'words')}) AS h_{c}" for c in _cats)}
  FROM posts2 GROUP BY 1) p USING (channel_id)) x LEFT JOIN canon m ON m.alias = x.name""", "chans2", "posts2", "canon")
add("category_evidence", "SELECT channel_id, category FROM cats2", "cats2")


def cat_forecast(src: str, base: str, lr: str, cr: str) -> str:
    v = f"{base} * pow(1 + growth, step)"
    rel = "least(0.35::DOUBLE, greatest(0.15::DOUBLE, views_std / base_views))"
    return f"""
SELECT channel_id, category, CAST(step AS BIGINT) AS step, round({v}, 1) AS predicted_views, round({v} * {lr}, 1) AS predicted_likes,
 round({v} * {cr}, 1) AS predicted_comments, round({v} * (1 - {rel}), 1) AS ci_low, round({v} * (1 + {rel}), 1) AS ci_high
FROM {src} JOIN priors USING (category), range(1, 6) AS s(step)"""


add("category_forecast", cat_forecast("cats", "base_views", "lpv", "cpv"), "cats", "priors")
add("benchmark_lookup", """
SELECT name, channels, category, display_name, base_views, weekend AS weekend_multiplier, pos AS prior_positive, n_keywords FROM (
 SELECT name, count(*) AS channels, coalesce(any_value(canonical), 'general') AS category FROM (
  SELECT coalesce(explicit_category, category, 'none') AS name FROM chans) LEFT JOIN canon ON alias = name GROUP BY 1) JOIN priors USING (category)""",
    "chans", "canon", "priors")
add("warmup", f"""
SELECT channel_id, 'warmup-' || k AS post_id, {ts("anchor - to_days(CAST(k * 3 AS INTEGER))")} AS published_at, category,
 round(v, 1) AS views, round(v * lpv, 1) AS likes, round(v * cpv, 1) AS comments, round(v * spv, 1) AS shares, 0.0 AS saves
FROM (SELECT *, greatest(1.0, CASE WHEN mv > 0 THEN mv ELSE base_views END / pow(1 + growth, k)) AS v FROM (
 SELECT channel_id, count(*) AS n, min(published_at) AS anchor, avg(views) AS mv FROM history GROUP BY 1)
 JOIN cats USING (channel_id) JOIN priors USING (category), range(1, 7) AS s(k) WHERE n < 6 AND k <= 6 - n)""", "history", "cats", "priors")
view("baseline", """
SELECT channel_id, CAST(step AS BIGINT) AS step, round(greatest(0.0, v * (1 + step * 0.01::DOUBLE)), 1) AS predicted_views,
 round(greatest(0.0, l * (1 + step * 0.01::DOUBLE)), 1) AS predicted_likes, round(greatest(0.0, c * (1 + step * 0.01::DOUBLE)), 1) AS predicted_comments,
 round(v * (1 + step * 0.01::DOUBLE) * 0.8::DOUBLE, 1) AS ci_low, round(v * (1 + step * 0.01::DOUBLE) * 1.2::DOUBLE, 1) AS ci_high
FROM trail, range(1, 6) AS s(step)""", "trail")
add("baseline_forecast", "SELECT * FROM baseline", "baseline")
view("scaled", "SELECT channel_id, category, coalesce(n_posts, 0) AS n_posts, mv, lr, cr FROM cats LEFT JOIN ratios USING (channel_id)", "cats", "ratios")
view("scaled_prior", cat_forecast(
    "scaled", "CASE WHEN mv > 0 THEN mv ELSE base_views END", "CASE WHEN lr <> 0 THEN lr ELSE lpv END",
    "CASE WHEN cr <> 0 THEN cr ELSE cpv END"), "scaled", "priors")
_vals = ("predicted_views", "predicted_likes", "predicted_comments", "ci_low", "ci_high")
add("blended_forecast", f"""
SELECT p.channel_id, p.step, s.n_posts, p.category, {", ".join(
    f"CASE WHEN n_posts = 0 THEN p.{c} WHEN n_posts < 6 THEN round(w * b.{c} + (1 - w) * p.{c}, 1) ELSE b.{c} END AS {c}" for c in _vals)},
 CASE WHEN n_posts = 0 THEN 'category_benchmark' WHEN n_posts < 6 THEN 'transfer_learning' ELSE 'baseline_moving_avg' END AS engine,
 CASE WHEN n_posts = 0 THEN 1.0 WHEN n_posts < 6 THEN round(1 - w, 2) ELSE 0.0 END AS prior_weight
FROM (SELECT *, least(1.0, n_posts / 5.0) AS w FROM scaled) s JOIN scaled_prior p USING (channel_id)
LEFT JOIN baseline b ON b.channel_id = p.channel_id AND b.step = p.step""", "scaled", "scaled_prior", "baseline")

# --- ranking and sets -------------------------------------------------------------------------

view("newest", """
SELECT *, row_number() OVER (PARTITION BY platform, parent_id ORDER BY ingested_at DESC, platform_id) AS r FROM comments""", "comments")
add("page_comments", "SELECT platform, parent_id, platform_id, r AS rank FROM newest WHERE r BETWEEN 6 AND 10", "newest")
add("page_by_label", f"""
SELECT platform_id, sentiment_label, {ts('ingested_at')} AS ingested_at FROM (
 SELECT *, row_number() OVER (ORDER BY c.ingested_at DESC, platform_id) AS r FROM comments c
 WHERE platform = 'youtube' AND parent_id = 'src0' AND sentiment_label = 'positive') c WHERE r BETWEEN 6 AND 10""", "comments")
add("page_by_cursor", f"""
SELECT platform_id, {ts('ingested_at')} AS ingested_at FROM (
 SELECT *, row_number() OVER (ORDER BY c.ingested_at DESC, platform_id) AS r FROM comments c
 WHERE platform = 'reddit' AND parent_id = 'src1') c WHERE r BETWEEN 9 AND 12""", "comments")
add("payload_scan", "SELECT video_id AS platform_id, title, views FROM videos WHERE video_id IN (SELECT video_id FROM links)", "videos", "links")
add("newest_payloads", f"""
SELECT video_id AS platform_id, {ts('published_at')} AS ingested_at FROM videos ORDER BY videos.published_at DESC, video_id LIMIT 40""", "videos")
add("snapshot_replace", """
SELECT video_id AS platform_id, title || CASE WHEN likes % 200 = 0 THEN ' v2' ELSE '' END AS title, views,
 CASE WHEN likes % 200 <> 0 THEN likes::DOUBLE END AS likes,
 strftime(published_at + CASE WHEN likes % 200 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END, '%Y-%m-%d %H:%M:%S') AS ingested_at
FROM videos""", "videos")
add("latest_n", f"SELECT platform, parent_id, platform_id, {ts('ingested_at')} AS ingested_at, r AS rank FROM newest WHERE r <= 3", "newest")
add("top_videos", "SELECT video_id, title, views FROM videos WHERE contains(lower(title), 'ring') ORDER BY views DESC, video_id LIMIT 25", "videos")
add("table_sorts", """
SELECT video_id, views AS youtube_views, likes AS total_reddit_shares FROM videos
WHERE contains(lower(title), 'small') OR contains(lower(channel_title), 'small') ORDER BY views DESC, video_id""", "videos")
add("active_first", """
SELECT platform_id, display_name FROM accounts WHERE platform = 'youtube'
ORDER BY CASE WHEN platform_id = 'src7' OR contains(lower(display_name), 'src7') THEN 0 ELSE 1 END, display_name, platform_id LIMIT 6""", "accounts")
add("recently_tracked", """
, s AS (SELECT video_id, video_no FROM videos ORDER BY views DESC, video_id LIMIT 3)
SELECT video_id, CAST(src AS BIGINT) AS source FROM (SELECT video_id, video_no, 0 AS src FROM s
 UNION ALL SELECT video_id, video_no, 1 FROM videos WHERE video_id NOT IN (SELECT video_id FROM s)) ORDER BY src, video_no, video_id LIMIT 5""", "videos")
add("dedupe_union", """
SELECT platform_id, score, CASE WHEN sentiment_label IS NOT NULL THEN author ELSE 'fresh' END AS author,
 CAST(CASE WHEN sentiment_label IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS source_rank
FROM comments WHERE platform = 'reddit'""", "comments")
add("candidate_ids", f"""
SELECT video_id FROM videos UNION SELECT unnest(regexp_extract_all(body, '{URL_RE}', 1)) FROM comments""", "videos", "comments")

# --- upserts -----------------------------------------------------------------------------------

add("upsert_last_wins", f"""
SELECT platform, platform_id, CASE WHEN platform = 'youtube' THEN upper(author) ELSE author END AS author,
 CAST(CASE WHEN platform = 'youtube' THEN like_count + 1000 ELSE like_count END AS DOUBLE) AS like_count, CAST(score AS DOUBLE) AS score, sentiment_label,
 {ts("CASE WHEN platform = 'youtube' THEN ingested_at + INTERVAL 1 DAY ELSE ingested_at END")} AS ingested_at FROM comments""", "comments")
add("insert_only", "SELECT platform, platform_id, author FROM comments WHERE author = '[deleted]'", "comments")
add("account_upsert", f"""
, f AS (SELECT platform, platform_id || CASE WHEN subscriber_count % 2 = 0 THEN '' ELSE 'new' END AS platform_id,
 'Fresh ' || display_name AS display_name, subscriber_count + 5 AS subscriber_count FROM accounts)
SELECT coalesce(a.platform, f.platform) AS platform, coalesce(a.platform_id, f.platform_id) AS platform_id,
 coalesce(a.platform || ':' || a.platform_id, 'fresh-id') AS id, coalesce(f.display_name, a.display_name) AS display_name,
 coalesce(f.subscriber_count, a.subscriber_count) AS subscriber_count,
 {ts(f"coalesce(a.created_at, TIMESTAMP '{AS_OF}')")} AS created_at,
 {ts(f"CASE WHEN f.platform IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE a.updated_at END")} AS updated_at
FROM accounts a FULL JOIN f ON a.platform = f.platform AND a.platform_id = f.platform_id""", "accounts")
add("metadata_merge", f"""
SELECT platform, parent_id AS platform_id, 'import' AS origin, {PCTS}, n AS total_comments_analyzed,
 'lexicon' AS model, '2030-01-01T00:00:00Z' AS analyzed_at, '2030-01-01 00:00:00' AS updated_at FROM tally""", "tally")

# --- payloads -----------------------------------------------------------------------------------

add("normalise_video_json", f"""
SELECT 'v' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS video_id, p_name AS title, p_brand AS channel_title,
 CASE WHEN p_size % 3 = 0 THEN 'h/' || p_type ELSE 'd/' || p_type END AS thumbnail_url, '2024-05-10 12:00:00' AS published_at,
 CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '|') ELSE '' END AS tags,
 CAST(floor(p_retailprice * 1000) AS BIGINT) AS views, CAST(CASE WHEN p_size % 5 <> 0 THEN p_size * 100 ELSE 0 END AS BIGINT) AS likes,
 0::BIGINT AS comment_count FROM part WHERE p_size % 10 <> 7""")
add("quarantine", """
SELECT p_partkey, substr('{"items":[{"id":"v' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '","snippet":{"title":"' || p_name, 1, 40) AS json
FROM part WHERE p_size % 10 = 7""")
def landed(shape: str, table: str, key: str, where: str = "true", rows: str = "true") -> str:
    return f"""SELECT '{shape}' AS shape, CAST(count_if({key} % 10 <> 7) AS BIGINT) AS good, CAST(count_if({key} % 10 = 7) AS BIGINT) AS bad,
 CAST(count_if({key} % 10 <> 7 AND {rows}) AS BIGINT) AS rows, CAST(count_if({key} % 10 = 7) AS BIGINT) AS kept_bad,
 CAST(sum({key}) FILTER ({key} % 10 = 7) AS BIGINT) AS bad_keys FROM {table} WHERE {where}"""


add("payload_errors", " UNION ALL ".join([
    landed("videos", "part", "p_partkey", "p_size % 10 <> 7"), landed("channels", "customer", "c_custkey"),
    landed("video_listing", "part", "p_partkey"),
    landed("comment_threads", "pages", "page_id", rows=f"page_id % 9 <> 0 AND length({strip('url')}) > 5"),
    landed("submissions", "pages", "page_id"),
    landed("reddit_comments", "documents", "doc_id", rows="doc_id % 8 > 1 AND text NOT IN ('', '[deleted]', '[removed]')"),
]))
add("normalise_comment_json", f"""
SELECT 'k' || page_id AS comment_id, 'vid' AS video_id, 'someone' AS author, {strip('url')} AS body, page_id AS like_count,
 '2024-01-02 03:04:05' AS published_at FROM pages WHERE page_id % 9 <> 0 AND length({strip('url')}) > 5""")
add("normalise_submission_json", f"""
SELECT 'p' || page_id AS post_id, 'https://reddit.com/r/x/' || page_id AS permalink, '[deleted]' AS author, 'SubX' AS subreddit,
 page_id * 3 AS score, 0::BIGINT AS num_comments, {ts('make_timestamp((1704067200 + page_id * 3600) * 1000000)')} AS created_at,
 CASE WHEN page_id % 2 = 1 THEN 't.jpg' END AS thumbnail_url, length(html) AS body_chars FROM pages""")
add("normalise_reddit_comment_json", f"""
SELECT 'reddit' AS platform, 'c' || doc_id AS platform_id, lower(source) AS parent_id, 'p1' AS post_id, n_chars AS score,
 {ts('make_timestamp((1704067200 + doc_id * 3600) * 1000000)')} AS published_at, sha256(text) AS body_sha
FROM documents WHERE doc_id % 8 > 1 AND text NOT IN ('', '[deleted]', '[removed]')""")

add("normalise_channel_json", """
SELECT 'UC' || c_custkey AS channel_id, c_name AS display_name, '' AS description,
 CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END AS BIGINT) AS subscriber_count, 0::BIGINT AS views FROM customer""")
add("normalise_listing_json", """
SELECT p_partkey, 'v' || p_partkey AS video_id, p_name AS title, '2026-01-01 00:00:00' AS published_at, p_brand AS next_page_token,
 CAST(p_size AS BIGINT) AS total_results FROM part""")
add("account_list", f"SELECT platform_id, display_name, {ts('updated_at')} AS updated_at FROM accounts WHERE platform = 'reddit'", "accounts")
add("video_facts", f"""
SELECT video_id, CASE WHEN likes > 1000 THEN 'S ' || title ELSE title END AS title, CASE WHEN likes > 2000 THEN views + 1 ELSE views END AS views,
 CASE WHEN likes > 3000 THEN likes + 1 ELSE likes END AS likes, comment_count, {ts('published_at')} AS published_at FROM videos""", "videos")

# --- text and ids ---------------------------------------------------------------------------------

view("names", """
SELECT doc_id, lower(source) || CASE WHEN n_chars % 2 = 0 THEN 'x' ELSE '' END AS name FROM documents""")
add("clean_subreddit", "SELECT doc_id, name, regexp_full_match(name, '[A-Za-z0-9_]{2,24}') AS is_valid FROM names", "names")
add("validate_ids", """
SELECT doc_id, n_chars % 4 = 2 AS is_channel,
 CASE WHEN length(regexp_replace(substr(md5(text), 1, 8) || ', ' || substr(source, 1, 3) || '!', '[^A-Za-z0-9_\\-]', '', 'g')) = 11
  THEN substr(md5(text), 1, 8) || substr(source, 1, 3) END AS raw_id, length(text) BETWEEN 3 AND 1000 AS is_question FROM documents""")
add("url_clean", f"""
SELECT platform_id, sha256(t) AS clean_sha, length(t) AS n, array_to_string({ordered_distinct('ids')}, '|') AS ids, substr(t, 1, 20) AS head FROM url_free""",
    "url_free")
add("number_format", f"""
SELECT o_orderkey, {human("CASE WHEN o_orderkey % 50 <> 0 THEN floor(o_totalprice * pow(10.0, o_orderkey % 6)) END")} AS shown FROM orders""")
add("comment_quality", f"""
SELECT platform_id, 'https://reddit.com' || permalink AS link, {WORTHY} AS worthy,
 regexp_matches(p.subreddit, '{V.SPAM_SUBREDDIT_RE}') AS spam, regexp_matches(p.url, '{V.IMAGE_HOST_RE}') AS image
FROM (SELECT * FROM comments WHERE platform = 'reddit') c LEFT JOIN (SELECT post_id, subreddit, url FROM posts) p USING (post_id)""", "comments", "posts")

# --- context -----------------------------------------------------------------------------------------

add("conv_window", """
SELECT conv_id, turn, role, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
add("answer_budget", """
SELECT conv_id, turn, CAST(CASE WHEN n <= 10 THEN 400 WHEN n <= 25 THEN 700 ELSE 1200 END AS BIGINT) AS budget FROM (
 SELECT *, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS n FROM conversations)""")

view("sheet_words0", tokens("newest", "platform, parent_id, r", "context", where="r <= CASE WHEN platform = 'youtube' THEN 30 ELSE 40 END"), "newest")
view("sheet_words", """
SELECT platform, parent_id, string_agg(term, ', ' ORDER BY k) AS words FROM (
 SELECT *, row_number() OVER (PARTITION BY platform, parent_id ORDER BY n DESC, f) AS k FROM (
  SELECT platform, parent_id, term, count(*) AS n, min(row(r, pos)) AS f FROM sheet_words0 GROUP BY 1, 2, 3))
WHERE k <= CASE WHEN platform = 'youtube' THEN 5 ELSE 8 END GROUP BY 1, 2""", "sheet_words0")
view("sheets", f"""
SELECT a.platform, a.account_id AS platform_id, a.display_name, concat_ws(chr(10),
 CASE WHEN a.platform = 'youtube' THEN concat_ws(chr(10), '  Channel: ' || a.display_name || ' (ID: ' || a.account_id || ')',
  '    Subscribers: ' || {human('a.subscriber_count')}, '    Total Views: ' || {human('a.chars')}, '    Total Likes: ' || {human('a.likes')},
  '    Total Videos: ' || {human('a.n')}, '    Tracked Comments: ' || {human('t.total')})
 ELSE concat_ws(chr(10), '  r/' || a.display_name || ' (internal ID: ' || a.account_id || ')', '    Members: ' || {human('a.chars')},
  '    Tracked Comments in DB: ' || {human('t.total')}) END,
 CASE WHEN t.n > 0 THEN '    Sentiment (' || t.n || ' analyzed): ✅ ' || t.pos || ' positive | ⚪ ' || t.neu || ' neutral | ❌ ' || t.neg || ' negative'
   || chr(10) || '    Dominant Sentiment: ' || {top_label('t.pos', 't.neu', 't.neg')}
  ELSE '    Sentiment: ' || t.total || ' comments tracked (classification queued)' END,
 CASE WHEN a.platform = 'youtube' THEN '    Top Keywords in Comments: ' ELSE '    Top Trending Keywords: ' END || w.words) AS sheet
FROM indexed a JOIN (SELECT platform, parent_id, count(*) AS total, {counts('sentiment_label')} FROM comments GROUP BY 1, 2) t
 ON a.platform = t.platform AND a.account_id = t.parent_id
LEFT JOIN sheet_words w ON a.platform = w.platform AND a.account_id = w.parent_id""", "indexed", "comments", "sheet_words")
add("fact_sheet", "SELECT platform, platform_id, sheet FROM sheets", "sheets")
add("platform_sheet", """
SELECT platform, CASE WHEN platform = 'youtube' THEN 'TRACKED YOUTUBE CHANNELS' ELSE 'TRACKED SUBREDDITS' END || ' (' || any_value(n) || ' total):'
 || chr(10) || '  [User is currently viewing: ' || CASE WHEN platform = 'youtube' THEN '' ELSE 'r/' END || 'src7]' || chr(10)
 || string_agg(sheet, chr(10) ORDER BY k) AS sheet
FROM (SELECT *, count(*) OVER (PARTITION BY platform) AS n, row_number() OVER (PARTITION BY platform
 ORDER BY CASE WHEN platform_id = 'src7' OR contains(lower(display_name), 'src7') THEN 0 ELSE 1 END, display_name, platform_id) AS k FROM sheets)
WHERE k <= 6 GROUP BY platform""", "sheets")
add("shared_video_sheet", f"""
SELECT r AS position, video_id, concat_ws(chr(10),
 '  • Video: "' || coalesce(title, video_id) || '" (ID: ' || video_id || ')',
 '    Reddit Discussions: ' || shares || ' shares/threads, ' || shares || ' comments, ' || coalesce(votes, 0) || ' upvotes',
 '    Propagation Speed: ' || {speed('delay_h', 'first_at', 'Recent Community Discovery')},
 '    YouTube Sentiment: ' || yt_dominant_label, '    Reddit Sentiment: ' || rd_dominant_label,
 '    Discussion Topics: ' || array_to_string(list_slice({TOPICS}, 1, 5), ', ')) AS lines
FROM (SELECT *, row_number() OVER (ORDER BY last_ingested DESC, video_id) AS r FROM shared) LEFT JOIN video_topics USING (video_id) WHERE r <= 6""",
    "shared", "video_topics")

# --- streams: the batch equivalent ----------------------------------------------------------------------

view("fill_comments", "SELECT *, coalesce(post_id, 'p' || (CAST(substr(platform_id, 2) AS BIGINT) // 4)) AS target FROM comments", "comments")
view("fill_offered", f"""
SELECT *, row_number() OVER (PARTITION BY target, number ORDER BY o.ingested_at DESC, platform_id) AS r FROM (
 SELECT *, CASE platform WHEN 'reddit' THEN 1 ELSE 2 END AS number FROM fill_comments
 WHERE (platform = 'youtube' OR sentiment_label IS NULL) AND {strip('body')} <> '') o
QUALIFY r <= number""", "fill_comments")
view("fill_stored", "SELECT target, sentiment_label AS label FROM fill_comments WHERE platform = 'reddit' AND sentiment_label IS NOT NULL", "fill_comments")
view("fill_counts", """
SELECT target, sum(n0) AS n0, sum(n1) AS n1 FROM (
 SELECT target, 1 AS n0, 0 AS n1 FROM fill_stored
 UNION ALL SELECT target, 0, CAST(number = 1 AS INT) FROM fill_offered) GROUP BY 1""", "fill_stored", "fill_offered")
view("fill_used", """
SELECT target, label, 0 AS number FROM fill_stored
UNION ALL SELECT target, lex.label, number FROM fill_offered JOIN fill_counts USING (target) JOIN lex USING (platform_id)
WHERE CASE number WHEN 1 THEN n0 < 2 ELSE n0 + CASE WHEN n0 < 2 THEN n1 ELSE 0 END < 3 END""", "fill_stored", "fill_offered", "fill_counts", "lex")
add("filled_breakdowns", f"""
SELECT target, stored, unlabelled, live, {breakdown('b', 'n', 'pos', 'neu', 'neg')} FROM (
 SELECT target, CAST(count_if(number = 0) AS BIGINT) AS stored, CAST(count_if(number = 1) AS BIGINT) AS unlabelled,
  CAST(count_if(number = 2) AS BIGINT) AS live, count(*) AS n, count_if(label = 'positive') AS pos,
  count_if(label = 'neutral') AS neu, count_if(label = 'negative') AS neg FROM fill_used GROUP BY 1)""", "fill_used")
add("stream_ingest", f"""
SELECT platform, platform_id, label AS sentiment_label, CASE WHEN nw = 0 THEN 0.0 ELSE share END AS sentiment_score, true AS sentiment_processed,
 {ts('newest')} AS ingested_at, 1::BIGINT AS times_scored
FROM (SELECT *, ingested_at + CASE WHEN (epoch(published_at)::BIGINT // 3600) % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS newest
 FROM comments) JOIN lex USING (platform_id)""", "comments", "lex")
add("stored_merge", f"""
SELECT bucket, count(*) AS rows, CAST(sum(like_count + CASE WHEN fresh THEN 1000 ELSE 0 END) AS BIGINT) AS likes,
 max({ts("ingested_at + CASE WHEN fresh THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END")}) AS newest,
 CAST(count_if(fresh OR author = upper(author)) AS BIGINT) AS upper_authors, bool_or(fresh) AS rewritten
FROM (SELECT *, bucket % 3 = 0 AND platform = 'youtube' AS fresh FROM (
 SELECT *, ('0x' || substr(md5(platform || chr(31) || platform_id), 1, 7))::BIGINT % 16 AS bucket FROM comments)) GROUP BY 1""", "comments")
add("stream_distribution", """
SELECT platform, parent_id, CAST(count_if(n_chars % 3 < 2) AS BIGINT) AS n, CAST(count_if(n_chars % 3 = 0) AS BIGINT) AS pos,
 CAST(count_if(n_chars % 3 = 1) AS BIGINT) AS neu, 0::BIGINT AS neg FROM comments GROUP BY 1, 2""", "comments")
add("stream_first_share", f"""
SELECT video_id, shares, {ts('first_at')} AS first_shared_at, delay_h AS propagation_delay_hours,
 {speed('delay_h', 'first_at', 'Recent Community Discovery')} AS propagation_speed FROM shared""", "shared")



def half_even(sql: str) -> str:
    """Spell ``round(x, n)`` as half-to-even on the scaled value, the rule of the Spark side."""
    out, at = "", 0
    while (start := re.search(r"(?<![a-z_])round\(", sql[at:])) is not None:
        open_ = at + start.end()
        depth, comma, i = 1, 0, open_
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        inner, scale = half_even(sql[open_:comma]), 10 ** int(sql[comma + 1 : i - 1])
        out += sql[at : at + start.start()] + f"(CAST(({inner}) * {scale}::DOUBLE AS BIGINT) / {scale}::DOUBLE)"
        at = i
    return out + sql[at:]


# A statement that begins with "," continues the list of views.
SQL = {k: half_even(v.replace(")\n\n, ", "),\n", 1)) for k, v in SQL.items()}
