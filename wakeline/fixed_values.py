"""Fixed values the results depend on.

Everything in this module is data, not logic: word lists, patterns, thresholds and
prior tables that have to equal the published behaviour for results to agree.
"""

# --- fixed values: patterns -------------------------------------------------
# (?d) limits "." to stop at \n only.
VIDEO_URL_PATTERN = (
    r"(?:https?://)?(?:www\.|m\.)?(?:youtu\.be/|youtube\.com/"
    r"(?:watch\?.*?v=|embed/|v/|shorts/))([A-Za-z0-9_\-]{11})"
)
VIDEO_URL_RE = "(?d)" + VIDEO_URL_PATTERN
CHANNEL_ID_RE = r"^UC[a-zA-Z0-9_-]{22}$"
SUBREDDIT_NAME_RE = r"^[A-Za-z0-9_]{2,24}$"
SPAM_SUBREDDIT_RE = r"(?i)(autonewspaper|bot|moderator|spam|promos|autotldr)"
IMAGE_HOST_RE = r"(i\.redd\.it|i\.imgur\.com|preview\.redd\.it)"
CREATOR_SUFFIX_RE = (
    r"(?iU)\b(official|channel|tv|hd|yt|hindi|english|media|network|productions|studio|studios)\b"
)
BRACKET_PHRASE_RE = r"[\*\"\[\(]([^\*\"\[\]\(\)]{2,40})[\*\"\]\)]"
BRACKETED_RE = r"[\(\[\*].*?[\)\]\*]"
SEGMENT_SPLIT_RE = r"\s*[|–—:]\s*|\s+-\s+"

# Every character that counts as white space when text is split into words.
WS = (
    r" \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = (
    " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"

# --- fixed values: limits and thresholds ------------------------------------
DESCRIPTION_MAX_CHARS = 300
MIN_SEMANTIC_CHARS = 15
SEMANTIC_THRESHOLD = 0.55
EMBEDDING_SIZE = 384
TIER_GATE_POSTS = 10
PUBLISH_GRACE_DAYS = 3
LAG_STEPS = 5
ROLLING_WINDOWS = (3, 5)

# --- fixed values: sentiment labels -----------------------------------------
LABEL_ALIASES = {
    "label_0": "negative", "label_1": "neutral", "label_2": "positive",
    "negative": "negative", "neutral": "neutral", "positive": "positive",
    "neg": "negative", "neu": "neutral", "pos": "positive",
    "0": "negative", "1": "neutral", "2": "positive",
}

# --- fixed values: stop lists -----------------------------------------------
TREND_STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between
both but by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from
further had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his
how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor
not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should
shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd
they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were
weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you
you'd you'll you're you've your yours yourself yourselves
just like will also get one even really much many know think people would could make made good well http https
com www watch youtube reddit comments
""".split()

CONTEXT_STOP_WORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will
would could should may might shall can not no nor so yet both either neither one two three i me my we our you
your he she it its they them their this that these those what which who whom how when where why than then also
just more very much many some any all each about after before between into through during again further once
""".split()

TOPIC_STOP_WORDS = CONTEXT_STOP_WORDS + """
http https www ftp youtube watch reddit youtu imgur twitter facebook amp utm ref source medium campaign com net
org video comments
""".split()

TITLE_STOP_WORDS = """
how much you really need the are for and this that with from what your video about why can will just
best top new get has its our their all was were she they watch youtube reddit but out than then think
thought know see look make made now here there who whom which when where some any like good bad well
say says said tell tells told
""".split()

GENERIC_SEGMENTS = [
    "official", "music", "video", "audio", "lyrics", "ft", "feat",
    "full", "hd", "full hd", "4k", "new", "latest", "vlog", "shorts",
    "official video", "official music video", "official audio", "lyric video",
    "official teaser trailer", "official trailer", "teaser trailer", "trailer",
]

CREATOR_ALIASES = {
    "marques brownlee": ["mkbhd"],
    "mkbhd": ["marques brownlee"],
    "mrwhosetheboss": ["arun", "arun maini"],
    "arun maini": ["mrwhosetheboss"],
    "linus tech tips": ["ltt", "linus sebastian"],
    "ltt": ["linus tech tips"],
    "technical guruji": ["gaurav chaudhary"],
    "tech burner": ["shlok srivastava"],
}

# --- fixed values: category priors ------------------------------------------
# name, display name, base views, views std, likes/view, comments/view, shares/view, growth per post,
# positive, neutral, negative, weekend, weekday
CATEGORY_PRIORS = [
    ("gaming", "Gaming & Esports", 8500.0, 3200.0, 0.075, 0.012, 0.005, 0.025, 0.62, 0.26, 0.12, 1.20, 0.92),
    ("tech", "Technology & Software", 6200.0, 2100.0, 0.055, 0.009, 0.008, 0.020, 0.68, 0.24, 0.08, 0.88, 1.05),
    ("entertainment", "Entertainment & Pop Culture", 14000.0, 5500.0, 0.085, 0.015, 0.012, 0.030, 0.58, 0.28, 0.14, 1.15, 0.95),
    ("education", "Education & Science", 4800.0, 1600.0, 0.065, 0.007, 0.010, 0.015, 0.75, 0.20, 0.05, 0.90, 1.04),
    ("news", "News & Politics", 9500.0, 4000.0, 0.040, 0.025, 0.015, 0.018, 0.42, 0.33, 0.25, 0.85, 1.06),
    ("music", "Music & Audio", 18000.0, 7000.0, 0.090, 0.014, 0.015, 0.035, 0.72, 0.22, 0.06, 1.12, 0.95),
    ("general", "General Content", 5000.0, 2000.0, 0.060, 0.008, 0.005, 0.020, 0.60, 0.30, 0.10, 1.00, 1.00),
]

CATEGORY_KEYWORDS = {
    "gaming": [
        "game", "gaming", "playstation", "xbox", "nintendo", "steam", "gta", "minecraft", "fortnite",
        "fps", "rpg", "esports", "twitch", "gameplay", "walkthrough", "speedrun", "mod", "valve", "roblox",
    ],
    "tech": [
        "tech", "technology", "software", "hardware", "python", "javascript", "ai", "coding", "developer",
        "computer", "linux", "apple", "google", "gadget", "review", "cybersecurity", "cloud", "code",
        "programming",
    ],
    "entertainment": [
        "movie", "film", "cinema", "trailer", "tv", "celebrity", "show", "hollywood", "netflix", "drama",
        "comedy", "funny", "meme", "anime", "entertainment", "popculture", "series", "actor",
    ],
    "education": [
        "education", "tutorial", "learn", "how to", "guide", "science", "math", "history", "physics",
        "lesson", "lecture", "university", "academy", "course", "study", "research", "explained",
    ],
    "news": [
        "news", "politics", "breaking", "world", "economy", "election", "government", "report",
        "journalism", "press", "crisis", "parliament", "congress", "senate", "investigation", "headline",
    ],
    "music": [
        "music", "song", "album", "artist", "band", "track", "remix", "cover", "lyrics", "official audio",
        "official video", "soundtrack", "instrumental", "acoustic", "concert", "beat", "rap", "hip hop",
    ],
}

CATEGORY_ALIASES = {
    "technology": "tech", "software": "tech", "coding": "tech",
    "games": "gaming", "videogames": "gaming", "esports": "gaming",
    "movies": "entertainment", "film": "entertainment", "popculture": "entertainment",
    "academic": "education", "science": "education", "tutorials": "education",
    "political": "news",
    "audio": "music", "songs": "music",
    "vlog": "general", "lifestyle": "general", "other": "general",
}
DEFAULT_LIKES_PER_VIEW = 0.06
DEFAULT_COMMENTS_PER_VIEW = 0.008

ENGAGEMENT_METRICS = ("views", "likes", "comments", "shares", "saves")
SENTIMENT_METRICS = ("sentiment_positive", "sentiment_neutral", "sentiment_negative")
