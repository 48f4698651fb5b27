"""Parameters and fixed values.

Everything under "FIXED VALUES" must equal the published analysis for results
to match; everything else is a tunable default.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the published analysis; stated in natural order)
# ---------------------------------------------------------------------------

# Default search terms.
DEFAULT_TERMS = [
    "MentalHealthAwareness",
    "anxiety",
    "mentalhealth",
    "depression",
    "mentalhealthawarenessmonth",
    "mentalhealthmatters",
    "mentalillness",
    "mentalilness",
    "stress",
    "suicide",
    "adhd",
    "burnout",
    "trauma",
    "suicideprevention",
    "emotionalwellbeing",
]

# Identifier columns (kept as strings).
ID_COLUMNS = ["id", "video_id", "music_id", "parent_comment_id", "playlist_id"]

# Topic-model stop words: domain list.
DOMAIN_STOPWORDS = [
    "mentalhealth",
    "mentalhealthawareness",
    "mentalhealthmatters",
    "mentalhealthawarenessmonth",
    "mentalillness",
    "mentalhealthawarness",
    "mentalhealthtiktok",
    "mentalhealthtiktoks",
    "mentalhealthawarenessweek",
    "mental",
    "health",
    "awareness",
    "month",
    "may",
    "dont",
    "matters",
    "mentalhealthmonth",
    "mentalillnessawareness",
    "mentalillnessawarenessweek",
]

# Topic-model stop words: social-media list.
SOCIAL_STOPWORDS = [
    "page",
    "for",
    "fyp",
    "fy",
    "fypviral",
    "foryou",
    "foryourpage",
    "tiktok",
    "capcut",
    "xyzbca",
    "sweden",
    "viralvideos",
    "viral",
    "trending",
    "outpatient",
    "foryoupage",
    "fypage",
    "fyppppppppppppppppppppppp",
    "viraltiktok",
    "greenscreenvideo",
    "greenscreen",
    "youre",
    "like",
    "im",
    "know",
    "get",
    "um",
    "xzybca",
    "tw",
    "xyzcba",
    "really",
    "people",
    "things",
    "viralvideo",
    "ive",
    "yeah",
    "painhub",
    "fyfyfy",
    "fr",
    "mh",
    "sh",
    "foryourepage",
    "duet",
    "duets",
    "dueto",
    "duett",
    "duetme",
    "duetwith",
    "duetwithme",
    "duetwithuser",
    "duetchain",
    "duetcrashers",
    "duetotiktokers",
    "duetsarehowimakefriends",
    "lhrduets",
    "with",
    "withuser",
    "user",
]

# Display names of the first fifteen topics (topic id 0 first).
PAPER_TOPIC_NAMES = [
    "Sunset",
    "Depression",
    "Mental Health Month",
    "Venting 1",
    "Mental Health",
    "Bipolar",
    "Anxiety",
    "Self Care",
    "Positivity",
    "Grief",
    "Borderline",
    "Duet",
    "Suicide Prevention",
    "Psychisch",
    "Venting 2",
]

# Published collection sizes reported in the sanity table.
PAPER_VIDEO_COUNT = 28_341
PAPER_COMMENT_COUNT = 80_130

# Metrics compared by the rank tests.
TEST_METRICS = [
    "detoxify_toxicity",
    "detoxify_insult",
    "detoxify_obscene",
    "xlm_polarity",
]

# Quantile levels of the per-topic quantile table.
QUANTILES = [0.01, 0.05, 0.10, 0.50, 0.90, 0.95, 0.99]

# Toxicity score columns of the export.
TOXICITY_COLUMNS = [
    "detoxify_toxicity",
    "detoxify_severe_toxicity",
    "detoxify_obscene",
    "detoxify_identity_attack",
    "detoxify_insult",
    "detoxify_threat",
    "detoxify_sexual_explicit",
]

# Sentiment score columns of the export.
SENTIMENT_COLUMNS = [
    "xlm_sentiment",
    "xlm_polarity",
    "xlm_negative",
    "xlm_neutral",
    "xlm_positive",
]

# Export column orders.
PARENT_EXPORT_COLUMNS = ["topic", "video_index", "date", *TOXICITY_COLUMNS, *SENTIMENT_COLUMNS]
CHILD_EXPORT_COLUMNS = ["video_index", "comment_index", "date", *TOXICITY_COLUMNS, *SENTIMENT_COLUMNS]

# Model-score column groups.
XLM_COLUMNS = ["xlm_negative", "xlm_neutral", "xlm_positive", "xlm_sentiment", "xlm_polarity"]
VADER_COLUMNS = ["vader_neg", "vader_neu", "vader_pos", "vader_compound"]

# Columns that must never appear in the shareable export.
DISALLOWED_EXPORT_COLUMNS = [
    "id",
    "video_id",
    "comment_id",
    "parent_comment_id",
    "username",
    "author",
    "text",
    "processed_text",
    "video_description",
    "voice_to_text",
]

# Identifying columns dropped from redacted companions.
REDACT_COLUMNS = [
    "id",
    "text",
    "processed_text",
    "username",
    "video_description",
    "voice_to_text",
    "source_file",
]

# Published headers of the topic table CSV, in order.
TOPIC_TABLE_HEADERS = ["ID", "topic_id", "Topic label", "Top tags (first 6)", "Top tags (all)"]

# Three-class sentiment labels (value keeps the column prefix).
SENTIMENT_LABELS = ["xlm_negative", "xlm_neutral", "xlm_positive"]

# Significance thresholds: (upper bound, stars), tested in order.
SIGNIFICANCE_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]

# KDE evaluation grid: 500 points on [-1.2, 1.1].
KDE_GRID = (-1.2, 1.1, 500)

# Daily-series window (month, day) inclusive, per year.
SERIES_WINDOW = ((4, 15), (10, 15))
SERIES_YEARS = [2023, 2024]

# ---------------------------------------------------------------------------
# Tunable defaults
# ---------------------------------------------------------------------------
DEFAULT_SEED = 42
DEFAULT_MAX_CHILDREN_PER_PARENT = 500
DEFAULT_TOP_N_KEYWORDS = 10
DEFAULT_TOP_PARENTS = 50
DEFAULT_MIN_ENTRIES_PER_DATE = 10
DEFAULT_MIN_TOPIC_TEXT_LEN = 3
DEFAULT_MIN_COMMENT_COUNT = 1

ALL_STOPWORDS = sorted(set(DOMAIN_STOPWORDS) | set(SOCIAL_STOPWORDS))

# Columns of the table of most-commented parents, in order.
TOP_PARENT_COLUMNS = [
    "id",
    "username",
    "collected_comments_raw_unique",
    "collected_comments_text_dedup",
    "comment_count",
    "view_count",
    "like_count",
]
