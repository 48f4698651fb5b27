"""skein — social-text analytics (parents and their child replies) on Spark.

Public API: plain ``DataFrame → DataFrame`` operators and ``Column`` functions.
Submodules hold the details; the names below are the stable surface.
"""

from skein.constants import (
    ALL_STOPWORDS,
    DEFAULT_TERMS,
    DOMAIN_STOPWORDS,
    ID_COLUMNS,
    SOCIAL_STOPWORDS,
)
from skein.functions.scalar import (
    compact_date,
    date_sequence,
    date_window,
    epoch_to_date_str,
    epoch_to_ts,
    normalize_id,
    normalize_id_columns,
    significance,
    softmax3,
    to_number,
)
from skein.functions.text import (
    alnum_count,
    comment_text_key,
    compose_text,
    csv_items,
    hashtag_text,
    normalize_social_text,
    parse_tags,
    term_tokens,
    topic_preprocess_text,
)
from skein.operators.export import build_exports, filter_sparse_dates, validate_exports
from skein.operators.keywords import log_odds_keywords, topic_documents, topic_info, topic_table
from skein.operators.relational import (
    add_topic_metadata,
    attach_child_topics,
    attach_parent_topics,
    cap_per_parent,
    dedupe_keep_first,
    dense_index,
    require_columns,
    search_filter,
    topic_names,
)
from skein.operators.sentence_rules import rule_sentiment
from skein.operators.scoring import batch_score, lexicon_sentiment, score_frame, train_text_classifier
from skein.operators.stats import bh_fdr, exact_quantiles, kde_grid, quantile_table, topic_vs_rest, two_sample_u
from skein.operators.timeseries import daily_activity, top_parents, topic_share_by_year, topic_share_total
from skein.operators.topics import cluster_topics, embed_batched, embed_documents, map_2d, reduce_dimensions
from skein.plans.analysis import prepare_data, run_analysis
from skein.plans.collection import collection_plan, prepare_child_ids
from skein.plans.preprocess import preprocess_children, preprocess_parents
from skein.plans.scoring import score_unseen
from skein.schemas import CHILD_FIELDS, PARENT_FIELDS
from skein.session import get_session
from skein.sources.readers import read_child_batches, read_parent_envelopes, read_table, read_terms
from skein.sources.sinks import redact, write_csv, write_table

__all__ = [
    "ALL_STOPWORDS", "CHILD_FIELDS", "DEFAULT_TERMS", "DOMAIN_STOPWORDS", "ID_COLUMNS", "PARENT_FIELDS",
    "SOCIAL_STOPWORDS", "add_topic_metadata", "alnum_count", "attach_child_topics", "attach_parent_topics",
    "batch_score", "bh_fdr", "build_exports", "cap_per_parent", "cluster_topics", "collection_plan",
    "comment_text_key", "compact_date", "compose_text", "csv_items", "daily_activity", "date_sequence",
    "date_window", "dedupe_keep_first", "dense_index", "embed_batched", "embed_documents", "epoch_to_date_str",
    "epoch_to_ts", "exact_quantiles", "filter_sparse_dates", "get_session", "hashtag_text", "kde_grid",
    "lexicon_sentiment", "log_odds_keywords", "map_2d", "normalize_id", "normalize_id_columns",
    "normalize_social_text", "parse_tags", "prepare_child_ids", "prepare_data", "preprocess_children",
    "preprocess_parents", "quantile_table", "read_child_batches", "read_parent_envelopes", "read_table",
    "read_terms", "reduce_dimensions", "redact", "require_columns", "rule_sentiment", "run_analysis", "score_frame",
    "score_unseen",
    "search_filter", "significance", "softmax3", "term_tokens", "to_number", "top_parents", "topic_documents",
    "topic_info", "topic_names", "topic_preprocess_text", "topic_share_by_year", "topic_share_total",
    "topic_table", "topic_vs_rest", "train_text_classifier", "two_sample_u", "validate_exports",
    "write_csv", "write_table",
]
