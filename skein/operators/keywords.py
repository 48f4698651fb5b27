"""Topic keywords: log-odds with an informative prior (TXT-1), topic docs (TXT-2),
topic table (TXT-3) and class-TF-IDF topic info (TXT-4).

``log_odds_keywords`` finds the best terms by bounds (``term_bounds``): counts in a
fixed number of hash buckets per topic say which terms can't be among the best, and
only the others are counted as strings.  ``log_odds_scores`` gives all terms:

1. tokens are produced by built-in array expressions and exploded;
2. ``groupBy(topic, term).count()`` — partial (map-side) aggregation, then one
   shuffle on (topic, term);
3. the counts are materialised once (checkpoint folder); term totals ``F`` come
   from a window partitioned on ``term`` over them; topic sizes ``n_i`` and the grand
   total ``N`` are joined back (AQE broadcasts them after measuring them).

Top-n per topic is ``row_number`` ≤ n: Spark inserts a map-side ``WindowGroupLimit``,
so a topic holding a third of all terms ships only its local top-n per task.

``f_j = F − f_i`` and ``n_j = N − n_i`` replace the per-topic sums over all other
topics, so the work is linear in the number of (topic, term) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import DEFAULT_MIN_TOPIC_TEXT_LEN, DEFAULT_TOP_N_KEYWORDS
from skein.operators.term_bounds import bounded_top_terms
from skein.session import cut_lineage
from skein.functions.text import (
    compute_once,
    explode_tokens,
    keyword_cells,
    spaced_ngrams,
    term_word_string,
    topic_preprocess_text,
)


def _valid_topic(df: DataFrame, topic_col: str) -> Column:
    dtype = df.schema[topic_col].dataType
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(topic_col).isNotNull() & (F.col(topic_col) >= 0)
    if isinstance(dtype, T.StringType):
        return F.col(topic_col).isNotNull()
    return F.coalesce(F.col(topic_col).try_cast("int"), F.lit(-1)) >= 0


def _topic_words(df: DataFrame, topic_col: str, text_col: str, out: str) -> DataFrame:
    """(topic, words joined by spaces) of the rows with a valid topic."""
    return df.filter(_valid_topic(df, topic_col)).select(F.col(topic_col).alias("topic"), term_word_string(text_col).alias(out))


def term_counts(df: DataFrame, topic_col: str, text_col: str) -> DataFrame:
    """AG-12: (topic, term, f_i) — count of each n-gram token per topic (valid topics only)."""
    toks = explode_tokens(_topic_words(df, topic_col, text_col, "__ws"), ["topic"], spaced_ngrams("__ws"), "term")
    counts = toks.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("f_i"))
    return counts.select("topic", F.translate("term", " ", "_").alias("term"), "f_i")


def log_odds_z(f_i: Column, big_f: Column, n_i: Column, big_n: Column) -> Column:
    """SC-23: log-odds z-score of a term in one topic against all others."""
    f_i, big_f, n_i, big_n = (c.cast("double") for c in (f_i, big_f, n_i, big_n))
    f_j = big_f - f_i
    n_j = big_n - n_i
    odds = (
        F.ln(f_i + big_f)
        - F.ln(F.greatest(F.lit(1.0), n_i + big_n - (f_i + big_f)))
        - F.ln(f_j + big_f)
        + F.ln(F.greatest(F.lit(1.0), n_j + big_n - (f_j + big_f)))
    )
    variance = F.lit(1.0) / (f_i + big_f) + F.lit(1.0) / (f_j + big_f)
    return odds / F.sqrt(variance)


def log_odds_scores(df: DataFrame, topic_col: str, text_col: str) -> DataFrame:
    """All (topic, term, z) for terms seen in the topic.

    The (topic, term) counts feed three branches (term totals, topic sizes, grand
    total); identical exchanges are not reliably reused, so the counts are
    materialised once in the checkpoint folder instead of re-tokenising the text
    three times.
    """
    counts = cut_lineage(term_counts(df, topic_col, text_col))
    sizes = counts.groupBy("topic").agg(F.sum("f_i").alias("n_i"))
    # grand total N by a window over the sizes table (one row per topic)
    sizes = sizes.withColumn("big_n", F.sum("n_i").over(Window.partitionBy()))
    by_term = Window.partitionBy("term")
    scored = counts.withColumn("big_f", F.sum("f_i").over(by_term)).join(sizes, "topic")
    return scored.select(
        "topic", "term", "f_i", "big_f", "n_i", "big_n",
        log_odds_z(F.col("f_i"), F.col("big_f"), F.col("n_i"), F.col("big_n")).alias("z_score"),
    )


def top_terms(scores: DataFrame, top_n: int, score_col: str = "z_score") -> DataFrame:
    """WN-3: rank within topic by score desc (ties: rounded score, then term), keep top n."""
    order = Window.partitionBy("topic").orderBy(F.round(F.col(score_col), 9).desc(), F.col("term"))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top_n)


def topic_term_map(terms: DataFrame) -> DataFrame:
    """AG-11: topic → ", "-joined terms in rank order (≤ top_n terms per topic)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda x: x["term"]), ", ").alias("keywords"))


def log_odds_keywords(
    df: DataFrame,
    topic_col: str,
    text_col: str,
    top_n: int = DEFAULT_TOP_N_KEYWORDS,
) -> tuple[DataFrame, DataFrame]:
    """TXT-1: (terms[topic, rank, term, z_score], map[topic, keywords]).

    The words are written once, because the bounds read them two or three times.
    """
    words = cut_lineage(_topic_words(df, topic_col, text_col, "words"))
    terms = bounded_top_terms(words, top_n, log_odds_z, top_terms)
    return terms, topic_term_map(terms)


def topic_documents(
    df: DataFrame,
    id_col: str = "id",
    min_len: int = DEFAULT_MIN_TOPIC_TEXT_LEN,
    text_col: str | None = None,
) -> DataFrame:
    """TXT-2: (id, source_text, topic_text[, create_time]) with short topic texts removed (FLT-3).

    PRJ-6: ``processed_text`` when present, else ``text``."""
    if text_col is None:
        text_col = "processed_text" if "processed_text" in df.columns else "text"
    keep = [F.col(id_col).alias("id"), F.col(text_col).alias("source_text")]
    if "create_time" in df.columns:
        keep.append(F.col("create_time"))
    out = compute_once(df, keep, topic_text=topic_preprocess_text(text_col))
    return out.filter(F.length(F.trim(F.col("topic_text"))) >= min_len)


def topic_table(keyword_map: DataFrame, names: DataFrame) -> DataFrame:
    """TXT-3: one row per named topic id: ID, topic_id, label, first six and all keywords.

    ``names`` is the (topic_id, topic_name) spine from ``topic_names``; keywords
    missing for a topic give empty cells.
    """
    joined = names.join(keyword_map.select(F.col("topic").alias("topic_id"), "keywords"), "topic_id", "left")
    first6, all_tags = keyword_cells(F.coalesce(F.col("keywords"), F.lit("")))
    return joined.select(
        (F.col("topic_id") + 1).alias("ID"),
        "topic_id",
        F.col("topic_name").alias("topic_label"),
        first6.alias("top_tags_first6"),
        all_tags.alias("top_tags_all"),
    )


def class_tfidf_terms(
    df: DataFrame, topic_col: str, text_col: str, top_n: int = DEFAULT_TOP_N_KEYWORDS, outliers: bool = False
) -> DataFrame:
    """TXT-4: class-based TF-IDF representative words per topic.

    weight(t, c) = tf(t, c) · ln(1 + A / f_t), A = mean tokens per class,
    f_t = frequency of t over all classes.  Unigrams only.  ``outliers`` makes the
    outlier topic (−1) a class too.
    """
    words = explode_tokens(
        df.filter(F.col(topic_col).isNotNull() if outliers else _valid_topic(df, topic_col)),
        [F.col(topic_col).alias("topic")],
        F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != F.lit("")),
    )
    tf = cut_lineage(words.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("tf")))  # read twice below
    per_topic = tf.groupBy("topic").agg(F.sum("tf").alias("__t"))
    # A = mean tokens per class, by a window over the per-topic table (one row per topic)
    avg = per_topic.select("topic", (F.sum("__t").over(Window.partitionBy()) / F.count(F.lit(1)).over(Window.partitionBy())).alias("avg_words"))
    scored = tf.withColumn("f_t", F.sum("tf").over(Window.partitionBy("term"))).join(avg, "topic")
    scored = scored.withColumn("z_score", F.col("tf") * F.ln(F.lit(1.0) + F.col("avg_words") / F.col("f_t")))
    return top_terms(scored, top_n).select("topic", "rank", "term", "z_score")


def topic_info(df: DataFrame, topic_col: str, text_col: str, top_n: int = DEFAULT_TOP_N_KEYWORDS) -> DataFrame:
    """TXT-4: per topic, the outlier topic included: size, representative words (class TF-IDF) and a
    name made of the topic and its first four words."""
    sizes = df.groupBy(F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    words = topic_term_map(class_tfidf_terms(df, topic_col, text_col, top_n, outliers=True))
    first = F.slice(F.split(F.coalesce("representation", F.lit("")), ", "), 1, 4)
    out = sizes.join(words.withColumnRenamed("keywords", "representation"), "topic", "left")
    return out.withColumn("name", F.concat_ws("_", F.col("topic").cast("string"), F.array_join(first, "_")))
