"""Text queries: keywords, normalisation, composition, search, content dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalog import register
from skein.catalog.sqlparts import log_odds_sql, topic_text, words
from skein.functions import text as tx
from skein.operators import keywords as kw
from skein.operators.relational import search_filter
from skein.session import table


def _lang_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = tx.compute_once(docs, [F.col("lang").alias("topic")], topic_text=tx.topic_preprocess_text("text"))
    return out.filter(F.length(F.trim(F.col("topic_text"))) >= 3)


_LANG_DOCS_SQL = f"""
SELECT topic, topic_text FROM (SELECT lang AS topic, {topic_text('text')} AS topic_text FROM documents)
WHERE length(trim(topic_text)) >= 3
"""


@register(
    "log_odds_keywords",
    log_odds_sql(_LANG_DOCS_SQL)
    + 'SELECT topic, rnk AS "rank", term, round(z, 6) AS z_score FROM ranked WHERE rnk <= 10',
)
def q_log_odds_keywords(spark: SparkSession, sf: str) -> DataFrame:
    terms, _ = kw.log_odds_keywords(_lang_docs(spark, sf), "topic", "topic_text", top_n=10)
    return terms.select("topic", "rank", "term", F.round("z_score", 6).alias("z_score"))


@register(
    "topic_keyword_map",
    log_odds_sql(_LANG_DOCS_SQL)
    + "SELECT topic, string_agg(term, ', ' ORDER BY rnk) AS keywords FROM ranked WHERE rnk <= 10 GROUP BY topic",
)
def q_topic_keyword_map(spark: SparkSession, sf: str) -> DataFrame:
    _, topic_map = kw.log_odds_keywords(_lang_docs(spark, sf), "topic", "topic_text", top_n=10)
    return topic_map


def _social_sql(expr: str) -> str:
    tokens = (
        f"list_transform({words(expr)}, lambda w: CASE WHEN starts_with(w, '@') AND length(w) > 1 THEN '@user' "
        "WHEN starts_with(w, 'http') THEN 'http' ELSE w END)"
    )
    return f"array_to_string({tokens}, ' ')"


_SOCIAL_INPUT_SQL = """
SELECT 'doc' AS src, doc_id AS id, text FROM documents
UNION ALL
SELECT 'page' AS src, page_id AS id, '@p' || CAST(page_id AS VARCHAR) || ' ' || url || ' ' || html AS text FROM pages
"""


def _social_input(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("src"),
        F.col("page_id").alias("id"),
        F.concat(F.lit("@p"), F.col("page_id").cast("string"), F.lit(" "), F.col("url"), F.lit(" "), F.col("html")).alias("text"),
    )
    return docs.unionByName(pages)


@register(
    "normalize_text",
    f"""
SELECT src, id, md5(n) AS norm_md5, CAST(len(regexp_split_to_array(n, ' ')) AS BIGINT) AS n_tokens,
  CAST(len(list_filter(regexp_split_to_array(n, ' '), lambda w: w = '@user')) AS BIGINT) AS n_user,
  CAST(len(list_filter(regexp_split_to_array(n, ' '), lambda w: w = 'http')) AS BIGINT) AS n_http
FROM (SELECT src, id, {_social_sql('text')} AS n FROM ({_SOCIAL_INPUT_SQL}))
""",
)
def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    df = _social_input(spark, sf).select("src", "id", tx.normalize_social_text("text").alias("n"))
    toks = F.split(F.col("n"), " ")
    return df.select(
        "src",
        "id",
        F.md5("n").alias("norm_md5"),
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(F.filter(toks, lambda w: w == "@user")).cast("bigint").alias("n_user"),
        F.size(F.filter(toks, lambda w: w == "http")).cast("bigint").alias("n_http"),
    )


_KEY_SQL = "lower(trim(regexp_replace(coalesce({e}, ''), '\\s+', ' ', 'g')))"


@register(
    "comment_text_key",
    f"SELECT doc_id, md5({_KEY_SQL.format(e='text')}) AS key_md5 FROM documents",
)
def q_comment_text_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.comment_text_key("text")).alias("key_md5"))


@register(
    "alnum_count",
    """
SELECT min_chars, CAST(count(*) AS BIGINT) AS n_kept FROM
  (SELECT length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) AS n FROM conversations)
  CROSS JOIN (SELECT unnest([0, 20, 100, 1000]) AS min_chars)
WHERE n >= min_chars GROUP BY min_chars
""",
)
def q_alnum_count(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations").select(tx.alnum_count("text").alias("n"))
    ks = (0, 20, 100, 1000)
    row = conv.agg(*[F.count_if(F.col("n") >= k).alias(str(k)) for k in ks])  # one scan, FLT-2 per threshold
    long = row.unpivot([], [str(k) for k in ks], "k", "n_kept")
    return long.select(F.col("k").cast("int").alias("min_chars"), "n_kept").filter(F.col("n_kept") > 0)


@register(
    "compose_text",
    f"""
SELECT doc_id, md5(trim(concat_ws(' ',
    CASE WHEN trim(text) <> '' THEN text END,
    CASE WHEN trim(t) <> '' THEN t END))) AS composed_md5,
  t AS tag_text
FROM (SELECT doc_id, text,
        array_to_string(list_transform(
          list_filter(list_transform(['##' || lang, ' ' || source || ' ', NULL, ' # '], lambda x: ltrim(trim(x), '#')), lambda x: x IS NOT NULL AND x <> ''),
          lambda x: '#' || x), ' ') AS t
      FROM documents)
""",
)
def q_compose_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tags = F.array(F.concat(F.lit("##"), F.col("lang")), F.concat(F.lit(" "), F.col("source"), F.lit(" ")), F.lit(None).cast("string"), F.lit(" # "))
    return docs.select(
        "doc_id",
        F.md5(tx.compose_text("text", None, tags)).alias("composed_md5"),
        tx.hashtag_text(tags).alias("tag_text"),
    )


# FLT-9: terms for the search filter (upper-case on purpose: matching ignores case).
_SEARCH_TERMS = ["The", "Elle", "src3", "Und"]
_SEARCH_REGIONS = ["en", "fr", "de"]


@register(
    "search_filter",
    f"""
SELECT doc_id FROM documents
WHERE lang IN ({", ".join(f"'{r}'" for r in _SEARCH_REGIONS)})
  AND (len(list_intersect(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), [{", ".join(f"'{t.lower()}'" for t in _SEARCH_TERMS)}])) > 0
       OR list_contains([{", ".join(f"'{t.lower()}'" for t in _SEARCH_TERMS)}], lower(source)))
""",
)
def q_search_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("tags", F.array("source")).withColumnRenamed("lang", "region_code")
    return search_filter(docs, _SEARCH_TERMS, text_col="text", tags_col="tags", regions=_SEARCH_REGIONS).select("doc_id")


@register(
    "content_dedupe",
    f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {_KEY_SQL.format(e='text')}) AS BIGINT) AS n_unique_text
FROM documents GROUP BY source
""",
)
def q_content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from skein.operators.relational import content_dedupe

    docs = table(spark, sf, "documents")
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    uniq = content_dedupe(docs, "source", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n_unique_text"))
    return rows.join(uniq, "source", "left").select("source", "n_rows", F.coalesce("n_unique_text", F.lit(0)).alias("n_unique_text"))
