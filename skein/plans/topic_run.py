"""Topic run (PIPE-9): topic documents → embeddings → reduce + cluster (or reuse a
saved model) → assignments → topic info → log-odds keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.constants import DEFAULT_MIN_TOPIC_TEXT_LEN, DEFAULT_TOP_N_KEYWORDS
from skein.operators import keywords as kw
from skein.operators import topics as tp
from skein.operators.quality import require_not_empty


def run_topics(
    parents: DataFrame,
    n_topics: int = 15,
    min_len: int = DEFAULT_MIN_TOPIC_TEXT_LEN,
    embed_dim: int = 64,
    reduce_k: int = 10,
    min_cluster: int = 2,
    top_n: int = DEFAULT_TOP_N_KEYWORDS,
    embeddings: DataFrame | None = None,
    model: tp.TopicModel | None = None,
) -> dict[str, DataFrame]:
    """With ``model`` (``topics.load_model``) documents are assigned to its topics without fitting.

    Returns topic_docs, embeddings, topic_assignments, topics (id, topic), topic_info,
    keyword_scores (topic_id, rank, term, z_score), id2topics (topic_id, topic)."""
    docs = kw.topic_documents(parents, "id", min_len)
    require_not_empty(docs, "topic documents")
    emb = embeddings if embeddings is not None else tp.embed_documents(docs, "id", "topic_text", dim=embed_dim)
    if model is None:
        model = tp.fit_topics(emb, k=n_topics, reduce_k=reduce_k, min_size=min_cluster)
    assign = model.assign(emb, "id")
    with_text = assign.join(docs.select("id", "topic_text"), "id")
    terms, id2 = kw.log_odds_keywords(with_text, "topic_id", "topic_text", top_n)
    return {
        "topic_docs": docs,
        "embeddings": emb,
        "topic_assignments": assign,
        "topics": assign.select("id", F.col("topic_id").alias("topic")),
        "topic_info": kw.topic_info(with_text, "topic_id", "topic_text", top_n),
        "keyword_scores": terms.withColumnRenamed("topic", "topic_id"),
        "id2topics": id2.select(F.col("topic").alias("topic_id"), F.col("keywords").alias("topic")),
    }
