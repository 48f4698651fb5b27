"""Topic tables, lexicon and softmax queries (SQL-checked) and model queries (rows-only)."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.catalog import register
from skein.catalog.sqlparts import log_odds_sql, topic_text
from skein.functions import scalar as sc
from skein.functions import text as tx
from skein.operators import density, sentence_rules
from skein.operators import graph
from skein.operators import keywords as kw
from skein.operators import nearest
from skein.operators import relational as rel
from skein.operators import scoring as scr
from skein.operators import topics as tp
from skein.session import ensure_checkpoint_dir, table

# topic id of a document = position of its language in alphabetical order
def _docs_by_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    number = (F.dense_rank().over(Window.orderBy(F.asc_nulls_last("lang"))) - 1).cast("int").alias("topic")
    topics = docs.select("lang").distinct().select(F.col("lang").alias("known"), number)  # one row per language, null too
    docs = docs.join(F.broadcast(topics), F.col("lang").eqNullSafe(F.col("known")))
    out = tx.compute_once(docs, ["doc_id", "topic"], topic_text=tx.topic_preprocess_text("text"))
    return out.filter(F.length(F.trim("topic_text")) >= 3)


_LANG_ID_SQL = "CAST(dense_rank() OVER (ORDER BY lang) AS INTEGER) - 1"
_DOCS_BY_ID_SQL = f"""
SELECT doc_id, topic, topic_text FROM (SELECT doc_id, {_LANG_ID_SQL} AS topic, {topic_text('text')} AS topic_text FROM documents)
WHERE length(trim(topic_text)) >= 3
"""

_NAMES4 = "SELECT * FROM (VALUES (0, 'Sunset'), (1, 'Depression'), (2, 'Mental Health Month'), (3, 'Venting 1')) AS t(topic_id, topic_name)"


@register(
    "topic_table",
    log_odds_sql(_DOCS_BY_ID_SQL)
    + f""",
km AS (SELECT topic AS topic_id, string_agg(term, ', ' ORDER BY rnk) AS kw FROM ranked WHERE rnk <= 10 GROUP BY topic),
items AS (SELECT nm.topic_id, nm.topic_name,
            list_transform(string_split(coalesce(km.kw, ''), ','), lambda x: replace(trim(x), '_', ' ')) AS it
          FROM ({_NAMES4}) nm LEFT JOIN km USING (topic_id))
SELECT topic_id + 1 AS ID, topic_id, topic_name AS topic_label, array_to_string(it[1:6], ', ') AS top_tags_first6,
       array_to_string(it, ', ') AS top_tags_all
FROM items
""",
)
def q_topic_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs_by_id(spark, sf)
    _, kmap = kw.log_odds_keywords(docs, "topic", "topic_text", 10)
    id2 = kmap.select(F.col("topic").alias("topic_id"), F.col("keywords").alias("topic"))
    names = rel.topic_names(id2)
    return kw.topic_table(kmap, names)


@register(
    "topic_info",
    f"""
WITH docs AS (SELECT CASE WHEN doc_id % 9 = 0 THEN -1 ELSE topic END AS topic, topic_text FROM ({_DOCS_BY_ID_SQL})),
w AS (SELECT topic, unnest(list_filter(regexp_split_to_array(topic_text, '\\s+'), lambda x: x <> '')) AS term FROM docs),
tf AS (SELECT topic, term, count(*) AS tf FROM w GROUP BY topic, term),
a AS (SELECT sum(tf) / count(DISTINCT topic) AS avg_words FROM tf),
ft AS (SELECT term, sum(tf) AS f_t FROM tf GROUP BY term),
sc AS (SELECT topic, term, tf * ln(1 + avg_words / f_t) AS s FROM tf JOIN ft USING (term) CROSS JOIN a),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(s, 9) DESC, term) AS r FROM sc),
rep AS (SELECT topic, string_agg(term, ', ' ORDER BY r) AS representation FROM rk WHERE r <= 10 GROUP BY topic),
sz AS (SELECT topic, count(*) AS n FROM docs GROUP BY topic)
SELECT sz.topic, CAST(sz.n AS BIGINT) AS count, rep.representation,
  sz.topic || '_' || array_to_string(string_split(rep.representation, ', ')[1:4], '_') AS name
FROM sz LEFT JOIN rep USING (topic)
""",
)
def q_topic_info(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs_by_id(spark, sf)
    outlier = docs.withColumn("topic", F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("topic")))
    return kw.topic_info(outlier, "topic", "topic_text", 10)


# Fixture lexicon (word → valence) for the lexicon scorer; a real run passes a full lexicon table.
_LEXICON = {
    "and": 1.2, "que": -0.8, "that": 0.5, "for": 1.9, "was": -1.5, "die": -2.9, "with": 0.7,
    "are": -0.3, "elle": 2.1, "ein": -1.1, "mit": 0.4, "est": 1.0, "pour": 2.3, "los": -2.0,
}


def _lex_case(var: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(_LEXICON.items()))
    return f"CASE {var} {whens} ELSE 0.0 END"


@register(
    "lexicon_sentiment",
    f"""
WITH t AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 2 END AS doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\pL'']+'), lambda w: w <> ''),
                lambda w: {_lex_case('w')}) AS v FROM documents),
s AS (SELECT doc_id,
        coalesce(list_sum(v), 0) AS s,
        coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x + 1 ELSE 0 END)), 0) AS pos,
        coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x < 0 THEN x - 1 ELSE 0 END)), 0) AS neg,
        coalesce(list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 1.0 ELSE 0 END)), 0) AS neu
      FROM t)
SELECT doc_id,
  round(CASE WHEN pos + abs(neg) + neu > 0 THEN abs(neg) / (pos + abs(neg) + neu) ELSE 0 END, 9) AS vader_neg,
  round(CASE WHEN pos + abs(neg) + neu > 0 THEN neu / (pos + abs(neg) + neu) ELSE 0 END, 9) AS vader_neu,
  round(CASE WHEN pos + abs(neg) + neu > 0 THEN pos / (pos + abs(neg) + neu) ELSE 0 END, 9) AS vader_pos,
  round(CASE WHEN s <> 0 THEN s / sqrt(s * s + 15) ELSE 0 END, 9) AS vader_compound
FROM s
""",
)
def q_lexicon_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # rows are scored on their own: repeated and null ids change nothing
    ids = F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.floor(F.col("doc_id") / 2).cast("bigint"))
    out = scr.lexicon_sentiment(docs.withColumn("doc_id", ids), "text", _LEXICON)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("vader_neg", "vader_neu", "vader_pos", "vader_compound")])


# Fixture word lists for the sentence rules, from the documents' common words.
_NEGATIONS = ("not", "from", "nicht", "pas", "una", "der")
_BOOSTERS = {"the": 0.293, "les": 0.293, "das": 0.293, "del": 0.293, "this": -0.293, "dans": -0.293, "ist": -0.293, "con": -0.293}
_CONTRASTS = ("but", "have", "sur", "sie", "por")


def _names(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


def _step_sql(k: int, damping: float) -> str:
    """Valence after the word ``k`` before: boosted, then turned by a negation."""
    step = f"(lag(boost, {k}) OVER o + CASE WHEN lag(boost, {k}) OVER o <> 0 AND lag(cap, {k}) OVER o AND mixed THEN 0.733 ELSE 0 END)"
    turn = f"CASE WHEN lag(negates, {k}) OVER o THEN -0.74 ELSE 1 END"
    return (
        f"SELECT *, CASE WHEN v0 <> 0 AND NOT coalesce(lag(known, {k}) OVER o, true) "
        f"THEN (v{k} + {damping} * {step} * sign(v{k})) * {turn} ELSE v{k} END AS v{k + 1} "
        f"FROM s{k} WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"
    )


_BOOST_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(_BOOSTERS.items()))
_BARE = "trim(t, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')"


@register(
    "rule_sentiment",
    f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS own FROM documents),
u AS (SELECT doc_id, unnest(own) AS t, unnest(range(len(own))) AS pos FROM t),
w AS (SELECT doc_id, pos, CASE WHEN length({_BARE}) > 2 THEN {_BARE} ELSE t END AS w FROM u),
a AS (SELECT *, lower(w) AS l, regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}') AS cap FROM w),
b AS (SELECT *, CAST(CASE l {_BOOST_CASE} ELSE 0 END AS DOUBLE) AS boost, l IN ({_names(_NEGATIONS)}) OR suffix(l, 'n''t') AS negates,
        l IN ({_names(_LEXICON)}) AS known, CAST(CASE WHEN l IN ({_names(_BOOSTERS)}) THEN 0 ELSE {_lex_case('l')} END AS DOUBLE) AS v0,
        sum(CAST(cap AS INTEGER)) OVER d AS caps, count(*) OVER d AS n, min(CASE WHEN l IN ({_names(_CONTRASTS)}) THEN pos END) OVER d AS turn
      FROM a WINDOW d AS (PARTITION BY doc_id)),
m AS (SELECT *, caps > 0 AND caps < n AS mixed FROM b),
s1 AS (SELECT *, v0 + CASE WHEN v0 <> 0 AND cap AND mixed THEN 0.733 * sign(v0) ELSE 0 END AS v1 FROM m),
s2 AS ({_step_sql(1, 1.0)}), s3 AS ({_step_sql(2, 0.95)}), s4 AS ({_step_sql(3, 0.9)}),
f AS (SELECT doc_id, v4 * CASE WHEN pos < turn THEN 0.5 WHEN pos > turn THEN 1.5 ELSE 1 END AS v FROM s4),
g AS (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS q,
        sum(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS z FROM f GROUP BY doc_id),
e AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS x,
        length(coalesce(text, '')) - length(replace(coalesce(text, ''), '?', '')) AS y FROM documents),
h AS (SELECT doc_id, CAST(0.292 * least(x, 4) + CASE WHEN y > 3 THEN 0.96 WHEN y > 1 THEN 0.18 * y ELSE 0 END AS DOUBLE) AS loud FROM e),
r AS (SELECT h.doc_id, coalesce(s, 0) + sign(coalesce(s, 0)) * loud AS s, coalesce(p, 0) + CASE WHEN p > q THEN loud ELSE 0 END AS p,
        coalesce(q, 0) + CASE WHEN q > p THEN loud ELSE 0 END AS q, coalesce(z, 0) AS z FROM h LEFT JOIN g USING (doc_id))
SELECT doc_id,
  round(CASE WHEN p + q + z > 0 THEN q / (p + q + z) ELSE 0 END, 9) AS vader_neg,
  round(CASE WHEN p + q + z > 0 THEN z / (p + q + z) ELSE 0 END, 9) AS vader_neu,
  round(CASE WHEN p + q + z > 0 THEN p / (p + q + z) ELSE 0 END, 9) AS vader_pos,
  round(s / sqrt(s * s + 15), 9) AS vader_compound
FROM r
""",
)
def q_rule_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = sentence_rules.rule_sentiment(docs, "text", _LEXICON, _NEGATIONS, _BOOSTERS, _CONTRASTS)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("vader_neg", "vader_neu", "vader_pos", "vader_compound")])


@register(
    "softmax_label",
    """
WITH l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c
           FROM embeddings),
e AS (SELECT vec_id, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM l),
p AS (SELECT vec_id, ea / (ea + eb + ec) AS pn, eb / (ea + eb + ec) AS pu, ec / (ea + eb + ec) AS pp FROM e)
SELECT vec_id, round(pn, 9) AS xlm_negative, round(pu, 9) AS xlm_neutral, round(pp, 9) AS xlm_positive,
  CASE WHEN pn >= pu AND pn >= pp THEN 'xlm_negative' WHEN pu >= pp THEN 'xlm_neutral' ELSE 'xlm_positive' END AS xlm_sentiment,
  round(pp - pn, 9) AS xlm_polarity, round(greatest(pn, pu, pp), 9) AS max_prob
FROM p
""",
)
def q_softmax_label(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    df = emb.select("vec_id", logits.alias("logits")).withColumn("max_prob", sc.max_probability(sc.softmax3("logits")))
    out = scr.sentiment_from_logits(df, "logits")
    cols = ["xlm_negative", "xlm_neutral", "xlm_positive", "xlm_polarity", "max_prob"]
    return out.select("vec_id", "xlm_sentiment", *[F.round(c, 9).alias(c) for c in cols])


@register("batch_score")
def q_batch_score(spark: SparkSession, sf: str) -> DataFrame:
    """ML-1 + ML-4: three-class sentiment by batched inference (hashed stand-in model) on every document."""
    docs = table(spark, sf, "documents").select("doc_id", tx.normalize_social_text("text").alias("processed_text"))
    out = scr.score_frame(
        docs, "processed_text", sentiment_factory=scr.hashed_linear_model(3, seed=7), lexicon=_LEXICON
    )
    return out.drop("processed_text")


@register("toxicity_batch")
def q_toxicity_batch(spark: SparkSession, sf: str) -> DataFrame:
    """ML-3: multi-label toxicity struct from a batched model, expanded to ``detoxify_*`` columns."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scr.score_frame(docs, "text", toxicity_factory=_sigmoid(scr.hashed_linear_model(7, seed=11))).drop("text")


def _sigmoid(factory):
    keys = [c.removeprefix("detoxify_") for c in scr.TOXICITY_COLUMNS]

    def make():
        import numpy as np

        predict = factory()

        def run(texts):
            z = 1.0 / (1.0 + np.exp(-predict(texts)))
            return {k: z[:, i] for i, k in enumerate(keys)}

        return run

    return make


@register("toxicity_model")
def q_toxicity_model(spark: SparkSession, sf: str) -> DataFrame:
    """ML-6: train on labels ⨝ documents, score every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(table(spark, sf, "labels"), "doc_id")
    model = scr.train_text_classifier(labelled, "text", "toxic", num_features=1 << 16, max_iter=20)
    return scr.apply_text_classifier(model, docs, "text", "detoxify_toxicity").drop("text")


@register("embed_docs")
def q_embed_docs(spark: SparkSession, sf: str) -> DataFrame:
    """ML-5: batched sentence embeddings of every document (hashed random-indexing encoder, 64 dims)."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tp.embed_batched(docs, "doc_id", "text", scr.hashed_linear_model(64, seed=3), batch_size=64)


@register("embed_hashed")
def q_embed_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """ML-5 (without a model): hashed word sums of the topic texts."""
    docs = _docs_by_id(spark, sf)
    return tp.embed_documents(docs, "doc_id", "topic_text", dim=32)


def _clustered(spark: SparkSession, sf: str):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    topics, _ = tp.cluster_topics(emb, "vec_id", k=10, reduce_k=10, min_size=5)
    return emb, topics


@register("cluster_topics")
def q_cluster_topics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-7 + ML-8 + ML-10: PCA(10) of normalised embeddings, KMeans, ids by size."""
    _, topics = _clustered(spark, sf)
    return topics


@register("topic_model_reuse", "SELECT vec_id, true AS known_topic, true AS as_before FROM embeddings WHERE vec_id % 2 = 1")
def q_topic_model_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """ML-9: fit on the even half, save, load, assign the odd half; the loaded model must assign as the fitted one."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    model = tp.fit_topics(emb.filter("vec_id % 2 = 0"), k=10, reduce_k=10, min_size=5)
    path = f"{ensure_checkpoint_dir(spark)}/topic-model-{uuid.uuid4().hex}"
    tp.save_model(model, path)
    new = emb.filter("vec_id % 2 = 1")
    before = model.assign(new, "vec_id").select("vec_id", F.col("topic_id").alias("before"), F.col("topic_probability").alias("p"))
    after = tp.load_model(path).assign(new, "vec_id").join(before, "vec_id")
    return after.select(
        "vec_id",
        F.col("topic_id").between(-1, 9).alias("known_topic"),
        ((F.col("topic_id") == F.col("before")) & (F.abs(F.col("topic_probability") - F.col("p")) < 1e-12)).alias("as_before"),
    )


@register("density_topics")
def q_density_topics(spark: SparkSession, sf: str) -> DataFrame:
    """ML-8 (b): density-connected micro-clusters over the reduced embeddings, outliers −1."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    feats, _ = tp.reduce_dimensions(emb, "vec_id", "embedding", k=10)
    # these embeddings form one dense cloud in PCA space; a tighter link factor shows its structure
    return tp.density_topics(feats, "vec_id", micro_k=40, min_points=3, min_size=10, link_factor=0.5)


_CUT = 1.2  # distance at which the hierarchy is cut; neighbours of a row are 1.0 to 1.25 away


@register(
    "density_cut",
    f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id AS u, b.vec_id AS v, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d, v) AS k FROM d QUALIFY k <= 5),
cores AS (SELECT u, max(d) AS core FROM near GROUP BY u),
one_way AS (SELECT n.u, n.v, greatest(n.d, a.core, b.core) AS w FROM near n JOIN cores a ON a.u = n.u JOIN cores b ON b.u = n.v),
edges AS (SELECT u, v, w FROM one_way UNION SELECT v, u, w FROM one_way),
spread AS (
  SELECT 0 AS n, u AS node, u AS component FROM cores
  UNION ALL
  SELECT n + 1, node, min(other) FROM (
    SELECT n, node, component AS other FROM spread WHERE n < 40
    UNION ALL SELECT s.n, e.u, s.component FROM spread s JOIN edges e ON e.v = s.node WHERE s.n < 40 AND e.w <= {_CUT})
  GROUP BY n, node
)
SELECT c.u AS vec_id, round(c.core, 9) AS core, round(min(e.w), 9) AS joins_at, s.component
FROM cores c JOIN edges e ON e.u = c.u JOIN spread s ON s.node = c.u AND s.n = 40 GROUP BY ALL
""",
)
def q_density_cut(spark: SparkSession, sf: str) -> DataFrame:
    """ML-8: core distances, the weight at which a row first joins another, and the clusters of a cut, by the forest.

    The nearest rows are exact, and every row with a vector has its own result, copies of a vector too.
    """
    nodes, near = nearest.nearest_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)
    cores = density.core_distances(nodes, near, 5)
    forest, _ = graph.spanning_forest(density.reachability_edges(near, cores))
    ends = forest.select(F.col("u").alias("node"), "w").unionByName(forest.select(F.col("v").alias("node"), "w"))
    first = ends.groupBy("node").agg(F.min("w").alias("joins_at"))
    found = cores.join(first, "node").join(density.cut_components(nodes, forest, _CUT), "node")
    return found.select(F.col("node").alias("vec_id"), F.round("core", 9).alias("core"), F.round("joins_at", 9).alias("joins_at"), "component")


@register("density_hierarchy")
def q_density_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """ML-7 + ML-8: the density hierarchy of the reduced embeddings, clusters of 10 to 200 rows, outliers −1."""
    feats, _ = tp.reduce_dimensions(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", k=10)
    feats = feats.select("vec_id", vector_to_array("features").alias("features"))
    return density.density_hierarchy(feats, "vec_id", "features", min_size=10, max_size=200, min_samples=5)


@register("map_2d")
def q_map_2d(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11: 2-D coordinates joined to topics by key."""
    emb, topics = _clustered(spark, sf)
    return tp.map_2d(emb, "vec_id", topics)


@register("map_2d_axes", "SELECT count(*) AS n, true AS uncorrelated, true AS ordered FROM embeddings")
def q_map_2d_axes(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11 by its properties: every key once, axes without covariance, the first of more variance."""
    emb, topics = _clustered(spark, sf)
    xy = tp.map_2d(emb, "vec_id", topics)
    return xy.agg(
        F.count_distinct("vec_id").alias("n"),
        (F.abs(F.covar_samp("x", "y")) < 1e-9).alias("uncorrelated"),
        (F.var_samp("x") >= F.var_samp("y")).alias("ordered"),
    )


@register(
    "embedding_topic_keys",
    """
SELECT 'left_only' AS side, count(*) AS n FROM embeddings WHERE vec_id % 10 = 3
UNION ALL SELECT 'right_only', count(*) FROM embeddings WHERE vec_id % 10 = 4
""",
)
def q_embedding_topic_keys(spark: SparkSession, sf: str) -> DataFrame:
    """DQ-8: keys on one side only, with planted ones on both."""
    emb, topics = _clustered(spark, sf)
    return tp.key_mismatch(emb.filter("vec_id % 10 <> 4"), topics.filter("vec_id % 10 <> 3"), "vec_id")
