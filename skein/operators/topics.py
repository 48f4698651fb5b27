"""Embeddings, dimension reduction, clustering into topics and 2-D maps (ML-5, ML-7 … ML-11).

The published pipeline uses UMAP + HDBSCAN on one machine; here the same roles
are played by MLlib stages that train and score in parallel:

* ML-5  ``embed_documents``: hashed word sums, or any ``predict_batch_udf``
  encoder through ``embed_batched``; ``embed_new`` skips known ids;
* ML-7  ``reduce_dimensions``: L2-normalise + PCA(k);
* ML-8  ``cluster_topics``: KMeans; clusters below the minimum size become
  outliers (−1); topic ids are renumbered by size, largest first (the published
  convention);
* ML-9  ``save_model`` / ``load_model``: the stages and the topic map, which
  assign new documents too;
* ML-10 topic probability = softmax of negative centre distances, max entry;
* ML-11 ``map_2d``: PCA(2) joined to topics by key (never by position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def embed_batched(docs: DataFrame, id_col: str, text_col: str, encoder_factory, batch_size: int = 64) -> DataFrame:
    """ML-5: (id, embedding ARRAY<FLOAT>) from any batched sentence encoder (built once per
    worker, fed Arrow batches of ``batch_size`` texts); not L2-normalised."""
    from pyspark.sql import types as T

    from skein.operators.scoring import batch_score

    out = batch_score(docs.select(id_col, text_col), text_col, encoder_factory, T.ArrayType(T.FloatType()), "embedding", batch_size)
    return out.select(id_col, "embedding")


def embed_documents(docs: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """ML-5 (without a model): (id, embedding ARRAY<FLOAT>) by hashing words into ``dim`` sums, L2-normalised.

    Needs no vocabulary, so nothing grows on the driver; a map in the JVM.
    """
    words = docs.select(id_col, F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "").alias("__w"))
    hashed = HashingTF(numFeatures=dim, inputCol="__w", outputCol="__v").transform(words)
    unit = Normalizer(inputCol="__v", outputCol="__u", p=2.0).transform(hashed)
    return unit.select(id_col, vector_to_array("__u", "float32").alias("embedding"))


def embed_new(docs: DataFrame, known: DataFrame, id_col: str, embed) -> DataFrame:
    """ML-5 reuse: ``known`` (id, embedding) plus ``embed`` of the documents whose id it lacks (anti join)."""
    return known.select(id_col, "embedding").unionByName(embed(docs.join(known.select(id_col), id_col, "left_anti")))


def reduce_dimensions(emb: DataFrame, id_col: str, vec_col: str = "embedding", k: int = 10) -> tuple[DataFrame, PipelineModel]:
    """ML-7: (id, features VECTOR) after L2 normalisation and PCA(k)."""
    base = emb.select(id_col, array_to_vector(vec_col).alias("__raw"))
    pipe = Pipeline(stages=[Normalizer(inputCol="__raw", outputCol="__norm", p=2.0), PCA(k=k, inputCol="__norm", outputCol="features")])
    model = pipe.fit(base)
    return model.transform(base).select(id_col, "features"), model


@dataclass
class TopicModel:
    """A fitted topic model: MLlib stages from the embedding to the cluster, and the clusters' topic ids.

    ``topics`` maps a cluster to (topic_id, cut); topic −1 are clusters below the
    minimum size, ``cut`` the largest distance to the centre that still belongs
    (null: all).
    """

    pipeline: PipelineModel
    topics: dict[int, tuple[int, float | None]]

    def assign(self, emb: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
        """ML-8 + ML-10: (id, topic_id, topic_probability) of any embeddings, the training ones or new ones."""
        centres = self.pipeline.stages[-1].clusterCenters()  # k × dim: bounded by k
        centre_list = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
        found = self.pipeline.transform(emb.select(id_col, array_to_vector(vec_col).alias("__raw")))
        found = found.withColumn("__f", vector_to_array("features"))
        sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        found = found.withColumn("__d", F.transform(centre_list, lambda c: F.sqrt(sq(F.col("__f"), c))))
        ex = F.transform("__d", lambda d: F.exp(F.array_min("__d") - d))
        prob = F.array_max(ex) / F.aggregate(ex, F.lit(0.0), lambda s, v: s + v)
        rows = [(c, t, cut) for c, (t, cut) in sorted(self.topics.items())]  # ≤ k
        mapping = emb.sparkSession.createDataFrame(rows, "cluster INT, __topic INT, __cut DOUBLE")
        inside = F.coalesce(F.element_at("__d", F.col("cluster") + 1) <= F.col("__cut"), F.lit(True))
        topic = F.when(inside, F.coalesce("__topic", F.lit(-1))).otherwise(F.lit(-1)).cast("int")
        return found.join(F.broadcast(mapping), "cluster", "left").select(
            id_col, topic.alias("topic_id"), prob.alias("topic_probability")
        )


def fit_topics(
    emb: DataFrame,
    vec_col: str = "embedding",
    k: int = 15,
    reduce_k: int = 10,
    min_size: int = 2,
    outlier_quantile: float | None = None,
    seed: int = DEFAULT_SEED,
) -> TopicModel:
    """ML-7 + ML-8 (a): L2-normalise, PCA, KMeans; topics numbered 0.. by size, largest first.

    Clusters smaller than ``min_size`` are outliers (−1).  With an
    ``outlier_quantile`` rows beyond that quantile of their cluster's distances
    are too; without one (the default) no row is an outlier for its rank alone.
    """
    stages = [
        Normalizer(inputCol="__raw", outputCol="__norm", p=2.0),
        PCA(k=reduce_k, inputCol="__norm", outputCol="features"),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=30),
    ]
    base = emb.select(array_to_vector(vec_col).alias("__raw"))
    model = PipelineModel(Pipeline(stages=stages).fit(base).stages)
    centres = model.stages[-1].clusterCenters()
    centre_list = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    own = F.element_at(centre_list, F.col("cluster") + 1)
    pairs = F.zip_with(vector_to_array("features"), own, lambda x, y: (x - y) * (x - y))
    dist = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v))
    cut = F.percentile_approx(dist, outlier_quantile) if outlier_quantile else F.lit(None).cast("double")
    sizes = model.transform(base).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), cut.alias("cut")).collect()  # ≤ k rows
    kept = sorted((r for r in sizes if r["n"] >= min_size), key=lambda r: (-r["n"], r["cluster"]))
    topics = {r["cluster"]: (-1, None) for r in sizes}
    topics.update({r["cluster"]: (i, r["cut"]) for i, r in enumerate(kept)})
    return TopicModel(model, topics)


def cluster_topics(emb: DataFrame, id_col: str, vec_col: str = "embedding", **fit) -> tuple[DataFrame, TopicModel]:
    """ML-8 (a) + ML-10: (id, topic_id, topic_probability) and the fitted model (see ``fit_topics``)."""
    model = fit_topics(emb, vec_col, **fit)
    return model.assign(emb, id_col, vec_col), model


def density_topics(
    feats: DataFrame,
    id_col: str,
    micro_k: int = 100,
    min_points: int = 3,
    min_size: int = 10,
    link_factor: float = 1.0,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """ML-8 (b): density-connected topics with outliers, without pairing data rows.

    1. KMeans with ``micro_k`` micro-clusters (distributed MLlib training);
    2. per micro-cluster size and radius (90th-percentile distance to the centre) —
       a table bounded by ``micro_k``;
    3. micro-clusters whose centres lie within ``link_factor × (r_i + r_j)`` are
       density-connected; pairs are formed among the ≤ ``micro_k`` centres only;
    4. connected components (union-find on that bounded graph); micro-clusters
       with fewer than ``min_points`` rows and components below ``min_size``
       are outliers (−1); topic ids are renumbered by size, largest first.
    Returns (id, topic_id).
    """
    import numpy as np

    km = KMeans(k=micro_k, seed=seed, featuresCol="features", predictionCol="micro", maxIter=20).fit(feats)
    centres = np.array(km.clusterCenters())  # micro_k × dim: bounded by the parameter
    assigned = km.transform(feats).withColumn("__f", vector_to_array("features"))
    centre_list = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    own = F.element_at(centre_list, F.col("micro") + 1)
    dist = F.sqrt(F.aggregate(F.zip_with("__f", own, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v))
    # extent of a micro-cluster: 90th-percentile distance to its centre (bounded-memory sketch)
    stats = assigned.groupBy("micro").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(dist, 0.9).alias("r")).collect()  # ≤ micro_k rows
    size = {r["micro"]: r["n"] for r in stats}
    radius = {r["micro"]: float(r["r"] or 0.0) for r in stats}
    dense = sorted(m for m in size if size[m] >= min_points)
    parent = {m: m for m in dense}

    def find(m):
        while parent[m] != m:
            parent[m] = parent[parent[m]]
            m = parent[m]
        return m

    for i, a in enumerate(dense):
        for b in dense[i + 1:]:
            if np.linalg.norm(centres[a] - centres[b]) <= link_factor * (radius[a] + radius[b]):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    comp_size: dict[int, int] = {}
    for m in dense:
        comp_size[find(m)] = comp_size.get(find(m), 0) + size[m]
    kept = sorted((c for c in comp_size if comp_size[c] >= min_size), key=lambda c: (-comp_size[c], c))
    topic_of_comp = {c: i for i, c in enumerate(kept)}
    mapping = [(m, topic_of_comp.get(find(m), -1) if m in parent else -1) for m in range(micro_k)]
    spark = feats.sparkSession
    mdf = spark.createDataFrame(mapping, "micro INT, topic_id INT")  # ≤ micro_k rows
    return assigned.join(F.broadcast(mdf), "micro").select(id_col, "topic_id")


def map_2d(emb: DataFrame, id_col: str, topics: DataFrame, vec_col: str = "embedding", exclude_topics=()) -> DataFrame:
    """ML-11: (id, x, y, topic_id) from PCA(2), joined by key; DQ-8 is ``key_mismatch``.

    ``exclude_topics`` (FLT-5) drops topic ids from the projection's input.
    """
    if exclude_topics:
        emb = emb.join(topics.filter(F.col("topic_id").isin(list(exclude_topics))).select(id_col), id_col, "left_anti")
    base = emb.select(id_col, array_to_vector(vec_col).alias("__raw"))
    model = PCA(k=2, inputCol="__raw", outputCol="__xy").fit(base)
    xy = model.transform(base).select(id_col, vector_to_array("__xy").alias("__a"))
    xy = xy.select(id_col, F.col("__a")[0].alias("x"), F.col("__a")[1].alias("y"))
    return xy.join(topics.select(id_col, "topic_id"), id_col, "inner")


def key_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """DQ-8: keys present on one side only (anti joins both ways), as (side, n)."""
    left = a.select(key).join(b.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("left_only").alias("side"), "n")
    right = b.select(key).join(a.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("right_only").alias("side"), "n")
    return left.unionByName(right)


def save_model(model: TopicModel, path: str) -> None:
    """ML-9: persist a fitted topic model (overwrite): its stages and its topic map."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    rows = [(c, t, cut) for c, (t, cut) in sorted(model.topics.items())]
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(rows, "cluster INT, topic_id INT, cut DOUBLE").write.mode("overwrite").parquet(f"{path}/topics")


def load_model(path: str) -> TopicModel:
    """ML-9: load a saved topic model."""
    rows = SparkSession.getActiveSession().read.parquet(f"{path}/topics").collect()  # ≤ k rows
    return TopicModel(PipelineModel.load(f"{path}/pipeline"), {r["cluster"]: (r["topic_id"], r["cut"]) for r in rows})
