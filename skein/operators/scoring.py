"""Per-row model scores (ML-1 … ML-6): batched inference, lexicon sentiment and a
trained offline toxicity/quality scorer.

* ``batch_score`` wraps any model behind ``pyspark.ml.functions.predict_batch_udf``:
  the model is built once per Python worker and fed Arrow batches of
  ``batch_size`` texts; no row-at-a-time Python.
* ``lexicon_sentiment`` loads the lexicon once per worker, like model weights,
  and scores each Arrow batch as flat arrays; no shuffle.
* ``train_text_classifier`` fits an MLlib pipeline (tokens → hashed TF → IDF →
  logistic regression) on labelled rows; ``apply_text_classifier`` scores any table.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import SENTIMENT_LABELS, TOXICITY_COLUMNS, VADER_COLUMNS, XLM_COLUMNS
from skein.functions.scalar import argmax_label, softmax3
from skein.functions.text import text_or_empty
from skein.operators.sentence_rules import by_slices, rule_sentiment
from skein.session import bound_batches

DEFAULT_BATCH = 128
_WORD = regex.compile(r"[\p{L}']+")
VADER_ALPHA = 15.0  # normaliser of the published compound score


# ---------------------------------------------------------------------------
# ML-1 / ML-3 / ML-5: batched inference
# ---------------------------------------------------------------------------


def batch_score(
    df: DataFrame,
    text_col: str,
    model_factory: Callable[[], Callable[[np.ndarray], np.ndarray | dict]],
    return_type: T.DataType,
    out_col: str,
    batch_size: int = DEFAULT_BATCH,
) -> DataFrame:
    """Run ``model_factory()`` (built once per worker) on Arrow batches of texts.

    The factory returns ``predict(texts: np.ndarray[str]) -> np.ndarray`` (array
    or struct-like dict of arrays for ``StructType`` results).
    """
    bound_batches(df.sparkSession)
    udf = predict_batch_udf(model_factory, return_type=return_type, batch_size=batch_size)
    return df.withColumn(out_col, udf(text_or_empty(text_col)))


def sentiment_from_logits(df: DataFrame, logits_col: str) -> DataFrame:
    """ML-1 tail (SC-15, PRJ-4): softmax → xlm_negative/neutral/positive, label, polarity."""
    probs = softmax3(logits_col)
    out = df.drop(*[c for c in XLM_COLUMNS if c in df.columns]).withColumn("__p", probs)
    out = out.withColumns(
        {
            "xlm_negative": F.col("__p")[0],
            "xlm_neutral": F.col("__p")[1],
            "xlm_positive": F.col("__p")[2],
            "xlm_sentiment": argmax_label("__p", SENTIMENT_LABELS),
        }
    ).withColumn("xlm_polarity", F.col("xlm_positive") - F.col("xlm_negative"))
    return out.drop("__p", logits_col)


def toxicity_columns(df: DataFrame, struct_col: str, prefix: str = "detoxify_") -> DataFrame:
    """ML-3 tail (PRJ-4): replace all ``detoxify_*`` columns by the struct's fields."""
    fields = [f.name for f in df.schema[struct_col].dataType.fields]
    base = df.drop(*[c for c in df.columns if c.startswith(prefix)])
    return base.select(*[c for c in base.columns if c != struct_col], *[F.col(f"{struct_col}.{f}").alias(f"{prefix}{f}") for f in fields])


def hashed_linear_model(n_outputs: int, dim: int = 1 << 16, seed: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A deterministic stand-in model: hashed bag of words × seeded weight matrix → logits.

    Used where real weights are not available offline; any model with the same
    call signature (e.g. an ONNX session) plugs into ``batch_score`` unchanged.
    """

    def factory():
        import pandas as pd

        rng = np.random.default_rng(seed)
        weights = rng.normal(0, 1, size=(dim, n_outputs)).astype(np.float32)

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), n_outputs), dtype=np.float32)
            words = pd.Series(texts, dtype="object").fillna("").str.lower().str.split()
            lens = words.str.len().to_numpy()
            if lens.sum() == 0:
                return out
            flat = np.concatenate([np.asarray(w, dtype=object) for w in words if len(w)])
            idx = (pd.util.hash_array(flat) % np.uint64(dim)).astype(np.int64)  # fixed-key hash: same in every process
            rows = np.flatnonzero(lens)
            starts = np.concatenate([[0], np.cumsum(lens[rows])[:-1]])
            sums = np.add.reduceat(weights[idx], starts, axis=0)
            out[rows] = sums / lens[rows][:, None]
            return out

        return predict

    return factory


def score_frame(
    df: DataFrame,
    text_col: str = "processed_text",
    sentiment_factory=None,
    toxicity_factory=None,
    toxicity_keys: Sequence[str] = tuple(c.removeprefix("detoxify_") for c in TOXICITY_COLUMNS),
    lexicon: Mapping[str, float] | DataFrame | None = None,
    batch_size: int = DEFAULT_BATCH,
    limit_rows: int = 0,
    order_key: str | None = None,
    sentence_rules: bool = False,
) -> DataFrame:
    """ML-4: check the text column, optional deterministic limit, run the enabled scorers.

    ``sentence_rules`` scores the lexicon's words in their context (``rule_sentiment``)."""
    if text_col not in df.columns:
        raise ValueError(f"input is missing text column {text_col!r}")
    out = df.orderBy(order_key or df.columns[0]).limit(limit_rows) if limit_rows > 0 else df
    if sentiment_factory is not None:
        arr = T.ArrayType(T.FloatType())
        out = sentiment_from_logits(batch_score(out, text_col, sentiment_factory, arr, "__logits", batch_size), "__logits")
    elif {"xlm_positive", "xlm_negative"} <= set(out.columns) and "xlm_polarity" not in out.columns:
        out = out.withColumn("xlm_polarity", F.col("xlm_positive") - F.col("xlm_negative"))  # PRJ-5
    if lexicon is not None:
        out = (rule_sentiment if sentence_rules else lexicon_sentiment)(out, text_col, lexicon)
    if toxicity_factory is not None:
        st = T.StructType([T.StructField(k, T.FloatType()) for k in toxicity_keys])
        out = toxicity_columns(batch_score(out, text_col, toxicity_factory, st, "__tox", batch_size), "__tox")
    return out


# ---------------------------------------------------------------------------
# ML-2: lexicon sentiment
# ---------------------------------------------------------------------------


def lexicon_sentiment(df: DataFrame, text_col: str, lexicon: Mapping[str, float]) -> DataFrame:
    """ML-2: vader_neg/neu/pos/compound from word valences, row by row.

    Words are runs of letters and apostrophes in lower case.  Every word scores
    its valence (0 when unknown); positive valences add v + 1, negative add
    v − 1, zeros count as neutral; neg/neu/pos are shares of their total and
    compound = s / sqrt(s² + 15).  Texts without words score 0.  Negation,
    booster and punctuation rules are those of ``rule_sentiment``.

    The lexicon goes to the workers like the weights of a model, once per
    worker; a slice of an Arrow batch, bounded in characters, is scored as one flat
    array of valences.  No key, no shuffle, no join back; rows with repeated or null ids are rows like others.
    """
    shared = df.sparkSession.sparkContext.broadcast(dict(lexicon))
    fields = T.StructType([T.StructField(c, T.DoubleType()) for c in VADER_COLUMNS])

    def frame(texts: Sequence[str | None]) -> pd.DataFrame:
        valence = shared.value
        lengths, values = np.zeros(len(texts), np.int64), array("d")
        for i, t in enumerate(texts):  # no list of words outlives its text
            own = _WORD.findall(t.lower()) if t else []
            lengths[i] = len(own)
            values.extend(valence.get(w, 0.0) for w in own)
        flat = np.array([*values, 0.0])
        starts = np.minimum(np.cumsum(lengths) - lengths, len(flat) - 1)

        def total(values: np.ndarray) -> np.ndarray:
            return np.where(lengths > 0, np.add.reduceat(values, starts), 0.0) if len(lengths) else np.zeros(0)

        positive, negative = flat > 0, flat < 0
        pos = total(np.where(positive, flat + 1, 0.0))
        neg = np.abs(total(np.where(negative, flat - 1, 0.0)))
        neu = lengths - total((positive | negative).astype(np.float64))
        s, whole = total(flat), np.maximum(pos + neg + neu, 1e-300)
        columns = (neg / whole, neu / whole, pos / whole, s / np.sqrt(s * s + VADER_ALPHA))
        return pd.DataFrame(dict(zip(("vader_neg", "vader_neu", "vader_pos", "vader_compound"), columns)))[list(VADER_COLUMNS)]

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield by_slices(texts, frame)

    bound_batches(df.sparkSession)
    scored = F.pandas_udf(score, fields)(F.col(text_col))
    base = df.drop(*(c for c in VADER_COLUMNS if c in df.columns))
    return base.withColumn("__lex", scored).select(*base.columns, *(F.col(f"__lex.{c}").alias(c) for c in VADER_COLUMNS))


# ---------------------------------------------------------------------------
# ML-6: trained offline scorer
# ---------------------------------------------------------------------------


def train_text_classifier(
    labelled: DataFrame, text_col: str, label_col: str, num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01
) -> PipelineModel:
    """MLlib pipeline: regex tokens → hashed TF → IDF → logistic regression."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[^\p{L}]+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol="__feat")
    lr = LogisticRegression(featuresCol="__feat", labelCol=label_col, maxIter=max_iter, regParam=reg, probabilityCol="__prob")
    data = labelled.select(text_or_empty(text_col).alias(text_col), F.col(label_col).cast("double").alias(label_col))
    return Pipeline(stages=[tok, tf, idf, lr]).fit(data)


def apply_text_classifier(model: PipelineModel, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Probability of the positive class as ``out_col``; model columns dropped."""
    scored = model.transform(df.withColumn(text_col, text_or_empty(text_col)))
    keep = [c for c in df.columns if c != out_col]
    return scored.select(*keep, vector_to_array("__prob")[1].alias(out_col))
