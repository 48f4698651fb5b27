"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score; the
document is toxic unless none of its sentences is (noisy-or).  The sentence
weights are learnt from document labels alone, and the sentences that make a
document toxic can then be pointed out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Worker, drop_shared, map_texts, prepare, write_shared
from skein.llm.features import hashed, held_out, labelled_sample

SAMPLE_ROWS = 4_000  # labelled documents that are learnt from, half of each label
BITS = 20  # feature buckets: 2 ** BITS
MIN_DOCUMENTS = 3  # sampled documents that a feature must occur in
MIN_Z = 4.0  # by so many standard errors more often in documents of label 1
ROUNDS = 150
MEMO = 500_000  # words whose weight a worker remembers

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = " \t.,;:!?\"'()[]{}<>|$%&#*_-+=~"


def sentences(text: str) -> list[str]:
    """Sentences of a text in lower case; every text has at least one."""
    return _SENTENCE.findall(text.lower()) or [""]


def word_features(word: str) -> list[str]:
    """A word without the marks around it, and its first four, five and six letters."""
    word = word.strip(_EDGE)
    if not word:
        return []
    return [word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    buckets: np.ndarray  # buckets with a weight, ascending
    weights: np.ndarray
    bias: float
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    def _word(self, word: str) -> float:
        names = word_features(word)
        if not names or not len(self.buckets):
            return 0.0
        found = hashed(names, BITS)
        place = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        return float(self.weights[place][self.buckets[place] == found].sum())

    def sentence_logits(self, parts: list[str]) -> np.ndarray:
        """Logit of each sentence: the bias and the weights of its words."""
        words = [p.split() for p in parts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for word in set(flat).difference(memo):
            memo[word] = self._word(word)
        weights = np.fromiter(map(memo.__getitem__, flat), np.float64, len(flat))
        sums = np.concatenate(([0.0], np.cumsum(weights)))
        ends = np.cumsum(lengths)
        return self.bias + sums[ends] - sums[ends - lengths]

    def score(self, text: str) -> float:
        """Noisy-or of the sentence scores: 1 - product of (1 - score)."""
        return float(-np.expm1(-_softplus(self.sentence_logits(sentences(text))).sum()))

    def locate(self, text: str, least: float) -> list[dict]:
        """Sentences whose own score is ``least`` or more, as code points of ``text``."""
        spans = [m.span() for m in _SENTENCE.finditer(text)]
        if not spans:
            return []
        logits = self.sentence_logits([text[a:b].lower() for a, b in spans])
        scores = 1 / (1 + np.exp(np.clip(-logits, -500, 500)))
        return [{"start": a, "end": b, "score": s} for (a, b), s in zip(spans, scores.tolist()) if s >= least]


def _associated(per_document: DataFrame, n1: int, n0: int) -> np.ndarray:
    """Buckets that occur in clearly more documents of label 1 than of label 0, ascending.

    ``per_document`` is (y, distinct buckets) of each sampled document.  Counted in
    Spark; at most 2 ** BITS numbers reach the driver.
    """
    both, in1 = F.count(F.lit(1)), F.sum("y")
    counts = per_document.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(both.alias("n"), in1.alias("in1"))
    share = F.col("n") / (n1 + n0)
    spread = F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-9
    z = (F.col("in1") / n1 - (F.col("n") - F.col("in1")) / n0) / spread
    found = counts.where((F.col("n") >= MIN_DOCUMENTS) & (z >= MIN_Z)).select("bucket").collect()
    return np.sort(np.array([r["bucket"] for r in found], np.int64))


class Bags:
    """A text's sentences as places of their features among the associated buckets.

    Sentences with equal features count as one that occurs several times, so a
    long text takes no more room than its different sentences with such features.
    """

    def __init__(self, names: np.ndarray):
        self.place = {int(n): i for i, n in enumerate(names)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            places = map(self.place.get, hashed(word_features(word), BITS).tolist())
            found = self.memo[word] = tuple(p for p in places if p is not None)
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, places per different sentence, occurrences of each)."""
        seen = Counter(tuple(sorted(p for w in s.split() for p in self._word(w))) for s in sentences(text))
        flat = np.fromiter(chain.from_iterable(seen), np.int32)
        return flat, np.array(list(map(len, seen)), np.int32), np.array(list(seen.values()), np.int32)


def train(bags: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], names: np.ndarray, share: float) -> Model:
    """Fit the sentence weights to (label, places, places per sentence, occurrences) bags.

    Maximises the noisy-or likelihood with Adam over all bags; labels weigh as
    often as they occur among all labelled rows (``share`` of label 1).
    """
    y = np.array([b[0] for b in bags], np.float64)
    if not len(y) or y.min() == y.max():
        rate = share if not len(y) else float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(np.expm1(-np.log1p(-rate)))))
    feature = np.concatenate([b[1] for b in bags])
    sentence = np.repeat(np.arange(sum(len(b[2]) for b in bags)), np.concatenate([b[2] for b in bags]))
    times = np.concatenate([b[3] for b in bags]).astype(np.float64)
    bag = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, bias = np.zeros(len(names)), -5.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, w[feature], len(bag))
        total = np.bincount(bag, times * _softplus(z), len(bags))
        # d log-likelihood / d total: -1 for label 0, 1 / (exp(total) - 1) for label 1
        slope = weight * np.where(y == 1, 1 / np.expm1(np.clip(total, 1e-6, 500)), -1.0)
        g = times * slope[bag] / (1 + np.exp(np.clip(-z, -500, 500)))
        gradient = np.append(np.bincount(feature, g[sentence], len(names)) - 0.02 * w, g.sum())
        gradient /= len(bags)
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w += move[:-1]
        bias += move[-1]
    return Model(names, w, float(bias))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id"
) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    The sample is written once and read twice: Spark counts the documents of each
    feature and label, then only the occurrences of associated features reach the
    driver, equal sentences of a document as one.  Without labels every sentence
    has the score of an even guess for a whole document.
    """
    prepare(docs.sparkSession)
    sample = write_shared(labelled_sample(docs, labels, label, rows, id_col), "toxicity-sample")
    of = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).agg(F.avg(label)).first()[0]
    share = 0.5 if share is None else float(np.clip(share, 1e-3, 1 - 1e-3))

    def buckets_of() -> Worker:
        def distinct(text: str) -> np.ndarray:
            words = set(chain.from_iterable(s.split() for s in sentences(text)))
            return np.unique(hashed([f for w in words for f in word_features(w)], BITS))

        return lambda texts: [pa.array(list(map(distinct, texts)), pa.list_(pa.int64()))]

    names = np.zeros(0, np.int64)
    if of.get(0) and of.get(1):
        names = _associated(map_texts(sample, buckets_of, "buckets array<bigint>", "y", "text"), of[1], of[0])
    shared = docs.sparkSession.sparkContext.broadcast(names)  # at most 2 ** BITS

    def bags_of() -> Worker:
        own = Bags(shared.value)
        kind = pa.list_(pa.int32())
        return lambda texts: [pa.array(part, kind) for part in zip(*map(own.of, texts))]

    schema = "flat array<int>, lengths array<int>, times array<int>"
    found = map_texts(sample, bags_of, schema, "id", "text", keep=["y"]).collect()
    found.sort(key=lambda r: r["id"])  # the same sums on every run
    drop_shared(sample)
    parts = ("flat", "lengths", "times")
    return train([(r["y"], *(np.array(r[p], np.int32) for p in parts)) for r in found], names, share)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3
) -> DataFrame:
    """Per row of ``docs``: (id, score, offending array<struct<start, end, score>>).

    ``offending`` holds the sentences with a score of ``least`` or more, in
    code points.  A null or empty text is one empty sentence; repeated rows and
    null ids give one row each; an empty table gives no row; other columns are
    not read.  No shuffle; the model (a fixed number of buckets) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def worker() -> Worker:
        own = shared.value

        def run(texts: list[str]) -> list[pa.Array]:
            scores = [own.score(t) for t in texts]
            # a sentence's score never exceeds its document's
            spans = [own.locate(t, least) if s >= least else [] for t, s in zip(texts, scores)]
            return [pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]

        return run

    schema = "score double, offending array<struct<start:bigint,end:bigint,score:double>>"
    return map_texts(docs, worker, schema, id_col, text_col)


TOXIC = 0.3


def op8_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), least=TOXIC)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )
