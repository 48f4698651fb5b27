"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its character-class trigrams (which symbols, cases, digits
and spaces follow each other), its word lengths and its repetitions (words and
lines).  Labelled documents are weighted by tf-idf, a truncated SVD gives the
latent space, and their vectors (a bounded set) go to every worker.  Every
document is compared with all of them by exact cosine in matrix blocks; its
nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Worker, map_rows, map_texts
from skein.llm.features import held_out, labelled_sample

SAMPLE_ROWS = 4_000  # labelled documents that are learnt from, half of each label
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 256  # documents in one matrix product

# Character classes of UTF-8 bytes: lower, upper, digit, space, line end, sentence marks,
# comma-like, quotes and brackets, the remaining ASCII symbols one by one in five groups, letters beyond ASCII.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".?", ",;:", "!",
           "\"'()[]{}<>", "|", "$%&#*", "@/\\_~^=+-`"]
CLASSES = len(_GROUPS) + 2  # and: beyond ASCII, control characters
WORD_LENGTHS = 24
MARKS = 4
TERMS = CLASSES**3 + WORD_LENGTHS + MARKS


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.int64)
    table[128:] = CLASSES - 2
    for number, group in enumerate(_GROUPS):
        for c in group:
            table[ord(c)] = number
    return table


_CLASS = _class_table()


def terms(text: str) -> np.ndarray:
    """Term counts of a whole text."""
    out = np.zeros(TERMS, np.float32)
    c = _CLASS[np.frombuffer(text.encode(), "u1")]
    if len(c) > 2:
        out[: CLASSES**3] = np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    words = text.split()
    if words:
        lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), WORD_LENGTHS) - 1
        out[CLASSES**3 : CLASSES**3 + WORD_LENGTHS] = np.bincount(lengths, minlength=WORD_LENGTHS)
        lines = text.split("\n")
        out[-4] = sum(map(operator.eq, words, words[1:]))
        out[-3] = sum(map(operator.eq, words, words[2:]))
        out[-2] = len(words) * max(0.0, 1 - 2 * len(set(words)) / len(words))
        out[-1] = len(lines) - len(set(lines))
    return out


def packed(counts: np.ndarray) -> bytes:
    """The terms that occur (16 bits each), then their counts."""
    own = np.flatnonzero(counts)
    return own.astype("<u2").tobytes() + counts[own].astype("<f4").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """Term counts of every row of ``packed``."""
    out = np.zeros((len(rows), TERMS), np.float32)
    for i, row in enumerate(rows):
        n = len(row) // 6
        out[i, np.frombuffer(row, "<u2", n)] = np.frombuffer(row[2 * n :], "<f4", n)
    return out


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency by term
    basis: np.ndarray  # terms × dimensions
    vectors: np.ndarray  # labelled documents × dimensions, length 1
    labels: np.ndarray
    prior: float  # share of label 1 among all labelled rows outside the held-out fold

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1 (0 for texts without terms), in doubles."""
        counts = counts.astype(np.float64)
        tf = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)) * self.weights
        latent = tf @ self.basis.astype(np.float64)
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the neighbours' votes, each weighted by its similarity.

        Similarities count to nine digits and ties go to the vector that comes
        first, so a text's score does not depend on the texts beside it.
        """
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        similar = np.round(self.project(counts) @ self.vectors.T.astype(np.float64), 9)
        n = similar.shape[1]
        k = min(NEIGHBOURS, n)
        order = np.round(similar * 1e9).astype(np.int64) * n - np.arange(n)  # no two are equal
        near = np.sort(np.argpartition(-order, k - 1, axis=1)[:, :k], axis=1)
        # similarities of near texts all lie close to 1; the power spreads them
        votes = np.maximum(np.take_along_axis(similar, near, 1), 0) ** 16
        total = votes.sum(1)
        return np.where(total > 1e-12, (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id"
) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    The terms that occur in those documents, with their counts (``rows`` × a fixed
    number of terms at most), are the only thing that reaches the driver.  Without labels every score is the
    prior, 0.5.
    """
    sample = labelled_sample(docs, labels, label, rows, id_col)

    def worker() -> Worker:
        return lambda texts: [pa.array([packed(terms(t)) for t in texts], pa.binary())]

    found = map_texts(sample, worker, "terms binary", "y", "text").collect()
    share = labels.where(F.col(label).isNotNull() & ~held_out(id_col)).agg(F.avg(label)).first()[0]
    prior = 0.5 if share is None else float(share)
    if not found:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), prior)
    y = np.array([r["y"] for r in found], np.float64)
    found = [bytes(r["terms"]) for r in found]
    counts = unpacked(found)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    tf = np.multiply(np.sqrt(counts, out=counts), idf, out=counts)
    used = np.flatnonzero(tf.any(0))
    left, right = tf[:, used], tf[:, used]
    del counts, tf  # the decomposition is the driver's peak: only the packed counts stay beside it
    gram = left.T @ right
    del left, right
    gram = gram.astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    del gram
    top = np.argsort(-values)[:DIMENSIONS]
    basis = np.zeros((TERMS, len(top)), np.float32)
    basis[used] = vectors[:, top]
    del vectors
    model = Model(idf, basis, np.zeros((0, len(top)), np.float32), y, prior)
    parts = [model.project(unpacked(found[i : i + BLOCK])) for i in range(0, len(found), BLOCK)]
    model.vectors = np.concatenate(parts).astype(np.float32)
    return model


def _scorer(docs: DataFrame, model: Model) -> Callable[[], Worker]:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker() -> Worker:
        own = shared.value

        def run(texts: list[str]) -> list[pa.Array]:
            counts, scores = np.zeros((BLOCK, TERMS), np.float32), []
            for i in range(0, len(texts), BLOCK):  # blocks of one shape, the last one filled up
                block = texts[i : i + BLOCK]
                counts[: len(block)] = [terms(t) for t in block]
                scores.append(own.scores(counts)[: len(block)])
            return [pa.array(np.concatenate(scores), pa.float64())]

        return run

    return worker


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Per row of ``docs``: (id, ``keep``, score), the whole text scored against every labelled vector.

    A null or empty text has no terms, hence the prior as its score; repeated
    rows and null ids give one row each; an empty table gives no row; other
    columns are not read.  No shuffle; the model (at most ``SAMPLE_ROWS``
    vectors and the basis) is broadcast.
    """
    return map_texts(docs, _scorer(docs, model), "score double", id_col, text_col, keep)


ACCEPT = 0.7


def accepted(docs: DataFrame, model: Model, least: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is ``least`` or more; their columns pass through, whatever their names."""
    scored = map_rows(docs, _scorer(docs, model), "score double", text_col)
    return scored.where(F.col("found.score") >= least).select("row.*")


def op10_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )
