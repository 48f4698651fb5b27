"""Exact top-k search by inner product: branch and bound over a vertical layout.

Vectors are whole numbers, floor(scale * x) of each component.  A candidate
block stores its dimensions one after the other (all rows of the first, all of
the second, ...), those of most mass first.  A query adds up its scores block of
dimensions by block; what the remaining dimensions can still add is bounded by
the product of the remaining lengths (Cauchy-Schwarz), so a candidate whose
upper bound is below the k-th best lower bound is dropped and the survivors are
moved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import write_shared
from skein.llm.vector_blocks import (
    CANDIDATE_ROWS,
    QUERY_ROWS,
    best,
    cells,
    enough_rows,
    first_of_each,
    packed,
    usable,
)

DIMENSIONS_AT_ONCE = 8
EXACT = 2.0**53


def vertical(matrix: np.ndarray) -> list[bytes]:
    """Whole-number matrix as dimensions × rows."""
    return [matrix.T.astype("<i8").tobytes()]


def search(queries: np.ndarray, candidates: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int):
    """For each query: (index into candidates, score) of its ``k`` best ids, ties to the smaller id.

    ``queries`` and ``candidates`` are dimensions × rows of whole numbers;
    ``c_ids`` ascends.  A query's own id is no candidate.
    """
    dims = len(candidates)
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * dims
    kind = np.float64 if largest < EXACT else np.int64  # both exact; doubles are faster
    order = np.argsort(-np.abs(candidates).sum(1, dtype=np.float64), kind="stable")
    cuts = [order[i : i + DIMENSIONS_AT_ONCE] for i in range(0, dims, DIMENSIONS_AT_ONCE)]
    blocks = [candidates[c].astype(kind) for c in cuts]
    asked = [queries[c].astype(kind) for c in cuts]
    # lengths of what remains behind each block, rounded up a little
    rest = [np.zeros(candidates.shape[1])]
    rest_q = [np.zeros(queries.shape[1])]
    for own, q in zip(blocks[:0:-1], asked[:0:-1]):
        rest.insert(0, np.sqrt(rest[0] ** 2 + (own.astype(np.float64) ** 2).sum(0)) * (1 + 1e-12))
        rest_q.insert(0, np.sqrt(rest_q[0] ** 2 + (q.astype(np.float64) ** 2).sum(0)) * (1 + 1e-12))
    need = enough_rows(c_ids, k)
    for j, own_id in enumerate(q_ids.tolist()):
        alive = np.flatnonzero(c_ids != own_id)
        score = np.zeros(len(alive), kind)
        for block, q, tail, tail_q in zip(blocks, asked, rest, rest_q):
            part = block if len(alive) == block.shape[1] else block[:, alive]
            score = score + q[:, j] @ part
            if len(alive) > 4 * need and tail_q[j] > 0:
                room = tail[alive] * tail_q[j] + 1
                lower = np.partition(score - room, len(alive) - need)[len(alive) - need]
                kept = score + room >= lower
                if 2 * kept.sum() < len(alive):  # worth moving together
                    alive, score = alive[kept], score[kept]
        if len(alive) > need:
            least = np.partition(score, len(alive) - need)[len(alive) - need]
            kept = score >= least
            alive, score = alive[kept], score[kept]
        top = np.lexsort((c_ids[alive], -score))
        top = top[first_of_each(c_ids[alive[top]], k)]
        yield alive[top], score[top].astype(np.int64)


def top_k(
    embeddings: DataFrame,
    is_query: str,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` largest inner products of each query, exactly.

    Queries are the rows for which the SQL condition ``is_query`` on ``id``
    holds, candidates all rows but the query's own, components
    floor(``scale`` * x).  Ties go to the smaller id.  Null, empty, null-holding
    and non-finite vectors take no part; vectors meet only vectors of the same
    length; an id with several vectors counts with the best pair of its own and
    the other's.  An empty table gives no row.  Scores are exact below 2**63.
    """
    rows = usable(embeddings, id_col, vector_col)
    rows = write_shared(
        rows.select("id", F.transform("vector", lambda x: F.floor(x * float(scale)).cast("long")).alias("vector")),
        "vectors",
    )
    queries = packed(rows.where(is_query), QUERY_ROWS, vertical, ["data"])
    candidates = packed(rows, CANDIDATE_ROWS, vertical, ["data"])
    met = cells(queries, candidates).select("q_dim", "q_ids", "q_data", "c_ids", "c_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, q, c_ids, c = (np.frombuffer(p, "<i8") for p in parts)
                for own, (at, score) in zip(
                    q_ids.tolist(), search(q.reshape(dim, -1), c.reshape(dim, -1), q_ids, c_ids, k)
                ):
                    arrays = [pa.array(np.full(len(at), own)), pa.array(c_ids[at]), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score long")
    return best(found, k, [F.desc("score"), F.asc("id")]).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op2_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, "id % 100 = 0")
