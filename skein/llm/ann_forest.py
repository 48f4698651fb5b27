"""Approximate nearest neighbours by cosine: a forest of hash-prefix trees.

Each tree gives every vector a long string of bits, the sides of random
hyperplanes it lies on, and is no more than the sorted array of these strings.
A query descends in each tree to its longest matching prefix (binary search),
then all trees ascend together, one bit at a time, until enough candidates
share a prefix with the query.  Candidates are ranked by exact cosine.

The index is made block by block (every row is in one block, with all trees over
that block), written to the shared folder, and a query searches every block.
Equal vectors of a block are one entry of its trees, so copies of one vector
don't count as found candidates more than once.
"""

from __future__ import annotations

import functools
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

TREES = 96
BITS = 24  # length of the hash strings
SEED = 20_240_501
#: Different vectors that a query gathers in each block before it stops ascending: a floor, and a share of the block's.
LEAST_CANDIDATES, CANDIDATE_SHARE = 1_024, 0.3
ROUNDING = 1e-9  # by which cosines from a product in blocks may differ from those made row by row


@functools.lru_cache(maxsize=4)
def hyperplanes(dim: int, trees: int) -> np.ndarray:
    """dim × (trees * BITS) normals; the same in every process."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


def strings(matrix: np.ndarray, trees: int) -> np.ndarray:
    """trees × rows of hash strings, the first bit highest."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    sides = (matrix / norms).astype(np.float32) @ hyperplanes(matrix.shape[1], trees) > 0
    sides = sides.reshape(len(matrix), trees, BITS)
    return (sides @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T.astype("<u4")


def indexed(matrix: np.ndarray, trees: int = TREES) -> list[bytes]:
    """Different vectors, sorted strings of each tree, the vectors they belong to, and the vector of each row."""
    matrix, kind_of = np.unique(matrix.astype("<f8") + 0.0, axis=0, return_inverse=True)  # -0.0 equals 0.0
    own = strings(matrix, trees)
    order = np.argsort(own, axis=1, kind="stable")
    return [
        matrix.tobytes(),
        np.take_along_axis(own, order, 1).tobytes(),
        order.astype("<u2").tobytes(),
        kind_of.astype("<u2").tobytes(),
    ]


def descend(asked: np.ndarray, sorted_strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind) of the run that shares a prefix with each query: levels × trees × queries.

    ``asked`` are the queries' strings, trees × queries; level k stands for a
    prefix of k bits.  One binary search per tree and level for all queries.
    """
    trees, n = asked.shape
    first = np.empty((BITS + 1, trees, n), np.int32)
    behind = np.empty_like(first)
    for level in range(BITS + 1):
        shift = np.uint32(BITS - level)
        least = (asked >> shift) << shift
        most = least | np.uint32((1 << (BITS - level)) - 1)
        for t in range(trees):
            first[level, t] = np.searchsorted(sorted_strings[t], least[t], "left")
            behind[level, t] = np.searchsorted(sorted_strings[t], most[t], "right")
    return first, behind


def gather(first: np.ndarray, behind: np.ndarray, rows: np.ndarray, enough: int) -> np.ndarray:
    """Mark of the rows that share with one query, in some tree, a prefix of the length reached.

    ``first`` and ``behind`` are levels × trees.  All trees ascend together from
    the longest prefixes until ``enough`` different rows are marked; levels whose
    runs are too short even without overlaps are passed at once.
    """
    seen = np.zeros(rows.shape[1], bool)
    sizes = (behind - first).sum(1)
    for level in range(BITS, -1, -1):
        if sizes[level] >= min(enough, rows.shape[1]) or not level:
            for t in np.flatnonzero(behind[level] > first[level]):
                seen[rows[t, first[level, t] : behind[level, t]]] = True
            if seen.sum() >= enough:
                break
    return seen


def nearest(
    embeddings: DataFrame,
    is_query: str,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    least_candidates: int = LEAST_CANDIDATES,
    candidate_share: float = CANDIDATE_SHARE,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each query, by exact cosine in double precision.

    Queries are the rows for which the SQL condition ``is_query`` on ``id``
    holds, candidates all rows but the query's own; ties go to the smaller id.
    Null, empty, zero, null-holding and non-finite vectors take no part;
    vectors meet only vectors of the same length; an id with several vectors
    counts with the best pair of its own and the other's.  An empty table gives
    no row.
    """
    rows = usable(embeddings, id_col, vector_col).where(F.exists("vector", lambda x: x != 0.0))
    rows = write_shared(rows, "vectors")
    index = packed(rows, CANDIDATE_ROWS, lambda m: indexed(m, trees), ["data", "strings", "order", "kind_of"])
    queries = packed(rows.where(is_query), QUERY_ROWS, lambda m: [m.astype("<f8").tobytes()], ["data"])
    met = cells(queries, index).select("q_dim", "q_ids", "q_data", "c_ids", "c_data", "c_strings", "c_order", "c_kind_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, c_ids = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[2], "<i8")
                q, c = (np.frombuffer(p, "<f8").reshape(-1, dim) for p in (parts[1], parts[3]))
                sorted_strings = np.frombuffer(parts[4], "<u4").reshape(trees, -1)
                order = np.frombuffer(parts[5], "<u2").reshape(trees, -1)
                kind_of = np.frombuffer(parts[6], "<u2")
                # the rows of vector v, by id: rows[start[v] : start[v + 1]]
                rows = np.lexsort((c_ids, kind_of))
                start = np.searchsorted(kind_of[rows], np.arange(len(c) + 1))
                need = enough_rows(c_ids, k)
                asked, place = set(q_ids.tolist()), {}
                for own, v in zip(c_ids.tolist(), kind_of.tolist()):
                    if own in asked:
                        place.setdefault(own, []).append(v)
                first, behind = descend(strings(q, trees), sorted_strings)
                norms = np.array([np.sqrt(np.dot(v, v)) for v in c])
                enough = max(least_candidates, int(candidate_share * len(c)))
                for j, own in enumerate(q_ids.tolist()):
                    seen = gather(first[:, :, j], behind[:, :, j], order, enough)
                    for v in place.get(own, []):
                        if (c_ids[rows[start[v] : start[v + 1]]] == own).all():
                            seen[v] = False  # no other id has this vector
                    at = np.flatnonzero(seen)
                    score = (c[at] @ q[j]) / (norms[at] * np.sqrt(np.dot(q[j], q[j])))
                    if len(at) > need:  # all ties of the k-th best
                        at = at[score >= np.partition(score, len(at) - need)[len(at) - need] - ROUNDING]
                    score = (c[at] * q[j]).sum(1)  # row by row, so that equal vectors have equal scores
                    score /= norms[at] * np.sqrt(np.dot(q[j], q[j]))
                    # the k smallest ids of each vector suffice, and one more for the query's own
                    meant = [rows[start[v] : min(start[v + 1], start[v] + k + 1)] for v in at.tolist()]
                    score = np.repeat(score, [len(m) for m in meant])
                    at = np.concatenate([*meant, np.zeros(0, np.int64)])
                    score, at = score[c_ids[at] != own], at[c_ids[at] != own]
                    top = np.lexsort((c_ids[at], -score))
                    top = top[first_of_each(c_ids[at[top]], k)]
                    arrays = [pa.array(np.full(len(top), own)), pa.array(c_ids[at[top]]), pa.array(score[top])]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score double")
    return best(found, k, [F.desc("score"), F.asc("id")]).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op4_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, "id % 50 = 0")
