"""Vectors in blocks: packing rows into matrices and meeting query blocks with candidate blocks.

A stated query set is compared with all rows cell by cell, a cell being one
query block and one candidate block of bounded sizes.  Blocks are rows of a
shared table, so cells spread over all executors and neither the driver nor a
broadcast ever holds the queries or the candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prepare, write_shared

QUERY_ROWS = 1_024
CANDIDATE_ROWS = 8_192


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vector array<double>) of the different rows that take part.

    Left out: null ids, null or empty vectors, vectors that hold a null, NaN or
    an infinity.  An id stays with all its vectors.
    """
    prepare(embeddings.sparkSession)
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite).distinct()


def packed(rows: DataFrame, size: int, pack: Callable[[np.ndarray], list[bytes]], names: list[str]) -> DataFrame:
    """(dim, rows, ids, ``names``...): blocks of about ``size`` vectors of the same length.

    ``pack`` turns a matrix (rows × dim) into one binary per name.  The number of
    blocks follows from the number of rows; rows are dealt out by a hash of
    id and vector, so blocks are alike in size whatever id or vector is repeated
    and however many partitions there are.
    """
    blocks = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for dim, (ids, vectors) in held.items():
                columns = [[dim], [len(ids)], [np.array(ids, "<i8").tobytes()]]
                columns += [[b] for b in pack(np.stack(vectors))]
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * (len(columns) - 2)
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["dim", "rows", "ids", *names])
            held.clear()

        now = None
        for batch in batches:
            vectors = batch.column(1)
            flat, offsets = vectors.values.to_numpy(), vectors.offsets.to_numpy()
            for k, (own, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if block != now:
                    yield from out()
                    now = block
                vector = flat[offsets[k] : offsets[k + 1]]
                ids, parts = held.setdefault(len(vector), ([], []))
                ids.append(own)
                parts.append(vector)
        yield from out()

    binaries = ", ".join(f"{n} binary" for n in names)
    return dealt.mapInArrow(run, f"dim int, rows int, ids binary, {binaries}")


def cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block beside every candidate block of the same dimension: (q_..., c_...).

    Query blocks are numbered by the partition and place that wrote them; a
    candidate block goes once to each of them, and the two meet by an equal key.
    """
    queries = write_shared(queries.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    candidates = write_shared(candidates, "candidate-blocks")
    numbers = queries.groupBy("dim").agg(F.collect_list("block").alias("blocks"))  # 8 bytes per query block
    left = candidates.join(numbers, "dim").withColumn("block", F.explode("blocks")).drop("blocks")
    left = left.select("block", *(F.col(c).alias(f"c_{c}") for c in candidates.columns))
    right = queries.select(*(F.col(c).alias(f"q_{c}" if c != "block" else c) for c in queries.columns))
    return left.join(right, "block")


def enough_rows(ids: np.ndarray, k: int) -> int:
    """Of rows with these ids, so many best ones hold ``k`` different ids (or all there are): ``k`` if none is repeated."""
    times = np.sort(np.unique(ids, return_counts=True)[1])[::-1]
    return 1 + int(times[: k - 1].sum()) if len(times) >= k else max(len(ids), 1)


def first_of_each(ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` different values, in order."""
    return np.sort(np.unique(ids, return_index=True)[1])[:k]


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` ids of each query_id in ``order``, each with its best score, and their rank from 1."""
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
