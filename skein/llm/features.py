"""Hashed text features for the classifiers (run inside workers)."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT_FOLD = 2


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 4, is 2 (a null id is never held out)."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents outside the held-out fold.

    Half of the bound goes to each label, in the order of a hash of the id, so
    the sample is the same on every run.  Only the chosen ids (a bounded set)
    are broadcast; an id that is repeated in ``labels`` with different values
    has the larger one; of an id with several documents the smallest text counts.
    """
    own = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("int").alias("y"))
    )
    of = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        # by the hash alone about one and a half times the bound is left, whatever the number of rows
        share = min(1.0, 1.5 * (rows // 2) / max(of.get(y, 0), 1))
        order = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        some = own.where((F.col("y") == y) & (order < int(share * (1 << 40)))).orderBy(order, "id").limit(rows // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # bounded: ``rows`` ids
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def hashed(names: list[str], bits: int) -> np.ndarray:
    """Bucket of each feature name."""
    crc, mask = zlib.crc32, (1 << bits) - 1
    return np.fromiter((crc(n.encode()) & mask for n in names), np.int64, len(names))
