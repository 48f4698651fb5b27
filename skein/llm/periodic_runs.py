"""Periodic runs: stretches of words that repeat with a period, found by Baier grouping.

One map over whole texts without a shuffle.  Words become numbers per slice of
texts; stretches in which nothing repeats are set aside by an exact rule, and
Lyndon arrays under both orders give the runs of the rest (see ``lyndon``).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SLICE_CHARS, prepare, text_slices
from skein.llm.lyndon import repeated_stretches, runs

LEAST_WORDS = 6
LEAST_POWER = 4
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def find_runs(texts: list[list[bytes]], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs (start, length, period), by start and period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(words) for words in texts]
    symbols = np.fromiter((number[w] for words in texts for w in words), np.int64, sum(sizes))
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum([0, *sizes])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in repeated_stretches(symbols, owner):
        doc = int(owner[start])
        offset = start - int(first[doc])
        own = np.unique(symbols[start:end], return_inverse=True)[1]
        found[doc] += [(s + offset, length, p) for s, length, p in runs(own, least, power)]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run repeats after its first period."""
    if found:
        stays = np.ones(len(words), bool)
        for start, length, period in found:
            stays[start + period : start + length] = False
        words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    power: int = LEAST_POWER,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """(id, n_words, runs, collapsed) per row of ``docs``.

    A run is a stretch of words with smallest period q, of max(least, power * q)
    words or more (``least`` 6 and ``power`` 4 at least), that no neighbouring
    word extends keeping that period; ``runs`` has all of them as (start, length,
    period) by start and period, and ``collapsed`` the text without the words
    that repeat a run's first period, joined by one space.  Words are runs of
    characters other than space and U+0009 to U+000D.  ``rewrite`` may change a
    row's words before the search; it gets the id and the words.

    A null or empty text has no words, no runs and an empty text back; repeated
    rows and null ids give one row each; an empty table gives no row.  Of
    overlapping runs each is listed.  Only the two named columns are read, so
    others may have any names.  Time is about linear in a text's words.
    """
    if least < LEAST_WORDS or power < LEAST_POWER:
        raise ValueError("runs of fewer than six words or below exponent 4 are not looked for")
    prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, SLICE_CHARS):
                words = [t.encode().split() for t in texts]  # bytes split at exactly these characters
                if rewrite:
                    words = [rewrite(i, w) for i, w in zip(rows.column(0).to_pylist(), words, strict=True)]
                found = find_runs(words, least, power)
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                offsets = pa.array(np.cumsum([0, *(len(own) for own in found)]), pa.int32())
                left = pa.array([collapsed(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string())
                columns = [rows.column(0), pa.array([len(w) for w in words], pa.int64())]
                columns += [pa.ListArray.from_arrays(offsets, parts), left]
                yield pa.RecordBatch.from_arrays(columns, names=["c0", "n_words", "runs", "collapsed"])

    schema = f"c0 {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    inputs = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    return inputs.mapInArrow(run, schema).withColumnRenamed("c0", id_col)


def planted_cycle(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with, in one of ten documents by the hash of the id, a cycle from some word on; a null id has none."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def _greatest(all_runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first in order."""

    def better(best: Column, r: Column) -> Column:
        return F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)

    return F.aggregate(all_runs, F.get(all_runs, F.lit(0)), better)


def op12_query(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, rewrite=planted_cycle)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", _greatest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", listed), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
