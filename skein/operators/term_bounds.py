"""TXT-1 without a table of all n-grams: the best terms of each topic by bounds.

Nearly all n-grams of a corpus are rare and can't be among a topic's best, yet a
count by (topic, term) moves every one of them.  Here terms are first counted in
hash buckets, whose number is fixed: at most topics × ``BUCKETS`` rows leave a
task, whatever the text.  A bucket's counts bound the score of every term in it:

* a term occurs ``f`` ≤ c times in the topic (c: the bucket's count there) and
  ``F`` ≤ C times in all (C: the bucket's total);
* with r = f / F the score is sqrt(F (1+r)(2-r) / 3) · (ln((1+r) / (2-r)) + ln(rest)),
  and rest ≤ (2N - n) / (n + N - c - C).  Over each interval of r every factor is
  replaced by its largest value there (``score_bound``).

Only the terms of buckets whose bound reaches a guess of the n-th best score are
counted as strings, over all topics, so their scores are exact.  The exact n-th
best then shows which further buckets could still hold a better term; those are
counted in a second round, after which none is left.  The guess decides how much
is counted, never what comes out.

Both counts run over Arrow batches: a batch's different words are numbered and
hashed once each, n-grams are runs of these numbers, and only the different
n-grams of chosen buckets are put together as strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import bound_batches, cut_lineage, ship_package

BUCKETS = 1 << 16  # rows per topic of the first count; also bounds the broadcast lists of buckets
HELD = 64  # topics whose counts a task holds at a time, 8 bytes per bucket each
GUESS_SHARE = 0.5  # buckets are counted from this share of the guessed n-th best score on
_RATIOS = (0.0, 1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)
_ROUNDING = 1e-6  # scores are ranked with 9 digits
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def score_bound(c: Column, total: Column, n_i: Column, big_n: Column) -> Column:
    """Upper bound on the log-odds z-score of every term that occurs at most ``c`` times in
    the topic and at most ``total`` times in all topics."""
    c, total, n_i, big_n = (x.cast("double") for x in (c, total, n_i, big_n))
    rest = F.ln(F.greatest(F.lit(1.0), 2 * big_n - n_i) / F.greatest(F.lit(1.0), n_i + big_n - c - total))
    bounds = []
    for low, high in zip(_RATIOS, _RATIOS[1:]):
        at = min(max(0.5, low), high)  # (1+r)(2-r) is largest at r = 1/2
        mass = F.least(total, c / low) if low else total
        odds = F.ln(F.lit((1 + high) / (2 - high))) + rest
        bounds.append(F.sqrt(mass * ((1 + at) * (2 - at) / 3)) * F.greatest(F.lit(0.0), odds))
    return F.greatest(*bounds)


class _Ngrams:
    """Uni-, bi- and trigrams of a batch (topic, words joined by single spaces), as numbers of its different words.

    ``first`` is the place of an n-gram's first word in ``word`` and ``n`` its length.
    """

    def __init__(self, batch: pa.RecordBatch, buckets: int) -> None:
        lists = pc.split_pattern(batch.column(1).cast(pa.large_string()).fill_null(""), " ")
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
        topics = batch.column(0).dictionary_encode(null_encoding="encode")
        self.topics = topics.dictionary
        names = self.words.to_pylist()
        hashes = np.array([zlib.crc32(w.encode()) for w in names], np.uint64)[self.word]  # the same in every process
        first, length, mixed = [], [], []
        fit = np.array([w != "" for w in names], bool)[self.word]  # the first word of an n-gram of the length reached
        mix = np.zeros(len(row), np.uint64)
        for n in range(3):
            more = max(0, len(row) - n)
            fit = fit[:more] & fit[len(fit) - more :] & (row[:more] == row[n:]) if n else fit
            mix = (mix[:more] * _SPREAD + hashes[n:]) * _SPREAD
            at = np.flatnonzero(fit)
            first.append(at)
            length.append(np.full(len(at), n + 1, np.int8))
            mixed.append(mix[at])
        self.first, self.n = np.concatenate(first), np.concatenate(length)
        mixed = np.concatenate(mixed)
        self.bucket = ((mixed ^ mixed >> np.uint64(29)) * _SPREAD >> np.uint64(32)) % np.uint64(buckets)
        self.bucket = self.bucket.astype(np.int64)
        self.topic = topics.indices.to_numpy().astype(np.int64)[row[self.first]]


def _bucket_counts(words: DataFrame, buckets: int) -> DataFrame:
    """(topic, bucket, c): the n-grams of each topic by hash bucket, added up within each task for ``HELD`` topics at a time."""
    kind = words.schema["topic"].dataType.simpleString()

    def rows(held: dict[Any, np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for topic, c in held.items():
            at = np.flatnonzero(c)
            columns = [pa.array([topic], kind).take(pa.array(np.zeros(len(at), np.int32))), pa.array(at.astype(np.int32)), pa.array(c[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["topic", "bucket", "c"])
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, np.ndarray] = {}
        topics = None
        for batch in batches:
            found = _Ngrams(batch, buckets)
            place, c = np.unique(found.topic * buckets + found.bucket, return_counts=True)
            topics = found.topics.type
            ends = np.searchsorted(place, np.arange(len(found.topics) + 1) * buckets)
            for i, topic in enumerate(found.topics.to_pylist()):
                if topic not in held and len(held) == HELD:
                    yield from rows(held, topics)
                own = slice(ends[i], ends[i + 1])
                held.setdefault(topic, np.zeros(buckets, np.int64))[place[own] - i * buckets] += c[own]
        yield from rows(held, topics)

    counts = words.select("topic", "words").mapInArrow(count, f"topic {kind}, bucket int, c bigint")
    return counts.groupBy("topic", "bucket").agg(F.sum("c").alias("c"))


def _exact(words: DataFrame, chosen: DataFrame, buckets: int) -> DataFrame:
    """(topic, term, f_i) of all terms in the chosen buckets (at most ``buckets`` numbers go to the tasks)."""
    wanted = np.zeros(buckets, bool)
    wanted[[r["bucket"] for r in chosen.collect()]] = True
    kind = words.schema["topic"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Ngrams(batch, buckets)
            hit = wanted[found.bucket]
            first, n = found.first[hit], found.n[hit]
            columns = {"t": pa.array(found.topic[hit])}
            for i in range(3):
                place = np.minimum(first + i, max(0, len(found.word) - 1))
                columns[f"w{i}"] = pa.array(found.word[place], mask=n <= i)
            counted = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            parts = [found.words.take(counted.column(f"w{i}").combine_chunks()) for i in range(3)]
            term = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()), null_handling="skip")
            topic = found.topics.take(counted.column("t").combine_chunks())
            columns = [topic, term.cast(pa.string()), counted.column("count_all").combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, names=["topic", "term", "f_i"])

    counts = words.select("topic", "words").mapInArrow(count, f"topic {kind}, term string, f_i bigint")
    return cut_lineage(counts.groupBy("topic", "term").agg(F.sum("f_i").alias("f_i")))


def bounded_top_terms(words: DataFrame, top_n: int, score, rank, buckets: int = BUCKETS) -> DataFrame:
    """(topic, rank, term, z_score): the ``top_n`` best n-grams of each topic.

    ``words`` is (topic, words), the words joined by single spaces, and is read two or three
    times.  ``score(f_i, big_f, n_i, big_n)`` is the log-odds z-score and ``rank(scores, top_n)``
    keeps the best rows of a topic; ties go as ``rank`` says.  A topic with fewer terms gives
    all of them, an empty table gives no row.
    """
    ship_package(words.sparkSession)
    bound_batches(words.sparkSession)
    counts = cut_lineage(_bucket_counts(words, buckets))
    big_n = F.lit(counts.agg(F.sum("c")).first()[0] or 0)
    # written, so that Spark knows its size: joined by a broadcast where it is small, never dealt by topic then
    sizes = cut_lineage(counts.groupBy("topic").agg(F.sum("c").alias("n_i")))
    totals = counts.groupBy("bucket").agg(F.sum("c").alias("total"))  # at most ``buckets`` rows
    known = counts.join(F.broadcast(totals), "bucket").join(sizes, "topic")
    # the heaviest term of a bucket, about: its count less what a bucket holds on average
    f = F.greatest(F.lit(1.0), F.col("c") - F.col("n_i") / buckets)
    big_f = F.greatest(f, F.col("total") - big_n / F.lit(buckets))
    known = cut_lineage(
        known.select(
            "topic", "bucket",
            score_bound(F.col("c"), F.col("total"), F.col("n_i"), big_n).alias("bound"),
            score(f, big_f, F.col("n_i"), big_n).alias("guess"),
        )
    )

    def nth_best(df: DataFrame, col: str) -> DataFrame:
        """(topic, least): the ``top_n``-th best value; null where there are fewer."""
        order = Window.partitionBy("topic").orderBy(F.col(col).desc())
        best = df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
        return best.groupBy("topic").agg(F.when(F.count(F.lit(1)) == top_n, F.min(col)).alias("least"))

    def scored(exact: DataFrame) -> DataFrame:
        total = F.sum("f_i").over(Window.partitionBy("term"))
        rows = exact.withColumn("big_f", total).join(sizes, "topic")
        rows = rows.withColumn("z_score", score(F.col("f_i"), F.col("big_f"), F.col("n_i"), big_n))
        return rows.withColumn("term", F.translate("term", " ", "_"))

    least = F.coalesce(F.greatest(F.col("least"), F.lit(0.0)), F.lit(0.0))
    reach = F.col("bound") >= least * GUESS_SHARE
    chosen = cut_lineage(known.join(nth_best(known, "guess"), "topic").where(reach).select("bucket").distinct())
    exact = _exact(words, chosen, buckets)
    best = rank(scored(exact), top_n).select("topic", "rank", "term", "z_score")
    # buckets not counted yet that could hold a term as good as the n-th best
    left = known.join(F.broadcast(chosen), "bucket", "left_anti").join(nth_best(best, "z_score"), "topic", "left")
    open_ = F.col("least").isNull() | (F.col("bound") >= F.col("least") - _ROUNDING)
    more = cut_lineage(left.where(open_).select("bucket").distinct())
    if more.isEmpty():
        return best
    exact = exact.unionByName(_exact(words, more, buckets))
    return rank(scored(exact), top_n).select("topic", "rank", "term", "z_score")
