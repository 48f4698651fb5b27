"""Ranked lexical search: exact top documents of every item by an integer BM25, over sparse ball trees.

Items go in blocks.  For a block, one pass over whole texts makes the documents'
sparse term counts in the block's vocabulary; statistics over all documents give
weights and lengths; then blocks of documents become ball trees that are searched
best first for all items of the block (see ``ball_tree``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from skein.llm.ball_tree import LEAF, BallTree, Vectors, dimension_groups, query_lengths
from skein.llm.common import SLICE_CHARS, prepare, text_slices, write_shared

TOP = 50
BLOCK_ITEMS, BLOCK_CHARS = 256, 1 << 16  # of a block of items; one longer item is a block of its own
TREE_DOCS, TREE_CELLS = 4096, 1 << 23  # vectors of one tree, and its nodes x terms, at most
FIRST_SHARE = 16  # a first search over one document in so many gives every item a score to beat

# Bytes that end a term become spaces, A-Z become a-z; all bytes of other characters are parts of terms.
_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in set(_KEPT) else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[set[bytes]]]]:
    """(ids, term sets) of blocks of items; texts under one id are one item.  One block at a time is on the driver."""
    ids: list = []
    sets: list[set[bytes]] = []
    chars = 0
    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).orderBy("i").toLocalIterator():
        if ids and row.i == ids[-1]:
            sets[-1].update(terms(row.t))
            continue
        if ids and (len(ids) == BLOCK_ITEMS or chars + len(row.t or "") > BLOCK_CHARS):
            yield ids, sets
            ids, sets, chars = [], [], 0
        ids.append(row.i)
        sets.append(set(terms(row.t)))
        chars += len(row.t or "")
    if ids:
        yield ids, sets


def term_counts(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """(id, n, dims, tfs) per row of ``docs``: all its terms counted, and its counts of the vocabulary's terms."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        width = len(number) + 1
        for batch in batches:
            for rows, texts in text_slices(batch, SLICE_CHARS):
                words = [terms(t) for t in texts]
                sizes = np.array([len(w) for w in words], np.int64)
                known = np.fromiter((number.get(w, -1) for own in words for w in own), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(len(words)), sizes)[known >= 0]
                cell, tf = np.unique(owner * width + known[known >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(cell, np.arange(len(words) + 1) * width).astype(np.int32))
                dims = pa.ListArray.from_arrays(offsets, pa.array((cell % width).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(offsets, pa.array(tf))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), dims, tfs], names=["id", "n", "dims", "tfs"])

    inputs = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    return inputs.mapInArrow(run, f"id {kind}, n bigint, dims array<int>, tfs array<bigint>")


def _statistics(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and per term of the vocabulary the number of documents."""
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(size, np.int64)
    for row in counts.select(F.explode("dims").alias("dim")).groupBy("dim").count().toLocalIterator():
        df[row.dim] = row["count"]
    return total.docs, total.terms or 0, df


def _search(counts: DataFrame, query: Broadcast, least: Broadcast, top: int) -> DataFrame:
    """(item, id, score): each tree's ``top`` documents per item with a score of ``least`` or more."""
    kind = counts.schema["id"].dataType.simpleString()

    def trees(rows: pa.Table) -> pa.RecordBatch:
        weights, groups, lengths, n_docs, n_terms = query.value
        n, dims = rows.column("n").to_pylist(), rows.column("dims").combine_chunks()
        tf = rows.column("tfs").combine_chunks().flatten().to_numpy()
        sizes = dims.value_lengths().to_numpy()
        m = np.array([50 + 50 * x * n_docs // n_terms for x in n], np.int64)
        values = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
        tree = BallTree(Vectors(sizes.astype(np.int64), dims.flatten().to_numpy(), values), weights.shape[1], groups)
        item, row, score = tree.search(weights, lengths, least.value, top)
        ids = rows.column("id").combine_chunks().take(pa.array(row))
        order = pa.table({"i": item, "s": -score, "id": ids}).sort_by([("i", "ascending"), ("s", "ascending"), ("id", "ascending")])
        place = np.arange(len(item)) - np.searchsorted(np.sort(item), np.sort(item))
        best = order.filter(pa.array(place < top))
        score = -best.column("s").to_numpy()
        columns = [best.column("i").combine_chunks().cast(pa.int32()), best.column("id").combine_chunks(), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(LEAF, min(TREE_DOCS, TREE_CELLS * LEAF // (2 * query.value[0].shape[1])))
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in waiting) == size:
                    yield trees(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            yield trees(pa.Table.from_batches(waiting))

    return counts.where(F.size("dims") > 0).mapInArrow(run, f"item int, id {kind}, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, id, score): each item's ``top`` documents with a score above 0, best first, ties to the smaller id.

    Terms are runs of characters other than the ASCII ones that are neither
    letters nor digits, A-Z lowered.  A term in df of N documents weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), its tf occurrences in a document
    of n terms count (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L,
    L being all documents' terms; a score is the sum over the item's terms.

    Null texts have no terms; they, empty ones and items without terms give no
    rows.  Rows that repeat an id are documents of their own, each with its
    place; a null id comes behind all others of its score.  Rows that repeat an
    item's id are one item with the terms of all, null ids too.  Empty tables
    give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    found = None
    for ids, sets in item_blocks(items, item_col, item_text_col):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        if not vocabulary:
            continue
        counts = write_shared(term_counts(own, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "term-counts")
        n_docs, n_terms, df = _statistics(counts, len(vocabulary))
        weigh = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
        weights = np.zeros((len(sets), len(vocabulary)), np.int64)
        for i, own_terms in enumerate(sets):
            for t in own_terms:
                weights[i, vocabulary[t]] = weigh[vocabulary[t]]
        groups = dimension_groups(df)
        query = spark.sparkContext.broadcast((weights, groups, query_lengths(weights, groups), n_docs, n_terms))
        least = np.ones(len(sets), np.int64)
        some = counts.where(F.pmod(F.xxhash64("id", "n"), F.lit(FIRST_SHARE)) == 0)
        for row in _ranked(_search(some, query, spark.sparkContext.broadcast(least), top), top).where(F.col("rank") == top).collect():
            least[row["item"]] = row["score"]  # one row per item of the block
        best = _ranked(_search(counts, query, spark.sparkContext.broadcast(least), top), top)
        kind = items.select(item_col).schema[0].dataType
        names = spark.createDataFrame([Row(item=i, name=v) for i, v in enumerate(ids)], f"item int, name {kind.simpleString()}")
        best = best.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        best = write_shared(best, "ranked")
        found = best if found is None else found.unionByName(best)
    if found is None:
        kinds = (items.select(item_col).schema[0].dataType, docs.select(id_col).schema[0].dataType)
        schema = f"`{item_col}` {kinds[0].simpleString()}, rank int, `{id_col}` {kinds[1].simpleString()}, score bigint"
        found = spark.createDataFrame([], schema)
    return found


def op11_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked_search(docs, benchmark)


_TERMS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest({_TERMS.format(text="coalesce(text, '')")}) AS term FROM documents
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS.format(text="coalesce(text, '')")}) AS term FROM benchmark
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN counts USING (term) JOIN weighed USING (term) JOIN lengths USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}
"""
