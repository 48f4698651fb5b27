"""Relational operators: dedupe, capping, topic joins, membership, indices, filters.

Scale notes (1000 executors, one key may hold a third of all rows):

* ``dedupe_keep_first`` is a ``min_by`` aggregate per key: partial aggregation
  leaves one row per key per task, so a hot key costs nothing extra.
* ``cap_per_parent`` is a salted two-step top-N (within (key, salt), then within
  key); Spark also inserts a map-side ``WindowGroupLimit`` so each task ships
  ≤ N rows per key, and the final step sees ≤ N × salts rows of a hot key.
* joins against small derived dimensions carry no broadcast hint: AQE measures
  the materialised dimension and broadcasts it only under its threshold.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.constants import (
    DEFAULT_MAX_CHILDREN_PER_PARENT,
    DEFAULT_MIN_COMMENT_COUNT,
    DEFAULT_SEED,
    PAPER_TOPIC_NAMES,
)
from skein.functions.text import comment_text_key
from skein.session import cut_lineage

DEFAULT_SALTS = 64


def require_columns(df: DataFrame, cols: Sequence[str], source: str = "input") -> DataFrame:
    """FLT-11 / DQ-1: raise listing the missing column names (schema only, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks the columns {', '.join(missing)}")
    return df


def file_order(df: DataFrame) -> list[str] | None:
    """The readers' order of rows (JSONL before JSON, then file, split and line), as far as ``df`` has it."""
    return [c for c in ("file_kind", "source_file", "pos_block", "pos") if c in df.columns] or None


def _salt(cols: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts))


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    salts: int = DEFAULT_SALTS,
    salt_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the first ``n`` rows per key under a total ``order`` (WN-8 / WN-4 core).

    Two steps so no task holds more than ``n × salts`` rows of one key:
    rank inside (key, salt), keep ≤ n, then rank inside key, keep ≤ n.
    ``salt_cols`` must not contain only the key (default: all columns).
    """
    salt_cols = list(salt_cols or df.columns)
    rn = "__rn"
    salted = df.withColumn("__salt", _salt(salt_cols, salts))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    step1 = salted.withColumn(rn, F.row_number().over(local)).filter(F.col(rn) <= n).drop(rn, "__salt")
    final = Window.partitionBy(*keys).orderBy(*order)
    return step1.withColumn(rn, F.row_number().over(final)).filter(F.col(rn) <= n).drop(rn)


def dedupe_keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str] | None = None,
) -> DataFrame:
    """AG-1: one row per key, the first by ``order``; null keys compare equal.

    ``order`` defaults to all non-key columns, which is total when whole rows are
    distinct (the ingest readers add ``source_file``/``pos`` for file order).

    Plan: ``min_by(struct(row), struct(order))`` per key with map-side partial
    aggregation (planned as a sort-based aggregate: struct buffers are not
    hash-aggregated), so a key repeated by a third of all rows leaves each task
    as one row, through one shuffle and without a window over whole keys.
    """
    keys = list(keys)
    cols = order or [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(c) for c in rest])
    key_order = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order_cols)])
    kept = df.groupBy(*keys).agg(F.min_by(row, key_order).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def content_dedupe(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """AG-2: distinct (group, normalised text key)."""
    return df.select(F.col(group_col), comment_text_key(text_col).alias("_norm_text")).dropDuplicates([group_col, "_norm_text"])


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """AG-3: distinct non-null ids as strings."""
    return df.select(F.col(col).cast("string").alias(col)).na.drop().distinct()


def seeded_order_key(id_col: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """D-3 / SO-2: reproducible pseudo-random order key, equal in Spark and DuckDB."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def cap_per_parent(
    df: DataFrame,
    parent_col: str = "video_id",
    id_col: str = "id",
    max_rows: int = DEFAULT_MAX_CHILDREN_PER_PARENT,
    seed: int = DEFAULT_SEED,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """WN-4: at most ``max_rows`` children per parent, chosen by a seeded hash order; ≤ 0 = no cap."""
    if max_rows <= 0:
        return df
    order = [seeded_order_key(id_col, seed), F.col(id_col).cast("string")]
    return first_per_key(df, [parent_col], order, max_rows, salts, salt_cols=[id_col])


def eligible_parents(df: DataFrame, count_col: str = "comment_count", min_count: int = DEFAULT_MIN_COMMENT_COUNT) -> DataFrame:
    """FLT-1: parents with ``count_col ≥ min_count``; null or non-numeric → 0."""
    n = F.coalesce(F.col(count_col).cast("string").try_cast("double"), F.lit(0.0))
    return df.filter(F.floor(n) >= min_count)


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """SO-2: total, reproducible shuffle order (a global sort: range-partitioned, not one task)."""
    return df.orderBy(seeded_order_key(id_col, seed), F.col(id_col).cast("string"))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """SRC-9 / SO-4: deterministic limit or bounded page (top-n by key; TakeOrderedAndProject)."""
    return df.orderBy(F.col(key)).limit(n) if n > 0 else df


def sorted_topic_ids(df: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """SO-3: distinct valid topic ids in order (a small range-partitioned sort)."""
    return df.select(F.col(topic_col).alias("topic_id")).filter(valid_topic("topic_id")).distinct().orderBy("topic_id")


def finite(c: Column | str) -> Column:
    """FLT-10: value is not null, not NaN and not ±infinity."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_topic(c: Column | str = "topic_id") -> Column:
    """FLT-4: topic not null and ≥ 0."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & (x >= 0)


def search_filter(
    df: DataFrame,
    terms: Sequence[str],
    text_col: str = "video_description",
    tags_col: str | None = "hashtag_names",
    regions: Sequence[str] | None = None,
    region_col: str = "region_code",
    include_keyword: bool = True,
    include_hashtag: bool = True,
) -> DataFrame:
    """FLT-9: (any term as a whole word in text, case-insensitive) OR (any term among tags)
    AND region in list.  Word characters are letters, digits and ``_``."""
    if not (include_keyword or include_hashtag):
        raise ValueError("search_filter has nothing to search: both text and hashtags are off")
    lowered = [t.lower() for t in terms]
    clauses = []
    if include_keyword and lowered:
        alt = "|".join(re.escape(t) for t in lowered)
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{alt})(?![\p{{L}}\p{{N}}_])"
        clauses.append(F.coalesce(F.lower(F.col(text_col)).rlike(pattern), F.lit(False)))
    if include_hashtag and tags_col and lowered:
        term_arr = F.array(*[F.lit(t) for t in lowered])
        clauses.append(F.coalesce(F.arrays_overlap(F.transform(F.col(tags_col), lambda x: F.lower(x)), term_arr), F.lit(False)))
    cond = F.lit(False)
    for c in clauses:
        cond = cond | c
    if regions:
        cond = cond & F.col(region_col).isin(list(regions))
    return df.filter(cond)


# ---------------------------------------------------------------------------
# Topic joins (JN-1..3, SC-18, SC-20)
# ---------------------------------------------------------------------------


def topic_names(id2topics: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """SC-18: (topic_id, topic_name) for 0..max valid id: the fixed names first, then ``Topic {i+1}``.

    No valid id → the fixed names.  Built from one aggregate (no driver collect).
    """
    spark = id2topics.sparkSession
    fixed = spark.createDataFrame([(i, n) for i, n in enumerate(PAPER_TOPIC_NAMES)], "topic_id INT, fixed_name STRING")
    ids = F.col(topic_col).cast("string").try_cast("int")
    top = id2topics.agg(F.max(F.when(ids >= 0, ids)).alias("m"))
    spine = top.select(
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("m"), F.lit(len(PAPER_TOPIC_NAMES) - 1)))).alias("topic_id")
    )
    return spine.join(F.broadcast(fixed), "topic_id", "left").select(
        "topic_id",
        F.coalesce(F.col("fixed_name"), F.concat(F.lit("Topic "), (F.col("topic_id") + 1).cast("string"))).alias("topic_name"),
    )


def topic_label(topic_id: Column | str = "topic_id") -> Column:
    """SC-20: id + 1 as text, '' when null."""
    x = F.col(topic_id) if isinstance(topic_id, str) else topic_id
    return F.coalesce((x + 1).cast("string"), F.lit(""))


def add_topic_metadata(df: DataFrame, id2topics: DataFrame, names: DataFrame) -> DataFrame:
    """JN-3: keywords (missing → "Outlier"), label, display name (outside the list → "Outlier")."""
    kw = id2topics.select(
        F.col("topic_id").cast("string").try_cast("int").alias("topic_id"), F.col("topic").alias("topic_keywords")
    )
    out = df.withColumn("topic_id", F.col("topic_id").cast("string").try_cast("int"))
    # one row per topic each: broadcast, so that rows never meet by topic in a few partitions
    out = out.join(F.broadcast(kw), "topic_id", "left")
    out = out.join(F.broadcast(names.withColumnRenamed("topic_name", "_name")), "topic_id", "left")
    return out.withColumn("topic_keywords", F.coalesce("topic_keywords", F.lit("Outlier"))).withColumn(
        "topic_label", topic_label("topic_id")
    ).withColumn("topic_name", F.coalesce(F.col("_name"), F.lit("Outlier"))).drop("_name")


def _topic_map(topics: DataFrame) -> DataFrame:
    return topics.select(F.col("id").cast("string").alias("id"), F.col("topic").cast("string").try_cast("int").alias("topic_id"))


def attach_parent_topics(parents: DataFrame, topics: DataFrame, id2topics: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """JN-1 + JN-3: parents ⟕ topics on id, then metadata."""
    names = names if names is not None else topic_names(id2topics)
    out = parents.withColumn("id", F.col("id").cast("string")).join(_topic_map(topics), "id", "left")
    return with_polarity(add_topic_metadata(out, id2topics, names))


def attach_child_topics(children: DataFrame, topics: DataFrame, id2topics: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """JN-2 + JN-3: children inherit the parent's topic through ``video_id``."""
    names = names if names is not None else topic_names(id2topics)
    tm = _topic_map(topics).withColumnRenamed("id", "video_id")
    out = children.withColumn("video_id", F.col("video_id").cast("string")).join(tm, "video_id", "left")
    return with_polarity(add_topic_metadata(out, id2topics, names))


def with_polarity(df: DataFrame, force: bool = True) -> DataFrame:
    """PRJ-5: ``xlm_polarity = positive − negative`` when both inputs exist."""
    if {"xlm_positive", "xlm_negative"} <= set(df.columns) and (force or "xlm_polarity" not in df.columns):
        return df.withColumn("xlm_polarity", F.col("xlm_positive").try_cast("double") - F.col("xlm_negative").try_cast("double"))
    return df


# ---------------------------------------------------------------------------
# Membership, indices
# ---------------------------------------------------------------------------


def children_of(children: DataFrame, parents: DataFrame, parent_key: str = "video_id", key: str = "id") -> DataFrame:
    """JN-6: children whose parent exists (left semi join)."""
    return children.join(parents.select(F.col(key).alias(parent_key)), parent_key, "left_semi")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN-7: rows of ``todo`` whose key is not in ``done`` (left anti join)."""
    return todo.join(done.select(key), key, "left_anti")


def dense_index(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "row_index",
    partitions: int | None = None,
    materialize: bool = True,
) -> DataFrame:
    """WN-7: 0-based dense index over a total order, without a single-task window.

    1. range-partition on the order and sort inside each partition;
    2. ``monotonically_increasing_id`` then encodes (partition, position);
    3. the per-partition row counts (one row per partition: bounded by the
       partition count, never by the data) become offsets by a window over that
       tiny table, joined back by broadcast.

    The positioned rows are written to the reliable checkpoint folder first so
    that counts and positions come from the same materialisation, even when an
    executor is lost and a stage is recomputed.
    """
    positioned = _positioned(df, order, partitions)
    if materialize:
        positioned = cut_lineage(positioned)
    counts = positioned.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    out = positioned.join(F.broadcast(_offsets(counts)), "__pid")  # one row per partition: bounded
    return out.withColumn(name, (F.col("__off") + F.col("__pos")).cast("bigint")).drop("__pid", "__pos", "__off")


def _positioned(df: DataFrame, order: Sequence[Column | str], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of a total order, with the range (``__pid``) and the place in it (``__pos``) of each row."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    mask = (1 << 33) - 1
    # without an explicit count AQE may coalesce neighbouring ranges (order is kept)
    by_range = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    return (
        by_range
        .sortWithinPartitions(*order_cols)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftright(F.col("__mid"), 33))
        .withColumn("__pos", F.col("__mid").bitwiseAND(F.lit(mask)))
        .drop("__mid")
    )


def _offsets(counts: DataFrame) -> DataFrame:
    """(__pid, __off): the sum of ``__n`` over all ranges before (one row per range)."""
    before = F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("__pid", before.alias("__off")).na.fill({"__off": 0})


def running_total(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, under a total order.

    As ``dense_index``: written once in ranges of the order, summed inside each
    range, and the totals of earlier ranges (one row per range) added by a broadcast.
    """
    positioned = cut_lineage(_positioned(df, order))
    sums = positioned.groupBy("__pid").agg(F.sum(value).alias("__n"))
    inside = Window.partitionBy("__pid").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    out = positioned.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.join(F.broadcast(_offsets(sums)), "__pid")
    return out.withColumn(name, (F.col("__off") + F.col("__in")).cast("bigint")).drop("__pid", "__pos", "__off", "__in")


def count_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """DQ-6: number of children whose parent key is absent (one-row result)."""
    orphans = children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("orphans"))
