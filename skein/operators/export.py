"""Privacy-safe indexed export (PIPE-6): sparse-date fixed point (SET-4, AG-16),
dense indices (WN-7), key → index lookup (JN-8) and validation (DQ-3 … DQ-7)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.constants import (
    CHILD_EXPORT_COLUMNS,
    DEFAULT_MIN_ENTRIES_PER_DATE,
    DISALLOWED_EXPORT_COLUMNS,
    PARENT_EXPORT_COLUMNS,
    SENTIMENT_COLUMNS,
    TOXICITY_COLUMNS,
)
from skein.functions.scalar import epoch_to_date_str
from skein.operators.relational import count_orphans, dedupe_keep_first, dense_index, file_order, require_columns, running_total
from skein.session import cut_lineage


def date_counts(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """AG-7 / SET-2: rows per date over both tables (null dates dropped)."""
    both = videos.select("date").unionAll(comments.select("date"))
    return both.filter(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def _parent_dates(videos: DataFrame) -> DataFrame:
    """(video_id, dates): the sorted dates of every parent."""
    return videos.groupBy(F.col("id").alias("video_id")).agg(F.sort_array(F.collect_set("date")).alias("dates"))


def _date_links(videos: DataFrame, comments: DataFrame) -> DataFrame:
    """(dates, date, n): children by their date and the sorted dates of their parent (null: no parent).

    Survival of a row depends on dates alone, so this is all that the fixed point
    reads of the children: with one date per parent at most days × days rows,
    whatever the tables' size.  Children are counted per (parent, date) before
    the one shuffle that meets their parents.
    """
    children = comments.groupBy("video_id", "date").agg(F.count(F.lit(1)).alias("n"))
    linked = children.join(_parent_dates(videos), "video_id", "left")
    return linked.groupBy("dates", "date").agg(F.sum("n").alias("n"))


def _living(links: DataFrame, dates: DataFrame) -> DataFrame:
    """Links whose date, and one date at least of whose parent, is in ``dates``."""
    own = links.join(dates, "date", "left_semi")
    by_parent = own.withColumn("__parent", F.explode("dates")).join(dates.toDF("__parent"), "__parent", "left_semi")
    return by_parent.groupBy("dates", "date").agg(F.max("n").alias("n"))


def filter_sparse_dates(
    videos: DataFrame,
    comments: DataFrame,
    min_entries: int = DEFAULT_MIN_ENTRIES_PER_DATE,
) -> tuple[DataFrame, DataFrame, int]:
    """SET-4: drop dates with fewer than ``min_entries`` rows over both tables, then children
    whose date or parent is gone; repeat until neither count changes.

    The wide tables are read once to count parents by date and children by
    (parent's dates, date); both counts are written to the shared folder.  A pass
    is one job over these small tables and neither writes nor reads rows again.
    The loop's whole state is the set of living dates, one value per day of the
    calendar on the driver.  At the end the wide tables are semi-joined once.
    Null dates never live; a null parent key has no parent; a parent with rows on
    several dates lives while one of them does.
    Returns (videos, comments, passes incl. the confirming one).
    """
    dates, n_pass = _living_dates(videos, _date_links(videos, comments), min_entries)
    v_out = videos.join(dates, "date", "left_semi").select(*videos.columns)
    c_out = comments.join(dates, "date", "left_semi").join(
        v_out.select(F.col("id").alias("video_id")), "video_id", "left_semi"
    )
    return v_out, c_out.select(*comments.columns), n_pass


def _living_dates(videos: DataFrame, links: DataFrame, min_entries: int) -> tuple[DataFrame, int]:
    """The fixed point of ``filter_sparse_dates``: (dates that live, to be broadcast; passes)."""
    spark = videos.sparkSession
    by_date = cut_lineage(videos.groupBy("date").agg(F.count(F.lit(1)).alias("n")))
    links = cut_lineage(links)
    kind = by_date.select("date").schema

    def counts(parents: DataFrame, children: DataFrame) -> list[tuple]:
        """(children?, date, rows): two values per day at most."""
        both = parents.select(F.lit(False).alias("child"), "date", "n").unionAll(children.select(F.lit(True), "date", "n"))
        return both.groupBy("child", "date").agg(F.sum("n").alias("n")).collect()

    def totals(rows: list[tuple]) -> tuple[int, int]:
        return sum(n for child, _, n in rows if not child), sum(n for child, _, n in rows if child)

    rows, n_pass = counts(by_date, links), 0
    while True:  # every pass but the last removes rows
        n_pass += 1
        per_date: Counter = Counter()
        for _, date, n in rows:
            if date is not None:
                per_date[date] += n
        living = [(date,) for date, n in sorted(per_date.items()) if n >= min_entries]
        dates = F.broadcast(spark.createDataFrame(living, kind))  # days of the calendar
        left = counts(by_date.join(dates, "date", "left_semi"), _living(links, dates))
        if totals(left) == totals(rows):
            return dates, n_pass
        rows = left


def build_exports(
    videos: DataFrame,
    comments: DataFrame,
    min_entries: int = DEFAULT_MIN_ENTRIES_PER_DATE,
    video_order: Sequence[str] = ("create_time", "id"),
    comment_order: Sequence[str] = ("video_id", "id"),
) -> tuple[DataFrame, DataFrame, int]:
    """PIPE-6: require columns → dedupe → UTC dates → SET-4 → dense indices → orphan check →
    fixed column lists.  Index order is explicit (``video_order``/``comment_order``).

    The children's wide rows are moved once, to their parents, and only where the child
    export is read: everything before takes their keys and times.  All steps on children
    (first row of a key, counts by parent and date, place within the parent) meet in the
    partition of their parent, of whom the pipeline keeps at most
    ``DEFAULT_MAX_CHILDREN_PER_PARENT`` children; a child's index is its place there after
    the children of all parents before (under an order that doesn't start with the parent:
    ``dense_index`` over the rows).  Children without a parent key are counted apart.
    """
    scores = [*TOXICITY_COLUMNS, *SENTIMENT_COLUMNS]
    require_columns(videos, ["id", "topic_name", "create_time", *scores], "videos")
    require_columns(comments, ["id", "video_id", "create_time", *scores], "comments")
    v = dedupe_keep_first(videos, ["id"], file_order(videos))
    v = v.withColumn("id", F.col("id").cast("string")).withColumn("date", epoch_to_date_str("create_time"))
    # read three times below (fixed point, index, export): deduped once, as Parquet in the shared folder
    if all(isinstance(x, str) for x in video_order):
        v = v.select(*dict.fromkeys(["id", "topic_name", "date", *scores, *video_order]))
    v = cut_lineage(v)
    c = comments.withColumn("video_id", F.col("video_id").cast("string"))
    counts = cut_lineage(_counts_by_parent(c, _parent_dates(v)))
    links = counts.groupBy("dates", "date").agg(F.sum("n").alias("n"))
    dates, passes = _living_dates(v, links, min_entries)
    vi = dense_index(v.join(dates, "date", "left_semi"), list(video_order), "video_index")

    alive = counts.join(dates, "date", "left_semi").withColumn("__parent", F.get("dates", F.lit(0)))  # one row per parent id
    alive = alive.join(dates.toDF("__parent"), "__parent", "left_semi")
    sizes = alive.groupBy("video_id").agg(F.sum("n").alias("n"))
    sizes = sizes.join(vi.select(F.col("id").alias("video_id"), "video_index"), "video_id", "left")  # JN-8
    parents = running_total(sizes, ["video_id"], "n", "__before")
    orphans = parents.filter(F.col("video_index").isNull()).agg(F.sum("n").alias("orphans")).first()["orphans"]
    if orphans:
        raise ValueError(f"{orphans} comments reference videos outside the parent table")
    lookup = parents.select("video_id", "video_index", "__before")
    rows = c.select(*_first_order(c), "id", "video_id").join(lookup, "video_id")
    ci = dedupe_keep_first(rows, ["id", "video_id"], [*_first_order(c), "video_index", "__before"])
    ci = ci.withColumn("date", epoch_to_date_str("create_time")).join(dates, "date", "left_semi")
    if isinstance(comment_order[0], str) and comment_order[0] == "video_id":
        place = F.row_number().over(Window.partitionBy("video_id").orderBy(*comment_order)) - 1
        ci = ci.withColumn("comment_index", (F.col("__before") + place).cast("bigint"))
    else:
        ci = dense_index(ci.drop("__before"), list(comment_order), "comment_index")
    # PRJ-3: rename and fixed column order
    video_export = vi.select(F.col("topic_name").alias("topic"), "video_index", "date", *scores).select(*PARENT_EXPORT_COLUMNS)
    comment_export = ci.select(*CHILD_EXPORT_COLUMNS)
    return video_export, comment_export, passes


def _first_order(comments: DataFrame) -> list[str]:
    """The order of a child key's rows: as in the files, then by the other columns (after file positions, the time first)."""
    rest = [c for c in comments.columns if c not in ("id", "video_id")]
    files = file_order(comments)
    return list(dict.fromkeys([*files, "create_time", *rest])) if files else rest


def _counts_by_parent(comments: DataFrame, parents: DataFrame) -> DataFrame:
    """(video_id, dates, date, n): the children of each parent by date, one row per key, the first, counting.

    Of the order only the columns up to the time are read: the first row's time needs no others.
    """
    order = _first_order(comments)
    order = order[: order.index("create_time") + 1]
    keys = comments.select("id", "video_id", *order)

    def counted(rows: DataFrame) -> DataFrame:
        first = dedupe_keep_first(rows, ["id", "video_id"], order)
        first = first.withColumn("date", epoch_to_date_str("create_time"))
        return first.groupBy("video_id", "date").agg(F.count(F.lit(1)).alias("n"))

    with_parent = counted(keys.filter("video_id IS NOT NULL").repartition("video_id")).join(parents, "video_id", "left")
    without = counted(keys.filter("video_id IS NULL")).withColumn("dates", F.lit(None).cast(parents.schema["dates"].dataType))
    return with_parent.unionByName(without)


def validate_exports(video_export: DataFrame, comment_export: DataFrame, min_entries: int = DEFAULT_MIN_ENTRIES_PER_DATE) -> DataFrame:
    """DQ-3 … DQ-7 as a DataFrame (check, failures); schema checks need no job.

    SET-3 leak check (disallowed ∩ columns), DQ-4 exact ordered column lists."""
    spark = video_export.sparkSession
    leaked_v = sorted(set(DISALLOWED_EXPORT_COLUMNS) & set(video_export.columns))
    leaked_c = sorted(set(DISALLOWED_EXPORT_COLUMNS) & set(comment_export.columns))
    schema_rows = [
        ("disallowed_columns", len(leaked_v) + len(leaked_c)),
        ("video_columns", 0 if list(video_export.columns) == PARENT_EXPORT_COLUMNS else 1),
        ("comment_columns", 0 if list(comment_export.columns) == CHILD_EXPORT_COLUMNS else 1),
    ]
    fixed = spark.createDataFrame(schema_rows, "check STRING, failures LONG")
    # three checks read these columns: taken from the export's plan once
    comment_export = cut_lineage(comment_export.select("video_index", "comment_index", "date"))
    dup_v = video_export.groupBy("video_index").count().filter("count > 1").agg(F.count(F.lit(1)).alias("failures"))
    dup_c = comment_export.groupBy("comment_index").count().filter("count > 1").agg(F.count(F.lit(1)).alias("failures"))
    orphans = count_orphans(comment_export, video_export, "video_index", "video_index").select(F.col("orphans").alias("failures"))
    sparse = date_counts(video_export, comment_export).filter(F.col("n") < min_entries).agg(F.count(F.lit(1)).alias("failures"))
    return fixed.unionByName(
        dup_v.select(F.lit("video_index_unique").alias("check"), "failures")
    ).unionByName(dup_c.select(F.lit("comment_index_unique").alias("check"), "failures")).unionByName(
        orphans.select(F.lit("comment_parent_exists").alias("check"), "failures")
    ).unionByName(sparse.select(F.lit("dates_above_threshold").alias("check"), "failures"))


def assert_valid(checks: DataFrame) -> None:
    """Raise when any check failed (collects the ≤ 7 check rows)."""
    bad = [(r["check"], r["failures"]) for r in checks.collect() if r["failures"]]
    if bad:
        raise ValueError(f"export validation failed: {bad}")
