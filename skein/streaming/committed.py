"""STR-2 / STR-5 without growing stream state: micro-batches committed to tables, exactly once per batch id.

Below a root folder every micro-batch writes its own folders ``rows``, ``keys``
and ``daily`` (``…/batch=<id>``) and then one marker ``commits/<id>``.  Only
batches with a marker are read, so a batch that fails between its writes and its
marker leaves nothing behind: run again, it replaces its folders.  A batch whose
marker is there is passed over.  Nothing is kept in the stream's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # of the keys: a batch reads those that its own keys fall into


def _fs(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed_batches(spark: SparkSession, root: str) -> list[int]:
    """Ids of the batches that are whole, ascending."""
    path, fs = _fs(spark, f"{root}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []


def _commit(spark: SparkSession, root: str, batch_id: int) -> None:
    path, fs = _fs(spark, f"{root}/commits/{batch_id}")
    fs.create(path, False).close()


def _read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The committed part of a table, or None before its first batch."""
    paths = [f"{root}/{name}/batch={i}" for i in committed_batches(spark, root)]
    paths = [p for p in paths if (f := _fs(spark, p))[1].exists(f[0])]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths) if paths else None


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def read_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """All rows taken in so far, each key once, with the batch that brought it."""
    return _read(spark, root, "rows")


def _latest_days(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest committed version of every day's counts; versions are chosen by folder names before any file is read."""
    found = _read(spark, root, "daily")
    if found is None:
        return None
    newest = found.select("day", "batch").distinct().groupBy("day").agg(F.max("batch").alias("batch"))  # a row per day
    return found.join(F.broadcast(newest), ["day", "batch"], "left_semi")


def read_daily(spark: SparkSession, root: str) -> DataFrame | None:
    """(day, ``by`` columns, n): counts of all rows taken in so far."""
    found = _latest_days(spark, root)
    return None if found is None else found.drop("batch")


def take_in(
    root: str,
    keys: Sequence[str],
    ts_col: str | None = None,
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends the rows with new ``keys`` and, with ``ts_col``, keeps daily counts.

    Of rows with one key in a batch the least stays, of those of several batches
    the first batch's, however late the repetition comes.  A batch reads the
    keys of its own buckets only, and of the daily counts the days that its new
    rows fall on: those days get a new version, no other is written.  Null keys
    are keys like others; rows without a time count under no day.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in committed_batches(spark, root):
            return
        columns = batch.columns
        firsts = batch.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("row")).select("row.*").withColumn("bucket", _bucket(keys, buckets))
        known = _read(spark, root, "keys")
        if known is not None:
            touched = [r["bucket"] for r in batch.select(_bucket(keys, buckets)).distinct().collect()]  # ``buckets`` at most
            known = known.where(F.col("bucket").isin(touched)).select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), F.col("bucket").alias("_bucket"))
            same = F.col("bucket") == F.col("_bucket")
            for i, k in enumerate(keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
            firsts = firsts.join(known, same, "left_anti")
        firsts.drop("bucket").select(*columns).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        new = spark.read.schema(batch.schema).parquet(f"{root}/rows/batch={batch_id}")
        new.select(*keys, _bucket(keys, buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/keys/batch={batch_id}")
        if ts_col is not None:
            _count(spark, new, batch_id)
        _commit(spark, root, batch_id)

    def _count(spark: SparkSession, new: DataFrame, batch_id: int) -> None:
        day = F.date_format(ts_col, "yyyy-MM-dd").alias("day")
        counts = new.where(F.col(ts_col).isNotNull()).groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"))
        before = _latest_days(spark, root)
        if before is not None:
            days = [r["day"] for r in counts.select("day").distinct().collect()]  # days of the calendar
            before = before.where(F.col("day").cast("string").isin(days)).select(F.col("day").cast("string").alias("day"), *by, "n")
            counts = counts.unionByName(before).groupBy("day", *by).agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").partitionBy("day").parquet(f"{root}/daily/batch={batch_id}")

    return write
