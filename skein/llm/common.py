"""Shared helpers: session preparation, shared-folder tables, Arrow batches."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import bound_batches, ensure_checkpoint_dir, ship_package

SLICE_CHARS = 1_000_000  # characters that a worker handles at a time


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the workers, and Arrow batches bounded by bytes.

    Settings that the caller has made are kept.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)


def write_shared(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a ``write_shared`` table that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once their plans are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def least_count(counts: DataFrame, rows: int) -> int:
    """The least value of ``n`` such that at most ``rows`` rows of ``counts`` have it or more.

    Reads one row per power-of-two step and then one per value within a step, so
    what reaches the driver doesn't grow with the rows.
    """
    step = F.floor(F.log2("n")).cast("int")
    left, by_step = rows, counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    for r in by_step:
        if r["count"] > left:
            low, high = 1 << r["step"], 2 << r["step"]
            width = max(1, (high - low) // 1024)  # values of a step in at most 1024 bins
            bins = counts.where((F.col("n") >= low) & (F.col("n") < high))
            bins = bins.groupBy(F.floor((F.col("n") - low) / width).cast("long").alias("bin")).count()
            least = high
            for b in bins.orderBy(F.desc("bin")).collect():
                left -= b["count"]
                if left < 0:
                    return least
                least = low + b["bin"] * width
            return least
        left -= r["count"]
    return 1


def text_slices(batch: pa.RecordBatch, chars: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, texts) in runs of about ``chars`` characters; a null text is ''."""
    values = [t or "" for t in batch.column(column).to_pylist()]
    start = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= chars or i + 1 == len(values):
            yield batch.slice(start, i + 1 - start), values[start : i + 1]
            start, size = i + 1, 0


Worker = Callable[[list[str]], list[pa.Array]]


def map_texts(
    docs: DataFrame,
    make_worker: Callable[[], Worker],
    schema: str,
    id_col: str,
    text_col: str,
    keep: Sequence[str] = (),
    chars: int = SLICE_CHARS,
) -> DataFrame:
    """(id, ``keep`` columns, ``schema`` columns) per row of ``docs``: a map over Arrow batches without a shuffle.

    ``make_worker`` runs once per task; the worker turns a list of texts (null:
    '') into one Arrow array per column of ``schema``.  Only the named columns
    are read, by position, so other columns may have any names; ``keep`` must
    not hold names of ``schema``.
    """
    prepare(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(id_col, *keep).schema}
    own = ", ".join([f"c0 {kinds[id_col]}", *(f"k{i} {kinds[k]}" for i, k in enumerate(keep))])
    names = [part.split(" ")[0] for part in re.split(r", (?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make_worker()
        for batch in batches:
            for rows, texts in text_slices(batch, chars):
                columns = [rows.column(0), *rows.columns[2:], *worker(texts)]
                yield pa.RecordBatch.from_arrays(columns, names=["c0", *(f"k{i}" for i in range(len(keep))), *names])
            pa.default_memory_pool().release_unused()  # else a worker holds on to its largest batch

    kept = [F.col(k).alias(f"k{i}") for i, k in enumerate(keep)]
    inputs = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"), *kept)
    out = inputs.mapInArrow(run, f"{own}, {schema}")
    return out.select(F.col("c0").alias(id_col), *(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), *names)


def map_rows(
    docs: DataFrame, make_worker: Callable[[], Worker], schema: str, text_col: str, chars: int = SLICE_CHARS
) -> DataFrame:
    """(row, found): every row of ``docs`` as a struct, with the worker's columns for its text as another.

    As ``map_texts``, for operators that hand whole rows on: columns travel by
    position, so those of ``docs`` may have any names.
    """
    prepare(docs.sparkSession)
    place, found = docs.columns.index(text_col), T.StructType.fromDDL(schema)
    own = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    made = [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(found)]
    names = [f.name for f in own + made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = make_worker()
        for batch in batches:
            for rows, texts in text_slices(batch, chars, place):
                yield pa.RecordBatch.from_arrays([*rows.columns, *worker(texts)], names=names)
            pa.default_memory_pool().release_unused()

    out = docs.toDF(*(f.name for f in own)).mapInArrow(run, T.StructType(own + made))
    row = F.struct(*(F.col(f.name).alias(c) for f, c in zip(own, docs.columns)))
    return out.select(row.alias("row"), F.struct(*(F.col(f"r{i}").alias(f.name) for i, f in enumerate(found))).alias("found"))
