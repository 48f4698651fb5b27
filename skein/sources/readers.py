"""Sources (SRC-1 … SRC-9): JSON envelopes, JSONL batches, tables by suffix,
id lists, term lists — all read by Spark's file scans, parsed by ``from_json``.

"First" rows (dedupe keep-first) need file order: every reader adds
``source_file`` and ``pos`` (position inside the file: array index for JSON
envelopes, (split start, row id) for JSONL lines), so ``order by
(source_file, pos)`` reproduces sorted-file concatenation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import DEFAULT_TERMS
from skein.functions.scalar import normalize_id_columns
from skein.functions.text import parse_tags
from skein.schemas import CHILD_SCHEMA, PARENT_SCHEMA


FAIL, SKIP = "fail", "skip"  # what a reader does with malformed JSON


def json_state(text: Column) -> Column:
    """'blank', 'malformed', 'object' or 'other' (valid JSON that is no object).

    A parser stops behind the first value, so the text is parsed as a value
    inside a list and an object, where anything behind it is an error.
    """
    bare = F.rtrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{FEFF}]+", ""), F.lit(" \t\r\n"))
    sound = F.try_parse_json(F.concat(F.lit('[{"x":'), bare, F.lit("}]"))).isNotNull()
    return (
        F.when(bare == "", "blank")
        .when(~sound | (bare.startswith("{") != bare.endswith("}")), "malformed")
        .when(bare.startswith("{"), "object")
        .otherwise("other")
    )


def checked_state(state: Column, where: Column, on_malformed: str) -> Column:
    """``state``, or an error that names the place of a malformed record when readers are to fail."""
    if on_malformed == SKIP:
        return state
    if on_malformed != FAIL:
        raise ValueError(f"on_malformed is {on_malformed!r}; it must be {FAIL!r} or {SKIP!r}")
    message = F.concat(F.lit("malformed JSON in "), where)
    return F.when(state == "malformed", F.raise_error(message).cast("string")).otherwise(state)


def _objects(items: Column, record: T.StructType) -> Column:
    """Parse the JSON-object elements of an ``ARRAY<STRING>``; other elements are skipped."""
    objs = F.filter(items, lambda x: F.ltrim(x).startswith("{"))
    return F.transform(objs, lambda x: F.from_json(x, record))


def records_from_payload(
    payload: Column,
    record: T.StructType,
    keys: Sequence[str] = ("results", "comments", "data"),
    single_object: bool = True,
) -> Column:
    """SRC-2: JSON text → ARRAY<record>.

    A list gives its object elements (scalars skipped); an object gives the
    object elements of the first list found under ``keys``; any other object is
    one record when ``single_object``.  Malformed text gives null, so that the
    caller can tell it from an empty payload.  Lists are first parsed as
    ``ARRAY<STRING>`` (objects stay raw JSON text), so one bad element never
    voids its neighbours.
    """
    state, none = json_state(payload), F.array().cast(T.ArrayType(record))
    as_list = _objects(F.from_json(payload, "array<string>"), record)
    env = F.from_json(payload, T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in keys]))
    from_keys = F.coalesce(*[env[k] for k in keys])
    fallback = F.array(F.from_json(payload, record)) if single_object else none
    listed = F.regexp_replace(payload, r"^[\s\x{FEFF}]+", "").startswith("[")
    return (
        F.when(state == "malformed", F.lit(None))
        .when(state == "object", F.when(from_keys.isNotNull(), _objects(from_keys, record)).otherwise(fallback))
        .when(listed, as_list)
        .otherwise(none)
    )


def read_json_payloads(spark: SparkSession, path: str, pattern: str = "*.json", below_bytes: int | None = None) -> DataFrame:
    """Whole-file text scan: one row per file, of the files below ``below_bytes`` where that is given."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    if below_bytes is not None:
        rows = rows.where(F.col("_metadata.file_size") < below_bytes)  # prunes files, none of the others is opened
    payload = F.regexp_replace("value", r"^\x{FEFF}", "")  # a byte order mark, as line readers drop it too
    return rows.select(payload.alias("payload"), F.col("_metadata.file_name").alias("source_file"))  # PRJ-7 lineage


def read_payload_records(
    spark: SparkSession,
    path: str,
    record: T.StructType,
    pattern: str = "*.json",
    keys: Sequence[str] = ("results", "comments", "data"),
    single_object: bool = True,
    on_malformed: str = FAIL,
    split_bytes: int | None = None,
) -> DataFrame:
    """SRC-1/2: (source_file, pos, record columns) of JSON payload files of any size.

    Files below ``split_bytes`` (default: ``split_json.LEAST_BYTES``) are read
    whole, one task each; larger ones by byte ranges (see ``split_json``), with
    the same rows and errors.
    """
    from skein.sources import split_json

    least = split_json.LEAST_BYTES if split_bytes is None else split_bytes
    payloads = read_json_payloads(spark, path, pattern, least)
    rows = explode_records(payloads, "payload", record, keys, single_object, on_malformed)
    if not _has_files(spark, path, pattern, least):
        return rows
    large = split_json.read_split_payloads(spark, path, record, pattern, keys, single_object, on_malformed, least)
    return rows.unionByName(large)


def _has_files(spark: SparkSession, path: str, pattern: str, least_bytes: int) -> bool:
    """Whether a file of ``least_bytes`` or more is there; only names and sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return not files.where(F.col("length") >= least_bytes).select("path").isEmpty()


def explode_records(
    df: DataFrame,
    payload: str,
    record: T.StructType,
    keys: Sequence[str] = ("results", "comments", "data"),
    single_object: bool = True,
    on_malformed: str = FAIL,
) -> DataFrame:
    """posexplode the records of a payload column; keeps ``source_file`` and adds ``pos``.

    A malformed payload is an error that names its file, or with
    ``on_malformed="skip"`` gives no row (see ``malformed_payloads``).
    """
    extra = [c for c in df.columns if c != payload]
    recs = records_from_payload(F.col(payload), record, keys, single_object)
    if on_malformed == FAIL:
        where = F.col("source_file") if "source_file" in extra else F.lit("a payload")
        error = F.raise_error(F.concat(F.lit("malformed JSON in "), where)).cast(T.ArrayType(record))
        recs = F.coalesce(recs, F.when(F.col(payload).isNotNull(), error))
    out = df.select(*extra, F.posexplode(recs).alias("pos", "r"))
    return out.select(*extra, F.col("pos").cast("bigint").alias("pos"), "r.*")


def malformed_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Error output of payload reads: the rows whose payload isn't JSON."""
    return df.where(json_state(F.col(payload)) == "malformed")


def _tags_as_array(df: DataFrame) -> DataFrame:
    """Hashtags are read as raw JSON, as records have them as lists or as text; SC-3 makes both a list."""
    if dict(df.dtypes).get("hashtag_names") != "string":
        return df
    return df.withColumn("hashtag_names", F.when(F.col("hashtag_names").isNotNull(), parse_tags("hashtag_names", False)))


def read_parent_envelopes(
    spark: SparkSession,
    path: str,
    pattern: str = "*.json",
    schema: T.StructType = PARENT_SCHEMA,
    on_malformed: str = FAIL,
    split_bytes: int | None = None,
) -> DataFrame:
    """SRC-1: parent envelopes → one row per record of ``results`` with ``source_file``/``pos``;
    files without results are skipped; a bare list is accepted too (D-1); ids normalised,
    hashtags a list whether the record has a list or text.  Files of ``split_bytes`` and more
    are read by many tasks (see ``read_payload_records``)."""
    rows = read_payload_records(spark, path, schema, pattern, ("results",), False, on_malformed, split_bytes)
    return normalize_id_columns(_tags_as_array(rows))


def _jsonl_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        "value",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("pos_block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return lines.withColumn("state", json_state(F.col("value")))


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.jsonl", on_malformed: str = FAIL
) -> DataFrame:
    """JSONL lines: blank lines and valid non-objects skipped (a line holding a list is skipped too).

    A line that isn't JSON is an error that names its file, or with
    ``on_malformed="skip"`` goes to ``malformed_lines`` alone.
    """
    lines = _jsonl_lines(spark, path, pattern)
    objects = lines.where(checked_state(F.col("state"), F.col("source_file"), on_malformed) == "object")
    parsed = objects.select("source_file", "pos_block", "pos", F.from_json("value", schema).alias("r"))
    return _tags_as_array(parsed.select("source_file", "pos_block", "pos", "r.*"))


def malformed_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Error output of JSONL reads: (source_file, pos_block, pos, value) of lines that aren't JSON."""
    lines = _jsonl_lines(spark, path, pattern)
    return lines.where(F.col("state") == "malformed").select("source_file", "pos_block", "pos", "value")


def read_child_batches(
    spark: SparkSession,
    path: str,
    schema: T.StructType = CHILD_SCHEMA,
    jsonl_pattern: str = "*.jsonl",
    json_pattern: str | None = "*.json",
    on_malformed: str = FAIL,
    split_bytes: int | None = None,
) -> DataFrame:
    """SRC-3: JSONL batches then JSON batches (lists or envelopes), ids normalised.

    JSONL files sort before JSON files in the reference order; the file order key
    is (``file_kind`` 0 = jsonl / 1 = json, ``source_file``, ``pos_block``, ``pos``).
    """
    jsonl = read_jsonl(spark, path, schema, jsonl_pattern, on_malformed).withColumn("file_kind", F.lit(0))
    if json_pattern is None:
        return normalize_id_columns(jsonl)
    js = read_payload_records(spark, path, schema, json_pattern, on_malformed=on_malformed, split_bytes=split_bytes)
    js = _tags_as_array(js).withColumn("file_kind", F.lit(1)).withColumn("pos_block", F.lit(0).cast("bigint"))
    both = jsonl.unionByName(js, allowMissingColumns=True)  # SET-1 union of differing columns
    return normalize_id_columns(both)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-4: read by suffix — parquet (the columnar re-aim of Feather), csv, json/jsonl; else error."""
    lower = path.lower().rstrip("/")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if lower.endswith((".parquet", ".feather")):
        return reader.parquet(path)
    if lower.endswith(".csv"):
        return reader.option("header", True).csv(path)
    if lower.endswith((".json", ".jsonl")):
        return reader.json(path)
    raise ValueError(f"Unsupported input format: {path}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop FileSystem existence test (works for any cluster file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """SRC-5: first path that exists (plan-time probe, no data read)."""
    for p in paths:
        if path_exists(spark, p):
            return p
    return None


def read_first(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """SRC-5: the table at the first path that exists (raw, then enriched, then collected); none is an error."""
    found = first_existing(spark, paths)
    if found is None:
        raise FileNotFoundError(f"none of these inputs exists: {', '.join(paths)}")
    return read_table(spark, found, schema)


def read_id_list(spark: SparkSession, path: str, column: str = "video_id") -> DataFrame:
    """SRC-6: id list from CSV: ``video_id`` column else the first; nulls dropped, distinct, strings."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    col = column if column in df.columns else df.columns[0]
    return df.select(F.col(col).cast("string").alias("video_id")).na.drop().distinct()


def read_terms(spark: SparkSession, terms: str | None = None, terms_file: str | None = None) -> DataFrame:
    """SRC-7: (pos, term) — file lines (``#`` comments and blanks skipped) or a comma list or the
    defaults; case-insensitive distinct keeping the first occurrence."""
    if terms_file:
        raw = spark.read.text(terms_file).select(
            F.trim("value").alias("term"), F.monotonically_increasing_id().alias("pos")
        ).filter((F.col("term") != "") & ~F.col("term").startswith("#"))
    else:
        items = [t.strip() for t in terms.split(",") if t.strip()] if terms else list(DEFAULT_TERMS)
        raw = spark.createDataFrame(list(enumerate(items)), "pos LONG, term STRING")
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower("term")).orderBy("pos")
    return raw.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").select("pos", "term")


def read_analysis_inputs(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """SRC-8: the four analysis inputs; a missing one raises."""
    need = ["videos_raw", "comments_raw", "topics", "id2topics"]
    missing = [k for k in need if k not in paths or not path_exists(spark, paths[k])]
    if missing:
        raise FileNotFoundError(f"Missing analysis inputs: {missing}")
    return {k: read_table(spark, paths[k]) for k in need}
