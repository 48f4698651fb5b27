"""SRC-1 / SRC-2 for large payload files: one JSON document read by many tasks.

Spark's text source cuts a file into byte ranges and hands out what stands
between its closing braces, so no task needs a whole file.  A first scan finds
for each range how it changes the state of a JSON text (inside a string or not,
depth); running sums over the ranges of a file give every range's own start.  A
second scan then cuts out the records, the objects that open one level below the
payload's top array or two levels below its top object.  What stands between
records, with the first and last record of each unbroken series in their place,
is the file's skeleton: a small document of the payload's own shape, by which
the payload reader decides which list counts and whether the file is JSON.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import cut_lineage, ensure_checkpoint_dir, ship_package
from skein.sources.readers import FAIL, SKIP, json_state, records_from_payload

LEAST_BYTES = 32 << 20  # files of fewer bytes are read whole
_MARK = T.StructType([T.StructField("#b", T.LongType()), T.StructField("#i", T.LongType())])
_COMMA = re.compile(rb"[ \t\r\n]*,[ \t\r\n]*")


def _structure(text: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(parity of the quotes up to each byte, +1 / −1 at brackets whatever the state) of bytes that end outside an escape."""
    quotes = text == 0x22
    slashes = np.flatnonzero(text == 0x5C)
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) > 1)
        last = np.append(first[1:], len(slashes)) - 1
        behind = slashes[last] + 1
        odd = (last - first + 1) % 2 == 1
        behind = behind[odd & (behind < len(text))]
        quotes[behind] = False
    parity = (np.cumsum(quotes, dtype=np.int64) + inside) & 1
    step = ((text == 0x7B) | (text == 0x5B)).astype(np.int64) - ((text == 0x7D) | (text == 0x5D))
    return parity, step


def _segments(spark: SparkSession, path: str, pattern: str, least_bytes: int) -> DataFrame:
    """(fid, block, value): the bytes between closing braces, in order within each byte range of a file."""
    rows = spark.read.option("pathGlobFilter", pattern).option("lineSep", "}").text(path)
    rows = rows.where(F.col("_metadata.file_size") >= least_bytes)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("fid"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("value").cast("binary").alias("value"),
    )


def _per_range(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[bytes], bool]]:
    """(leading columns, segments, whether the range ends here) for runs of rows of one byte range."""
    held: tuple[tuple, list[bytes]] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fid, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((np.diff(fid) != 0) | (np.diff(block) != 0)) + 1
        values = batch.column(batch.num_columns - 1)
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(batch.column(c)[int(start)].as_py() for c in range(columns))
            if held:
                yield *held, held[0][:2] != key[:2]
            held = key, values.slice(start, end - start).to_pylist()
    if held:
        yield *held, True


def _range_states(segments: DataFrame) -> DataFrame:
    """(fid, block, source_file, inside, depth, level, closed): the state at the start of every byte range.

    ``level`` is the depth below which records open; ``closed`` tells whether
    the file's last segment ends with a brace, which its size shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for key, values, over in _per_range(batches, 4):
            text = np.frombuffer(b"}".join([*values, b""]), np.uint8)
            parity, step = _structure(text, 0)
            head = b"}".join(values)[:4096].lstrip(b" \t\r\n\xef\xbb\xbf")[:1]
            own = [int(parity[-1]), int(step[parity == 0].sum()), int(step[parity == 1].sum()), len(text)]
            if total is None:
                total = [*own, head]
            else:  # what was outside in the state at the range's start now depends on the quotes before
                flip = total[0]
                total[0] ^= own[0]
                total[1] += own[1 + flip]
                total[2] += own[2 - flip]
                total[3] += own[3]
            if over:
                row = [*key, *total[:4], total[4].decode("latin-1")]
                names = ["fid", "block", "source_file", "file_size", "quotes", "outside", "within", "bytes", "head"]
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))])
                total = None

    schema = "fid bigint, block bigint, source_file string, file_size bigint, quotes bigint, outside bigint, within bigint, bytes bigint, head string"
    ranges = cut_lineage(segments.mapInArrow(run, schema))
    before = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("fid")
    state = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)))
    state = state.withColumn("change", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    state = state.withColumns(
        {
            "depth": F.coalesce(F.sum("change").over(before), F.lit(0)),
            "level": F.when(F.min_by("head", "block").over(whole) == "[", 1).otherwise(2).cast("bigint"),
            # a byte order mark, of three bytes, is left out by the reader
            "closed": (F.sum("bytes").over(whole) - F.max("file_size").over(whole)).isin(0, -3),
            "final": F.col("block") == F.max("block").over(whole),
        }
    )
    return cut_lineage(
        state.select("fid", "block", "source_file", "inside", "depth", "level", (~F.col("closed") & F.col("final")).alias("open_end"))
    )


def _mark(block: int, number: int) -> bytes:
    return b'{"#b": %d, "#i": %d}' % (block, number)


class _Range:
    """One byte range on its way through the second scan: records, the skeleton's text, and what crosses its ends."""

    def __init__(self, block: int, inside: int, depth: int, level: int):
        self.block, self.inside, self.depth, self.level = block, inside, depth, level
        self.heading = depth > level  # still in what an earlier range has begun
        self.head: list[bytes] = []
        self.head_closed = False
        self.open: list[bytes] | None = None  # text so far of a record that has begun here
        self.count = 0
        self.skeleton: list[bytes] = []
        self.series: list[int] = []  # first and last record of an unbroken series
        self.between: list[bytes] = []

    def _outside(self, text: bytes) -> None:
        self.between.append(text)

    def _flush(self) -> None:
        if self.series:
            self.skeleton.append(_mark(self.block, self.series[0]))
            if self.series[-1] != self.series[0]:
                self.skeleton.append(b"," + _mark(self.block, self.series[-1]))
            self.series = []
        self.skeleton += self.between
        self.between = []

    def _record(self) -> None:
        if self.series and _COMMA.fullmatch(b"".join(self.between)):
            self.between = []
            self.series = [self.series[0], self.count]
        else:
            self._flush()
            self.series = [self.count]
        self.count += 1

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        """The (number, text) of the records that end in ``data``, which ends outside an escape."""
        text = np.frombuffer(data, np.uint8)
        parity, step = _structure(text, self.inside)
        step = np.where(parity == 0, step, 0)
        depth = self.depth + np.cumsum(step)
        # where something opens below the level or closes up to it
        edges = np.flatnonzero(((step > 0) & (depth == self.level + 1)) | ((step < 0) & (depth == self.level)))
        done, at = [], 0
        nested = self.heading or self.open is not None or self.depth > self.level
        for i in edges.tolist():
            if step[i] > 0 and not nested:
                nested = True
                if text[i] == 0x7B:
                    self._outside(data[at:i])
                    at, self.open = i, []
            elif step[i] < 0 and nested:
                nested = False
                if self.heading:
                    self.head.append(data[at : i + 1])
                    self.heading, self.head_closed, at = False, True, i + 1
                elif self.open is not None:
                    self._record()
                    done.append((self.count - 1, b"".join([*self.open, data[at : i + 1]])))
                    self.open, at = None, i + 1
        rest = data[at:]
        if self.heading:
            self.head.append(rest)
        elif self.open is not None:
            self.open.append(rest)
        else:
            self._outside(rest)
        self.inside, self.depth = int(parity[-1]), int(depth[-1])
        return done

    def ends(self) -> dict:
        tail = None
        if self.open is not None:
            self._record()
            tail = b"".join(self.open)
        self._flush()
        return {"head": b"".join(self.head), "head_closed": self.head_closed, "skeleton": b"".join(self.skeleton), "tail": tail, "count": self.count}


_PIECES = "fid bigint, block bigint, number bigint, value binary, head binary, head_closed boolean, skeleton binary, tail binary, count bigint"


def _pieces(segments: DataFrame, states: DataFrame) -> DataFrame:
    """Records (number, value) that lie within one byte range, and one row per range (number null) with the rest."""
    lead = ["fid", "block", "inside", "depth", "level", "open_end"]
    rows = segments.select("fid", "block", "value").join(F.broadcast(states.select(*lead)), ["fid", "block"])
    names = [part.split(" ")[0] for part in _PIECES.split(", ")]
    schema = pa.schema(
        [("fid", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("value", pa.binary()), ("head", pa.binary())]
        + [("head_closed", pa.bool_()), ("skeleton", pa.binary()), ("tail", pa.binary()), ("count", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for (fid, block, inside, depth, level, open_end), values, over in _per_range(batches, 6):
            own = own or _Range(block, inside, depth, level)
            data = b"}".join(values) + (b"" if over and open_end else b"}")
            out = [dict.fromkeys(names) | {"fid": fid, "block": block, "number": n, "value": v} for n, v in own.feed(data)] if data else []
            if over:
                out.append(dict.fromkeys(names) | {"fid": fid, "block": block} | own.ends())
                own = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return cut_lineage(rows.select(*lead, "value").mapInArrow(run, _PIECES))


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of one file: its skeleton (number null), and the records that cross ranges.  There is a row per range."""
    fid, out, skeleton = pieces["fid"].iloc[0], [], []
    open_record: list | None = None
    for row in pieces.sort_values("block").itertuples(index=False):
        head = row.head or b""
        if open_record:
            open_record[2].append(head)
            if row.head_closed:
                out.append((fid, open_record[0], open_record[1], b"".join(open_record[2])))
                open_record = None
        else:
            skeleton.append(head)
        skeleton.append(row.skeleton or b"")
        if row.tail is not None:
            open_record = [row.block, row.count - 1, [row.tail]]
    if open_record:
        out.append((fid, open_record[0], open_record[1], b"".join(open_record[2])))
    out.append((fid, None, None, b"".join(skeleton)))
    return pd.DataFrame(out, columns=["fid", "block", "number", "value"]).astype({"block": "Int64", "number": "Int64"})


def read_split_payloads(
    spark: SparkSession,
    path: str,
    record: T.StructType,
    pattern: str = "*.json",
    keys: Sequence[str] = ("results", "comments", "data"),
    single_object: bool = True,
    on_malformed: str = FAIL,
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """(source_file, pos, record columns) of the files of ``least_bytes`` and more, as ``explode_records`` gives them.

    Files that aren't JSON are an error that names them, or with
    ``on_malformed="skip"`` give no row.  A payload that is one record itself is
    put together again for one task; all others are never in one place.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if on_malformed not in (FAIL, SKIP):
        raise ValueError(f"on_malformed is {on_malformed!r}; it must be {FAIL!r} or {SKIP!r}")
    segments = _segments(spark, path, pattern, least_bytes)
    columns = ["source_file", "pos"]
    states = _range_states(segments.select("fid", "block", "source_file", "file_size", "value"))
    pieces = _pieces(segments, states)
    ranges = pieces.where("number is null").drop("number", "value")
    joined = cut_lineage(ranges.groupBy("fid").applyInPandas(lambda p: _joined(p), "fid bigint, block bigint, number bigint, value binary"))
    skeleton = joined.where("number is null").select("fid", F.col("value").cast("string").alias("skeleton"))
    marks = records_from_payload(F.col("skeleton"), _MARK, keys, single_object)
    shape = skeleton.withColumn("state", json_state(F.col("skeleton"))).withColumn("marks", F.filter(marks, lambda m: m["#b"].isNotNull()))
    envelope = F.from_json("skeleton", T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in keys]))
    listed = F.coalesce(*[envelope[k] for k in keys]).isNotNull()
    alone = (F.col("state") == "object") & ~listed & F.lit(single_object)
    end = [F.struct(F.get("marks", F.lit(0)).alias("first"), F.try_element_at("marks", F.lit(-1)).alias("last")).alias("span")]
    shape = cut_lineage(shape.select("fid", "state", alone.alias("alone"), *end).select("fid", "state", "alone", "span.first", "span.last"))

    records = pieces.where("number is not null").select("fid", "block", "number", "value")
    records = records.unionByName(joined.where("number is not null")).withColumn("value", F.col("value").cast("string"))
    malformed = json_state(F.col("value")) == "malformed"
    counts = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("fid", "block", F.coalesce(F.sum("count").over(counts), F.lit(0)).alias("offset"))
    names = states.groupBy("fid").agg(F.first("source_file").alias("source_file"))
    files = names.join(shape, "fid")
    broken = files.where("state = 'malformed'").select("fid").union(records.where(malformed).select("fid")).distinct()
    if on_malformed == FAIL:
        said = F.raise_error(F.concat(F.lit("malformed JSON in "), "source_file")).cast("boolean")
        files = files.where(F.when(F.col("state") == "malformed", said).otherwise(F.lit(True)))
        sound = F.when(malformed, said).otherwise(F.lit(True))
    else:
        files = files.join(F.broadcast(broken), "fid", "left_anti")
        sound = F.lit(True)
    # one row per file, and per byte range; the records themselves are not shuffled
    first = offsets.select("fid", F.col("block").alias("first_block"), F.col("offset").alias("first_offset"))
    spans = files.where(~F.col("alone")).withColumn("first_block", F.col("first")["#b"])
    spans = spans.join(first, ["fid", "first_block"], "left").withColumn("from", F.col("first_offset") + F.col("first")["#i"])
    last = offsets.select("fid", F.col("block").alias("last_block"), F.col("offset").alias("last_offset"))
    spans = spans.withColumn("last_block", F.col("last")["#b"]).join(last, ["fid", "last_block"], "left")
    spans = spans.withColumn("to", F.col("last_offset") + F.col("last")["#i"]).select("fid", "source_file", "from", "to")
    located = records.join(F.broadcast(offsets), ["fid", "block"]).join(F.broadcast(spans), "fid")
    located = located.withColumn("at", F.col("offset") + F.col("number")).where(sound)
    inside = located.where(F.col("at").between(F.col("from"), F.col("to")))
    out = inside.select("source_file", (F.col("at") - F.col("from")).alias("pos"), F.from_json("value", record).alias("r"))
    if single_object:
        ends = states.select("fid", "block", "open_end")
        whole = segments.withColumn("at", F.monotonically_increasing_id()).join(F.broadcast(files.where("alone").select("fid")), "fid")
        parts = F.sort_array(F.collect_list(F.struct("block", "at", F.col("value").cast("string").alias("value"))))
        text = F.array_join(F.transform(parts, lambda p: p["value"]), "}")
        closed = ends.groupBy("fid").agg(F.max("open_end").alias("open_end"))
        whole = whole.groupBy("fid", "source_file").agg(text.alias("value")).join(F.broadcast(closed), "fid")
        whole = whole.withColumn("value", F.when(F.col("open_end"), F.col("value")).otherwise(F.concat("value", F.lit("}"))))
        out = out.unionByName(whole.select("source_file", F.lit(0).cast("bigint").alias("pos"), F.from_json("value", record).alias("r")))
    return out.select(*columns, "r.*")
