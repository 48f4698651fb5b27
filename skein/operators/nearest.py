"""Exact nearest neighbours of every row by Euclidean distance, from blocks of vectors.

1. Equal vectors become one; of the ids that share a vector the ``k`` + 1
   smallest are kept, as no row can have a further one among its nearest.
2. Vectors are put in the order of a space-filling curve and packed into blocks
   with a center and a radius.
3. Every block first meets itself.  With the distances found, a block asks only
   those other blocks in whose ball, by the triangle inequality, a nearer vector
   may lie, and of its vectors only those do for which that holds; a call takes
   a bounded number of blocks.
4. A cell, two blocks, is one matrix product with a bound on its rounding error;
   pairs that may be near enough have their distance summed up dimension by
   dimension.

So no pair of rows is a row of Spark, and nothing is left out.  Where balls
overlap, as those of vectors without structure in many dimensions do, the
number of cells grows with the square of the blocks of different vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.density import _matrix, fine_vectors, on_curves
from skein.operators.relational import dense_index
from skein.session import bound_batches, cut_lineage, ensure_checkpoint_dir, ship_package

BLOCK_ROWS, BLOCK_NUMBERS = 8192, 1 << 19  # of a block, at most
MOST_ASKS, ASK_BLOCKS = 4 * BLOCK_ROWS, 24  # larger blocks of asks move the vectors less often; but there are as many blocks, if they can be
ASKED_AT_ONCE = 256  # rows of a cell's matrix product
PAIRS_AT_ONCE = 1 << 19
RUN = 16  # blocks of vectors that a call takes for one block of asks
LAST = np.iinfo(np.int64).max


def _beyond(away: np.ndarray, radius: float, d: np.ndarray) -> np.ndarray:
    """Whether all of a ball, whose center is ``away``, is farther than ``d``; where lengths overflow it may not be."""
    return np.isfinite(away) & (away * (1 - 1e-9) - radius * (1 + 1e-9) > d)


class Nearest:
    """The ``k`` nearest so far of a block of asks, ascending by (distance, id); ``near`` is the number of a vector.

    An ask is a vector and, where ``bars`` is set, an id ``x`` that is no
    neighbour of its own.
    """

    def __init__(self, vectors: np.ndarray, at: np.ndarray, x: np.ndarray, bars: np.ndarray, k: int):
        self.vectors, self.at, self.x, self.bars = vectors, at, x, bars.astype(bool)
        self.d = np.full((len(at), k), np.inf)
        self.id = np.full((len(at), k), LAST)
        self.near = np.full((len(at), k), -1)

    def meet(self, vectors: np.ndarray, at: np.ndarray, first: np.ndarray, second: np.ndarray, alone: np.ndarray) -> None:
        """Compares with the vectors ``at`` (ascending) of a block, whose smallest ids are ``first`` and, unless ``alone``, ``second``."""
        k, dims = self.d.shape[1], vectors.shape[1]
        slack = 16 * (dims + 8) * 2.0**-53  # relative to the squared lengths; several times the rounding error
        with np.errstate(all="ignore"):  # what overflows is compared by its distance
            center = vectors.mean(0)
            own = vectors - center
            length = (own * own).sum(1)
            right, radius = np.vstack([own.T, length * (1 - slack)]), np.sqrt(length.max())
            across, alone = np.ascontiguousarray(vectors.T), alone.astype(bool)
            for start in range(0, len(self.at), ASKED_AT_ONCE):
                some = np.arange(start, min(start + ASKED_AT_ONCE, len(self.at)))
                asked = self.vectors[some] - center
                size = (asked * asked).sum(1)
                within = ~_beyond(np.sqrt(size), radius, self.d[some, -1])
                some, asked, size = some[within], asked[within], size[within]
                if not len(some):
                    continue
                # squared distance at least, less the ask's own part of it
                least = np.hstack([-2 * asked, np.ones((len(some), 1))]) @ right
                same = np.minimum(np.searchsorted(at, self.at[some]), len(at) - 1)
                row = np.flatnonzero(at[same] == self.at[some])
                no = [(row, same[row])]
                for i in np.flatnonzero(self.bars[some]):
                    col = np.flatnonzero(alone & (first == self.x[some[i]]))
                    no.append((np.full(len(col), i), col))
                for cell in no:
                    least[cell] = np.inf
                limit = self.d[some, -1] ** 2 * (1 + 1e-12) - size * (1 - slack) + 1e-300
                may = ~(least > limit[:, None])
                many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * k)
                if len(many) and len(at) > k:  # the k-th nearest of this block bounds them closer
                    most = np.partition(least[many], k - 1, axis=1)[:, k - 1] + 2 * slack * (size[many] + length.max()) + 1e-300
                    limit[many] = np.minimum(limit[many], most)
                    may[many] = ~(least[many] > limit[many, None])
                for cell in no:
                    may[cell] = False
                row, col = np.nonzero(may)
                turned = np.ascontiguousarray(self.vectors[some].T)
                for i in range(0, len(row), PAIRS_AT_ONCE):
                    r, c = row[i : i + PAIRS_AT_ONCE], col[i : i + PAIRS_AT_ONCE]
                    square = np.zeros(len(r))
                    for x, y in zip(turned, across, strict=True):
                        step = x[r] - y[c]
                        square += step * step
                    d, r = np.sqrt(square), some[r]
                    kept = np.isfinite(d) & (d <= self.d[r, -1])
                    r, c = r[kept], c[kept]
                    name = np.where(self.bars[r] & (first[c] == self.x[r]), second[c], first[c])
                    self._keep(r, d[kept], name, at[c])

    def _keep(self, row: np.ndarray, d: np.ndarray, name: np.ndarray, near: np.ndarray) -> None:
        k = self.d.shape[1]
        touched, place = np.unique(row, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        columns = [np.concatenate([old[touched].ravel(), new]) for old, new in ((self.d, d), (self.id, name), (self.near, near))]
        order = np.lexsort((columns[1], columns[0], rows))
        rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
        for old, all_ in zip((self.d, self.id, self.near), columns, strict=True):
            old[touched] = all_[order].reshape(-1, k)

    def rows(self) -> pa.RecordBatch:
        """(at, x, near) per ask, x null where no id is barred."""
        known = np.isfinite(self.d)
        parts = [pa.array(column[known]) for column in (self.d, self.id, self.near)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(known.sum(1))]).astype(np.int32))
        near = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["d", "id", "at"]))
        columns = [pa.array(self.at), pa.array(self.x, mask=~self.bars), near]
        return pa.RecordBatch.from_arrays(columns, names=["at", "x", "near"])


def _bytes(matrix: np.ndarray) -> bytes:
    """The size of a number, then the numbers: of 4 bytes where that loses nothing, else of 8."""
    with np.errstate(all="ignore"):
        short = matrix.astype("<f4")
    kept = short if np.array_equal(short, matrix) else matrix.astype("<f8")
    return np.array([kept.itemsize], "<i8").tobytes() + kept.tobytes()


def _vectors(data: pa.Scalar, rows: int) -> np.ndarray:
    held = data.as_buffer()
    size = int(np.frombuffer(held, "<i8", 1)[0])
    return np.frombuffer(held, f"<f{size}", offset=8).reshape(rows, -1).astype(np.float64)


def _longs(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "<i8")


def _packed(rows: DataFrame, longs: list[str]) -> DataFrame:
    """(block, least, most, vec, ``longs``): per block of ``rows`` its least and greatest ``at``, its vectors and columns ``longs`` as binaries, by ``at``."""
    rows = rows.select("block", "vec", *(F.col(c).cast("long").alias(c) for c in longs))
    dealt = rows.repartition("block").sortWithinPartitions("block", *longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held)
                matrix = _matrix(whole.column("vec").combine_chunks())
                numbers = {c: np.asarray(whole.column(c)).astype("<i8") for c in longs}
                columns = [pa.array([whole.column("block")[0].as_py()]), *(pa.array([int(numbers["at"][i])]) for i in (0, -1))]
                columns += [pa.array([x], pa.binary()) for x in (_bytes(matrix), *(numbers[c].tobytes() for c in longs))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "least", "most", "vec", *longs])
                held.clear()

        for batch in batches:
            blocks = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0].as_py() != blocks[start]:
                    yield from out()
                if stop > start:
                    held.append(batch.slice(start, stop - start))
        yield from out()

    return dealt.mapInArrow(run, ", ".join(["block bigint", "least bigint", "most bigint", "vec binary", *(f"{c} binary" for c in longs)]))


ASK, HELD = ["at", "x", "bars"], ["at", "first", "second", "alone"]
FOUND = "array<struct<d: double, id: bigint, at: bigint>>"


def _part(blocks: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """The vectors and other ``columns`` of the first block."""
    longs = [_longs(blocks.column(c)[0]) for c in columns[1:]]
    return [_vectors(blocks.column(columns[0])[0], len(longs[0])), *longs]


def _together(
    asks: DataFrame, held: DataFrame, keys: list[str], tasks: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``run(block of asks, blocks of vectors)`` for every value of ``keys``; ``tasks`` values are dealt out thinly."""
    deal = min(4 * max(tasks, 1), 4096)
    sides = (side.toDF(*side.columns).repartition(deal, *keys).groupBy(*keys) for side in (asks, held))
    return next(sides).cogroup(next(sides)).applyInArrow(run, schema)


def _balls(blocks: DataFrame) -> list[tuple[int, np.ndarray, float]]:
    """(block, center, radius) of every block: as many numbers as a vector has, and two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centers, radii = [], []
            for data, at in zip(batch.column(1), batch.column(2), strict=True):
                own = _vectors(data, len(_longs(at)))
                with np.errstate(all="ignore"):
                    centers.append(own.mean(0).tolist())
                    radii.append(float(np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max()))
            columns = [batch.column(0), pa.array(centers, pa.list_(pa.float64())), pa.array(radii, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "center", "radius"])

    found = blocks.select("block", "vec", "at").mapInArrow(run, "block bigint, center array<double>, radius double")
    return [(r.block, np.array(r.center), r.radius) for r in found.collect()]


def _search(vectors: DataFrame, asks: DataFrame, k: int, rows: int) -> DataFrame:
    """(at, x, near): the ``k`` nearest of every ask (at, x, vec), as (d, id, at) ascending.

    ``vectors`` is (at, vec, first, second), ``at`` being 0, 1, … and ``first``
    and ``second`` the smallest ids that have the vector; ``x`` is null or an id
    that is left out.  The own vector is none of the near ones.
    """
    number = F.floor(F.col("at") / rows).cast("long").alias("block")
    ids = ["first", F.coalesce("second", F.lit(0)).alias("second"), F.col("second").isNull().alias("alone")]
    blocks = cut_lineage(_packed(vectors.select(number, "vec", "at", *ids), HELD))
    balls = _balls(blocks)
    listed = dense_index(asks.select("at", "x", "vec"), ["at", "x"], "i")
    number = F.floor(F.col("i") / max(rows, min(MOST_ASKS // BLOCK_ROWS * rows, -(-listed.count() // ASK_BLOCKS)))).cast("long").alias("block")
    bars = [F.coalesce("x", F.lit(0)).alias("x"), F.col("x").isNotNull().alias("bars")]
    asked = cut_lineage(_packed(listed.select(number, "vec", "at", *bars), ASK))

    def first_look(asks: pa.Table, held: pa.Table) -> pa.Table:
        best = Nearest(*_part(asks, ["vec", *ASK]), k)
        for i in range(len(held)):
            best.meet(*_part(held.slice(i, 1), ["vec", *HELD]))
        met, others = set(held.column("home").to_pylist()), []
        with np.errstate(all="ignore"):
            for other, center, radius in balls:
                if other not in met and not _beyond(np.sqrt(((best.vectors - center) ** 2).sum(1)), radius, best.d[:, -1]).all():
                    others.append(other)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (best.d, best.id, best.near)]
        columns = [asks.column("block"), pa.array([others], pa.list_(pa.int64())), *columns]
        return pa.table(columns, names=["block", "others", "d", "id", "near"])

    def look(asks: pa.Table, held: pa.Table) -> pa.Table:
        best = Nearest(*_part(asks, ["vec", *ASK]), k)
        best.d = np.frombuffer(asks.column("d")[0].as_buffer(), "<f8").reshape(-1, k).copy()
        best.id, best.near = (_longs(asks.column(c)[0]).reshape(-1, k).copy() for c in ("id", "near"))
        for i in range(len(held)):
            best.meet(*_part(held.slice(i, 1), ["vec", *HELD]))
        return pa.Table.from_batches([best.rows()])

    ends = [F.floor(F.col(c) / rows).cast("long") for c in ("least", "most")]
    homes = asked.select("block", F.explode(F.sequence(*ends)).alias("home"))
    own = blocks.select(F.col("block").alias("home"), "vec", *HELD).join(homes, "home")
    schema = "block bigint, others array<bigint>, d binary, id binary, near binary"
    looks = cut_lineage(_together(asked.select("block", "vec", *ASK), own, ["block"], asked.count(), first_look, schema))

    pairs = looks.select("block", F.posexplode("others").alias("i", "other")).select("block", F.floor(F.col("i") / RUN).cast("int").alias("part"), "other")
    pairs = cut_lineage(pairs)
    others = blocks.select(F.col("block").alias("other"), "vec", *HELD).join(pairs, "other").drop("other")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("others") / RUN).cast("int") - 1))
    begun = asked.join(looks, "block").withColumn("part", F.explode(parts)).select("block", "part", "vec", *ASK, "d", "id", "near")
    tasks = looks.select(F.explode(parts)).count()
    found = _together(begun, others, ["block", "part"], tasks, look, f"at bigint, x bigint, near {FOUND}")
    # what several calls found for one ask
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return cut_lineage(found.groupBy("at", "x").agg(merged.alias("near")))


def nearest_rows(rows: DataFrame, id_col: str, vec_col: str, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, copies) and (node, near): per id its ``k`` nearest rows of other ids, as (d, node, copies) by distance and id.

    ``id_col`` holds whole numbers.  Rows with null ids and with vectors that are
    null, empty or hold a null or non-finite number take no part, and a distance
    that overflows counts as none.  Vectors must be of one length.  Rows of other
    ids with the same vector are at distance 0.  ``copies`` is how often a row is
    repeated; an id with several vectors has the nearest of all of them.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)
    own = fine_vectors(rows.withColumn(id_col, F.col(id_col).cast("long")), id_col, vec_col).where("vec is not null")
    vectors = on_curves(cut_lineage(own.select("vec").distinct()), 1).select("code", "vec")
    vectors = cut_lineage(dense_index(vectors, ["code", "vec"], "at").select("at", "vec"))
    points = cut_lineage(own.join(vectors, "vec").groupBy("at", "id").agg(F.count(F.lit(1)).alias("copies")))
    several = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("id").alias("x"))
    points = cut_lineage(points.join(several, "id", "left").select("at", "id", "copies", "x"))
    ranked = points.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("id"))).where(F.col("r") <= k + 1)
    held = cut_lineage(ranked.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("id", "copies"))).alias("held")))

    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    count = -(-shape["n"] // min(block_rows, max(256, BLOCK_NUMBERS // (shape["dims"] or 1))))
    block_rows = -(-shape["n"] // max(count, 1)) or 1  # all blocks of about one size
    known = vectors.join(held, "at").select("at", "vec", F.col("held")[0]["id"].alias("first"), F.get("held", F.lit(1))["id"].alias("second"))
    asks = points.select("at", "x").distinct()
    found = _search(known, asks.join(vectors, "at"), k, block_rows)

    # rows for vectors: those of the own vector and of the near ones, of which one may be the row's own
    near = found.select("at", "x", F.explode("near").alias("n")).select("at", "x", "n.d", F.col("n.at").alias("of"))
    near = near.unionByName(asks.select("at", "x", F.lit(0.0).alias("d"), F.col("at").alias("of")))
    near = near.join(held.withColumnRenamed("at", "of"), "of").select("at", "x", "d", F.explode("held").alias("h"))
    near = near.where("x is null or h.id <> x").groupBy("at", "x")
    around = near.agg(F.slice(F.sort_array(F.collect_list(F.struct("d", F.col("h.id").alias("node"), F.col("h.copies").alias("copies")))), 1, k + 1).alias("near"))
    around = around.select(F.col("at").alias("of"), F.col("x").alias("but"), "near")
    mine = points.join(around, F.col("at").eqNullSafe(F.col("of")) & F.col("x").eqNullSafe(F.col("but")), "left")
    mine = mine.select("id", "copies", F.slice(F.filter("near", lambda n: n["node"] != F.col("id")), 1, k).alias("near"))
    merged = mine.groupBy(F.col("id").alias("node")).agg(
        F.max("copies").alias("copies"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")
    )
    merged = cut_lineage(merged)
    return merged.select("node", "copies"), merged.where(F.size("near") > 0).select("node", "near")
