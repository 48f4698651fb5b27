"""Similarity self-join on word n-grams: a grouped prefix join.

Two documents link when the Jaccard similarity of their shingle sets is at
least p / q.  Under one global order of shingles, two such sets share a shingle
within their first n - ceil(n * p / q) + 1 ones (their prefixes), and their
sizes differ by no more than that ratio.

1. The order: shingles of many documents last (their document counts are summed
   over the whole corpus), all others by hash.  Any order gives the same links.
2. Texts with equal sets become one class, whatever ids they have; classes with
   equal prefix and size become one group.  Members are verified against the group's pivot; those
   that don't link to it go on as groups of their own.
3. Groups that share a prefix shingle are candidates.  First every group meets
   only the smallest group of each of its shingles (the hub), which is linear in
   the postings and joins the bulk of any large family.
4. What is still apart: groups under one shingle whose components differ are
   compared pairwise, unless the places of the shingle in both sets or their
   distances to the hub (triangle inequality of the Jaccard distance) already
   rule a link out.
5. Where two groups are apart but their pivots' distance leaves room for a link
   between members, the groups are expanded and their members verified.
6. Components over all verified links and over the classes that share a
   document, expanded to the members of each class.

Steps 2 to 5 know classes only: a document with several texts has a class for
each of them, and every one is posted, absorbed and verified on its own.

No step lists all pairs of a family, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import (
    Worker,
    drop_shared,
    least_count,
    map_texts,
    prepare,
    release_shuffles,
    text_slices,
    write_shared,
)
from skein.llm.components import connected_components
from skein.llm.shingles import digest, shingle_sets

SPREAD = 32  # documents from which a shingle is put last
SPREAD_SHINGLES = 1 << 18  # at most so many, the most frequent ones; 12 bytes each
COUNT_SHINGLES = 1_000_000  # shingles that a worker sums up before it hands counts on
TEXT_CHARS = 400_000  # characters whose shingles a worker hashes at a time
BROADCAST_IDS = 1_000_000  # ids up to which a table of ids is broadcast; beyond, it is joined by a shuffle
_HIGH = np.uint64(32)
#: Shingles that the short form may take for common: n_a * n_b / 2**32 are expected at most, more than eight standard
#: deviations and three above that are out of reach (four in one pair of small sets).
SURPLUS = f"(3 + n_a * double(n_b) / {1 << 32}L + 8 * sqrt(n_a * double(n_b) / {1 << 32}L))"


def doubtful(p: int, q: int) -> str:
    """SQL condition on (both, n_a, n_b): without what the short form may add, the pair might be no link."""
    return f"(both - {SURPLUS}) * {p + q} < {p} * (n_a + n_b)"


def spread_shingles(docs: DataFrame, width: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(32-bit shingle, documents) of the shingles that most documents share, ascending by shingle.

    Counts cover every shingle of every document.  Each worker sums up sorted
    runs and cuts them by the leading bits of the shingle into packets; packets
    of a range meet in one shuffle partition and are merged there.
    """
    spark = docs.sparkSession
    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (4 * partitions - 1).bit_length())

    def packets(runs: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(runs), return_counts=True)
        cuts = np.searchsorted(values, (np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.uint32))
        packet, own = [], np.append(cuts, len(values))
        for k in range(1 << bits):
            a, b = own[k], own[k + 1]
            if b > a:
                packet.append((k, values[a:b].astype("<u4").tobytes(), counts[a:b].astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*packet), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["range", "shingles", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, size = [], 0
        for batch in batches:
            for _, texts in text_slices(batch, TEXT_CHARS, 0):
                for own in shingle_sets(texts, width):
                    runs.append((own >> _HIGH).astype(np.uint32))
                    size += len(own)
                if size >= COUNT_SHINGLES:
                    yield packets(runs)
                    runs, size = [], 0
        if size:
            yield packets(runs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        size = 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            values, place = np.unique(np.concatenate(held), return_inverse=True)
            return values, np.bincount(place, np.concatenate(sums), len(values)).astype(np.int64)

        for batch in batches:
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append(np.frombuffer(a, "<u4"))
                sums.append(np.frombuffer(b, "<u4"))
                size += len(held[-1])
            if size >= 2 * COUNT_SHINGLES:
                values, totals = settle()
                held, sums, size = [values], [totals], 0
        if held:
            values, totals = settle()
            many = totals >= SPREAD
            arrays = [pa.array(values[many].astype(np.int64)), pa.array(totals[many])]
            yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "n"])

    parts = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "range int, shingles binary, counts binary")
    merged = parts.repartition(partitions, "range").mapInArrow(merge, "shingle long, n long")
    merged = write_shared(merged, "shingle-counts")
    top = merged.where(F.col("n") >= least_count(merged, SPREAD_SHINGLES)).toArrow()
    shingle, n = top.column("shingle").to_numpy(), top.column("n").to_numpy()
    drop_shared(merged)
    release_shuffles(spark)
    order = np.argsort(shingle)
    return shingle[order].astype(np.uint32), n[order].astype(np.uint32)


def prefix_table(
    docs: DataFrame, width: int, least: Fraction, spread: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str
) -> DataFrame:
    """(id, n, h1, h2, g1, g2, prefix): set size, hash of the set, hash of the prefix, prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(spread)

    def worker() -> Worker:
        hot, documents = shared.value
        near = np.zeros(1 << 20, bool)
        near[hot & np.uint32((1 << 20) - 1)] = True

        def ranked(own: np.ndarray) -> np.ndarray:
            """``own`` in the global order: rare shingles by hash, then the spread ones by document count."""
            high = (own >> _HIGH).astype(np.uint32)
            maybe = np.flatnonzero(near[high & np.uint32((1 << 20) - 1)])
            if not len(maybe) or not len(hot):
                return own
            place = np.minimum(np.searchsorted(hot, high[maybe]), len(hot) - 1)
            key = np.zeros(len(own), np.uint32)
            key[maybe] = np.where(hot[place] == high[maybe], documents[place], 0)
            return own[np.argsort(key, kind="stable")]

        def run(texts: list[str]) -> list[pa.Array]:
            rows = []
            for own in shingle_sets(texts, width):
                if not len(own):
                    rows.append((0, 0, 0, 0, 0, []))
                    continue
                size = len(own) - -(-len(own) * least.numerator // least.denominator) + 1
                prefix = ranked(own)[:size]
                rows.append((len(own), *digest(own), *digest(prefix), prefix.view(np.int64)))
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            return [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]

        return run

    schema = "n bigint, h1 bigint, h2 bigint, g1 bigint, g2 bigint, prefix array<bigint>"
    return map_texts(docs, worker, schema, id_col, text_col, chars=TEXT_CHARS).withColumnRenamed(id_col, "id")


def _only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (id); broadcast behind a check of its size."""
    ids = ids.withColumnRenamed("id", id_col)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_semi")


def class_sets(docs: DataFrame, classes: DataFrame, width: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    """(class, shingles) of ``classes`` (class, id, h1, h2, copies), one row each, computed from the text of ``id``.

    A document may have several texts: the one whose set has the hash (h1, h2)
    counts.  Only classes with ``copies`` > 1, rows with that id and that set,
    have to be reduced to one row.
    """
    shift = np.uint64(64 - 8 * np.dtype(kind).itemsize)

    def worker() -> Worker:
        def run(texts: list[str]) -> list[pa.Array]:
            sets = shingle_sets(texts, width)
            hashes = [digest(s) if len(s) else (None, None) for s in sets]  # an empty set is of no class
            data = [(s >> shift if shift else s).astype(kind).tobytes() for s in sets]
            return [*(pa.array(h, pa.int64()) for h in zip(*hashes)), pa.array(data, pa.binary())]

        return run

    def computed(own: DataFrame) -> DataFrame:
        wanted = _only(docs.select(id_col, text_col), own.select("id").distinct(), id_col)
        schema = "h1 bigint, h2 bigint, shingles binary"
        sets = map_texts(wanted, worker, schema, id_col, text_col, chars=TEXT_CHARS).withColumnRenamed(id_col, "id")
        own = own.select("class", "id", "h1", "h2")
        own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
        return sets.join(own, ["id", "h1", "h2"]).select("class", "shingles")

    sets = computed(classes.where("copies = 1"))
    repeated = classes.where("copies > 1")
    if not repeated.isEmpty():
        sets = sets.unionByName(computed(repeated).dropDuplicates(["class"]))
    return sets


def verify(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, id_col: str, text_col: str, kind: str = "<u4"
) -> DataFrame:
    """(a, b, both, n_a, n_b) with the sizes of intersection and sets for ``pairs`` (a, b) of classes, a written table.

    The sets are computed again from the texts of the classes in question and
    travel as the leading 32 bits of each shingle ("<u4") or whole ("<u8").  The
    short form may count a few shingles too many as common, never too few.
    """
    spark = docs.sparkSession

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            rows = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                rows.append((int((x[place] == y).sum()), len(x), len(y)))
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([a, b, *counts], names=["a", "b", "both", "n_a", "n_b"])

    meant = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    meant = write_shared(classes.join(meant, "class"), "pair-classes")
    sets = write_shared(class_sets(docs, meant, width, id_col, text_col, kind), "pair-sets")
    joined = (
        pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("right")), "b")
        .select("a", "b", "left", "right")
    )
    checked = joined.mapInArrow(intersect, "a long, b long, both long, n_a long, n_b long")
    checked = write_shared(checked, "pairs-verified")
    drop_shared(sets)
    release_shuffles(spark)
    return checked


def similarity_components(
    docs: DataFrame,
    width: int = 5,
    least: Fraction = Fraction(4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: (id, n_shingles, component_id).

    ``n_shingles`` is the size of the row's set of ``width``-word shingles
    (fewer words: the whole sequence as one), ``component_id`` the smallest id
    reachable through pairs with a Jaccard similarity of ``least`` or more, the
    row's own included.

    A null or empty text has no shingles and links with nothing; a row with a
    null id has a null component and takes no part; rows that repeat an id are
    the same document, and any of its texts may link.  An empty table gives no row.  Other columns are not
    read.
    """
    spark = docs.sparkSession
    prepare(spark)
    p, q = least.numerator, least.denominator
    spread = spread_shingles(docs, width, text_col)
    table = write_shared(prefix_table(docs, width, least, spread, id_col, text_col), "prefixes")
    rows = table.where("n > 0 and id is not null")

    # classes of equal sets, numbered in the order of their smallest ids; groups of equal prefix and size
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep")).orderBy("rep", "h1", "h2")
    classes = write_shared(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = rows.select("id", "n", "h1", "h2", "g1", "g2").join(classes, ["h1", "h2"])
    members = members.groupBy(*members.columns).agg(F.count(F.lit(1)).alias("copies"))
    members = write_shared(members, "members")
    reps = members.where("id = rep").select("class", "id", "n", "h1", "h2", "g1", "g2", "copies")
    texts = reps.select("class", "id", "h1", "h2", "copies")
    groups = write_shared(reps.groupBy("n", "g1", "g2").agg(F.min("class").alias("pivot")), "groups")
    grouped = reps.join(groups, ["n", "g1", "g2"]).where("class <> pivot")
    in_groups = write_shared(grouped.select(F.col("pivot").alias("a"), F.col("class").alias("b")), "pairs")

    similar = F.expr(f"both * {p + q} >= {p} * (n_a + n_b)")  # both / (n_a + n_b - both) >= p / q
    # the largest distance of a link; the small term covers rounding and the short form of the sets
    reach = float(1 - least) + 0.002
    none = spark.createDataFrame([], "a long, b long, far double")

    def distances(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, all) of ``pairs`` (a, b): written tables (a, b) and (a, b, far) with the Jaccard distance."""
        if pairs.isEmpty():
            return none.select("a", "b"), none
        checked = verify(docs, texts, pairs, width, id_col, text_col)
        # common shingles that the short form may have added decide: those pairs are verified again with whole shingles
        close = checked.where(similar).where(doubtful(p, q)).select("a", "b").distinct()
        close = write_shared(close, "pairs")
        links = checked.where(similar).select("a", "b").distinct()
        if not close.isEmpty():
            exact = verify(docs, texts, close, width, id_col, text_col, "<u8").where(similar).select("a", "b")
            links = links.join(close, ["a", "b"], "left_anti").unionByName(exact)
        far = checked.select("a", "b", (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("far"))
        return write_shared(links, "links"), far

    def joined(before: DataFrame, *links: DataFrame) -> DataFrame:
        """Components (node, component) of the links and the components found before."""
        edges = before.select(F.col("node").alias("u"), F.col("component").alias("v"))
        for more in links:
            edges = edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return connected_components(edges)

    # members of a group that link to its pivot stay behind it, within a radius
    own, far = distances(in_groups)
    behind = write_shared(own.join(far, ["a", "b"]).distinct(), "absorbed")
    radius = behind.groupBy(F.col("a").alias("unit")).agg(F.max("far").alias("radius"))
    radius = write_shared(radius, "radius")
    start = write_shared(own.select(F.col("b").alias("node"), F.col("a").alias("component")), "stars")

    # postings of the groups: pivots, and members that don't link to theirs
    units = (
        rows.join(classes, ["h1", "h2"])
        .where("id = rep")
        .select(F.col("class").alias("unit"), "n", "prefix")
        .dropDuplicates(["unit"])
        .join(behind.select(F.col("b").alias("unit")), "unit", "left_anti")
    )
    postings = units.select("unit", "n", F.posexplode("prefix").alias("pos", "shingle"))
    least_unit = F.min(F.struct("unit", "n", "pos")).alias("hub")
    hubs = postings.groupBy("shingle").agg(least_unit, F.count(F.lit(1)).alias("m")).where("m > 1")
    hubs = hubs.select("shingle", *(F.col(f"hub.{c}").alias(name) for c, name in (("unit", "hub"), ("n", "hub_n"), ("pos", "hub_pos"))))
    hubs = write_shared(hubs, "hubs")
    shared = write_shared(postings.join(hubs, "shingle"), "postings")  # under shingles of two groups or more
    # sizes, and places: before their first common shingle two sets have nothing in common, so what is
    # behind it bounds the intersection (for a whole group, as its members share size and prefix)
    room = "{q} * least(n, {n}) >= {p} * greatest(n, {n}) and {s} * least(n - pos, {n} - {pos}) >= {p} * (n + {n})"
    sizes = F.expr(room.format(p=p, q=q, s=p + q, n="hub_n", pos="hub_pos"))
    to_hub = shared.where(F.col("unit") != F.col("hub")).where(sizes)
    to_hub = write_shared(to_hub.select(F.col("hub").alias("a"), F.col("unit").alias("b")).distinct(), "pairs")
    hub_links, hub_far = distances(to_hub)
    found = joined(start, hub_links)

    # groups under one shingle that are still apart
    apart = shared.join(found.withColumnRenamed("node", "unit"), "unit", "left").join(radius, "unit", "left")
    apart = apart.withColumns({"component": F.coalesce("component", "unit"), "radius": F.coalesce("radius", F.lit(0.0))})
    apart = write_shared(apart, "postings")
    several = apart.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    several = write_shared(several.where("x < y").select("shingle"), "shingles")
    distance = hub_far.select(F.col("a").alias("hub"), F.col("b").alias("unit"), "far")
    rest = apart.where("unit <> hub").join(several, "shingle", "left_semi").join(distance, ["hub", "unit"], "left")
    rest = write_shared(rest.select("shingle", "unit", "n", "pos", "component", "radius", "far"), "postings")
    other = rest.select("shingle", *(F.col(c).alias(f"{c}_b") for c in rest.columns if c != "shingle"))
    pairs = rest.join(other, "shingle").where(
        f"unit < unit_b and component <> component_b and {room.format(p=p, q=q, s=p + q, n='n_b', pos='pos_b')}"
        f" and coalesce(abs(far - far_b) <= {reach!r} + radius + radius_b, true)"
    )
    pairs = write_shared(pairs.select(F.col("unit").alias("a"), F.col("unit_b").alias("b")).distinct(), "pairs")
    pair_links, pair_far = distances(pairs)
    found = joined(found, pair_links)

    # members of groups that are apart, where the distance of the pivots leaves room for a link
    inner = behind.select(F.col("a").alias("pivot"), F.col("b").alias("member"), F.col("far").alias("own"))
    pivots = radius.select(F.col("unit").alias("pivot"), F.col("unit").alias("member"), F.lit(0.0).alias("own"))
    inner = write_shared(inner.unionByName(pivots), "members")
    near = hub_far.unionByName(pair_far).distinct().where(f"far <= {3 * reach!r}")
    for end in ("a", "b"):
        label = found.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
        near = near.join(label, end, "left").withColumn(f"component_{end}", F.coalesce(f"component_{end}", end))
    near = write_shared(near.where("component_a <> component_b").select("a", "b", "far"), "pairs")
    for end in ("a", "b"):
        side = inner.select(F.col("pivot").alias(end), F.col("member").alias(f"x_{end}"), F.col("own").alias(f"own_{end}"))
        near = near.join(side, end, "left").withColumns(
            {f"x_{end}": F.coalesce(f"x_{end}", end), f"own_{end}": F.coalesce(f"own_{end}", F.lit(0.0))}
        )
    near = near.where(f"far - own_a - own_b <= {reach!r} and (x_a <> a or x_b <> b)")
    near = write_shared(near.select(F.col("x_a").alias("a"), F.col("x_b").alias("b")).distinct(), "pairs")
    member_links, _ = distances(near)

    # one document may have several texts: its classes are linked, and a component bears its smallest id
    several = members.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z")
    same = members.join(several.select("id", "a"), "id").where("class > a").select("a", F.col("class").alias("b"))
    components = joined(found, member_links, same.distinct())
    components = components.select(F.col("node").alias("class"), "component")
    least_id = classes.join(components, "class").groupBy("component").agg(F.min("rep").alias("component_id"))
    least_id = write_shared(least_id, "component-ids")
    named = components.join(F.broadcast(least_id) if least_id.count() <= BROADCAST_IDS else least_id, "component")
    label = classes.join(named, "class", "left")
    label = write_shared(label.select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id")), "labels")
    linked = rows.select("id", "n", "h1", "h2").join(label, ["h1", "h2"]).select("id", "n", "component_id")
    alone = table.where("n = 0 or id is null").select("id", "n", F.when(F.lit(True), F.col("id")).alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


NULL_IDS = 1 << 62  # stand-ins for null ids begin here; no document may have such an id


def representatives(
    docs: DataFrame,
    width: int = 5,
    least: Fraction = Fraction(4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` of each group of near duplicates: that of the smallest (integer) id.

    Rows with a null id are compared too and come behind all others.  Of rows
    that repeat an id and a text one stays, the least in its other columns; rows
    with one id and several texts are one document and stay or go together.
    Texts without words are near no other; only their exact repeats go.  Other
    columns pass through, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # texts that are equal have one stand-in, so they are one document
    other = F.lit(NULL_IDS) + F.pmod(F.xxhash64(text), F.lit(NULL_IDS - 1))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), other).alias("key"), text.alias("body"))
    found = similarity_components(rows, width, least, "key", "body")
    found = write_shared(found.select("key", "component_id"), "components")
    later = write_shared(found.where("component_id < key").select("key").distinct(), "later-ids")
    repeated = write_shared(found.groupBy("key").count().where("count > 1").select("key"), "repeated-ids")

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    kept = rows.join(few(later), "key", "left_anti")
    once = kept.join(few(repeated), "key", "left_anti").select("row")
    # equal rows meet in partial aggregates first, so copies of a third of the table are no hot group
    again = kept.join(few(repeated), "key", "left_semi")
    again = again.groupBy("key", F.xxhash64("body").alias("h1"), F.md5("body").alias("h2")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(again.select("row")).select("row.*")


def op7_query(docs: DataFrame) -> DataFrame:
    return similarity_components(docs, width=3, least=Fraction(9, 10))
