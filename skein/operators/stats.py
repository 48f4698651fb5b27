"""Statistics: exact quantiles and medians, Mann-Whitney U (topic vs rest and two
samples), Benjamini-Hochberg q-values, significance stars, Gaussian KDE
(AG-8, AG-9, AG-10, STAT-1 … STAT-6).

Scale design
------------
Everything is built on one primitive, ``ranked_histogram``: the distinct values
of each group with their count ``c`` and the number of smaller values
``below``.  It is exact and never puts a whole group in one task:

1. ``groupBy(group, value).count()`` — a value repeated by a third of all rows is
   one histogram row;
2. ``repartitionByRange`` on (group, value) and a per-partition running count
   (``mapInPandas`` over Arrow batches, state carried across batches);
3. per-partition totals (one row per partition and group) turned into offsets by
   a window over that small table and joined back.

The positioned histogram is written to the reliable checkpoint folder so the
partition ids used for offsets and rows come from one materialisation.

* mid-rank of a value = below + (c + 1) / 2  → U for every topic in one pass;
* k-th smallest value of a group = the row with below < k ≤ below + c, found by
  an equi-join on the group with a tiny table of target positions;
* the k-th smallest value of "everything except topic t" is found from the
  topic's own rows (see ``_rest_positions``) — no topic × value pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import KDE_GRID, QUANTILES
from skein.functions.scalar import significance, to_number
from skein.operators.relational import finite
from skein.session import cut_lineage

# ---------------------------------------------------------------------------
# Long format and the ranked histogram
# ---------------------------------------------------------------------------


def long_metrics(df: DataFrame, keep: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keep…, metric, value) with non-finite values removed (FLT-10, PRJ-2)."""
    cols = [to_number(m).alias(m) for m in metrics]
    wide = df.select(*keep, *cols)
    long = wide.unpivot(list(keep), list(metrics), "metric", "value")
    return long.filter(finite("value"))


def _local_running(group_cols: list[str]):
    """Per-partition exclusive running count per group, rows sorted by (group, value).

    State (last group key, its running total) is carried across Arrow batches.
    """

    def run(batches):
        carry_key, carry_val = None, 0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(lbelow=pd.Series(dtype="int64"))
                continue
            size = len(pdf)
            if group_cols:
                g = pdf[group_cols]
                change = g.ne(g.shift(1)).any(axis=1).to_numpy()
                first_key = tuple(g.iloc[0])
                last_key = tuple(g.iloc[-1])
            else:
                change = np.zeros(size, dtype=bool)
                first_key = last_key = ()
            change[0] = True
            c = pdf["c"].to_numpy(dtype="int64")
            csum = np.cumsum(c)
            start_idx = np.maximum.accumulate(np.where(change, np.arange(size), 0))
            base = np.where(start_idx > 0, csum[np.maximum(start_idx - 1, 0)], 0)
            lbelow = csum - c - base
            continues = carry_key is not None and first_key == carry_key
            if continues:
                lbelow = lbelow + np.where(start_idx == 0, carry_val, 0)
            last_start = start_idx[-1]
            tail_total = int(csum[-1] - (csum[last_start - 1] if last_start > 0 else 0))
            carry_val = carry_val + tail_total if (continues and last_start == 0) else tail_total
            carry_key = last_key
            yield pdf.assign(lbelow=lbelow.astype("int64"))

    return run


def ranked_histogram(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str = "value",
    partitions: int | None = None,
    materialize: bool = True,
    counts: str | None = None,
) -> DataFrame:
    """(group…, value, c, below): exact per-group value counts and count of smaller values.

    ``counts`` names a column that holds how often each row counts, so a
    histogram can be made from a finer one without reading the data again.
    """
    group_cols = list(group_cols)
    times = F.sum(counts) if counts else F.count(F.lit(1))
    hist = df.groupBy(*group_cols, value_col).agg(times.alias("c"))
    # without an explicit count AQE may coalesce neighbouring ranges (order is kept)
    by_range = hist.repartitionByRange(partitions, *group_cols, value_col) if partitions else hist.repartitionByRange(*group_cols, value_col)
    ranged = (
        by_range
        .sortWithinPartitions(*group_cols, value_col)
        .withColumn("pid", F.spark_partition_id())
    )
    schema = T.StructType(ranged.schema.fields + [T.StructField("lbelow", T.LongType())])
    local = ranged.mapInPandas(_local_running(group_cols), schema)
    if materialize:
        local = cut_lineage(local)
    totals = local.groupBy("pid", *group_cols).agg(F.sum("c").alias("ptotal"))
    w = Window.partitionBy(*group_cols).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid", *group_cols, F.coalesce(F.sum("ptotal").over(w), F.lit(0)).alias("offset"))
    # one row per (partition, group) that meet, partitions + groups at most: broadcast, never a
    # shuffle of the histogram on a handful of group keys
    out = local.join(F.broadcast(offsets), ["pid", *group_cols])
    return out.select(*group_cols, value_col, "c", (F.col("offset") + F.col("lbelow")).alias("below"))


def _lookup(hist: DataFrame, group_cols: Sequence[str], targets: DataFrame, value_col: str = "value") -> DataFrame:
    """Value at 1-based position ``pos`` of each group: the row with below < pos ≤ below + c.

    ``targets`` (group…, tag, pos) is small (a few rows per group); the join is on
    the group keys with the position range as a residual condition.
    """
    h = hist.alias("h")
    # a few targets per group, and groups are topics × metrics: broadcast, so no task ever
    # receives a whole group's histogram (a shuffle join on the group key would)
    t = F.broadcast(targets).alias("t")
    cond = [F.col(f"h.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group_cols]
    cond.append(F.col("h.below") < F.col("t.pos"))
    cond.append(F.col("t.pos") <= F.col("h.below") + F.col("h.c"))
    joined = h.join(t, cond)
    return joined.select(*[F.col(f"t.{g}").alias(g) for g in group_cols], F.col("t.tag"), F.col(f"h.{value_col}").alias("v"))


def exact_quantiles(
    long: DataFrame,
    group_cols: Sequence[str],
    probs: Sequence[float] = QUANTILES,
    value_col: str = "value",
    hist: DataFrame | None = None,
) -> DataFrame:
    """AG-8: (group…, q, value) exact quantiles with linear interpolation (numpy's default)."""
    group_cols = list(group_cols)
    hist = hist if hist is not None else ranked_histogram(long, group_cols, value_col)
    sizes = hist.groupBy(*group_cols).agg(F.sum("c").alias("n"))
    qs = F.array(*[F.lit(float(p)) for p in probs])
    per_q = sizes.select(*group_cols, "n", F.explode(qs).alias("q")).withColumn("h", (F.col("n") - 1) * F.col("q"))
    lo = per_q.select(*group_cols, "q", "h", (F.floor("h") + 1).cast("long").alias("pos"), F.lit("lo").alias("side"))
    hi = per_q.select(*group_cols, "q", "h", (F.ceil("h") + 1).cast("long").alias("pos"), F.lit("hi").alias("side"))
    targets = lo.unionByName(hi).withColumn("tag", F.concat_ws("|", F.col("q").cast("string"), "side"))
    found = _lookup(hist, group_cols, targets.select(*group_cols, "tag", "pos"), value_col)
    found = found.join(targets.select(*group_cols, "tag", "q", "h", "side"), [*group_cols, "tag"])
    agg = found.groupBy(*group_cols, "q", "h").agg(
        F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("v_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("v_hi"),
    )
    frac = F.col("h") - F.floor("h")
    value = F.col("v_lo") + frac * (F.col("v_hi") - F.col("v_lo"))
    return agg.select(*group_cols, "q", value.alias("value"))


def quantile_table(
    long: DataFrame,
    group_col: str,
    probs: Sequence[float] = QUANTILES,
    spine: DataFrame | None = None,
) -> DataFrame:
    """AG-8: wide table, one row per group (``spine`` completes missing groups), columns q01…q99."""
    return _widened(exact_quantiles(long, [group_col], probs), group_col, probs, spine)


def quantile_tables(
    df: DataFrame,
    group_col: str,
    metrics: Sequence[str],
    probs: Sequence[float] = QUANTILES,
    spine: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """AG-8 for several metrics: metric → wide table, all from one histogram of the data."""
    q = cut_lineage(exact_quantiles(long_metrics(df, [group_col], metrics), ["metric", group_col], probs))
    return {m: _widened(q.filter(F.col("metric") == m), group_col, probs, spine) for m in metrics}


def _widened(q: DataFrame, group_col: str, probs: Sequence[float], spine: DataFrame | None) -> DataFrame:
    names = {float(p): f"q{int(round(p * 100)):02d}" for p in probs}
    wide = q.groupBy(group_col).agg(
        *[F.max(F.when(F.abs(F.col("q") - p) < 1e-12, F.col("value"))).alias(names[float(p)]) for p in probs]
    )
    return spine.join(wide, group_col, "left") if spine is not None else wide


def group_medians(df: DataFrame, group_col: str, cols: Sequence[str]) -> DataFrame:
    """AG-9: per-group medians of several columns after a joint null drop (FLT-12)."""
    clean = df.select(group_col, *[to_number(c).alias(c) for c in cols]).na.drop()
    long = clean.unpivot([group_col], list(cols), "metric", "value")
    q = exact_quantiles(long, [group_col, "metric"], [0.5])
    return q.groupBy(group_col).pivot("metric", list(cols)).agg(F.first("value"))


# ---------------------------------------------------------------------------
# Mann-Whitney U
# ---------------------------------------------------------------------------


_PERIOD = 840  # least common multiple of 1 … 8


def _sums_up_to(limit: int, parts: int) -> int:
    """Number of ways to write a number of at most ``limit`` as a sum of parts 1 … ``parts`` (≤ 8), order aside.

    For limits of one residue modulo the period the numbers follow a polynomial
    of degree ``parts``; it is fixed by its first values, so any limit takes the
    same time and memory.
    """
    if limit < 0:
        return 0
    at, rest = divmod(limit, _PERIOD)
    known = _first_sums(parts)[rest::_PERIOD][: parts + 1]
    if at <= parts:
        return known[at]
    # Lagrange through 0 … parts; the factors are integers up to the common denominator
    total, whole = 0, math.factorial(parts)
    span = math.prod(at - j for j in range(parts + 1))
    for i, value in enumerate(known):
        total += (-1) ** (parts - i) * math.comb(parts, i) * value * (span // (at - i))
    return total // whole


@functools.lru_cache(maxsize=8)
def _first_sums(parts: int) -> list[int]:
    ways = [1] * (_PERIOD * (parts + 1))  # limits 0 …: the unused remainder is one more part of size 1
    for size in range(1, parts + 1):
        for k in range(size, len(ways)):
            ways[k] += ways[k - size]
    return ways


def _exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U ≥ u) under H0 without ties, in constant memory for min(n1, n2) ≤ 8.

    U has the generating function ∏ (1 − q^(N+i)) / (1 − q^i) for i = 1 … m; its
    numerator has at most 2^m terms, each of which shifts the count of sums.
    """
    m, big = min(n1, n2), max(n1, n2)
    below = math.ceil(u - 1e-9) - 1
    if below < 0:
        return 1.0
    count = 0
    for chosen in range(1 << m):
        shift = sum(big + i + 1 for i in range(m) if chosen >> i & 1)
        count += (-1) ** chosen.bit_count() * _sums_up_to(below - shift, m)
    total = math.comb(n1 + n2, m)
    return max(0, total - count) / total


def mwu_p_value(u1: float, n1: int, n2: int, tie_term: float, exact_limit: int = 8) -> float:
    """Two-sided p-value, ``method='auto'``: exact when one side ≤ 8 and no ties, else the
    normal approximation with tie and continuity correction."""
    if n1 < 1 or n2 < 1 or u1 is None or (isinstance(u1, float) and math.isnan(u1)):
        return float("nan")
    n = n1 + n2
    u2 = n1 * n2 - u1
    u = max(u1, u2)
    if min(n1, n2) <= exact_limit and tie_term == 0:
        return min(1.0, 2.0 * _exact_sf(u, n1, n2))
    mu = n1 * n2 / 2.0
    var = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return float("nan")
    z = (u - mu - 0.5) / math.sqrt(var)
    return min(1.0, max(0.0, math.erfc(z / math.sqrt(2.0))))


@F.pandas_udf(T.DoubleType())
def mwu_p_udf(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Arrow-batched p-values on the aggregated rows (one row per topic × metric)."""
    out = []
    for a, b, c, d in zip(u1, n1, n2, ties):
        if pd.isna(a) or pd.isna(b) or pd.isna(c) or b < 2 or c < 2:
            out.append(float("nan"))
        else:
            out.append(mwu_p_value(float(a), int(b), int(c), float(d)))
    return pd.Series(out, dtype="float64")


def mwu_z(u1: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """z of the normal approximation (the SQL-checkable part of the p-value)."""
    n = n1 + n2
    u = F.greatest(u1, n1 * n2 - u1)
    var = n1 * n2 / 12.0 * ((n + 1) - F.try_divide(ties, n * (n - 1)))
    # all values tied → zero variance → no test (null)
    return F.when(var > 0, F.try_divide(u - n1 * n2 / 2.0 - 0.5, F.sqrt(var)))


def _rest_positions(
    topic_hist: DataFrame, global_hist: DataFrame, sizes: DataFrame, group_cols: list[str], topic_col: str
) -> DataFrame:
    """Targets for the median of "all values except topic t", as global positions.

    For topic values u_1 < … < u_m with cumulative topic counts CT_j, the k-th
    smallest rest value v* lies at global position k + CT_{j*}, where j* is the
    last topic value with (rest values below u_j) = belowAll(u_j) − belowT(u_j) < k.
    Only the topic's own histogram rows are scanned.
    """
    g = global_hist.select(*group_cols, "value", F.col("below").alias("below_all"))
    th = topic_hist.join(g, [*group_cols, "value"])
    th = th.withColumn("rest_below", F.col("below_all") - F.col("below")).withColumn("ct", F.col("below") + F.col("c"))
    ks = sizes.select(
        *group_cols, topic_col, "n_rest",
        F.explode(
            F.array(
                F.struct(F.lit("lo").alias("side"), F.floor((F.col("n_rest") + 1) / 2).cast("long").alias("k")),
                F.struct(F.lit("hi").alias("side"), F.ceil((F.col("n_rest") + 1) / 2).cast("long").alias("k")),
            )
        ).alias("t"),
    ).select(*group_cols, topic_col, "t.side", "t.k").filter(F.col("k") >= 1)
    cand = th.join(F.broadcast(ks), [*group_cols, topic_col]).filter(F.col("rest_below") < F.col("k"))
    best = cand.groupBy(*group_cols, topic_col, "side", "k").agg(F.max_by("ct", "value").alias("ct_star"))
    ks = ks.join(best, [*group_cols, topic_col, "side", "k"], "left")
    return ks.select(*group_cols, topic_col, "side", (F.col("k") + F.coalesce("ct_star", F.lit(0))).alias("pos"))


def topic_vs_rest(
    df: DataFrame,
    topic_col: str,
    metrics: Sequence[str],
    kind: str = "videos",
    with_p: bool = True,
    with_fdr: bool = True,
) -> DataFrame:
    """STAT-1 (+ STAT-2, STAT-5, SC-17): per topic × metric, Mann-Whitney U of the topic's
    finite values against all other rows' finite values.  JN-10 "topic vs rest" is
    derived from totals minus the topic (no join); WN-5 mid-ranks from the ranked
    histogram; AG-10 means/medians of both sides.

    Columns: kind, topic, metric, n_topic, n_rest, median_topic, median_rest,
    mean_topic, mean_rest, u_stat, tie_term, z, [p_value, q_value_bh_fdr, significance].
    A topic without finite values of a metric has a row with n_topic = 0; sides
    with fewer than two values give null U / p.
    """
    long = long_metrics(df.filter(F.col(topic_col).isNotNull()), [topic_col], metrics)
    group_cols = ["metric"]
    thist = ranked_histogram(long, [*group_cols, topic_col])
    ghist = ranked_histogram(thist, group_cols, counts="c")

    totals = ghist.groupBy("metric").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("value")).alias("sum_all"),
        F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("tie_term"),
    )
    mid = ghist.select("metric", "value", (F.col("below") + (F.col("c") + 1) / 2.0).alias("midrank"))
    per_topic = thist.join(mid, ["metric", "value"]).groupBy("metric", topic_col).agg(
        F.sum("c").alias("n_topic"),
        F.sum(F.col("c") * F.col("value")).alias("sum_topic"),
        F.sum(F.col("c") * F.col("midrank")).alias("rank_sum"),
    )
    # every topic with every metric, also where it has no finite value (topics × metrics rows)
    spine = df.filter(F.col(topic_col).isNotNull()).select(topic_col).distinct()
    spine = spine.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    stats = spine.join(F.broadcast(totals), "metric", "left").join(F.broadcast(per_topic), ["metric", topic_col], "left")
    stats = stats.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_topic")})
    stats = cut_lineage(stats.withColumn("n_rest", F.col("n") - F.col("n_topic")))

    # medians: topic from its own histogram, rest from global positions
    tpos = stats.select(
        "metric", topic_col,
        F.explode(
            F.array(
                F.struct(F.lit("lo").alias("tag"), F.floor((F.col("n_topic") + 1) / 2).cast("long").alias("pos")),
                F.struct(F.lit("hi").alias("tag"), F.ceil((F.col("n_topic") + 1) / 2).cast("long").alias("pos")),
            )
        ).alias("t"),
    ).select("metric", topic_col, "t.tag", "t.pos").filter(F.col("pos") >= 1)
    tmed = _lookup(thist, ["metric", topic_col], tpos).groupBy("metric", topic_col).agg((F.sum("v") / 2.0).alias("median_topic"))
    rpos = _rest_positions(thist, ghist, stats, group_cols, topic_col)
    rtargets = rpos.select("metric", F.concat_ws("|", F.col(topic_col).cast("string"), "side").alias("tag"), "pos", topic_col)
    rfound = _lookup(ghist, ["metric"], rtargets.select("metric", "tag", "pos"))
    rmed = (
        rfound.join(rtargets.select("metric", "tag", topic_col), ["metric", "tag"])
        .groupBy("metric", topic_col)
        .agg((F.sum("v") / 2.0).alias("median_rest"))
    )

    n1, n2 = F.col("n_topic").cast("double"), F.col("n_rest").cast("double")
    u1 = F.col("rank_sum") - n1 * (n1 + 1) / 2.0
    ok = (F.col("n_topic") >= 2) & (F.col("n_rest") >= 2)
    out = (
        stats.join(tmed, ["metric", topic_col], "left")
        .join(rmed, ["metric", topic_col], "left")
        .select(
            F.lit(kind).alias("kind"),
            F.col(topic_col),
            "metric",
            F.col("n_topic").cast("bigint").alias("n_topic"),
            F.col("n_rest").cast("bigint").alias("n_rest"),
            "median_topic",
            F.when(F.col("n_rest") > 0, F.col("median_rest")).alias("median_rest"),
            F.when(F.col("n_topic") > 0, F.col("sum_topic") / n1).alias("mean_topic"),
            F.when(F.col("n_rest") > 0, (F.col("sum_all") - F.coalesce("sum_topic", F.lit(0.0))) / n2).alias("mean_rest"),
            F.when(ok, u1).alias("u_stat"),
            "tie_term",
            F.when(ok, mwu_z(u1, n1, n2, F.col("tie_term"))).alias("z"),
        )
    )
    if with_p:
        out = out.withColumn("p_value", F.when(F.col("u_stat").isNotNull(), mwu_p_udf("u_stat", "n_topic", "n_rest", "tie_term")))
        if with_fdr:
            out = bh_fdr(out, "p_value", ["kind", "metric"]).withColumn("significance", significance("q_value_bh_fdr"))
    return out


def two_sample_u(a: DataFrame, b: DataFrame, metric: str, names: tuple[str, str] = ("videos", "comments")) -> DataFrame:
    """STAT-3: sample ``a`` vs sample ``b`` on one metric; q = p (a single test)."""
    side = "__side"
    both = a.select(F.lit(names[0]).alias(side), F.col(metric)).unionByName(b.select(F.lit(names[1]).alias(side), F.col(metric)))
    # a single test: q = p, so no FDR windows
    res = topic_vs_rest(both, side, [metric], kind="two_sample", with_p=True, with_fdr=False).filter(F.col(side) == names[0])
    return res.select(
        F.lit(metric).alias("metric"),
        F.col("n_topic").alias(f"n_{names[0]}"),
        F.col("n_rest").alias(f"n_{names[1]}"),
        F.col("median_topic").alias(f"median_{names[0]}"),
        F.col("median_rest").alias(f"median_{names[1]}"),
        F.col("mean_topic").alias(f"mean_{names[0]}"),
        F.col("mean_rest").alias(f"mean_{names[1]}"),
        "u_stat",
        "z",
        "p_value",
        F.col("p_value").alias("q_value_bh_fdr"),
        significance("p_value").alias("significance"),
    )


# ---------------------------------------------------------------------------
# Benjamini-Hochberg
# ---------------------------------------------------------------------------


def bh_fdr(df: DataFrame, p_col: str, partition_cols: Sequence[str], q_col: str = "q_value_bh_fdr") -> DataFrame:
    """STAT-5: BH q-values within each partition; non-finite p stay null and do not count in m.

    q_(i) = min_{j ≥ i} p_(j)·m / j, clipped to [0, 1] (WN-6: running minimum from the largest p).  The windows are
    partitioned by (kind, metric): one partition holds the tests of one family
    (topics × metrics rows), never data rows.
    """
    ok = finite(p_col)
    tested = df.filter(ok)
    untested = df.filter(~ok).withColumn(q_col, F.lit(None).cast("double"))
    parts = [F.col(c) for c in partition_cols]
    order = Window.partitionBy(*parts).orderBy(F.col(p_col).asc())  # ties give equal q either way
    ranked = tested.withColumn("__rank", F.row_number().over(order)).withColumn(
        "__m", F.count(F.lit(1)).over(Window.partitionBy(*parts))
    )
    raw = F.col(p_col) * F.col("__m") / F.col("__rank")
    suffix = Window.partitionBy(*parts).orderBy(F.col("__rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = ranked.withColumn(q_col, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(raw).over(suffix))))
    return q.drop("__rank", "__m").unionByName(untested)


# ---------------------------------------------------------------------------
# Kernel density
# ---------------------------------------------------------------------------

KDE_CELLS = 4  # cells per bandwidth
KDE_ORDER = 10  # power sums kept per cell
KDE_REACH = 39.0  # bandwidths from which a Gaussian kernel is 0 in doubles


def kde_grid(df: DataFrame, value_col: str, grid: tuple[float, float, int] = KDE_GRID) -> DataFrame:
    """STAT-6: Gaussian KDE (Scott bandwidth, sample std) on an even grid: (idx, x, density).

    One pass adds the values up in cells of a quarter bandwidth, each as the power
    sums of the values' distances from its middle; partial sums leave every task
    with one row per cell.  Expanding the kernel in these distances (Hermite
    series) gives the density, so the kernels are evaluated per cell, not per
    value.  With distances d of at most 1/8 and ten sums, the rest of a value's
    series is below 1.1 · d¹⁰ / √10! / (1 − d), 1e-12 of its kernel's peak.
    Cells reach 39 bandwidths beyond the grid (a kernel is 0 from there on), so
    their number depends on the bandwidth alone.  n and h come from a one-row
    aggregate read on the driver.
    Empty when n < 3 or the standard deviation is 0.
    """
    lo, hi, npts = grid
    step = (hi - lo) / (npts - 1)
    spark = df.sparkSession
    vals = df.select(F.col(value_col).cast("double").alias("x")).filter(finite("x"))
    stats = vals.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd")).first()
    schema = "idx INT, x DOUBLE, density DOUBLE"
    if stats is None or stats["n"] < 3 or not stats["sd"] or stats["sd"] <= 0:
        return spark.createDataFrame([], schema)
    n = int(stats["n"])
    h = float(stats["sd"]) * n ** -0.2
    width, first = h / KDE_CELLS, lo - KDE_REACH * h
    grid_x = lo + step * np.arange(npts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(npts)
        for batch in batches:
            cell, *sums = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + KDE_ORDER))
            for k in range(0, len(cell), 2_000):
                near = (grid_x[:, None] - (first + (cell[None, k : k + 2_000] + 0.5) * width)) / h
                before, now = np.zeros_like(near), np.exp(-near * near / 2.0)  # Hermite polynomials times the kernel
                for order, power_sum in enumerate(sums):
                    total += now @ (power_sum[k : k + 2_000] / math.factorial(order))
                    before, now = now, near * now - order * before
        arrays = [pa.array(np.arange(npts, dtype=np.int32)), pa.array(total)]
        yield pa.RecordBatch.from_arrays(arrays, names=["idx", "part"])

    cells = vals.where(F.col("x").between(first, hi + KDE_REACH * h)).select(
        "x", F.floor((F.col("x") - first) / width).cast("bigint").alias("cell")
    )
    cells = cells.select("cell", ((F.col("x") - (F.lit(first) + (F.col("cell") + 0.5) * width)) / h).alias("d"))
    powers = [F.lit(1.0)]
    for _ in range(1, KDE_ORDER):
        powers.append(powers[-1] * F.col("d"))
    sums = cells.groupBy("cell").agg(*(F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)))
    # one vector of grid sums per partition, whatever its number of cells
    parts = sums.mapInArrow(partial, "idx int, part double")
    dens = parts.groupBy("idx").agg((F.sum("part") / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))
    spine = spark.range(npts).select(F.col("id").cast("int").alias("idx"))
    return spine.join(dens, "idx", "left").select(
        "idx", (F.lit(lo) + F.col("idx") * F.lit(step)).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density")
    )
