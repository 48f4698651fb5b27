"""Scalar column functions: ids, numbers, dates, probabilities, labels
(PRJ-1, PRJ-2, PRJ-8, SC-9 … SC-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import ID_COLUMNS, SENTIMENT_LABELS, SIGNIFICANCE_LEVELS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_id(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """PRJ-1: id → string; integral floats print without a fraction; null stays null.

    Strings that hold an integral JSON number (``"7.0"``) lose the ``.0`` too.
    """
    x = _col(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # below 2^63 the BIGINT cast is exact (Python prints the double's exact integer value)
        exact = F.when(F.abs(x) < F.lit(9.2e18), x.cast("bigint").cast("string")).otherwise(x.cast("decimal(38,0)").cast("string"))
        whole = F.when(~F.isnan(x) & (x == F.floor(x)), exact)
        return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string")).otherwise(F.coalesce(whole, x.cast("string")))
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0+$", "$1")
    if dtype is None or isinstance(dtype, T.StringType):
        return F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0+$", "$1")
    return x.cast("string")


def normalize_id_columns(df: DataFrame, cols=ID_COLUMNS) -> DataFrame:
    """PRJ-1 over every id column present."""
    present = {f.name: f.dataType for f in df.schema.fields if f.name in set(cols)}
    return df.withColumns({name: normalize_id(name, dtype) for name, dtype in present.items()}) if present else df


def to_number(c: Column | str) -> Column:
    """PRJ-2: numeric coercion, null on failure (ANSI-safe ``try_cast``; numbers are cast directly)."""
    return _col(c).try_cast("double")


def to_count(c: Column | str) -> Column:
    """Integer counters: non-numeric/null → 0, truncated to BIGINT."""
    return F.coalesce(to_number(c), F.lit(0.0)).cast("bigint")


def epoch_to_ts(c: Column | str) -> Column:
    """SC-9: epoch seconds (any numeric/string) → TIMESTAMP (UTC session), bad → null."""
    return F.timestamp_seconds(to_number(c))


def epoch_to_date_str(c: Column | str) -> Column:
    """SC-10: epoch seconds → ``YYYY-MM-DD`` (UTC), whole seconds (D-15)."""
    secs = F.floor(to_number(c)).cast("bigint")
    return F.date_format(F.timestamp_seconds(secs), "yyyy-MM-dd")


def epoch_to_date(c: Column | str) -> Column:
    """SC-11: epoch seconds → DATE (UTC floor to day)."""
    return F.to_date(epoch_to_ts(c))


def date_window(year: int, start_mmdd: str, end_mmdd: str) -> tuple[str, str]:
    """SC-12: the window of one year from two month-day strings, as ISO dates (a parameter check on the driver)."""
    import datetime as dt

    first, last = (dt.date.fromisoformat(f"{int(year):04d}-{day}") for day in (start_mmdd, end_mmdd))
    if first > last:
        raise ValueError(f"the window {start_mmdd} to {end_mmdd} runs backwards")
    return str(first), str(last)


def date_sequence(start: Column, end: Column) -> Column:
    """SC-13: inclusive daily sequence (array of DATE) — explode it for a spine."""
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def compact_date(c: Column | str) -> Column:
    """SC-14: DATE → ``YYYYMMDD``."""
    return F.date_format(_col(c), "yyyyMMdd")


def softmax3(logits: Column | str) -> Column:
    """SC-15: numerically stable softmax of a logit array."""
    x = _col(logits)
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / total)


def argmax_label(probs: Column | str, labels=SENTIMENT_LABELS) -> Column:
    """SC-15: label of the largest probability (first on ties, like argmax)."""
    p = _col(probs)
    return F.element_at(F.array(*[F.lit(s) for s in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def max_probability(probs: Column | str) -> Column:
    """SC-16: row-wise maximum of a probability vector (null array → null)."""
    return F.array_max(_col(probs))


def significance(q: Column | str) -> Column:
    """SC-17: stars for a q-value; not finite → ''."""
    x = _col(q).cast("double")
    expr = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(""))
    for bound, stars in SIGNIFICANCE_LEVELS:
        expr = expr.when(x < bound, F.lit(stars))
    return expr.otherwise(F.lit(""))
