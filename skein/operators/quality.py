"""Data-quality checks (DQ-1 … DQ-8) as lazy DataFrames plus eager ``assert_*`` helpers.

The lazy forms return (check, failures) rows so a caller can union and write
them; the ``assert_*`` forms run one small job and raise on failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.relational import count_orphans, require_columns  # DQ-1, re-exported

__all__ = [
    "require_columns",
    "require_not_empty",
    "duplicate_keys",
    "assert_unique",
    "assert_no_orphans",
]


def require_not_empty(df: DataFrame, source: str = "input") -> DataFrame:
    """DQ-2: raise when the input has no rows (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"No rows found in {source}.")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ-5: one-row (failures) = number of keys that occur more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("failures"))


def assert_unique(df: DataFrame, keys: Sequence[str], source: str = "input") -> DataFrame:
    """DQ-5 / D-17: raise when a key repeats (a repeated topic key would multiply join rows)."""
    n = duplicate_keys(df, keys).first()["failures"]
    if n:
        raise ValueError(f"{source} has {n} duplicated keys on {list(keys)}")
    return df


def assert_no_orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> None:
    """DQ-6 eager form."""
    n = count_orphans(children, parents, child_key, parent_key).first()["orphans"]
    if n:
        raise ValueError(f"{n} children reference parents that do not exist")
