"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed up into cells of (source, language, topic).  The cells
are raked: scaled to the target shares of one marginal after the other, again
and again, until all three hold.  A document's sampling probability is
calibrated so that its cell's expected tokens follow the raked weights within a
token budget.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prepare, write_shared

MARGINALS = ("source", "lang", "topic")
BROADCAST_CELLS = 1_000_000  # cells up to which their table is broadcast; beyond, it is joined by a shuffle
ROUNDS = 20
ROUNDS_AT_ONCE = 5  # rounds in one plan


def token_count(text: Column) -> Column:
    """Words of a text: runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def form(text: Column, tokens: Column) -> Column:
    """Topic of a text where no topic column exists: its form, by columns and length."""
    return (
        F.when(text.contains(" | "), "table")
        .when(tokens < 100, "note")
        .when(tokens < 400, "article")
        .when(tokens < 1600, "chapter")
        .otherwise("book")
    )


def smoothed(cells: DataFrame, column: str, power: float) -> DataFrame:
    """(value, target): natural token shares raised to ``power``, made to sum to 1; categories without tokens get none."""
    total = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    weight = F.pow(F.col("tokens").cast("double"), F.lit(float(power)))
    return total.select("value", (weight / F.sum(weight).over(Window.partitionBy())).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (three marginals, tokens) with ``weight``: shares of all tokens after raking.

    ``targets`` has a table (value, target) per marginal; values that it lacks
    get nothing.  Cells without tokens keep weight 0.  The work is on cells,
    whose number is that of the categories' combinations, not of documents.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for column in MARGINALS:
        goal = targets[column].select(F.col("value").alias("__v"), F.col("target").alias(f"to_{column}"))
        now = now.join(goal, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
        now = now.withColumn(f"to_{column}", F.coalesce(f"to_{column}", F.lit(0.0)))
    now = write_shared(now, "cells")
    for n in range(rounds):
        for column in MARGINALS:
            have = F.sum("weight").over(Window.partitionBy(column))
            now = now.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"to_{column}") / have).otherwise(0.0))
        if n % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1 or n == rounds - 1:
            now = write_shared(now, "cells")
    return now.drop(*(f"to_{c}" for c in MARGINALS))


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``p``: the share of each cell's documents to keep.

    p = min(1, c * weight / tokens), with the c for which the expected tokens
    are ``budget`` of all; the c is found by setting aside, until none is new,
    the cells that are kept whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    raked = raked.withColumn("ratio", ratio)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    goal, c, whole = budget * total, 0.0, -1
    while True:
        full = F.col("ratio") * c >= 1
        row = raked.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("kept"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
            F.sum(F.when(full, 1).otherwise(0)).alias("whole"),
        ).first()
        if row["whole"] is None or row["whole"] == whole or not row["rest"]:
            break
        whole = row["whole"]
        c = max(c, (goal - row["kept"]) / row["rest"])
    return raked.withColumn("p", F.least(F.lit(1.0), F.col("ratio") * c)).drop("ratio")


def draw(id_col: str) -> Column:
    """A uniform number in [0, 1) that depends on the id alone."""
    return F.conv(F.md5(F.col(id_col).cast("string").cast("binary")).substr(1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(
    docs: DataFrame,
    powers: dict[str, float],
    budget: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with (topic, tokens, p, kept): the sampling decision for every document.

    Targets are the natural token shares raised to ``powers`` per marginal,
    made to sum to 1 (1: as they are, 0: all alike).  ``kept`` is whether the
    document's own uniform number is below ``p``.

    Null sources, languages and ids are values like others (a null id is never
    kept); null and empty texts have no tokens and form cells with their like;
    a cell without tokens is not sampled (p 0).  Repeated rows share their
    decision; an empty table gives no row.  ``docs`` must have source and lang;
    a column topic is used if present, else the form of the text; columns
    tokens, p and kept are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("tokens", "p", "kept")
    rows = docs.withColumn("tokens", token_count(F.col(text_col)))
    if "topic" not in docs.columns:
        rows = rows.withColumn("topic", form(F.col(text_col), F.col("tokens")))
    cells = write_shared(rows.groupBy(*MARGINALS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = {column: smoothed(cells, column, powers[column]) for column in MARGINALS}
    chosen = write_shared(probabilities(rake(cells, targets, rounds), budget).select(*MARGINALS, "p"), "cells")
    apart = "_"  # before the cells' names, so that no column of ``docs`` begins with it
    while any(c.lower().startswith(apart) for c in docs.columns):
        apart += "_"
    side = chosen.select(*(F.col(c).alias(f"{apart}{c}") for c in MARGINALS), "p")
    same = F.lit(True)
    for c in MARGINALS:
        same = same & F.col(c).eqNullSafe(F.col(f"{apart}{c}"))
    joined = rows.join(F.broadcast(side) if side.count() <= BROADCAST_CELLS else side, same)
    joined = joined.drop(*(f"{apart}{c}" for c in MARGINALS))
    return joined.withColumn("kept", F.coalesce(draw(id_col) < F.col("p"), F.lit(False)))


# Production parameters of the query and the pipeline.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.6


def op1_query(docs: DataFrame) -> DataFrame:
    """Every document with its topic, tokens, probability and decision."""
    own = mixed(docs.select("doc_id", "text", "source", "lang"), POWERS, BUDGET)
    return own.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 9).alias("p"), "kept")


def _raked_sql(relation: str) -> str:
    """Common table expressions up to ``chosen`` (source, lang, topic, p) for a relation of documents with tokens."""
    return f"""
cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM {relation} GROUP BY ALL
), {", ".join(
    f"goal_{c} AS (SELECT {c} AS v, pow(CAST(sum(tokens) AS DOUBLE), {POWERS[c]}) AS w FROM cells GROUP BY {c} HAVING sum(tokens) > 0)"
    for c in MARGINALS)}, start AS (
  SELECT cells.*, CAST(tokens AS DOUBLE) AS weight, {", ".join(
    f"coalesce((SELECT w FROM goal_{c} WHERE v IS NOT DISTINCT FROM cells.{c}), 0) / (SELECT sum(w) FROM goal_{c}) AS to_{c}"
    for c in MARGINALS)} FROM cells
), raked AS (
  SELECT 0 AS n, * FROM start
  UNION ALL
  SELECT n + 1, source, lang, topic, tokens,
         CASE WHEN s3 > 0 THEN w2 * to_topic / s3 ELSE 0 END, to_source, to_lang, to_topic
  FROM (SELECT *, sum(w2) OVER (PARTITION BY topic) AS s3 FROM (
    SELECT *, CASE WHEN s2 > 0 THEN w1 * to_lang / s2 ELSE 0 END AS w2
    FROM (SELECT *, sum(w1) OVER (PARTITION BY lang) AS s2 FROM (
      SELECT *, CASE WHEN s1 > 0 THEN weight * to_source / s1 ELSE 0 END AS w1
      FROM (SELECT *, sum(weight) OVER (PARTITION BY source) AS s1 FROM raked WHERE n < {ROUNDS})))))
), ratios AS (
  SELECT source, lang, topic, tokens, weight, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS ratio
  FROM raked WHERE n = {ROUNDS}
), filled AS (
  -- cells in the order in which they are kept whole; c if all before a cell are
  SELECT *, ({BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER before, 0))
            / nullif(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0), 0) AS c
  FROM ratios WINDOW before AS (ORDER BY ratio DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), scale AS (
  SELECT c FROM filled WHERE ratio * c < 1 ORDER BY ratio DESC LIMIT 1
), chosen AS (
  SELECT source, lang, topic, least(1.0, ratio * (SELECT c FROM scale)) AS p FROM ratios
)"""


_WORDS = "CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT)"


def rows_sql(relation: str) -> str:
    return f"""SELECT *, CASE WHEN contains(text, ' | ') THEN 'table' WHEN tokens < 100 THEN 'note'
         WHEN tokens < 400 THEN 'article' WHEN tokens < 1600 THEN 'chapter' ELSE 'book' END AS topic
  FROM (SELECT *, {_WORDS} AS tokens FROM {relation})"""


OP1_SQL = f"""
WITH RECURSIVE rows_ AS (
  {rows_sql("documents")}
), {_raked_sql("rows_")}
SELECT doc_id, r.source, r.lang, r.topic, r.tokens, round(p, 9) AS p,
       coalesce(CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / {1 << 48} < p, false) AS kept
FROM rows_ r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source AND r.lang IS NOT DISTINCT FROM c.lang
  AND r.topic IS NOT DISTINCT FROM c.topic
"""
