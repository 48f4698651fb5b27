"""DuckDB SQL fragments shared by the oracle queries (kept to the dialect subset
that DuckDB 2.0 accepts: ``lambda x: …`` lambdas, ``'g'`` regex flag)."""

from __future__ import annotations

from skein.constants import ALL_STOPWORDS

STOPWORD_LIST = "[" + ", ".join(f"'{w}'" for w in ALL_STOPWORDS) + "]"


def words(expr: str) -> str:
    """Whitespace split with empty pieces removed."""
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '\\s+'), lambda w: w <> '')"


def topic_text(expr: str) -> str:
    """SC-5 in DuckDB."""
    cleaned = f"regexp_replace(lower(coalesce({expr}, '')), '[^a-z#\\s]', ' ', 'g')"
    stripped = f"list_transform({words(cleaned)}, lambda w: replace(w, '#', ''))"
    kept = f"list_filter({stripped}, lambda w: w <> '' AND NOT list_contains({STOPWORD_LIST}, w))"
    return f"array_to_string({kept}, ' ')"


def ngram_tokens(words_expr: str) -> str:
    """SC-6 n-grams of an already filtered word list column named by ``words_expr``."""
    w = words_expr
    return (
        f"list_concat({w}, "
        f"list_transform(range(1, len({w})), lambda i: {w}[i] || '_' || {w}[i + 1]), "
        f"list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || '_' || {w}[i + 1] || '_' || {w}[i + 2]))"
    )


def term_words(expr: str) -> str:
    """SC-6 word filter: longer than one char and all letters."""
    return f"list_filter({words(expr)}, lambda w: length(w) > 1 AND regexp_full_match(w, '\\pL+'))"


def log_odds_sql(docs_cte: str, top_n: int = 10) -> str:
    """TXT-1 over a CTE ``docs(topic, topic_text)``."""
    return f"""
WITH docs AS ({docs_cte}),
wl AS (SELECT topic, {term_words('topic_text')} AS w FROM docs WHERE topic IS NOT NULL),
toks AS (SELECT topic, unnest({ngram_tokens('w')}) AS term FROM wl),
counts AS (SELECT topic, term, CAST(count(*) AS DOUBLE) AS f_i FROM toks GROUP BY topic, term),
sizes AS (SELECT topic, sum(f_i) AS n_i FROM counts GROUP BY topic),
tot AS (SELECT sum(f_i) AS big_n FROM counts),
termtot AS (SELECT term, sum(f_i) AS big_f FROM counts GROUP BY term),
scored AS (
  SELECT c.topic, c.term,
    (ln(c.f_i + t.big_f) - ln(greatest(1.0, s.n_i + tot.big_n - (c.f_i + t.big_f)))
     - ln((t.big_f - c.f_i) + t.big_f)
     + ln(greatest(1.0, (tot.big_n - s.n_i) + tot.big_n - ((t.big_f - c.f_i) + t.big_f))))
    / sqrt(1.0 / (c.f_i + t.big_f) + 1.0 / ((t.big_f - c.f_i) + t.big_f)) AS z
  FROM counts c JOIN termtot t USING (term) JOIN sizes s USING (topic) CROSS JOIN tot
),
ranked AS (SELECT topic, term, z, row_number() OVER (PARTITION BY topic ORDER BY round(z, 9) DESC, term) AS rnk FROM scored)
"""
