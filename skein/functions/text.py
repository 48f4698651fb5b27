"""Social-text column functions (SC-1 … SC-8, SC-19, SC-21, SC-22, SC-24).

All functions take and return ``Column`` objects built from built-in Spark
expressions (regex, split, higher-order array functions), so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.constants import ALL_STOPWORDS

# Python's str.split() whitespace set: Unicode White_Space plus U+001C..U+001F.
WS = r"(?U)[\s\x1c-\x1f]+"
WS_CLASS = r"\s\x1c-\x1f"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# An item of a list literal: a string in either quote, or None.
QUOTED_ITEM = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|None)"""


def split_words(text: Column | str) -> Column:
    """Split on any run of whitespace, dropping empty pieces (Python ``str.split()``)."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), WS), lambda w: w != F.lit(""))


def normalize_social_text(text: Column | str) -> Column:
    """SC-1: ``@name`` → ``@user``, ``http…`` → ``http``, whitespace collapsed; null → ''."""
    tokens = F.transform(
        split_words(text),
        lambda w: F.when(w.startswith("@") & (F.length(w) > 1), F.lit("@user"))
        .when(w.startswith("http"), F.lit("http"))
        .otherwise(w),
    )
    return F.array_join(tokens, " ")


def parse_tags(value: Column | str, is_array: bool = True) -> Column:
    """SC-3: hashtag list → clean ``ARRAY<STRING>`` (trim, strip leading ``#``, drop empties).

    ``is_array=False`` handles string input: a list literal (JSON, or quoted
    items and ``None`` between brackets, either quote, backslash escapes) gives
    its items, any other text in brackets itself, all else splits on ``[, ]+``.
    """
    v = _col(value)
    if is_array:
        raw = F.coalesce(v, F.array().cast("array<string>"))
    else:
        s = strip_ws(F.coalesce(v, F.lit("")))
        quoted = F.regexp_extract_all(s, F.lit(QUOTED_ITEM), F.lit(0))
        items = F.transform(
            F.filter(quoted, lambda x: x != "None"),
            lambda x: F.regexp_replace(x.substr(F.lit(2), F.length(x) - 2), r"\\(.)", "$1"),
        )
        literal = F.when(s.rlike(rf"^\[\s*({QUOTED_ITEM}\s*(,\s*|(?=\])))*\]$"), items)
        listed = F.when(s.startswith("[") & s.endswith("]"), F.coalesce(F.from_json(s, "array<string>"), literal, F.array(s)))
        raw = F.when(s == F.lit(""), F.array().cast("array<string>")).otherwise(
            F.coalesce(listed, F.filter(F.split(s, r"[, ]+"), lambda x: strip_ws(x) != F.lit("")))
        )
    cleaned = F.transform(
        F.filter(raw, lambda x: x.isNotNull()),
        lambda x: F.regexp_replace(strip_ws(x), r"^#+", ""),
    )
    return F.filter(cleaned, lambda x: x != F.lit(""))


def hashtag_text(tags: Column | str, is_array: bool = True) -> Column:
    """SC-2: tags → ``#a #b``."""
    return F.array_join(F.transform(parse_tags(tags, is_array), lambda x: F.concat(F.lit("#"), x)), " ")


def _blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.regexp_replace(c, WS, "")) > 0, c)


def compose_text(
    description: Column | str,
    speech: Column | str | None = None,
    tags: Column | str | None = None,
    include_tags: bool = True,
    tags_are_array: bool = True,
) -> Column:
    """SC-4: description + speech + hashtag text; blank parts skipped; result trimmed.

    Blankness is tested on the trimmed part but the part is kept as is, like the
    published composition; nulls are skipped (never the word "nan").
    """
    parts = [_blank_to_null(_col(description))]
    if speech is not None:
        parts.append(_blank_to_null(_col(speech)))
    if include_tags and tags is not None:
        parts.append(_blank_to_null(hashtag_text(tags, tags_are_array)))
    joined = F.concat_ws(" ", *parts)
    return strip_ws(joined)


def strip_ws(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of the full Unicode set."""
    return F.regexp_replace(_col(text), rf"(?U)^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def topic_preprocess_text(text: Column | str, stopwords: Iterable[str] = ALL_STOPWORDS) -> Column:
    """SC-5: lower, keep only ``[a-z#]`` and whitespace, drop stop words (with or without ``#``), strip ``#``.

    Written as string regexes (inside whole-stage codegen): with ``#`` deleted,
    one pass turns every run of non-letters, and the stop words within it, into
    one space, which yields exactly the words of the split-then-strip form.
    Stop words that aren't plain letters are patterns of a pass of their own,
    which takes them out as whole words before spaces are collapsed.
    """
    stop = sorted(set(stopwords), key=lambda w: (-len(w), w))
    bare = F.replace(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("#"), F.lit(""))
    if all(re.fullmatch("[a-z]+", w) for w in stop):
        # possessive, so that the length of a run of stop words costs no stack
        between = rf"(?:{_any_of(stop)}(?:[^a-z]++|\z))*+" if stop else ""
        return F.trim(F.regexp_replace(bare, f"(?:[^a-z]++|^){between}", " "))
    letters = F.regexp_replace(bare, "[^a-z]+", " ")
    letters = F.regexp_replace(letters, "(?<![a-z])(?:" + "|".join(stop) + ")(?![a-z])", "")
    return F.trim(F.regexp_replace(letters, " {2,}", " "))


def _any_of(words: Iterable[str]) -> str:
    """Pattern of ``words``, plain letters, as a tree of their common beginnings: a word is tried letter by letter, not word by word."""
    ends: dict[str, set[str]] = {}
    for w in words:
        ends.setdefault(w[:1], set()).add(w[1:])
    done = ends.pop("", None) is not None
    tree = "|".join(first + _any_of(rest) for first, rest in sorted(ends.items()))
    return f"(?:{tree})" + "?" * done if tree else ""


# SC-6 word: a whitespace-separated token of two or more letters
_TERM_WORD = r"(?U)(?<![^\s\x1c-\x1f])\p{L}{2,}(?![^\s\x1c-\x1f])"


def term_word_string(text: Column | str) -> Column:
    """SC-6 words joined by single spaces (one regex pass, no per-word lambdas)."""
    return F.array_join(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(_TERM_WORD), 0), " ")


def spaced_ngrams(words: Column | str) -> Column:
    """Unigrams, bigrams and trigrams of a space-joined word string, space-joined.

    Bigrams/trigrams are captured by zero-width lookaheads at every word start,
    so the whole expression is three regex scans.  Words hold letters only, so
    the space form maps one-to-one onto the published ``_`` form
    (``translate(term, ' ', '_')``), applied after aggregation.
    """
    w = _col(words)
    return F.concat(
        F.regexp_extract_all(w, F.lit("[^ ]+"), 0),
        F.regexp_extract_all(w, F.lit("(?<![^ ])(?=([^ ]+ [^ ]+))"), 1),
        F.regexp_extract_all(w, F.lit("(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), 1),
    )


def compute_once(df, keep, **cols: Column):
    """Project expensive expressions exactly once.

    Catalyst pushes a filter on a projected alias below the projection by
    substituting the expression, so a regex-heavy column filtered afterwards
    would be evaluated twice.  Producing the columns through a one-row
    generator (``inline(array(struct(...)))``) is a boundary filters cannot
    cross; the expressions then run once per row.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select(*keep, F.inline(packed))


def explode_tokens(df, keep, array_col: Column | str, out: str = "term"):
    """One row per array element, without an inferred pre-filter.

    For ``explode`` Catalyst infers ``size(array) > 0`` and pushes it below the
    projections, re-evaluating the whole array expression; ``explode_outer``
    gets no inferred filter, and empty arrays (null elements) are dropped above
    the generator instead.
    """
    col = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keep, F.explode_outer(col).alias(out)).filter(F.col(out).isNotNull())


def term_words(text: Column | str) -> Column:
    """SC-6 word filter: words longer than one character made of letters only."""
    return F.filter(split_words(text), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{L}+$"))


def term_tokens(text: Column | str) -> Column:
    """SC-6: alphabetic words longer than one char, plus ``_``-joined bigrams and trigrams of them.

    """
    return ngrams_of(term_words(text))


def ngrams_of(words: Column) -> Column:
    """Unigrams + bigrams + trigrams of a word array (consecutive, ``_``-joined)."""
    n = F.size(words)
    tail1 = F.slice(words, 2, F.greatest(n - 1, F.lit(0)))
    tail2 = F.slice(words, 3, F.greatest(n - 2, F.lit(0)))
    head1 = F.slice(words, 1, F.greatest(n - 1, F.lit(0)))
    bigrams = F.zip_with(head1, tail1, lambda a, b: F.concat(a, F.lit("_"), b))
    head2 = F.slice(bigrams, 1, F.greatest(n - 2, F.lit(0)))
    trigrams = F.zip_with(head2, tail2, lambda a, b: F.concat(a, F.lit("_"), b))
    empty = F.array().cast("array<string>")
    return F.concat(
        words,
        F.when(n >= 2, bigrams).otherwise(empty),
        F.when(n >= 3, trigrams).otherwise(empty),
    )


def comment_text_key(text: Column | str) -> Column:
    """SC-7: null → '', whitespace runs → one space, trimmed, lower-cased."""
    collapsed = F.regexp_replace(F.coalesce(_col(text), F.lit("")), WS, " ")
    return F.lower(F.regexp_replace(collapsed, r"^ | $", ""))


def alnum_count(text: Column | str) -> Column:
    """SC-8: number of ``[A-Za-z0-9]`` characters."""
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "[^A-Za-z0-9]", ""))


def keyword_cells(keywords: Column | str, first: int = 6) -> tuple[Column, Column]:
    """SC-19: comma list → (first ``first`` items, all items); items trimmed, ``_`` → space."""
    items = F.transform(F.split(F.coalesce(_col(keywords), F.lit("")), ","), lambda x: F.replace(F.trim(x), F.lit("_"), F.lit(" ")))
    return F.array_join(F.slice(items, 1, first), ", "), F.array_join(items, ", ")


def csv_items(value: Column | str) -> Column:
    """SC-21: comma list → trimmed non-empty items."""
    return F.filter(F.transform(F.split(F.coalesce(_col(value), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != F.lit(""))


def clean_slug(value: Column | str) -> Column:
    """SC-22: last path part, runs outside ``[A-Za-z0-9_.-]`` → ``_``."""
    return F.regexp_replace(F.element_at(F.split(_col(value), "/"), -1), r"[^A-Za-z0-9_.-]+", "_")


def text_or_empty(text: Column | str) -> Column:
    """SC-24: null → ''."""
    return F.coalesce(_col(text).cast("string"), F.lit(""))
