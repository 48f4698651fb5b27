"""ML-2 with its sentence rules: lexicon sentiment of words in their context.

The published rules on top of word valences: boosters and negations among the
three words before, words in capitals among others that are not, the shift at a
contrasting conjunction, exclamation and question marks.  Idioms and the special
cases of "least" and "never so" are not applied.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.constants import VADER_COLUMNS
from skein.session import bound_batches

# The published weights of the rules.
COMPOUND_ALPHA = 15.0
BOOST = 0.293
CAPITALS = 0.733
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)  # of boosters one, two and three words before
CONTRAST = (0.5, 1.5)  # before and after the conjunction
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, FEW_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "nowhere", "neither", "nor", "cannot", "without", "rarely", "seldom")
BOOSTERS = {
    **dict.fromkeys(("very", "really", "extremely", "absolutely", "completely", "so", "totally", "especially", "most"), BOOST),
    **dict.fromkeys(("slightly", "somewhat", "barely", "hardly", "almost", "partly", "marginally", "less"), -BOOST),
}
SLICE_CHARS = 500_000  # characters of texts that a worker splits into words at a time
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _word(token: str) -> str:
    """``token`` without punctuation around it; short ones (emoticons) stay whole."""
    bare = token.strip(PUNCTUATION)
    return bare if len(bare) > 2 else token


def by_slices(texts: pd.Series, frame: Callable[[list], pd.DataFrame], chars: int = SLICE_CHARS) -> pd.DataFrame:
    """``frame`` of all texts (null: None), in slices of about ``chars`` characters, so that the
    words in memory don't grow with the rows of a batch; no slice splits a text."""
    parts, own, size = [], [], 0
    for t in texts:
        own.append(t if isinstance(t, str) else None)
        size += len(own[-1] or "")
        if size >= chars:
            parts.append(frame(own))
            own, size = [], 0
    if own or not parts:
        parts.append(frame(own))
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def score_texts(
    texts: Sequence[str | None],
    lexicon: Mapping[str, float],
    negations: frozenset[str],
    boosters: Mapping[str, float],
    contrasts: frozenset[str],
) -> dict[str, np.ndarray]:
    """The four scores of every text; all words of a batch are handled as shifted flat arrays."""
    words = [[_word(t) for t in _SPACE.split(text) if t] if text else [] for text in texts]
    count = len(words)
    lengths = np.fromiter(map(len, words), np.int64, count)
    doc = np.repeat(np.arange(count), lengths)
    flat = [w for own in words for w in own]
    lower = [w.lower() for w in flat]
    capital = np.fromiter((w.isupper() for w in flat), bool, len(flat))
    boost = np.fromiter((boosters.get(w, 0.0) for w in lower), np.float64, len(flat))
    negates = np.fromiter((w in negations or w.endswith("n't") for w in lower), bool, len(flat))
    known = np.fromiter((w in lexicon for w in lower), bool, len(flat))
    plain = np.fromiter((lexicon.get(w, 0.0) for w in lower), np.float64, len(flat))
    value = np.where(boost != 0, 0.0, plain)  # a booster has no valence of its own

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, count)

    capitals = total(capital)
    mixed = ((capitals > 0) & (capitals < lengths))[doc]
    scores = value != 0
    value = value + np.where(scores & capital & mixed, CAPITALS * np.sign(value), 0.0)
    for distance, damping in enumerate(DAMPING, 1):
        if len(flat) <= distance:
            break
        here = np.zeros(len(flat), bool)  # words with an unvalued word of their text at this distance
        here[distance:] = scores[distance:] & (doc[distance:] == doc[:-distance]) & ~known[:-distance]
        step = np.zeros(len(flat))
        step[distance:] = boost[:-distance] + np.where((boost[:-distance] != 0) & capital[:-distance] & mixed[distance:], CAPITALS, 0.0)
        value = np.where(here, value + damping * step * np.sign(value), value)
        turned = np.zeros(len(flat), bool)
        turned[distance:] = here[distance:] & negates[:-distance]
        value = np.where(turned, value * NEGATION, value)
    place = np.arange(len(flat))
    first = np.full(count, len(flat))  # place of each text's first conjunction
    np.minimum.at(first, doc, np.where(np.fromiter((w in contrasts for w in lower), bool, len(flat)), place, len(flat)))
    shift = first[doc]
    value = np.where(shift < len(flat), value * np.where(place < shift, CONTRAST[0], np.where(place > shift, CONTRAST[1], 1.0)), value)

    marks = np.array([((t or "").count("!"), (t or "").count("?")) for t in texts], np.float64).reshape(-1, 2)
    emphasis = EXCLAMATION * np.minimum(marks[:, 0], MOST_EXCLAMATIONS)
    emphasis += np.where(marks[:, 1] > FEW_QUESTIONS, MANY_QUESTIONS, np.where(marks[:, 1] > 1, QUESTION * marks[:, 1], 0.0))
    whole = total(value)
    whole = whole + np.sign(whole) * emphasis
    pos = total(np.where(value > 0, value + 1, 0.0))
    neg = total(np.where(value < 0, 1 - value, 0.0))
    neu = total((value == 0).astype(np.float64))
    pos, neg = pos + np.where(pos > neg, emphasis, 0.0), neg + np.where(neg > pos, emphasis, 0.0)
    share = np.where(lengths > 0, pos + neg + neu, 1.0)
    columns = (neg / share, neu / share, pos / share, whole / np.sqrt(whole * whole + COMPOUND_ALPHA))
    return dict(zip(("vader_neg", "vader_neu", "vader_pos", "vader_compound"), columns))


def rule_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon: Mapping[str, float],
    negations: Sequence[str] = NEGATIONS,
    boosters: Mapping[str, float] = BOOSTERS,
    contrasts: Sequence[str] = ("but",),
) -> DataFrame:
    """ML-2: vader_neg/neu/pos/compound by word valences and sentence rules, row by row.

    The word lists go to the workers once, like a model's weights; there is no
    shuffle.  Null and empty texts score 0; earlier columns of the same names
    are replaced; repeated rows and ids are rows like others.
    """
    lists = dict(lexicon), frozenset(negations), dict(boosters), frozenset(contrasts)
    shared = df.sparkSession.sparkContext.broadcast(lists)
    fields = T.StructType([T.StructField(c, T.DoubleType()) for c in VADER_COLUMNS])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield by_slices(texts, lambda some: pd.DataFrame(score_texts(some, *own))[list(VADER_COLUMNS)])

    bound_batches(df.sparkSession)
    scored = F.pandas_udf(score, fields)(F.col(text_col))
    base = df.drop(*(c for c in VADER_COLUMNS if c in df.columns))
    return base.withColumn("__rules", scored).select(*base.columns, *(F.col(f"__rules.{c}").alias(c) for c in VADER_COLUMNS))
