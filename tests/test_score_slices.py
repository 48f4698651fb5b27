"""ML-1, ML-2: what a worker holds at a time is bounded in characters; slices change no score."""

from __future__ import annotations

import numpy as np
import pandas as pd

from skein.operators import scoring as scr
from skein.operators.sentence_rules import by_slices, rule_sentiment
from skein.session import BATCH_BYTES


def test_slices_are_bounded_and_whole():
    seen = []

    def frame(texts):
        seen.append(texts)
        return pd.DataFrame({"n": [len(t or "") for t in texts]})

    texts = ["a" * (i % 7 * 10) for i in range(500)] + [None, "b" * 5000, ""]
    out = by_slices(pd.Series(texts), frame, chars=200)
    assert list(out["n"]) == [len(t or "") for t in texts] and list(out.index) == list(range(len(texts)))
    assert [t for own in seen for t in own] == texts
    assert max(sum(len(t or "") for t in own[:-1]) for own in seen) < 200  # one text more at most
    assert list(by_slices(pd.Series([], dtype=object), frame)["n"]) == []


def test_scores_over_many_slices(spark):
    words = np.random.default_rng(5).choice(["good", "bad", "very", "not", "GOOD", "but", "x!", "it's"], (60, 400))
    texts = [" ".join(w[: i * 7]) for i, w in enumerate(words)] + [None, ""]
    long = spark.createDataFrame([(i, t if t is None else t * 30) for i, t in enumerate(texts)], "i INT, text STRING").coalesce(1)
    lexicon = {"good": 1.5, "bad": -2.0}
    for score in (scr.lexicon_sentiment, rule_sentiment):
        at_once = {r["i"]: r[2:] for r in score(long, "text", lexicon).collect()}
        alone = {r["i"]: r[2:] for r in score(long.repartition(31, "i"), "text", lexicon).collect()}
        assert at_once.keys() == alone.keys() == set(range(len(texts)))
        assert all(np.allclose(at_once[i], alone[i], rtol=0, atol=1e-12) for i in alone)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES
