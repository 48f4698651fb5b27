"""Lexicon sentiment with sentence rules against a plain loop over words."""

from __future__ import annotations

import math
import random

import pytest

from skein.operators import sentence_rules as sr

LEXICON = {"good": 1.9, "bad": -2.5, "fine": 0.8, "awful": -2.0, "so": 0.4, ":)": 2.0}


def plain(text):
    words = [sr._word(t) for t in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if t]
    caps = [w.isupper() for w in words]
    mixed = any(caps) and not all(caps)
    values = []
    for i, word in enumerate(words):
        v = 0.0 if word.lower() in sr.BOOSTERS else LEXICON.get(word.lower(), 0.0)
        if v:
            v += math.copysign(0.733, v) if caps[i] and mixed else 0.0
            for back, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i < back or words[i - back].lower() in LEXICON:
                    continue
                before = words[i - back].lower()
                step = sr.BOOSTERS.get(before, 0.0)
                if step and caps[i - back] and mixed:
                    step += 0.733
                v += damping * step * ((v > 0) - (v < 0))
                if before in sr.NEGATIONS or before.endswith("n't"):
                    v *= -0.74
        values.append(v)
    lower = [w.lower() for w in words]
    if "but" in lower:
        at = lower.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(values)]
    loud = 0.292 * min((text or "").count("!"), 4)
    asks = (text or "").count("?")
    loud += 0.96 if asks > 3 else 0.18 * asks if asks > 1 else 0.0
    s = sum(values)
    s += loud if s > 0 else -loud if s < 0 else 0.0
    pos, neg = sum(v + 1 for v in values if v > 0), sum(1 - v for v in values if v < 0)
    neu = sum(v == 0 for v in values)
    if pos > neg:
        pos += loud
    elif neg > pos:
        neg += loud
    whole = pos + neg + neu if words else 1
    return neg / whole, neu / whole, pos / whole, s / math.sqrt(s * s + 15)


def test_rules_equal_a_plain_loop(spark):
    rng = random.Random(3)
    tokens = [*LEXICON, "GOOD", "Bad,", "not", "isn't", "very", "VERY", "slightly", "but", "BUT", "the", "day", "wasn't", "good!!", "why??", "\n", "…"]
    texts = [None, "", " ", "!", "but", "good", "not good", "very VERY bad but fine!!!!!", "\t good \n\n bad "]
    texts += [" ".join(rng.choices(tokens, k=rng.randint(1, 14))) for _ in range(400)] + [" ".join(rng.choices(tokens, k=20_000))]
    rows = [(i % 50, t, 1.0) for i, t in enumerate(texts)] + [(None, "not bad", 1.0)] * 2
    df = spark.createDataFrame(rows, "id INT, text STRING, vader_pos DOUBLE")
    out = sr.rule_sentiment(df, "text", LEXICON)
    assert out.columns == ["id", "text", "vader_neg", "vader_neu", "vader_pos", "vader_compound"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows)
    for (_, text, _), (_, same, *scores) in zip(rows, got):
        assert same == text and scores == pytest.approx(plain(text), abs=1e-9)
    assert sr.rule_sentiment(df.limit(0), "text", LEXICON).count() == 0


def test_each_rule_turns_the_score_its_way():
    def compound(text):
        own = (LEXICON, frozenset(sr.NEGATIONS), sr.BOOSTERS, frozenset({"but"}))
        return sr.score_texts([text], *own)["vader_compound"][0]

    assert compound("a very good day") > compound("a good day") > compound("a slightly good day") > 0
    assert compound("not a good day") < 0 < compound("not a bad day")
    assert compound("a GOOD day") > compound("a good day") == compound("A GOOD DAY")
    assert compound("good but awful") < 0 < compound("awful but good")
    assert compound("a good day!!") > compound("a good day!") > compound("a good day?")
    assert compound("very good") > compound("very much good") > compound("very much more good") > compound("good")
