"""Operators 6 and 9: words of a slice are cut and merged together, with the rows of those cut and merged alone."""

from __future__ import annotations

import random

import numpy as np
from tokenizers import Tokenizer

from skein.llm import bpe, bpe_codec, token_counts, transducer

PARTS = ["a", "the", "ing", "ation", " ", " ", " ", "  ", "\n", "\n\n", "\t", "'re", "'ll", "'ve", "'s", "'", "!", "23",
         "é", "ß", "¾", "日本", "😀", "🫠", "\x1c", "\x85", "\xa0", "$$$", "foo", "xqz", "<|endoftext|>", "<|endof"]


def texts(seed: int, n: int, parts: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, parts))) for _ in range(n)]


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [" " + "".join(rng.choices("aabcdeeghiilnnorsttuéß漢", k=rng.randint(1, 20))) for _ in range(n)]


def test_latin_texts_are_cut_alike():
    rng = random.Random(3)
    own = bpe.load(bpe.vocabulary_path())
    latin = [chr(c) for c in range(0x180)]
    for _ in range(2_000):
        text = "".join(rng.choices(latin + [" ", "'", "s", "re", "\n"] * 20, k=30))
        assert own.pretokens(text) == bpe.PRETOKEN.findall(text), repr(text)
    assert all(own.pretokens(c) == [c] for c in latin)


def test_texts_with_newer_characters_are_cut_as_the_library_does():
    own = bpe.load(bpe.vocabulary_path())
    for text in texts(4, 500, 30):
        want = [text[a:b] for _, (a, b) in own._library_pretokeniser.pre_tokenize_str(text)]
        assert own.pretokens(text) == want, repr(text)


def test_prefix_counts_of_words_together_equal_the_library(monkeypatch):
    monkeypatch.setattr(token_counts, "TOGETHER_WORDS", 1)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for pairs, slots in ((1, 4), (1_000_000, 20)):
        monkeypatch.setattr(token_counts, "TOGETHER_PAIRS", pairs)
        monkeypatch.setattr(token_counts, "PAIR_SLOTS", slots)
        counter = token_counts.PrefixCounter(bpe.vocabulary_path())
        some = texts(5, 60, 14) + ["".join(words(6, 3)), "y" * 200 + " z", ""]
        for text, counts in zip(some, counter.tables(some), strict=True):
            want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
            assert counts.tolist() == want, repr(text)


def test_new_words_step_together(monkeypatch):
    alone = []
    extend = token_counts.PrefixCounter._extend
    monkeypatch.setattr(token_counts.PrefixCounter, "_extend", lambda self, w, s: alone.append(w) or extend(self, w, s))
    counter = token_counts.PrefixCounter(bpe.vocabulary_path())
    new = words(7, 3_000)
    table = counter.tables(["x".join(new)])[0]
    assert not alone  # one by one before
    monkeypatch.setattr(token_counts, "TOGETHER_WORDS", 1 << 60)
    other = token_counts.PrefixCounter(bpe.vocabulary_path())
    assert np.array_equal(other.tables(["x".join(new)])[0], table) and alone


def test_words_of_many_tokens_and_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 40)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(8)
    some = ["".join(rng.choices("qzxj漢", k=700)) + " end", " " * 900 + "x" + "\n" * 700 + "y", *words(9, 50)]
    counter = token_counts.PrefixCounter(bpe.vocabulary_path())
    for _ in range(2):
        for own in (some, some[:1], some[1:2]):
            for text, counts in zip(own, counter.tables(own), strict=True):
                for i in (*range(0, len(text), 97), len(text)):
                    assert counts[i] == len(library.encode(text[:i], add_special_tokens=False).ids)


def test_encoder_cuts_whole_texts(tmp_path, monkeypatch):
    path = tmp_path / "some.fst"
    own = bpe.load(bpe.vocabulary_path())
    path.write_bytes(transducer.build((w.encode(), own.merge_word(w.encode())) for w in words(10, 50)))
    encoder = bpe_codec.Encoder(bpe.vocabulary_path(), str(path))
    calls = []
    pretokens = bpe.ByteBpe.pretokens
    monkeypatch.setattr(bpe.ByteBpe, "pretokens", lambda self, text: calls.append(text) or pretokens(self, text))
    some = [",".join(words(seed, 500)) for seed in (10, 11)]
    got = encoder.encode(some)
    assert len(calls) <= len(some)  # one for each distinct piece before
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert got == [bpe.pack(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_encoder_forgets_merged_words_first(tmp_path, monkeypatch):
    path = tmp_path / "some.fst"
    own = bpe.load(bpe.vocabulary_path())
    frequent = words(12, 20)
    path.write_bytes(transducer.build((w.encode(), own.merge_word(w.encode())) for w in frequent))
    monkeypatch.setattr(bpe_codec, "MEMO_PIECES", 120)
    encoder = bpe_codec.Encoder(bpe.vocabulary_path(), str(path))
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for seed in range(6):
        text = "".join(frequent + words(20 + seed, 60))
        assert encoder.encode([text]) == [bpe.pack(library.encode(text, add_special_tokens=False).ids)]
        assert set(frequent) <= encoder._words.keys()
        memos = (encoder._words, encoder._pieces)
        assert sum(map(len, memos)) <= 120
        assert encoder._held == sum(len(w) + len(ids) for memo in memos for w, ids in memo.items())
