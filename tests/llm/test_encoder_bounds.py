"""Operator 9 and the pipeline's last stage: what a worker holds is bounded; bounds change no id."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa

from skein.llm import bpe, bpe_codec, transducer
from skein.llm.common import text_slices


def invented(seed: int, chars: int, length: int) -> str:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(rng.choices(letters, k=length)) for _ in range(chars // (length + 1)))


def encoder(tmp_path) -> bpe_codec.Encoder:
    path = tmp_path / "none.fst"
    path.write_bytes(transducer.build([]))
    return bpe_codec.Encoder(bpe.vocabulary_path(), str(path))


def peak_mb(own: bpe_codec.Encoder, texts_of_batches) -> float:
    """Peak of Python's memory over Arrow batches, cut as ``encode`` cuts them."""
    own.encode(["warm up"])
    tracemalloc.start()
    try:
        for texts in texts_of_batches:
            batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
            for _, some in text_slices(batch, bpe_codec.ENCODE_CHARS, 0):
                own.encode(some)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_new_words_leave_memory_bounded(tmp_path):
    batches = ([invented(100 * b + k, 100_000, 8) for k in range(20)] for b in range(2))
    assert peak_mb(encoder(tmp_path), batches) < 80  # 158 with slices of 2 million characters and 400,000 pieces


def test_long_pieces_are_bounded_in_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe_codec, "MEMO_BYTES", 200_000, raising=False)
    own, most = encoder(tmp_path), 0
    texts = ["x " + invented(k, 40_000, 1_999) for k in range(12)]
    for text in texts:
        assert own.encode([text]) == [own._head(text)]  # remembered or not, the same ids
        most = max(most, sum(len(p) + len(d) for memo in (own._pieces, own._words) for p, d in memo.items()))
    assert most < 200_000 + 4 * 40_000  # the bound, and what one slice adds


def test_pretokeniser_comes_without_the_vocabulary(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path()).pre_tokenizer
    monkeypatch.setattr(Tokenizer, "from_file", None)  # would load the vocabulary a second time
    own = bpe.ByteBpe(bpe.vocabulary_path())
    for text in ("😀 𞤀𞤁 it's", " 日本語 ß̈ ՘\n\n 12", "", "<|endoftext|> 🫠🫠 don't", "  \x1c 🀄"):
        assert own._library_pretokeniser.pre_tokenize_str(text) == whole.pre_tokenize_str(text)
    assert own.pretokens(" 🫠 it's 🫠") == [" 🫠", " it", "'s", " 🫠"]
