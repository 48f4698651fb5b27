"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

1. ``word_counts`` counts the pre-tokens of all texts (partial sums per batch,
   then one shuffle of distinct words).
2. ``frequent_words`` takes the most frequent ones (a bound that is a
   parameter), merges each once and compiles them into a transducer file.
3. ``encode`` maps the file into every worker; words in it cost a walk, all
   others are merged exactly.  Which words are in the lexicon changes the cost
   only, never the ids.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, transducer
from skein.llm.common import Worker, least_count, map_texts, prepare, text_slices, write_shared

LEXICON_WORDS = 65_536  # words compiled into the transducer
LEXICON_WORD_BYTES = 64  # longer words are merged when they occur
COUNT_CHARS = 2_000_000  # characters whose words are counted before they are handed on
ENCODE_CHARS = 500_000  # characters that are encoded at a time; new words are merged once among them
MEMO_PIECES = 100_000  # pre-tokens whose ids a task remembers
MEMO_BYTES = 16 << 20  # characters and bytes of ids that it remembers, as pre-tokens may be long


def word_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(word binary, n long): how often each pre-token of up to 64 bytes occurs in all texts."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.load(bpe.vocabulary_path(vocabulary))
        for batch in batches:
            for _, texts in text_slices(batch, COUNT_CHARS, 0):
                words: Counter[str] = Counter()
                for text in texts:
                    for ordinary, _ in own.segments(text):
                        words.update(own.pretokens(ordinary))
                data = pa.array(list(words), pa.string()).cast(pa.binary())
                counts = pa.array(words.values(), pa.int64())
                del words  # before the arrays travel
                short = pc.less_equal(pc.binary_length(data), LEXICON_WORD_BYTES)
                arrays = [data.filter(short), counts.filter(short)]
                del data, counts
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(
    docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS, vocabulary: str | None = None
) -> bytes:
    """Transducer file of the most frequent pre-tokens, ``words`` of them at most.

    The counts' own distribution gives the least count at which no more than
    ``words`` pre-tokens are left; only those, of at most 64 bytes each, reach
    the driver.
    """
    counts = write_shared(word_counts(docs, text_col, vocabulary).where("n > 1"), "word-counts")
    least = least_count(counts, words)
    top = counts.where(F.col("n") >= least).select("word").collect()
    own = bpe.load(bpe.vocabulary_path(vocabulary))
    return transducer.build((bytes(r["word"]), own.merge_word(bytes(r["word"]))) for r in top)


def ship(spark: SparkSession, lexicon: bytes) -> str:
    """Give the lexicon file to all executors, present and future; its name there."""
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:24]}.fst"
    if name not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
        path = os.path.join(tempfile.mkdtemp(prefix="skein-lexicon-"), name)  # the driver serves it from here
        with open(path, "wb") as f:
            f.write(lexicon)
        spark.sparkContext.addFile(path)
        _SHIPPED[spark.sparkContext.applicationId].add(name)
    return name


_SHIPPED: dict[str, set[str]] = {}


class Encoder:
    """Encodes texts in a worker: remembered pre-tokens, then the lexicon, then exact merges.

    A task has its own, so what it remembers goes with it; words of the lexicon,
    which are the frequent ones, stay longest.
    """

    def __init__(self, vocabulary: str, lexicon: str) -> None:
        self.bpe = bpe.load(vocabulary)
        self.lexicon = transducer.load(lexicon)
        self._words: dict[str, bytes] = {}  # words of the lexicon
        self._pieces: dict[str, bytes] = {}  # other pre-tokens, merged
        self._held = 0  # characters and bytes of ids in both

    def _forget(self, more: int) -> None:
        """Make room for so many pre-tokens: merged ones go first."""
        for memo in (self._pieces, self._words):
            if len(self._pieces) + len(self._words) + more > MEMO_PIECES or self._held > MEMO_BYTES:
                self._held -= sum(len(word) + len(ids) for word, ids in memo.items())
                memo.clear()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each of ``words``; new ones are remembered."""
        self._forget(sum(1 for w in words if w not in self._words and w not in self._pieces))
        known = {w: self._words.get(w) or self._pieces.get(w) for w in words}
        new = [w for w, ids in known.items() if ids is None]
        data = [w.encode() for w in new]
        numbers = self.lexicon.numbers(data).tolist()
        merged = iter(self.bpe.merge_words([w for w, number in zip(data, numbers) if number < 0]))
        for word, number in zip(new, numbers):
            if number >= 0:
                known[word] = self._words[word] = self.lexicon.ids(number)
            else:
                known[word] = self._pieces[word] = next(merged)
            self._held += len(word) + len(known[word])
        return known

    def _head(self, text: str) -> bytes:
        """Ids of an ordinary text by merges alone."""
        return b"".join([bpe.pack(self.bpe.merge_word(w.encode())) for w in self.bpe.pretokens(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[(self.bpe.pretokens(t), special) for t, special in self.bpe.segments(text)] for text in texts]
        known = self._learn({word for own in cut for words, _ in own for word in words})
        out = []
        for own in cut:
            parts = []
            for words, special in own:
                parts += map(known.__getitem__, words)
                if special:
                    parts.append(bpe.pack([self.bpe.special[special]]))
            out.append(b"".join(parts))
        return out


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    lexicon_words: int = LEXICON_WORDS,
    digests_only: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row of ``docs``: (id, ``keep``, n_tokens, ids, decoded, ids_sha256, decoded_sha256).

    Equal to the ``tokenizers`` library with the same vocabulary file, without
    added special tokens; strings of special tokens inside a text become those
    tokens.  ``decoded`` is decoded from the ids, special tokens kept.
    ``digests_only=True`` leaves ``ids`` and ``decoded`` null.

    A null text is an empty one (no ids); repeated rows and null ids give one
    row each; an empty table gives no row (and an empty lexicon); other columns
    are not read.  Two passes over the texts; only distinct words are shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    lexicon = ship(spark, frequent_words(docs, text_col, lexicon_words, vocabulary))

    def worker() -> Worker:
        own = Encoder(bpe.vocabulary_path(vocabulary), SparkFiles.get(lexicon))

        def run(texts: list[str]) -> list[pa.Array]:
            rows = []
            for data in own.encode(texts):
                numbers = np.frombuffer(data, "<u4")
                raw = own.bpe.bytes_of(numbers)
                decoded = raw.decode("utf-8", "replace")
                if "\ufffd" in decoded:  # bytes that were no UTF-8, or that character itself
                    raw = decoded.encode()
                digests = (hashlib.sha256(data).hexdigest(), hashlib.sha256(raw).hexdigest())
                kept = (None, None) if digests_only else (numbers.astype(np.int32), decoded)
                rows.append((len(numbers), *kept, *digests))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string())
            return [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

        return run

    schema = "n_tokens bigint, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, worker, schema, id_col, text_col, keep, chars=ENCODE_CHARS)


def op9_query(docs: DataFrame) -> DataFrame:
    return encode(docs, digests_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
