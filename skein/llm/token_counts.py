"""Token counts by prefix dynamic programming.

For every prefix of a text the table holds the exact number of tokens that the
vocabulary gives that prefix, so "how many tokens are in the first n
characters", "where must this text be cut for a budget of k tokens" and "how
many tokens does the whole text have" are look-ups that encode nothing again.

A byte sequence has exactly one merge-ordered encoding, and a sequence of
tokens is such an encoding if and only if every two neighbours, taken alone,
encode to themselves.  Hence for a prefix ending at byte i the last token is
the one suffix t whose neighbour, the last token of the prefix before t, stays
separate from it; count[i] = count[i - len(t)] + 1.  One step per byte; the new
words of a slice step together in arrays, byte by byte, and long ones alone.
"""

from __future__ import annotations

import functools
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import bpe
from skein.llm.common import Worker, map_texts

MEMO = 600_000  # words and pairs that a worker remembers; beyond it they are computed again
STEP_BYTES = 16  # longest prefix whose state is shared between words
TOGETHER_BYTES = 64  # longest word that steps together with others
TOGETHER_WORDS = 32  # least number of them; fewer step alone
TOGETHER_PAIRS = 256  # the same for pairs of tokens that are merged
PAIR_SLOTS = 20  # bits of the slots that hold pairs of tokens in an array
LAST = (1 << 17) - 1  # as a token: the start of a word
SHORT_CONTRACTIONS = ("'re", "'ve", "'ll")
_WHITE_RUN = regex.compile(r"\s{2,}")  # not str.isspace(), which counts U+001C to U+001F


class PrefixCounter:
    """Token counts of every prefix of a text, under one vocabulary."""

    def __init__(self, path: str) -> None:
        self.bpe = bpe.load(path)
        self._longest: dict[bytes, int] = {}  # longest token by its last three (or fewer) bytes
        for token in self.bpe.token_id:
            tail = token[-3:]
            self._longest[tail] = max(self._longest.get(tail, 0), len(token))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._slots = np.full(1 << PAIR_SLOTS, -1, np.int64)  # pair * 2 + whether it stays apart
        self._steps: dict[bytes, int] = {}
        self._words: dict[str, bytes] = {}
        self._large: dict[str, np.ndarray] = {}  # words of more than 255 tokens

    def _apart(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves (left < 0: the right one alone)."""
        known = self._pairs.get((left, right))
        if known is None:
            own = self.bpe.token_bytes
            if left < 0:
                known = self.bpe.merge_word(own[right]) == [right]
            else:
                known = self.bpe.merge_word(own[left] + own[right]) == [left, right]
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def _extend(self, word: bytes, states: list[int]) -> None:
        """Append to ``states`` the states of the prefixes of ``word`` that it lacks.

        A state is count * 2**17 + last token.
        """
        token_id, longest, own, steps = self.bpe.token_id, self._longest, self.bpe.token_bytes, self._steps
        for end in range(len(states), len(word) + 1):
            prefix = word[:end] if end <= STEP_BYTES else None
            state = steps.get(prefix)
            if state is None:
                # most often the last token grows by the new byte; else try all, longest first
                grown = end - 1 - len(own[states[end - 1] & LAST]) if end > 1 else 0
                reach = longest.get(word[max(0, end - 3) : end], 2)
                for start in (grown, *range(max(0, end - reach), end)):
                    token = token_id.get(word[start:end])
                    if token is not None:
                        before = states[start]
                        if self._apart(before & LAST if start else -1, token):
                            state = ((before >> 17) + 1 << 17) + token
                            break
                if prefix is not None:
                    steps[prefix] = state
            states.append(state)

    @functools.cached_property
    def _grown(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys token * 256 + byte in ascending order, and the token of both."""
        token_id = self.bpe.token_id
        grown = {token_id[t[:-1]] << 8 | t[-1]: i for t, i in token_id.items() if t[:-1] in token_id}
        return _by_key(grown)

    @functools.cached_property
    def _backwards(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens read from their last byte: keys node * 256 + byte, the node behind each, and each node's token or -1."""
        behind: dict[int, int] = {}
        tokens = [-1]
        for token, i in self.bpe.token_id.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in behind:
                    behind[key] = len(tokens)
                    tokens.append(-1)
                node = behind[key]
            tokens[node] = i
        return *_by_key(behind), np.array(tokens, np.int64)

    @functools.cached_property
    def _lengths(self) -> np.ndarray:
        own = self.bpe.token_bytes
        return np.array([len(own.get(i, b"")) for i in range(max(own) + 1)], np.int64)

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs; a slot of the array holds the pair that was asked for last."""
        pair = left << 17 | right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_SLOTS)).astype(np.int64)
        held = self._slots[slot]
        apart = held & 1 == 1
        lacking = np.flatnonzero(held >> 1 != pair)
        if len(lacking):
            new, which = np.unique(pair[lacking], return_inverse=True)
            pairs = [(a, b) if a != LAST else (b,) for a, b in zip((new >> 17).tolist(), (new & LAST).tolist())]
            own = self.bpe.token_bytes
            joined = [b"".join([own[i] for i in pair]) for pair in pairs]
            if len(pairs) < TOGETHER_PAIRS:
                found = [tuple(self.bpe.merge_word(word)) == pair for word, pair in zip(joined, pairs)]
            else:
                found = [ids == bpe.pack(pair) for ids, pair in zip(self.bpe.merge_words(joined), pairs)]
            apart[lacking] = np.array(found)[which]
            self._slots[slot[lacking]] = pair[lacking] << 1 | apart[lacking]
        return apart

    def _learn_together(self, words: list[tuple[bytes, str]]) -> None:
        """Counts of words of at most ``TOGETHER_BYTES`` bytes: one step of all words per byte."""
        words.sort(key=lambda w: len(w[0]), reverse=True)
        size = np.fromiter((len(data) for data, _ in words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1  # place of a word's empty prefix; that of n bytes is n places on
        raw = np.frombuffer(b"\0".join([b"", *(data for data, _ in words)]), "u1").astype(np.int64)
        last, count = np.full(len(raw), LAST, np.int64), np.zeros(len(raw), "u1")
        keys, grown = self._grown
        steps, behind, tokens = self._backwards
        for n in range(1, int(size[0]) + 1):
            place = first[: np.searchsorted(-size, -n, "right")] + n
            before = place - 1  # the prefix that the last token follows
            token = np.full(len(place), -1, np.int64)
            if n > 1:  # most often the last token grows by the new byte
                own = last[place - 1]
                token = _find(keys, grown, own << 8 | raw[place])
                before = place - 1 - self._lengths[own]
                known = np.flatnonzero(token >= 0)
                token[known[~self._all_apart(last[before[known]], token[known])]] = -1
            todo = np.flatnonzero(token < 0)  # else try all, shortest first
            at, node = place[todo], np.zeros(len(todo), np.int64)
            while len(todo):
                node = _find(steps, behind, node << 8 | raw[at])
                at = at - 1
                ends = np.flatnonzero(tokens[node] >= 0)
                ends = ends[self._all_apart(last[at[ends]], tokens[node[ends]])]
                token[todo[ends]], before[todo[ends]] = tokens[node[ends]], at[ends]
                left = np.ones(len(todo), bool)
                left[ends] = False
                todo, at, node = todo[left], at[left], node[left]
            last[place], count[place] = token, count[before] + 1
        # the prefixes that end a character
        whole = np.append(raw[1:] & 0xC0 != 0x80, True)
        whole[first] = False
        flat, at = count[whole].tobytes(), 0
        for _, word in words:
            self._words[word] = flat[at : at + len(word)]
            at += len(word)

    def learn(self, words: set[str]) -> None:
        """Put the counts of new pre-tokens into the memo; those that step alone sorted, so that neighbours share steps."""
        if len(self._steps) > MEMO:
            self._steps.clear()
        alone = [(w.encode(), w) for w in words]
        if len(alone) >= TOGETHER_WORDS:
            if together := [x for x in alone if len(x[0]) <= TOGETHER_BYTES]:
                self._learn_together(together)
            alone = [x for x in alone if len(x[0]) > TOGETHER_BYTES]
        before, states = b"", [0]
        for data, word in sorted(alone):
            same = len(commonprefix((before, data)))
            del states[same + 1 :]
            self._extend(data, states)
            counts = [s >> 17 for s in states[1:]]
            if len(data) > len(word):
                counts = [c for c, nxt in zip(counts, data[1:] + b"\0") if nxt & 0xC0 != 0x80]
            if counts[-1] < 256:
                self._words[word] = bytes(counts)
            else:
                self._large[word] = np.array(counts, "<i4")
            before = data
        for word in words.intersection(SHORT_CONTRACTIONS):  # cut after its first letter: an apostrophe and a letter
            self._words[word] = bytes((1, 2, self._words[word][-1]))

    @staticmethod
    def _ordinary(words: list[str], runs: list[tuple[int, str]], known: dict, large: set[str]) -> np.ndarray:
        """Counts after each character of a text without special tokens, for prefixes that end there.

        The text is given as its pre-tokens and its runs of white space, with the
        counts of all of them.  A run that ends the prefix is one pre-token,
        though a word after it takes its last space.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        if large.isdisjoint(words):
            counts = np.frombuffer(b"".join(map(known.__getitem__, words)), "u1").astype("<i4")
        else:
            counts = np.concatenate([_array(known[w]) for w in words]).astype("<i4")
        totals = counts[np.cumsum(size) - 1]
        counts += np.repeat((np.cumsum(totals) - totals).astype("<i4"), size)
        for at, run in runs:
            counts[at : at + len(run)] = _array(known[run]) + (counts[at - 1] if at else np.int32(0))
        return counts

    def _cut(self, text: str) -> tuple[list[str], list[tuple[int, str]]]:
        """(pre-tokens, runs of white space with their places)."""
        return self.bpe.pretokens(text), [(m.start(), m.group()) for m in _WHITE_RUN.finditer(text)]

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """Per text: count[i] = tokens of the first i characters, for i from 0 to len(text).

        A prefix that ends inside a special token's string has ordinary text
        there; from the string's end on it is one token.
        """
        cut = []  # per text: words and runs up to the special token, those with the cut-off special string, or None
        for text in texts:
            cut.append(
                [
                    (self._cut(ordinary), self._cut(ordinary + special[:-1]) if special else None)
                    for ordinary, special in self.bpe.segments(text)
                ]
            )
        words: set[str] = set()
        for segments in cut:
            for pair in segments:
                for own, runs in filter(None, pair):
                    words.update(own)
                    words.update(run for _, run in runs)
        new = words.difference(self._words, self._large)
        if len(self._words) + len(self._large) + len(new) > MEMO:  # before learning: a slice's words stay together
            self._words.clear()
            self._large.clear()
            new = words
        self.learn(new)
        large = words.intersection(self._large)
        known = {w: self._large[w] if w in large else self._words[w] for w in words}  # quicker than the whole memo
        out = []
        for segments in cut:
            parts, base = [np.zeros(1, "<i4")], 0
            for whole, until in segments:
                own = self._ordinary(*whole, known, large)
                if until is None:
                    parts.append(own + base if base else own)
                else:
                    parts.append(self._ordinary(*until, known, large) + base)
                    base += (int(own[-1]) if len(own) else 0) + 1
                    parts.append(np.array([base], "<i4"))
            out.append(np.concatenate(parts))
        return out


def _array(counts: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(counts, "u1") if isinstance(counts, bytes) else counts


def _by_key(values: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.fromiter(values, np.int64, len(values))
    order = np.argsort(keys)
    return keys[order], np.fromiter(values.values(), np.int64, len(values))[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, -1 for those that ``keys`` lacks."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], -1)


@functools.lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_token_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = 1024,
    vocabulary: str | None = None,
    keep_counts: bool = True,
) -> DataFrame:
    """Per row of ``docs``: (id, n_bytes, n_chars, n_tokens, fit_chars, prefix_counts).

    ``prefix_counts[i]`` is the exact token count of the first i characters
    (code points), ``fit_chars`` the longest prefix of at most ``budget``
    tokens; both come out of the same table.  ``keep_counts=False`` leaves
    ``prefix_counts`` null where only the answers are wanted.

    A null text is an empty one (0 tokens, ``prefix_counts`` [0]); repeated rows
    and null ids give one row each; an empty table gives no row; other columns
    of ``docs`` are not read.  No shuffle: a map over Arrow batches, memory
    bounded by the batch and by the worker's memo.
    """

    def worker() -> Worker:
        own = counter(bpe.vocabulary_path(vocabulary))

        def run(texts: list[str]) -> list[pa.Array]:
            rows = []
            for text, counts in zip(texts, own.tables(texts)):
                fits = len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])
                rows.append((len(text.encode()), len(text), int(counts[-1]), fits, counts if keep_counts else None))
            columns = list(zip(*rows))
            return [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int32()))]

        return run

    schema = "n_bytes bigint, n_chars bigint, n_tokens bigint, fit_chars bigint, prefix_counts array<int>"
    return map_texts(docs, worker, schema, id_col, text_col)


def tokens_before(n_chars: Column | int, counts: Column | str = "prefix_counts") -> Column:
    """Tokens of the first ``n_chars`` characters (all, if the text is shorter), from the stored table."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    n = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return F.element_at(counts, (F.least(n, F.size(counts) - 1) + 1).cast("int"))


def fitting_chars(budget: Column | int, counts: Column | str = "prefix_counts") -> Column:
    """Longest prefix, in characters, of at most ``budget`` tokens, from the stored table."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    fits = F.transform(counts, lambda c, i: F.when(c <= limit, i))
    return F.array_max(fits).cast("long")


def op6_query(docs: DataFrame) -> DataFrame:
    table = prefix_token_table(docs, budget=1024, keep_counts=False)
    return table.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fit_chars"
    )
