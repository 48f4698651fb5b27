"""Minimal acyclic transducer from words to token ids, as flat arrays in one file.

The automaton shares prefixes and suffixes of its words (incremental
construction from sorted words).  Every transition carries the number of words
that sort before the ones behind it; their sum along a word's path is the
word's number, and its ids stand at that number in a table.  The file is
memory-mapped: the workers of one machine share its pages.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np

MAGIC = 0x534B4C58


def build(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """File of the minimal transducer for (word, ids) entries; repeated words count once."""
    table = dict(entries)
    words = sorted(table)
    final: list[bool] = [False]
    out: list[dict[int, int]] = [{}]  # per state: byte → state, in ascending order
    register: dict[tuple, int] = {}
    path = [0]  # states along the word added last
    free: list[int] = []

    def settle(down_to: int, word: bytes) -> None:
        """Replace the states behind ``down_to`` by equal registered ones."""
        for depth in range(len(path) - 1, down_to, -1):
            state, parent, byte = path[depth], path[depth - 1], word[depth - 1]
            key = (final[state], *out[state].items())
            known = register.setdefault(key, state)
            if known != state:
                out[parent][byte] = known
                free.append(state)
        del path[down_to + 1 :]

    before = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        settle(same, before)
        for byte in word[same:]:
            if free:
                state = free.pop()
                final[state], out[state] = False, {}
            else:
                state = len(out)
                final.append(False)
                out.append({})
            out[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        before = word
    settle(0, before)

    # words behind each state, children before parents
    behind: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [s for s in out[state].values() if s not in behind]
        if todo:
            stack.extend(todo)
            continue
        behind[state] = final[state] + sum(behind[s] for s in out[state].values())
        stack.pop()
    number = {state: i for i, state in enumerate(sorted(behind))}
    keys, targets, skipped = [], [], []
    for state in sorted(behind):
        passed = int(final[state])
        for byte in sorted(out[state]):
            target = out[state][byte]
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            skipped.append(passed)
            passed += behind[target]
    lengths = [len(table[w]) for w in words]
    arrays = [
        np.array(keys, "<u4"),
        np.array(targets, "<u4"),
        np.array(skipped, "<u4"),
        np.array([final[s] for s in sorted(behind)], "<u4"),
        np.concatenate(([0], np.cumsum(lengths))).astype("<u4"),
        np.array([i for w in words for i in table[w]], "<u4"),
    ]
    head = np.array([MAGIC, *map(len, arrays)], "<u4")
    return b"".join(a.tobytes() for a in [head, *arrays])


class Transducer:
    """A transducer file, memory-mapped."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype="<u4", mode="r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is not a transducer file")
        at, arrays = 7, []
        for length in data[1:7].tolist():
            arrays.append(np.asarray(data[at : at + length]))  # a view: the pages stay mapped
            at += length
        self._keys, self._targets, self._skipped, self._final, self._offsets, self._ids = arrays

    @property
    def states(self) -> int:
        return len(self._final)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word in the lexicon, -1 for words that it lacks; all words step together."""
        n = len(words)
        result = np.full(n, -1, np.int64)
        if not n or not len(self._keys):
            return result
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), "u1")
        alive = np.flatnonzero(lengths > 0)
        state = np.zeros(len(alive), np.uint32)
        passed = np.zeros(len(alive), np.int64)
        depth = 0
        while len(alive):
            key = state << np.uint32(8) | data[starts[alive] + depth]
            place = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = self._keys[place] == key
            alive, place, passed = alive[found], place[found], passed[found]
            state = self._targets[place]
            passed = passed + self._skipped[place]
            depth += 1
            ended = lengths[alive] == depth
            hit = ended & (self._final[state] == 1)
            result[alive[hit]] = passed[hit]
            alive, state, passed = alive[~ended], state[~ended], passed[~ended]
        return result

    def ids(self, number: int) -> bytes:
        """Ids of the word with this number, as little-endian unsigned 32-bit integers."""
        return self._ids[self._offsets[number] : self._offsets[number + 1]].tobytes()


@functools.lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """The transducer at ``path``, mapped once per worker process."""
    return Transducer(path)
