"""Word-shingle sets as sorted 64-bit hashes, computed for many texts at once (run inside workers)."""

from __future__ import annotations

import numpy as np

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _STEP)


_BYTE = _random(256, 1)
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_place = _random(4096, 2) | np.uint64(1)  # weight of a byte by its place in the word


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = _random(2 * n, 2) | np.uint64(1)
    return _place


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text).

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z lowered.
    """
    parts = [t.encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), "u1")  # a space ends each text
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    # places behind a word's end belong to spaces, whose value is 0
    longest = int((np.flatnonzero(space)[np.searchsorted(np.flatnonzero(space), starts)] - starts).max())
    weight = _places(longest + 1)[np.minimum(place, longest)]
    sums = np.add.reduceat(_BYTE[data[starts[0] :]] * weight, starts - starts[0])
    return mix(sums), np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Per text its distinct ``width``-word shingles, ascending; the whole sequence for a text of fewer words."""
    hashes, counts = words(texts)
    if not len(hashes):
        return [np.zeros(0, np.uint64) for _ in texts]
    rolled = mix(hashes)
    if len(hashes) >= width:
        for k in range(1, width):
            rolled = mix(rolled[: len(hashes) - width + 1] * _STEP + hashes[k : len(hashes) - width + 1 + k])
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            whole = mix(hashes[start : start + 1])
            for k in range(1, n):
                whole = mix(whole * _STEP + hashes[start + k : start + k + 1])
            out.append(whole + np.uint64(n))  # apart from the shingles of full width
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def digest(values: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a sorted array as two signed 64-bit numbers."""
    place = _places(len(values))[: len(values)]
    one = int(mix((values * place).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(values)))[0])
    two = int(mix((mix(values) * place).sum(keepdims=True, dtype=np.uint64))[0])
    return one - (one >> 63 << 64), two - (two >> 63 << 64)
