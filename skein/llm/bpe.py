"""Byte-level BPE: vocabulary, pre-tokens and exact merges (runs inside workers)."""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import regex

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: how a byte-level pre-tokeniser cuts a text.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _latin_pattern() -> re.Pattern:
    """``PRETOKEN`` for texts of characters up to U+017F alone, in the faster ``re``."""
    chars = [chr(c) for c in range(0x180)]
    letters, numbers = ("".join(c for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN")
    white = r"\t-\r \x85\xa0"
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
    return re.compile(rf"{pattern}|[{white}]+(?![^{white}])|[{white}]+")


_LATIN_PRETOKEN = _latin_pattern()

# A space between two other characters that are not white space always starts a
# new pre-token, so texts may be cut there and the pieces handled on their own.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S\n ]")
NEVER = 1 << 40  # rank of a pair that is not merged
_BEYOND_LATIN = re.compile(r"[^\x00-ſ]")


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the installed public vocabulary on this machine."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _printable_bytes() -> dict[str, int]:
    """Character of the vocabulary file → byte: printable ones stand for themselves, the rest follow from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in kept}
    others = (b for b in range(256) if b not in set(kept))
    table.update({chr(256 + i): b for i, b in enumerate(others)})
    return table


class ByteBpe:
    """Vocabulary of a byte-level ``tokenizers`` file with exact merging of words."""

    LONG = 64  # bytes from which merging goes through a heap

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _printable_bytes()
        model = spec["model"]
        text_id = model["vocab"]
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in t) for t, i in text_id.items()}
        self.token_id: dict[bytes, int] = {b: i for i, b in self.token_bytes.items()}
        self.byte_id = [self.token_id[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[text_id[left], text_id[right]] = rank
            self.made.append(text_id[left + right])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_cut = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        self._path = path

    # -- pre-tokens -----------------------------------------------------

    def segments(self, text: str) -> list[tuple[str, str | None]]:
        """(ordinary text, special token that follows it or None), in order."""
        if self.special_cut is None:
            return [(text, None)]
        out, at = [], 0
        for m in self.special_cut.finditer(text):
            out.append((text[at : m.start()], m.group()))
            at = m.end()
        out.append((text[at:], None))
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces of ``text`` between the spaces at which a pre-token must start.

        All but the first stand for a space and the piece; encodings of the
        pieces can simply be joined.
        """
        if (
            "  " in text
            or " \n" in text
            or "\n " in text
            or text[:1] == " "
            or text[-1:] == " "
            or _OTHER_SPACE.search(text)
        ):
            return _CUT.split(text)
        return text.split(" ")

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of ``text``, as the library cuts it.

        Characters that newer Unicode versions have added may be classed
        differently by the two libraries; such pieces are cut by the vocabulary's
        own pre-tokeniser.
        """
        if not _BEYOND_LATIN.search(text):
            return _LATIN_PRETOKEN.findall(text)
        if not all(map(_old_character, set(text))):
            first, *rest = self.chunks(text)
            if rest:
                return [w for piece in (first, *(" " + p for p in rest)) for w in self.pretokens(piece)]
            return [text[a:b] for _, (a, b) in self._library_pretokeniser.pre_tokenize_str(text)]
        return PRETOKEN.findall(text)

    @functools.cached_property
    def _library_pretokeniser(self):
        """The vocabulary file's own pre-tokeniser; the vocabulary itself isn't loaded a second time."""
        from tokenizers import Tokenizer

        with open(self._path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"] |= {"vocab": {}, "merges": []}
        own = {"version": spec["version"], "pre_tokenizer": spec["pre_tokenizer"], "model": spec["model"], "added_tokens": []}
        return Tokenizer.from_str(json.dumps(own)).pre_tokenizer

    # -- merges ---------------------------------------------------------

    def merge_word(self, word: bytes) -> list[int]:
        """Token ids of one pre-token by merging the lowest-ranked pair, leftmost first."""
        parts = [self.byte_id[b] for b in word]
        if len(parts) > self.LONG:
            return self._merge_long(parts)
        rank = self.rank.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks and (lowest := min(ranks)) != NEVER:
            i = ranks.index(lowest)
            parts[i : i + 2] = [self.made[lowest]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        return parts

    @functools.cached_property
    def _made(self) -> np.ndarray:
        return np.array(self.made, np.int64)

    @functools.cached_property
    def _byte_id(self) -> np.ndarray:
        return np.array(self.byte_id, np.int64)

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the pairs that merge in ascending order, their ranks, ranks of the pairs of bytes).

        A rank of ``len(made)`` means that the pair is not merged.
        """
        pairs = np.array(list(self.rank), np.int64).reshape(-1, 2)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key)
        keys, ranks = key[order], np.fromiter(self.rank.values(), np.int32, len(key))[order]
        first = np.repeat(self._byte_id, 256) << 32 | np.tile(self._byte_id, 256)
        return keys, ranks, self._ranks(keys, ranks, first)

    def _ranks(self, keys: np.ndarray, ranks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), len(self.made), np.int32)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, ranks[place], np.int32(len(self.made)))

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as ``pack`` gives them: ``merge_word`` for many at once.

        All words step together: a round looks up the lowest-ranked pair of every
        word (the leftmost of equal ones) and merges it; words without such a pair
        leave.  Words of more than ``LONG`` bytes go one by one.
        """
        out = [b""] * len(words)
        own = []
        for i, word in enumerate(words):
            if len(word) > self.LONG:
                out[i] = pack(self.merge_word(word))
            elif word:
                own.append(i)
        keys, ranks, byte_ranks = self._pairs
        never, made = len(self.made), self._made
        raw = np.frombuffer(b"".join([words[i] for i in own]), "u1").astype(np.int64)
        size = np.fromiter((len(words[i]) for i in own), np.int64, len(own))
        word = np.array(own, np.int64)
        parts = self._byte_id[raw]
        last = np.cumsum(size) - 1
        # rank of each part with the next one of its word
        rank = np.full(len(parts), never, np.int32)
        rank[:-1] = byte_ranks[raw[:-1] << 8 | raw[1:]]
        rank[last] = never
        while len(word):
            start = np.cumsum(size) - size
            lowest = np.minimum.reduceat(rank, start)
            open_ = lowest < never
            if not open_.all():  # hand out the words that are done
                inside = np.repeat(open_, size)
                data, at = parts[~inside].astype("<u4").tobytes(), 0
                for i, n in zip(word[~open_].tolist(), (4 * size[~open_]).tolist()):
                    out[i] = data[at : at + n]
                    at += n
                parts, rank, word, size, lowest = parts[inside], rank[inside], word[open_], size[open_], lowest[open_]
                if not len(word):
                    break
                start = np.cumsum(size) - size
            hits = np.flatnonzero(rank == np.repeat(lowest, size))
            left = hits[np.searchsorted(hits, start)]  # the first hit of each word
            parts[left] = made[lowest]
            keep = np.ones(len(parts), bool)
            keep[left + 1] = False
            rank[left] = rank[left + 1]  # never, where the pair ended its word
            parts, rank = parts[keep], rank[keep]
            left = left - np.arange(len(left))  # one part fewer for every word before
            size = size - 1
            start = np.cumsum(size) - size
            for at in (left[left + 1 < start + size], left[left > start] - 1):
                rank[at] = self._ranks(keys, ranks, parts[at] << 32 | parts[at + 1])
        return out

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same order of merges in O(n log n): a heap of pairs over a linked list."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.rank.get((parts[i], parts[j]))) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    @functools.cached_property
    def _flat_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, bytes) of all tokens, one after the other by id."""
        tokens = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.cumsum(length) - length, length, np.frombuffer(b"".join(tokens), "u1")

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, one after the other."""
        start, length, flat = self._flat_bytes
        size = length[ids]
        end = np.cumsum(size)
        place = np.arange(end[-1] if len(end) else 0) + np.repeat(start[ids] + size - end, size)
        return flat[place].tobytes()

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``; bytes that aren't UTF-8 become U+FFFD."""
        return self.bytes_of(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4096)
def _old_character(c: str) -> bool:
    return unicodedata.ucd_3_2_0.category(c) != "Cn"


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary at ``path``, read once per worker process."""
    return ByteBpe(path)


def pack(ids: list[int]) -> bytes:
    """``ids`` as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)
