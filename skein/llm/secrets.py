"""Secret scan: Aho-Corasick prefilter, anchored patterns at its hits, embedded checksums.

One automaton finds the keywords of all kinds in a folded view of the text
(same positions, ASCII letters lowered); a second view, in which every hex
digit is one symbol, is searched for runs.  Patterns are matched only where a
keyword starts, never searched.  Tokens that carry a checksum (CRC-32 in base
62, double SHA-256 in base 58) are added when it is right.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Worker, map_rows, map_texts

# Kinds in order, their patterns, and the strings they start with (lower case).
KINDS = ("assign", "access", "hex", "crc_token", "extended_key")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
EXTENDED_KEY = re.compile(r"[xyzt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
STARTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "crc_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "extended_key": ("xprv", "yprv", "zprv", "tprv"),
}
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUNS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))


@functools.lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    words, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, starts in STARTS.items():
        for start in starts:
            words.add_word(start, (kind, len(start)))
    runs.add_word("h" * HEX_CHARS, HEX_CHARS)
    words.make_automaton()
    runs.make_automaton()
    return words, runs


def crc_token_valid(body: str, check: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the ones before."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def base58_valid(text: str) -> bool:
    """Whether a base-58 string ends in the first four bytes of its double SHA-256."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of ``text`` in code points, by start and then kind."""
    words, runs = _automata()
    aligned = text.encode("latin-1", "replace")  # one byte for each code point
    spans: list[tuple[int, int, str]] = []
    until = dict.fromkeys(KINDS, 0)
    hits = [(end + 1 - length, kind) for end, (kind, length) in words.iter(aligned.translate(_LOWER).decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < until[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                until[kind] = m.end()
                if len(m[2]) >= ASSIGN_CHARS:
                    spans.append((start, m.end(), kind))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                until[kind] = m.end()
                if m.end() - start >= ACCESS_CHARS:
                    spans.append((start, m.end(), kind))
        elif kind == "crc_token":
            if (m := CRC_TOKEN.match(text, start)) and crc_token_valid(m[1], m[2]):
                until[kind] = m.end()
                spans.append((start, m.end(), kind))
        elif (m := EXTENDED_KEY.match(text, start)) and base58_valid(m[0]):
            until[kind] = m.end()
            spans.append((start, m.end(), kind))
    for end, length in runs.iter(aligned.translate(_RUNS).decode("latin-1")):
        start = end + 1 - length
        if start >= until["hex"] and (m := HEX.match(text, start)):
            until["hex"] = m.end()
            spans.append((start, m.end(), "hex"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]) if out else text


_FOUND = "spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string"


def _scanner() -> Worker:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(texts: list[str]) -> list[pa.Array]:
        found = [find(t) for t in texts]
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in own] for own in found]
        clean = [redact(t, own) if own else None for t, own in zip(texts, found)]
        return [pa.array(spans, pa.list_(span)), pa.array(clean, pa.string())]

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: (id, ``keep``, spans array<struct<kind, start, end>>, redacted text).

    ``redacted`` is null where nothing was found.  A null text is an empty one;
    repeated rows and null ids give one row each; an empty table gives no row;
    other columns are not read.  No shuffle, whole texts, memory bounded by the
    Arrow batch.
    """
    return map_texts(docs, lambda: _scanner(), _FOUND, id_col, text_col, keep)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with a mark in place of every secret, and the length column, if any, recomputed where that changed a text.

    All other columns pass through, whatever their names.
    """
    clean = F.col("found.redacted")
    new = {text_col: clean, length_col: F.length(clean).cast("long")}
    done = map_rows(docs, lambda: _scanner(), _FOUND, text_col)
    return done.select(*(F.coalesce(new[c], f"row.{c}").alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


BASE_KINDS = KINDS[:3]


def op5_query(docs: DataFrame) -> DataFrame:
    found = scan(docs)

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(number(k) for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
