"""Operator 10: what reaches the driver is packed, and packing loses nothing."""

from __future__ import annotations

import numpy as np

from skein.llm import quality


def test_packed_terms_are_whole_and_small():
    texts = ["", "a", "One two two, THREE!\nOne two\nOne two", "é" * 300 + " x" * 70_000, "The cat sat on the mat. " * 40]
    rows = [quality.packed(quality.terms(t)) for t in texts]
    assert np.array_equal(quality.unpacked(rows), np.stack([quality.terms(t) for t in texts]))
    assert max(map(len, rows)) < quality.TERMS * 4 / 5  # less than a fifth of all counts as floats
    assert quality.unpacked([]).shape == (0, quality.TERMS)
