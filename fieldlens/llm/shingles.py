"""Hashed word shingles of texts."""

from __future__ import annotations

import numpy as np

from fieldlens.llm import textkit as tk


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as ascending 64-bit hashes.

    A-Z count as a-z. A text with fewer than n words has its whole sequence as
    its one shingle; a text without words has none.
    """
    count = len(offsets) - 1
    hashes, doc = tk.word_hashes(tk.lower(data), offsets)
    runs = tk.combine(hashes, n)
    first = np.searchsorted(doc, np.arange(count + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(tk.combine(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set of shingles."""
    with np.errstate(over="ignore"):
        h = tk.mix(np.array([tk.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(h.view(np.int64)[0])
