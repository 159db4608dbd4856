"""Shingles of whole words."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of whole words, repeats included; fewer words give the one whole sequence."""
    found = text.lower().split()  # of bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(x) + 1 for x in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)
