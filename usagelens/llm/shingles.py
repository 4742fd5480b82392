"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, A-Z lower-cased, words cut at ASCII white space, repeats included.

    Fewer words than a shingle has are one shingle; without words there is none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(g, SEED) for g in grams], dtype=np.uint64)
