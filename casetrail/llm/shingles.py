"""Word shingles of a text as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _powers[base]
    if len(got) < n:
        got = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end], from one running polynomial over ``raw``."""
    with np.errstate(over="ignore"):
        terms = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        h = (upto[ends] - upto[starts]) * powers(_INVERSE, len(raw) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes: A-Z lower-cased, words between ASCII white space, five words each (fewer words: one)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(raw)]])
    n = max(len(words) - WORDS + 1, 1)
    return np.unique(span_hashes(raw, starts[:n], ends[-n:]))
