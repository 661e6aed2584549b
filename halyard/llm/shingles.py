"""Canonical text, character shingles and min-max signatures, computed on Arrow batches with NumPy."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

WIDTH = 5
_TABLE = 0x33480  # beyond lie only marks, private use and tags: no letters or digits


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    keep, lower = np.zeros(_TABLE, bool), np.arange(_TABLE, dtype=np.uint32)
    for cp in range(_TABLE):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd":
            keep[cp] = True
            low = ch.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    return keep, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def canonical_points(text: str) -> np.ndarray:
    """Letters and digits of the text in lower case, as code points."""
    keep, lower = _tables()
    cp = code_points(text)
    cp = cp[cp < _TABLE]
    return lower[cp[keep[cp]]]


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def canonical(text: str) -> str:
    return as_text(canonical_points(text))


def shingle_hashes(points: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A 32-bit hash of each run of ``width`` code points (repeats included; they change no minimum and no maximum)."""
    n = len(points) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    p = points.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ p[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


@functools.lru_cache(maxsize=8)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def minmax_signature(hashes: np.ndarray, permutations: int, seed: int = 20) -> np.ndarray:
    """Min-max hashing: under each permutation both the minimum and the maximum are kept, so that ``permutations`` hash
    evaluations give twice as many values, each of which two sets share with the probability of their similarity."""
    a, b = _permutations(permutations, seed)
    low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    for start in range(0, len(hashes), 16_384):  # a long text takes no more memory than a short one
        mixed = (hashes[start : start + 16_384, None] ^ b[None, :]) * a[None, :]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(low, mixed.min(axis=0), out=low)
        np.maximum(high, mixed.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` (even) values, all from different permutations; the band's number goes into the hash.

    A band takes half of its values from minima and half from maxima; those of one permutation go to different bands, as a set's
    minimum and maximum under one permutation are not independent.
    """
    bands = len(signature) // rows
    low = signature[: bands * rows // 2].reshape(rows // 2, bands)
    high = np.roll(signature[bands * rows // 2 : bands * rows].reshape(rows // 2, bands), bands // 3, axis=1)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for part in (*low.astype(np.uint64), *high.astype(np.uint64)):
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def bit_sketch(signature: np.ndarray) -> tuple[int, int]:
    """One bit of each of the first 128 values: two sets of similarity s agree in about 128 * (1 + s) / 2 bits."""
    bits = ((signature[:128] * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint8)
    words = np.packbits(bits).view(np.int64)
    return int(words[0]), int(words[1])


def jaccard(a: str, b: str, width: int = WIDTH) -> float:
    """Shared distinct sequences of two canonical texts divided by those of either; 0 if neither has one.

    Sequences are numbered, not hashed: the code points of both texts are ranked, then the pairs of neighbours, and so on, one more
    character each time; a rank stays below the number of characters, so the numbers are exact at every length and take 8 bytes a character.
    """
    cut = max(0, len(a) - width + 1)
    n = cut + max(0, len(b) - width + 1)
    points = code_points(a + b)
    if not n:
        return 0.0
    _, single = np.unique(points, return_inverse=True)
    base = int(single.max()) + 1
    code = single
    for k in range(1, width):
        code = code[:-1] * base + single[k:]
        if k < width - 1 and int(code.max()) >= 2**62 // base:
            code = np.unique(code, return_inverse=True)[1]
    x, y = np.unique(code[:cut]), np.unique(code[len(code) - (n - cut) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)
