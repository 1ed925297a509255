"""Hashes of stretches of text and of word sequences, computed over whole batches with numpy.

All arithmetic is modulo 2**64. The hash of a stretch [s, e) is sum(v[i] * B**(i - s)), taken from one
prefix sum over the batch, so that equal stretches have equal hashes wherever they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters that are hashed at a time; the arrays of a step take about 100 bytes for each.
STEP_CHARS = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit value for each number."""
    x = x.astype(U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def power_of(base: int, n: int) -> np.ndarray:
    """The powers 0 .. n - 1 of ``base``; lengths are rounded up so that batches share one array."""
    return powers(base, max(STEP_CHARS, 1 << (n - 1).bit_length()) if n > STEP_CHARS else STEP_CHARS)[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums, from which ``stretch`` takes the hash of any stretch."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * power_of(BASE, len(values)), out=out[1:])
    return out


def stretch(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * power_of(INVERSE, len(prefix))[start]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=1)
def word_values() -> np.ndarray:
    """By code point: a hash value for letters and digits, 0 for all else."""
    is_word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return np.where(is_word, mixed(np.arange(0x110000)) | U(1), U(0))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in their order, and the number of the text of each.

    A word is a maximal run of letters and digits; case is folded.
    """
    folded = [(t or "").replace("İ", "i").casefold() for t in texts]
    points = code_points("\n".join(folded) + "\n")
    values = word_values()[points]
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = values != 0
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in folded], out=begins[1:])
    owner = np.searchsorted(begins, start, side="right") - 1
    return stretch(prefix_hash(values), start, end), owner


def in_steps(sizes: list[int], most: int = STEP_CHARS) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters together; a longer row stands alone."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            out.append((at, i))
            at, total = i, 0
        total += n
    return [*out, (at, len(sizes))] if at < len(sizes) else out
