"""Vectorised text scanning for Arrow batches: code points, character classes and hashes in numpy."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
IDEOGRAPH = 4


@cache
def classes() -> np.ndarray:
    """Per code point OTHER, LETTER, NUMBER or SPACE (Unicode general categories L and N, property White_Space)."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


@cache
def word_classes() -> np.ndarray:
    """1 for letters and digits, IDEOGRAPH for U+4E00 to U+9FFF, 0 for the rest."""
    table = (classes() == LETTER) | (classes() == NUMBER)
    table = table.astype(np.uint8)
    table[0x4E00:0xA000] = IDEOGRAPH
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def codes(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All texts as one string, its code points, and where each text begins (with the end as the last entry)."""
    whole = "".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], ends))


BASE = 0xD1B54A32D192ED03


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    step = 1
    while step < n:
        m = min(step, n - step)
        up[step : step + m] = up[:m] * np.uint64(pow(BASE, step, 1 << 64))
        down[step : step + m] = down[:m] * np.uint64(pow(inverse, step, 1 << 64))
        step *= 2
    return up, down


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points, the same for equal spans wherever they stand."""
    n = 1 << max(10, int(len(points)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(points) + 1, np.uint64)
    scaled = (points + np.uint32(1)) * up[: len(points)]
    np.cumsum(scaled, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has. A word is one ideograph or else a
    longest run of letters and digits, in lower case."""
    texts = [t.lower() for t in texts]
    _, points, at = codes(texts)
    if not len(points):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    kind = word_classes()[points]
    fresh = np.ones(len(points), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh |= kind == IDEOGRAPH
    fresh[at[:-1][at[:-1] < len(points)]] = True
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(points))
    keep = kind[begins] > 0
    begins, ends = begins[keep], ends[keep]
    counts = np.diff(np.searchsorted(begins, at))
    return span_hashes(points, begins, ends), counts


#: Characters that are scanned at a time, so that the arrays of a task stay small; a longer text is scanned alone.
SLICE = 3_000_000


def slices(batches, column: int):
    """The record batches cut so that the texts of a column have about SLICE bytes together."""
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = int(size[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, done + SLICE, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
