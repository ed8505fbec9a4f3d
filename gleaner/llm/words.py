"""Words of a text as numpy arrays: positions and 64-bit hashes, computed in bounded blocks.

Everything works on UTF-8 bytes. A hash depends on the word's bytes alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import xxhash

U64 = np.uint64
BLOCK = 1 << 18                    # bytes hashed at once
LONG_WORD = 1 << 12                # longer words are hashed one by one
_BASE = 0x9E3779B97F4A7C15         # odd, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@cache
def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LONG_WORD + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; made where they are needed, not sent with the code."""
    return _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def plain_bytes(text: str | None, lower: bool = True) -> bytes:
    """UTF-8, A-Z in lower case; null is empty, lone surrogates become ``?``."""
    data = (text or "").encode("utf-8", "replace")
    return data.lower() if lower else data


def word_bounds(data: bytes, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space (0x20, 0x09-0x0D)."""
    marks = np.ones(len(data) + 2, dtype=np.int8)
    marks[1:-1] = space[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    return edges[0::2], edges[1::2]


def hash_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash a word."""
    return hash_spans(np.frombuffer(data, dtype=np.uint8), starts, ends)


def hash_spans(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each ascending span of bytes or code points."""
    powers, inverses = _tables()
    out = np.empty(len(starts), dtype=U64)
    size = ends - starts
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(int(np.searchsorted(ends, at + BLOCK, side="right")), i + 1)
        if size[i] > LONG_WORD:
            j = i + 1
        elif (big := np.flatnonzero(size[i:j] > LONG_WORD)).size:
            j = i + int(big[0])
        if size[i] > LONG_WORD:
            out[i] = xxhash.xxh64_intdigest(units[at:int(ends[i])].tobytes())
        else:
            part = units[at:int(ends[j - 1])].astype(U64)
            sums = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum((part + U64(1)) * powers[:len(part)], out=sums[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix((sums[b] - sums[a]) * inverses[a] + size[i:j].astype(U64))
        i = j
    return out


def words_of(text: str | None, lower: bool = True) -> np.ndarray:
    """Hashes of the text's words, in order."""
    data = plain_bytes(text, lower)
    return hash_words(data, *word_bounds(data))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    if k <= 8:
        out = words[:n].copy()
        for j in range(1, k):
            out = out * U64(_BASE) + words[j:j + n]
        return mix(out)
    powers, inverses = _tables()
    out = np.empty(n, dtype=U64)
    for at in range(0, n, BLOCK - k):
        part = words[at:at + BLOCK]
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * powers[:len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[at:at + m] = mix((sums[k:] - sums[:-k]) * inverses[:m])
    return out


def slices(n: int, sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices of ``n`` rows whose sizes sum to about ``most`` at the most."""
    at = total = 0
    for i in range(n):
        if total and total + sizes[i] > most:
            yield slice(at, i)
            at, total = i, 0
        total += sizes[i]
    if n > at:
        yield slice(at, n)
