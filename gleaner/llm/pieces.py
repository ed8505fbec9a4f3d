"""Ids of many texts at once: distinct pieces are encoded by a library, the rest are look-ups.

Pieces are known by 64-bit hashes of their code points, so that a task's table of known pieces is
a few flat arrays of bounded size instead of millions of Python objects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from gleaner.llm.pretokens import code_points, piece_starts
from gleaner.llm.words import U64, hash_spans, slices

SLICE_CHARS = 1 << 20      # characters looked up together
KNOWN = 1 << 21            # pieces remembered at most

Encoder = Callable[[list[str]], list[list[int]]]


class PieceTable:
    """Remembers the ids of pieces; ``encode`` is asked only for pieces that are new."""

    def __init__(self, encode: Encoder, known: int = KNOWN) -> None:
        self.encode, self.limit = encode, known
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=U64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self._forget()
        ids = self.encode(pieces)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for part in ids for i in part), dtype=np.uint32, count=int(size.sum()))
        at = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(merged := np.concatenate((self.keys, keys)), kind="stable")
        self.keys = merged[order]
        self.at = np.concatenate((self.at, at))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.flat = np.concatenate((self.flat, flat))

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))

    def ids_of_pieces(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each piece has."""
        if len(starts) == 0:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        keys, first, place = np.unique(hash_spans(points, starts, ends), return_index=True, return_inverse=True)
        spot = self._places(keys)
        new = np.flatnonzero(self.keys[spot] != keys) if len(self.keys) else np.arange(len(keys))
        if new.size:
            if len(self.keys) + len(new) > self.limit:
                new = np.arange(len(keys))
            self._learn(keys[new], [points[a:b].tobytes().decode("utf-32-le", "replace") for a, b in zip(starts[first[new]], ends[first[new]])])
            spot = self._places(keys)
        at, size = self.at[spot][place], self.size[spot][place]
        ends_at = np.cumsum(size)
        return self.flat[np.repeat(at - ends_at + size, size) + np.arange(ends_at[-1] if len(ends_at) else 0)], size

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for part in slices(len(texts), [len(t) for t in texts], SLICE_CHARS):
            points, starts, pieces, base = [], [], [], 0
            for t in texts[part]:
                p = code_points(t)
                s = piece_starts(p)
                points.append(p)
                starts.append(s + base)
                pieces.append(len(s))
                base += len(p)
            a = np.concatenate(starts)
            found, size = self.ids_of_pieces(np.concatenate(points), a, np.append(a[1:], base))
            cut = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(pieces)))]
            out += [found[x:y] for x, y in zip(cut[:-1], cut[1:])]
        return out


def clean_text(text: str | None) -> str:
    """Null is empty; lone surrogates, which UTF-8 cannot hold, become ``?``."""
    return (text or "").encode("utf-8", "replace").decode("utf-8")
