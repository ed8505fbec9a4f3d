"""Where the pieces of the public byte-level pattern begin, computed on arrays of code points.

The pattern (``public_tokenizers.PATTERN``) splits a text completely: contractions, runs of
letters, digits or other signs with at most one space before them, and white space, whose last
character stays with what follows. The classes come from the ``regex`` module, so no rule is
applied per match.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
_WHITE = r"[\t-\r \x85\xa0  -     　]"   # Unicode White_Space
_PAIRS = {("r", "e"), ("v", "e"), ("l", "l")}


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, f"{_WHITE}+")):
        for m in regex.finditer(pattern, every):
            a, b = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            out[a:b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Positions where the matches begin, for a text that is read from its start."""
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = char_classes()[points]
    start = np.ones(n, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    white = kind == SPACE
    # a white-space character before something else: the run ends before it ...
    last = np.flatnonzero(white[:-1] & ~white[1:])
    start[last] = True
    # ... and a plain space belongs to what follows
    start[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero(points[:-1] == 0x27)
    if quote.size:
        for i in quote[start[quote] & (kind[quote + 1] == LETTER)].tolist():
            a = chr(points[i + 1])
            long = 1 if a in "stmd" else 2 if i + 2 < n and (a, chr(points[i + 2])) in _PAIRS else 0
            if long:
                start[i + 1] = False
                if i + 1 + long < n:
                    start[i + 1 + long] = True
    return np.flatnonzero(start)
