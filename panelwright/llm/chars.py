"""Vectorised text primitives on code point arrays (NumPy, inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_CLASSED = 0x20000          # code points with tables; the rest count as word characters
_K = np.uint64(0x9E3779B97F4A7C15)
_K_INV = np.uint64(pow(int(_K), -1, 1 << 64))
OTHER, WORD, SPACE = 0, 1, 2


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (if that is one character), its class."""
    lower = np.arange(_CLASSED, dtype=np.uint32)
    kind = np.zeros(_CLASSED, dtype=np.uint8)
    for cp in range(_CLASSED):
        c = chr(cp)
        low = c.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
        kind[cp] = WORD if c.isalnum() or c == "_" else SPACE if c.isspace() else OTHER
    return lower, kind


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def lowered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points and their classes."""
    lower, kind = tables()
    inside = np.minimum(codes, _CLASSED - 1)
    k = kind[inside]
    low = lower[inside]
    if len(codes) and int(codes.max()) >= _CLASSED:
        far = codes >= _CLASSED
        low[far] = codes[far]
        k[far] = WORD
    return low, k


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _K)]).astype(np.uint64))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _K_INV)]).astype(np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of letters, digits, "_")
    of all texts in order, and the number of words of each text."""
    codes = code_points("\n".join(texts))
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    low, kind = lowered(codes)
    inside = np.concatenate([[False], kind == WORD, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _POWERS.upto(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up)])
    h = mix((total[ends] - total[starts]) * down[starts])
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, at))


def text_blocks(texts: list[str], chars: int = 500_000):
    """Cut a list of texts into slices of about ``chars`` characters: (lo, hi)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
