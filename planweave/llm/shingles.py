"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z in lower case. All words of a batch are hashed
together: a polynomial in an odd base, modulo 2^64, of which any stretch follows from two prefix sums and a power of the base's inverse.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random odd number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers_upto(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n. The longest array asked for stays; each doubling of it is one multiplication."""
    out = _POWERS.setdefault(base, np.ones(1, np.uint64))
    while len(out) <= n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = _POWERS[base] = np.concatenate([out, out * step])
    return out[: n + 1]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text the place of its first word, with the total at the end."""
    raw = [(t or "").encode().lower() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white])))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[data] * _powers_upto(BASE, len(data))[:-1], dtype=np.uint64)])
    inverse = _powers_upto(pow(BASE, -1, 1 << 64), len(data))
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending. A text with fewer words has all of them as one shingle; without words, none."""
    hashes, first = words(texts)
    multipliers = mixed(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    whole = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        whole[: n - k] += hashes[k:] * multipliers[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            terms = np.append(hashes[a:b] * multipliers[: b - a], np.uint64(b - a))
            out.append(mixed(np.cumsum(terms, dtype=np.uint64)[-1:]))
        else:
            out.append(np.empty(0, np.uint64))
    return out
