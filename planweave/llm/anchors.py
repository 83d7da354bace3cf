"""Cutting byte strings by the least hash of every window, so that equal windows meet wherever they stand.

A window of ``WINDOW`` bytes is known by the least hash of its ``GRAM``-byte pieces. Equal windows have equal least hashes, and neighbouring
windows mostly share theirs: a run of window starts with one least hash makes a passage, which is the bytes of all its windows.

Shorter repeats are only told, by marks: of every ``SPREAD`` neighbouring places that with the least hash is a mark, known by the hash of its next
``MARK`` bytes. Two equal strings of ``MARK + SPREAD - 1`` bytes have a mark in common, unless a piece comes twice in ``SPREAD`` places.
"""

from __future__ import annotations

import numpy as np

from planweave.llm.shingles import BASE, _letters, _powers_upto, mixed

WINDOW, GRAM = 400, 32
MARK, SPREAD = 150, 150


def _sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letters()[data] * _powers_upto(BASE, len(data))[:-1], dtype=np.uint64)])


def _gram_hashes(sums: np.ndarray) -> np.ndarray:
    n = len(sums) - GRAM
    return mixed((sums[GRAM:] - sums[:-GRAM]) * _powers_upto(pow(BASE, -1, 1 << 64), n)[:n])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all pieces of GRAM bytes."""
    return _gram_hashes(_sums(data))


def _marks(sums: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Different marks of one string, from its sums and the hashes of its pieces. The low byte of a hash is replaced by its place, which the
    least of a window so gives away."""
    n = len(sums) - MARK
    width = min(SPREAD, n)
    placed = (hashes[:n] & ~np.uint64(0xFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFF))
    least = sliding_least(placed, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    at = first + (((least[first] & np.uint64(0xFF)).astype(np.int64) - first) & 0xFF)
    return np.unique(mixed((sums[at + MARK] - sums[at]) * _powers_upto(pow(BASE, -1, 1 << 64), n)[at]))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values: of each block the minima from its start and to its end, combined."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _occurrences(hashes: np.ndarray, keys: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each key is among hashes[first:end]. A table of low bits leaves few places to look at."""
    table = np.zeros(1 << 16, bool)
    table[keys & np.uint64(0xFFFF)] = True
    place = np.flatnonzero(table[hashes & np.uint64(0xFFFF)])
    known, number = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, hashes[place]), len(known) - 1)
    real = known[at] == hashes[place]
    wide = len(hashes) + 1
    found = np.sort(at[real] * wide + place[real])
    return np.searchsorted(found, number * wide + end) - np.searchsorted(found, number * wide + first)


#: Turns the hashes of pieces into those of another, independent order.
_SECOND = np.uint64(0x5851F42D4C957F2D)


def parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``passages`` in another order of the pieces: key, first window start and number of window starts of runs of windows. Equal windows
    have equal keys here too, so passages that share one key can be cut anew by the other."""
    least = sliding_least(mixed(gram_hashes(data) ^ _SECOND), WINDOW - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.concatenate([first, [len(least)]]))


def passages(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each passage of one string: least hash, first window start, number of window starts, and whether the piece with that hash comes
    more than once in it, without which it has no two equal windows. Then the marks of the string."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    if len(data) < MARK:
        return *none, np.empty(0, np.uint64)
    sums = _sums(data)
    hashes, width = _gram_hashes(sums), WINDOW - GRAM + 1
    marks = _marks(sums, hashes)
    if len(data) < WINDOW:
        return *none, marks
    least = sliding_least(hashes, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [len(least)]]))
    return least[first], first, count, _occurrences(hashes, least[first], first, first + count + width - 1) > 1, marks
