"""Suffix and common-prefix arrays by external induced sorting.

The suffixes that begin a rising run of symbols (S* suffixes) are named by sorting their substrings and ordered by recursion on the
string of names; below ``INTERNAL`` names that string is ordered in memory by doubling. All other suffixes are induced: a queue
holds tuples (key of the first symbol, place, common prefix with the tuple before it) and gives them up in order; each tuple taken puts
the suffix one symbol to the left into the queue. Descending suffixes are induced from the ordered S* suffixes, ascending ones from the
descending ones in the opposite direction.

Keys have two halves, induced suffixes before the seeds of the same symbol, and within a key the queue is first in, first out, as the order
of insertion is the order of the suffixes. The queue is cut in ranges of keys; ranges not yet reached are appended to files once the
memory for them is used up. Tuples leave it in batches: a batch ends before the first key greater than a key that the batch itself
inserts, so that all of a batch can be handled by array operations. The common prefix of two neighbours in a bucket is one more than the
least common prefix among the tuples taken between the two that induced them, and is carried up to ``limit``.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Strings of names up to this length are ordered in memory.
INTERNAL = 4_000_000
#: Tuples in a batch at most, tuples in a range of keys, and bytes that waiting tuples may hold in memory. A shard of a few MB already has
#: more, so that the queues of every shard go through files.
BATCH, RANGE, WAITING_BYTES = 1 << 16, 1 << 15, 4 << 20
#: Results of more symbols than this are kept in files that are looked at in place.
RESIDENT = 1 << 24
_TUPLE = np.dtype([("key", np.int32), ("place", np.int32), ("lcp", np.int32)])
_LONG_TUPLE = np.dtype([("key", np.int64), ("place", np.int64), ("lcp", np.int32)])
_FAR = np.iinfo(np.int32).max


def _stable_order(values: np.ndarray, top: int) -> np.ndarray:
    """Stable sorting order of numbers below ``top``; few enough are sorted by digits."""
    return np.argsort(values.astype(np.uint16) if top <= 1 << 16 else values, kind="stable")


class Spool:
    """An append-only array that moves to a file of the folder when asked."""

    def __init__(self, folder: str, dtype: np.dtype):
        self.folder, self.dtype, self.held, self.file, self.bytes = folder, np.dtype(dtype), [], None, 0

    def append(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.bytes += values.nbytes

    def spill(self) -> int:
        """Move what is in memory to the file; gives the bytes freed."""
        if self.file is None:
            handle, self.file = tempfile.mkstemp(dir=self.folder)
            os.close(handle)
        with open(self.file, "ab") as f:
            for values in self.held:
                f.write(np.ascontiguousarray(values).data)
        freed, self.held, self.bytes = self.bytes, [], 0
        return freed

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        if self.held:
            self.spill()
        return np.memmap(self.file, self.dtype, "r") if os.path.getsize(self.file) else np.empty(0, self.dtype)

    def close(self) -> None:
        self.held = []
        if self.file is not None:
            os.unlink(self.file)
            self.file = None


class InductionQueue:
    """The disk-backed priority queue: tuples by key, first in first out within a key."""

    def __init__(self, folder: str, per_key: np.ndarray, kind: np.dtype):
        """``kind``: the type of a tuple. ``per_key``: how many tuples each key will get in all, from which the ranges are cut."""
        filled, self.keys = np.cumsum(per_key), len(per_key)
        wanted = np.searchsorted(filled, np.arange(RANGE, filled[-1] + RANGE, RANGE)) if len(filled) else np.empty(0, np.int64)
        self.ends = np.unique(np.append(np.minimum(wanted, len(per_key) - 1), len(per_key) - 1))
        self.waiting = [Spool(folder, kind) for _ in self.ends]
        self.now, self.front, self.at, self.bytes = -1, np.empty(0, kind), 0, 0

    def push(self, tuples: np.ndarray) -> None:
        """Add tuples with ascending keys; within a key they are in the order of their suffixes."""
        own = int(np.searchsorted(tuples["key"], self.ends[self.now], side="right")) if self.now >= 0 else 0
        if own:
            rest = np.concatenate([self.front[self.at :], tuples[:own]])
            self.front, self.at = rest[_stable_order(rest["key"], self.keys)], 0
        at = own
        while at < len(tuples):
            of = int(np.searchsorted(self.ends, tuples["key"][at]))
            end = int(np.searchsorted(tuples["key"], self.ends[of], side="right"))
            self.waiting[of].append(tuples[at:end].copy())
            self.bytes += tuples[at:end].nbytes
            at = end
        if self.bytes > WAITING_BYTES:
            for spool in self.waiting:
                if spool.bytes > 4096:
                    self.bytes -= spool.spill()

    def peek(self) -> np.ndarray:
        """Up to BATCH least tuples; empty when none is left."""
        while self.at >= len(self.front) and self.now + 1 < len(self.ends):
            self.now += 1
            spool = self.waiting[self.now]
            self.bytes -= spool.bytes
            found = spool.array()
            single = self.now and self.ends[self.now] == self.ends[self.now - 1] + 1 or self.ends[self.now] == 0
            self.front, self.at = (found if single else found[_stable_order(found["key"], self.keys)]), 0
        return self.front[self.at : self.at + BATCH]

    def take(self, n: int) -> None:
        self.at += n

    def close(self) -> None:
        for spool in self.waiting:
            spool.close()


class RangeMinimum:
    """Least values of stretches of one batch, by doubling."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (1 << (len(self.levels) - 1)):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of values first..end-1, first < end."""
        level = np.frexp((end - first).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            values = self.levels[k]
            out[own] = np.minimum(values[first[own]], values[end[own] - (1 << k)])
        return out


def _rising(text: np.ndarray) -> np.ndarray:
    """For each place, whether its suffix is less than the next one. The last symbol is the least and counts as rising."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    up = text[change] < text[change + 1]
    ends = np.append(change, n - 1)
    return np.repeat(np.append(up, True), np.diff(np.concatenate([[-1], ends])))


def _run_lengths(text: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """How often the symbol at each place is repeated from there on, up to the limit."""
    length = np.ones(len(places), np.int64)
    active = np.arange(len(places))
    while len(active):
        at = places[active] + length[active]
        on = (at < len(text)) & (length[active] < limit)
        on[on] = text[at[on]] == text[places[active][on]]
        active = active[on]
        length[active] += 1
    return length


def induce(text: np.ndarray, alphabet: int, seeds: np.ndarray, seed_lcp: np.ndarray, descending: bool, per_symbol: np.ndarray, limit: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and common prefixes of all induced suffixes, in the order in which they are taken.

    Ascending scan (``descending`` false): seeds are the S* suffixes, what is induced are the suffixes that exceed the next one. In the
    opposite scan, symbols count from the greatest. ``per_symbol``: how many suffixes will be induced for each symbol.
    """
    mirror = (lambda s: alphabet - 1 - s) if descending else (lambda s: s)
    seed_symbols = mirror(text[seeds].astype(np.int64))
    per_key = np.zeros(2 * alphabet, np.int64)
    per_key[0::2] = per_symbol[::-1] if descending else per_symbol
    per_key[1::2] = np.bincount(seed_symbols, minlength=alphabet)
    kind = _TUPLE if len(text) < 1 << 30 else _LONG_TUPLE
    queue = InductionQueue(folder, per_key, kind)
    for a in range(0, len(seeds), BATCH):
        made = np.empty(len(seeds[a : a + BATCH]), kind)
        made["key"], made["place"], made["lcp"] = 2 * seed_symbols[a : a + BATCH] + 1, seeds[a : a + BATCH], seed_lcp[a : a + BATCH]
        queue.push(made)
    places, prefixes = Spool(folder, np.int64), Spool(folder, np.int32)
    since = np.full(alphabet, _FAR, np.int32)  # least prefix after the last tuple that induced the symbol, in its batch
    batch_of = np.full(alphabet, -1, np.int64)
    minima, batches = np.empty(1024, np.int32), 0  # least prefix from each batch on
    last_key, last_place, kept = -1, -1, 0
    while len(batch := queue.peek()):
        key, place = batch["key"].astype(np.int64), batch["place"].astype(np.int64)
        symbol = key >> 1
        left = mirror(text[np.maximum(place - 1, 0)].astype(np.int64))
        goes = (place > 0) & ((left > symbol) | ((left == symbol) & (key & 1 == 0)))
        reach = np.minimum.accumulate(np.where(goes, 2 * left, np.iinfo(np.int64).max))
        cut = int(np.argmax(key[1:] > reach[:-1])) + 1 if len(key) > 1 and (key[1:] > reach[:-1]).any() else len(key)
        batch, key, place, symbol, left, goes = batch[:cut], key[:cut], place[:cut], symbol[:cut], left[:cut], goes[:cut]
        lcp = batch["lcp"].copy()
        before = np.concatenate([[last_key], key[:-1]])
        lcp[(before != key) & (before >> 1 != symbol)] = 0
        if len(turn := np.flatnonzero((before != key) & (before >> 1 == symbol))):
            prior = np.concatenate([[last_place], place[:-1]])[turn]
            lcp[turn] = np.minimum(_run_lengths(text, prior, limit), _run_lengths(text, place[turn], limit))
        own = key & 1 == 0
        places.append(place[own].copy())
        prefixes.append(lcp[own])
        kept += int(own.sum()) * 12
        if kept > WAITING_BYTES:
            kept = 0
            places.spill()
            prefixes.spill()
        who = np.flatnonzero(goes)
        if len(who):
            order = who[_stable_order(left[who], alphabet)]
            target = left[order]
            new = np.concatenate([[True], target[1:] != target[:-1]])
            made = np.empty(len(order), kind)
            made["key"], made["place"] = 2 * target, place[order] - 1
            minimum = RangeMinimum(lcp)
            between = np.empty(len(order), np.int32)
            again = np.flatnonzero(~new)
            between[again] = minimum.least(order[again - 1] + 1, order[again] + 1)
            first = np.flatnonzero(new)
            ahead = minimum.least(np.zeros(len(first), np.int64), order[first] + 1)
            met = batch_of[target[first]]
            gap = np.where(met + 1 < batches, minima[np.minimum(met + 1, max(batches - 1, 0))], _FAR) if batches else np.full(len(first), _FAR, np.int32)
            between[first] = np.where(met >= 0, np.minimum(np.minimum(ahead, since[target[first]]), gap), -1)
            made["lcp"] = np.minimum(between + 1, limit)
            final = np.append(first[1:], len(order)) - 1
            tail = order[final] + 1
            rest = np.full(len(final), _FAR, np.int32)
            if (inside := tail < len(lcp)).any():
                rest[inside] = minimum.least(tail[inside], np.full(int(inside.sum()), len(lcp)))
            since[target[final]], batch_of[target[final]] = rest, batches
        if batches == len(minima):
            minima = np.concatenate([minima, np.empty(batches, np.int32)])
        least = lcp.min()
        minima[batches] = least
        np.minimum(minima[:batches], least, out=minima[:batches])
        batches += 1
        last_key, last_place = int(key[-1]), int(place[-1])
        queue.take(cut)
        if len(who):
            queue.push(made)
    queue.close()
    out = places.array(), prefixes.array()
    if len(text) <= RESIDENT and isinstance(out[0], np.memmap):
        out = np.array(out[0]), np.array(out[1])
    # A file without a name stays as long as it is looked at.
    places.close()
    prefixes.close()
    return out


def _results(n: int, kind: type, folder: str) -> np.ndarray:
    """Zeros, in a file without a name if there are many."""
    if n <= RESIDENT:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(n,))


def _names(text: np.ndarray, rising: np.ndarray, starts: np.ndarray, alphabet: int) -> tuple[np.ndarray, int]:
    """Ranks of the S* substrings, equal for equal ones, and their number. Symbols carry their type, which orders a suffix that goes on falling before one that ends."""
    bits = int(2 * alphabet + 1).bit_length()
    per = 64 // bits
    lengths = np.append(np.diff(starts) + 1, 1)
    coded = (2 * text.astype(np.uint64)) + rising.astype(np.uint64) + np.uint64(1)

    def word(who: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(who), np.uint64)
        for k in range(per):
            out <<= np.uint64(bits)
            inside = at + k < lengths[who]
            out[inside] |= coded[starts[who[inside]] + at + k]
        return out

    who, at = np.arange(len(starts)), 0
    name = np.zeros(len(starts), np.int64)
    while len(who):
        values = word(who, at)
        order = np.lexsort((values, name[who])) if at else np.argsort(values, kind="stable")
        group, values = name[who][order], values[order]
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        differs = fresh | np.concatenate([[True], values[1:] != values[:-1]])
        place = np.arange(len(order))
        begin = np.maximum.accumulate(np.where(fresh, place, 0))
        ranked = group + np.maximum.accumulate(np.where(differs, place, 0)) - begin
        name[who[order]] = ranked
        alone = differs & np.concatenate([differs[1:], [True]])
        at += per
        left = order[~alone]
        who = who[left]
        who = who[lengths[who] > at]
    present = np.zeros(len(starts) + 1, np.int64)
    present[name] = 1
    dense = np.cumsum(present) - 1
    return dense[name], int(present.sum())


def _doubled(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of ranks and their common prefixes, both up to ``depth`` symbols, in memory."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranks = [text.astype(np.int32)]
    current = np.empty(n, np.int64)
    sorted_text = text[order]
    starts = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    current[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    step = 1
    while step < depth:
        ranks[-1] = current.astype(np.int32)
        alone = starts & np.append(starts[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        who = order[open_]
        ahead = np.where(who + step < n, current[np.minimum(who + step, n - 1)] + 1, 0)
        sub = np.argsort((current[who] << 32) | ahead, kind="stable")
        order[open_] = who = who[sub]
        ahead, group = ahead[sub], current[who]
        differs = np.concatenate([[True], (ahead[1:] != ahead[:-1]) | (group[1:] != group[:-1])])
        starts[open_] = differs
        fresh = current.copy()
        fresh[who] = open_[np.maximum.accumulate(np.where(differs, np.arange(len(who)), 0))]
        current = fresh
        ranks.append(current.astype(np.int32))
        step *= 2
    ranks[-1] = current.astype(np.int32)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n, np.int64)
    shared = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        fits = (x < n) & (y < n)
        same = np.zeros(len(fits), bool)
        same[fits] = ranks[k][x[fits]] == ranks[k][y[fits]]
        shared[same] += 1 << k
    lcp[1:] = shared
    return order, lcp


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, symbol by symbol, up to the limit."""
    shared = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    n = len(text)
    while len(active):
        x, y = a[active] + shared[active], b[active] + shared[active]
        on = (x < n) & (y < n) & (shared[active] < limit)
        on[on] = text[x[on]] == text[y[on]]
        active = active[on]
        shared[active] += 1
    return shared


def suffix_arrays(text: np.ndarray, alphabet: int, limit: int, folder: str, internal: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order and the common prefix of each with the one before it, both by the first ``limit`` symbols at least.

    The last symbol is 0 and occurs nowhere else; all symbols are below ``alphabet``.
    """
    n = len(text)
    internal = INTERNAL if internal is None else internal
    if n <= 2:
        return np.arange(n)[::-1].copy(), np.zeros(n, np.int64)
    rising = _rising(text)
    starts = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    name, count = _names(text, rising, starts, alphabet)
    if count == len(starts):
        order, shared = np.argsort(name), np.zeros(len(starts), np.int64)
    elif len(starts) <= internal:
        order, shared = _doubled(name, limit // 2 + 2)
    else:
        order, shared = suffix_arrays(name.astype(np.int32), count, limit // 2 + 2, folder, internal)
    seeds = starts[order]
    seed_lcp = np.zeros(len(seeds), np.int32)
    if len(seeds) > 1:
        a, b, l = order[:-1], order[1:], shared[1:]
        l = np.minimum(l, len(starts) - 1 - np.maximum(a, b))
        whole = starts[a + l] - starts[a]
        near = whole < limit
        rest = np.zeros(len(a), np.int64)
        rest[near] = _prefixes(text, starts[a + l][near], starts[b + l][near], limit)
        seed_lcp[1:] = np.minimum(whole + rest, limit)
    symbols = np.bincount(text, minlength=alphabet)
    falling = np.bincount(text[~rising], minlength=alphabet)
    down, down_lcp = induce(text, alphabet, seeds, seed_lcp, False, falling, limit, folder)
    back = down[::-1].copy()
    back_lcp = np.zeros(len(back), np.int32)
    back_lcp[1:] = down_lcp[::-1][:-1]
    up, up_lcp = induce(text, alphabet, back, back_lcp, True, symbols - falling, limit, folder)
    # Rising suffixes came greatest first. Of each symbol the falling ones come first.
    up = np.append(up, n - 1)[::-1] if not len(up) or up[-1] != n - 1 else up[::-1]
    ordered_up_lcp = np.zeros(len(up), np.int64)
    gap = len(up) - len(up_lcp)
    ordered_up_lcp[1 + gap :] = up_lcp[::-1][: len(up) - 1 - gap] if len(up) > 1 + gap else 0
    order, lcp = _results(n, np.int64, folder), _results(n, np.int32, folder)
    begin = np.cumsum(symbols) - symbols
    low = text[down].astype(np.int64)
    rank = np.arange(len(down)) - (np.cumsum(falling) - falling)[low]
    order[begin[low] + rank], lcp[begin[low] + rank] = down, down_lcp
    rise = symbols - falling
    high = text[up].astype(np.int64)
    rank = np.arange(len(up)) - (np.cumsum(rise) - rise)[high]
    place = begin[high] + falling[high] + rank
    order[place], lcp[place] = up, ordered_up_lcp
    turn = np.flatnonzero((falling > 0) & (rise > 0))
    at = begin[turn] + falling[turn]
    lcp[at] = np.minimum(_run_lengths(text, order[at - 1], limit), _run_lengths(text, order[at], limit))
    lcp[begin[symbols > 0]] = 0
    np.minimum(lcp, limit, out=lcp)
    return order, lcp
