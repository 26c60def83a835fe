"""Suffix arrays by induced sorting, with runs of whole buckets induced at a time, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor (S); the last is S."""
    differs = np.flatnonzero(s[:-1] != s[1:])
    small = np.ones(len(s), dtype=bool)
    if len(differs):
        # Equal neighbours take the type of the next place that differs.
        small[: differs[-1] + 1] = np.repeat(s[differs] < s[differs + 1], np.diff(np.r_[-1, differs]))
    return small


def leftmost_small(small: np.ndarray) -> np.ndarray:
    """Places of S suffixes after an L suffix."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _ranks(symbols: np.ndarray) -> np.ndarray:
    """Of symbols in order, each one's number in its run of equal ones."""
    edge = np.empty(len(symbols), dtype=bool)
    edge[:1] = True
    np.not_equal(symbols[1:], symbols[:-1], out=edge[1:])
    return np.arange(len(symbols)) - edge.nonzero()[0][edge.cumsum() - 1]


def _scan(out: np.ndarray, s: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> None:
    """Goes up the slots of `out`; each suffix in them puts the one before it, if that is `wanted`, to the next place of its bucket.

    Free slots hold -1. Suffixes are put into their own or a later bucket. Neighbouring buckets that put nothing into each
    other are complete once the first is reached, so they go in one batch; a bucket that puts into itself goes alone, and
    what it gets so is its next batch. In a text of many symbols few of a batch's buckets meet, so there are about as many
    batches as the root of its length.
    """

    def put(before: np.ndarray, at: np.ndarray) -> None:
        order = at.argsort(kind="stable")
        at = at[order]
        to = place[at] + _ranks(at)
        out[to] = before[order]
        place[at] = to + 1  # of a run, its last counts

    def all_of(batch: np.ndarray) -> None:
        if len(batch) < 16:  # runs of one symbol come one by one
            for i in batch.tolist():
                if i > 0 and wanted[i - 1]:
                    c = s[i - 1]
                    out[place[c]] = i - 1
                    place[c] += 1
            return
        before = batch[batch > 0] - 1
        before = before[wanted[before]]
        if len(before):
            put(before, s[before])

    n, at, look = len(out), 0, 1024
    while at < n:
        bucket = int(ends.searchsorted(at, side="right"))  # the first one that ends later
        if ends[bucket] - at < look:
            slots = out[at : at + look]
            live = (slots > 0).nonzero()[0]
            before = slots[live] - 1
            kept = wanted[before].nonzero()[0]
            live, before = live[kept], before[kept]
            symbol = s[before]
            last = int(ends.searchsorted(at + len(slots), side="right"))  # buckets before it end within the slots
            size = ends[bucket:last] - at
            upto = live.searchsorted(size)  # how many of `before` stand in the buckets up to each
            lowest = np.minimum.accumulate(symbol)
            fits = ((upto == 0) | (lowest[np.maximum(upto, 1) - 1] > np.arange(bucket, last))).nonzero()[0] if len(symbol) else np.arange(last - bucket)
            if len(fits):
                took, count = int(size[fits[-1]]), int(upto[fits[-1]])
                if count:
                    put(before[:count], symbol[:count])
                at += took
                look = min(1 << 17, 2 * look) if took > look // 2 else max(256, look // 2) if took < look // 8 else look
                continue
        while at < place[bucket]:
            upto = int(place[bucket])
            all_of(out[at:upto])
            at = upto
        all_of(out[at : ends[bucket]])
        at = int(ends[bucket])


def induce(s: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost small suffixes: L suffixes going up, S suffixes going down."""
    n, counts = len(s), np.bincount(s, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(n, -1, dtype=np.int64)
    symbol = s[sorted_lms]
    seeds = ends[symbol] - np.bincount(symbol, minlength=symbols)[symbol] + _ranks(symbol)  # at the back of their buckets
    out[seeds] = sorted_lms
    heads = starts.copy()
    _scan(out, s, starts, ends, heads, ~small)
    out[seeds] = -1
    # The same in the mirror: buckets, slots and symbols counted from the other end.
    mirrored, down, tails = out[::-1], (symbols - 1 - s.astype(np.int64)).astype(s.dtype), n - ends[::-1]
    mirrored[tails[symbols - 1 - int(s[-1])]] = n - 1  # the sentinel
    tails[symbols - 1 - int(s[-1])] += 1
    _scan(mirrored, down, n - ends[::-1], n - starts[::-1], tails, small)
    return out


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost small substrings in text order, equal for equal ones; and how many there are."""
    length = np.zeros(len(s), dtype=np.int64)
    length[lms] = np.diff(np.r_[lms, len(s) - 1]) + 1
    length[lms[-1]] = 1  # the sentinel stands alone
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    pairs, k = np.flatnonzero(same), 0
    while len(pairs):
        x, y = a[pairs], b[pairs]
        differ = s[x + k] != s[y + k]
        same[pairs[differ]] = False
        k += 1
        pairs = pairs[~differ & (length[x] > k)]
    name = np.zeros(len(s), dtype=np.int64)
    name[order] = np.cumsum(np.r_[0, ~same])
    return name[lms], int(name[order[-1]]) + 1


def _by_names(names: np.ndarray, n: int) -> np.ndarray:
    """The order of the suffixes of a text of names, by recursion.

    A suffix is told from all others where a name comes that stands nowhere else, so only the other names, each with what
    follows it up to such a name, need to be sorted.
    """
    counts = np.bincount(names, minlength=n)
    alone = counts[names] == 1
    kept = ~alone
    kept[1:] |= ~alone[:-1]
    kept[-1] = True
    if 10 * int(kept.sum()) > 9 * len(names):
        return suffix_array(names, n)
    at = kept.nonzero()[0]
    used = np.zeros(n, dtype=np.int32)
    used[names[at]] = 1
    fewer = used.cumsum(dtype=np.int32) - 1
    order = at[suffix_array(fewer[names[at]], int(fewer[-1]) + 1)]
    order = order[~alone[order]]
    starts = counts.cumsum() - counts
    out = np.empty(len(names), dtype=np.int64)
    single = alone.nonzero()[0]
    out[starts[names[single]]] = single
    if len(order):
        name = names[order]
        out[starts[name] + _ranks(name)] = order
    return out


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes of s in order.

    s: integers below `symbols`, the last a zero that stands nowhere else. Leftmost small substrings are sorted by
    inducing and get names; the text of names, half as long at most, is sorted the same way, until names are distinct.
    """
    if len(s) == 1:
        return np.zeros(1, dtype=np.int64)
    small = suffix_types(s)
    lms = leftmost_small(small)
    by_first = lms[np.argsort(s[lms], kind="stable")]
    is_lms = np.zeros(len(s), dtype=bool)
    is_lms[lms] = True
    rough = induce(s, small, by_first, symbols)
    order = rough[is_lms[rough]]
    names, n = _names(s, order, lms)
    if n < len(lms):
        order = lms[_by_names(names.astype(np.int32), n)]
    return induce(s, small, order, symbols)


def permuted_prefixes(text: np.ndarray, suffixes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """In text order of the given suffixes (whose ranks come second): how many bytes each shares with the one before it in the array, at most `cap`.

    text: bytes with at least cap + 8 more behind the last suffix. Eight bytes are compared at a time.
    """
    by_place = np.argsort(suffixes, kind="stable")
    place = suffixes[by_place]
    previous = np.r_[-1, suffixes[:-1]][by_place]
    words = np.ndarray((len(text) - 7,), dtype="<u8", buffer=text, strides=(1,))
    shared = np.zeros(len(suffixes), dtype=np.int64)
    live = np.flatnonzero(previous >= 0)
    for at in range(0, cap, 8):
        x = words[place[live] + at] ^ words[previous[live] + at]
        # Zero bytes at the low end are equal bytes at the front.
        shared[live] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8
        live = live[x == 0]
    return np.minimum(shared, cap), by_place
