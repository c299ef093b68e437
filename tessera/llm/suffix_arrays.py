"""Suffix arrays, common prefixes and window classes of one block of bytes, in numpy."""

from __future__ import annotations

import numpy as np

#: bytes that the first sort looks at, and the bits of one (a byte plus one; 0 is past the end)
FIRST, DIGIT = 4, 9
#: bits of a position or a rank
PLACE = 21


def _ranks(order_key: np.ndarray) -> np.ndarray:
    """Rank of each sorted key's group: the index of the group's first member."""
    first = np.empty(len(order_key), bool)
    first[0] = True
    np.not_equal(order_key[1:], order_key[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return np.repeat(at, np.diff(np.append(at, len(order_key))))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions in suffix order.

    Larsson-Sadakane refinement: suffixes are sorted by their first bytes; then only the
    groups that are still unsorted are sorted again by the rank of the suffix that starts as
    many bytes further on as are sorted already, which doubles that number each round. One
    sort moves (rank, rank further on, position) packed into a 64-bit number, so a text has
    fewer than 2**21 bytes. Past its end a text goes on with a digit below all others.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    if n >= (1 << PLACE) - 1:
        raise ValueError(f"a block holds fewer than 2**{PLACE} - 1 bytes")
    place = np.uint64(PLACE)
    mask = np.uint64((1 << PLACE) - 1)
    digits = np.zeros(n + FIRST, np.uint64)
    digits[:n] = text
    digits[:n] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for k in range(FIRST):
        key = key << np.uint64(DIGIT) | digits[k:k + n]
    packed = np.sort(key << place | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    group = _ranks(packed >> place)  # rank of the group, by place in the order
    rank = np.empty(n, np.int64)
    rank[order] = group
    done = FIRST
    while True:
        open_ = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        start = order[at]
        # a suffix without further bytes is smaller than all others of its group
        further = np.where(start + done < n, rank[np.minimum(start + done, n - 1)] + 1, 0)
        packed = np.sort(group[at].astype(np.uint64) << (place + place) | further.astype(np.uint64) << place | start.astype(np.uint64))
        # a group's members keep its places among themselves
        order[at] = (packed & mask).astype(np.int64)
        first = np.empty(len(at), bool)
        first[0] = True
        np.not_equal(packed[1:] >> place, packed[:-1] >> place, out=first[1:])
        heads = np.flatnonzero(first)
        group[at] = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
        rank[order[at]] = group[at]
        done *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """For each suffix in order, the bytes it shares with the one before it (at most ``cap``).

    Kasai's rule - a suffix shares at least one byte less with its neighbour than the suffix
    one position earlier shares with its own - is followed along many stretches of the text
    at once: each stretch of ``lane`` positions is a lane, and all lanes step together,
    comparing eight bytes at a time.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.zeros(n + cap + 16, np.uint8)
    padded[:n] = text
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for step in range(min(lane, n)):
        at = starts + step
        inside = at < n
        if not inside.all():
            starts, h, at = starts[inside], h[inside], at[inside]
        other = before[at]
        h = np.maximum(h - 1, 0)
        h[other < 0] = 0
        # both suffixes end at the text's end: neither shares bytes beyond it
        most = np.minimum(cap, n - np.maximum(at, other))
        todo = np.flatnonzero((other >= 0) & (h < most))
        while len(todo):
            differ = eight[at[todo] + h[todo]] ^ eight[other[todo] + h[todo]]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
            h[todo] += equal
            todo = todo[(equal == 8) & (h[todo] < most[todo])]
        h = np.minimum(h, most)
        h[other < 0] = 0
        shared[at] = h
    out[:] = shared[order]
    return out


def window_classes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple:
    """``(starts in suffix order, class of each)``: windows of ``length`` bytes at ``starts``
    have the same class exactly if they hold the same bytes. No window may pass the end."""
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    group = np.cumsum(shared < length)  # a new class wherever fewer bytes are shared
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    keep = wanted[order]
    group = group[keep]
    classes = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group
    return order[keep], classes
