"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement, Kasai common prefixes, search and merging."""

from __future__ import annotations

import numpy as np

#: Parts of one shard end with this byte, which UTF-8 never uses.
BETWEEN = 0xFF
PLACE_BITS = 21
#: Bytes that one suffix array holds at most.
MOST = (1 << PLACE_BITS) - 1


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all parts with a separator after each, and where each part starts."""
    data = np.frombuffer(b"\xff".join([*parts, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    return data, np.cumsum(sizes) - sizes


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; past the end come zeros."""
    wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    two = (wide[:-1] << np.uint64(8)) | wide[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return ((four[:-4] << np.uint64(32)) | four[4:])[:len(data)]


def first_keys(data: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """The first bytes of every suffix as one number of at most ``room`` bits, in the order of the bytes, and how many they are."""
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    bits = max(1, len(seen).bit_length())
    codes = np.zeros(256, dtype=np.uint64)
    codes[seen] = np.arange(1, len(seen) + 1)
    reach = room // bits
    wide = np.concatenate([codes[data], np.zeros(reach, dtype=np.uint64)])
    keys = np.zeros(len(data), dtype=np.uint64)
    for k in range(reach):
        keys = (keys << np.uint64(bits)) | wide[k:len(data) + k]
    return keys, reach


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes or more, and the rank of each (that of the last of its equals).

    Larsson-Sadakane: groups of equal prefixes are refined by the rank of the
    suffix as far ahead as the prefix is long; suffixes that are alone in their
    group are never touched again. Up to ``MOST`` bytes, group, rank and place
    fit one number, so that a round is one sort of numbers.
    """
    n = len(data)
    if n > MOST:
        raise ValueError(f"a suffix array holds at most {MOST} bytes")
    place_bits = np.uint64(PLACE_BITS)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys, reach = first_keys(data, 63 - PLACE_BITS)
    keys = np.sort((keys << place_bits) | np.arange(n, dtype=np.uint64))
    order = (keys & mask).astype(np.int32)
    # Ranks from 1 on; past the end of the data stand zeros, which come before all.
    rank = np.zeros(n + depth, dtype=np.int32)
    rank[order] = _group_ends(keys >> place_bits) + 1
    places = np.arange(n, dtype=np.int32)
    while reach < depth:
        members = order[places]
        group = rank[members]
        same = group[1:] == group[:-1]
        shared = np.zeros(len(places), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        places, group, members = places[shared], group[shared], members[shared]
        if not len(places):
            break
        ahead = rank[members + np.int32(reach)]
        keys = np.sort((((group.astype(np.uint64) << place_bits) | ahead.astype(np.uint64)) << place_bits) | members.astype(np.uint64))
        members = (keys & mask).astype(np.int32)
        order[places] = members
        rank[members] = places[_group_ends(keys >> place_bits)] + 1
        reach *= 2
    return order, rank[:n] - 1


def _group_ends(keys: np.ndarray) -> np.ndarray:
    """For each place the last place with the same key, for sorted keys."""
    last = np.ones(len(keys), dtype=bool)
    last[:-1] = keys[1:] != keys[:-1]
    ends = np.flatnonzero(last)
    return np.repeat(ends, np.diff(np.append(-1, ends)))


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, most: int, places: np.ndarray | None = None) -> np.ndarray:
    """Kasai: bytes, up to ``most``, that each suffix in order shares with the one before.

    With ``places`` only the first so many suffixes of each part are looked
    at; the others get 0.

    A suffix shares at most one byte less than the one that starts a byte
    earlier did, if that one was told apart from its neighbour within the
    depth of the order; suffixes of one rank share ``most`` bytes anyway. The
    parts of a shard are taken in step, one byte further in each round, so that
    a round is one pass over arrays.
    """
    n = len(data)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    words = words_at(data)
    out = np.zeros(n, dtype=np.int32)
    sizes = np.diff(np.append(starts, n)) if places is None else places
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    known = np.zeros(len(starts), dtype=np.int64)
    live = len(starts)
    for step in range(int(sizes.max(initial=0))):
        while live and sizes[live - 1] <= step:
            live -= 1
        at = starts[:live] + step
        own = place[at]
        before = np.where(own > 0, order[own - 1], -1)
        equals = (before >= 0) & (rank[before] == rank[at])
        shared = np.where(equals, most, np.where(known[:live] == most, 0, np.maximum(known[:live] - 1, 0)))
        open_ = np.flatnonzero((before >= 0) & (shared < most))
        while len(open_):
            a, b = at[open_] + shared[open_], before[open_] + shared[open_]
            inside = (a < n) & (b < n)
            differ = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(1) << np.uint64(63))
            equal = np.where(differ == 0, 8, _leading_bytes(differ))
            equal = np.minimum(equal, n - np.maximum(a, b))
            shared[open_] += np.maximum(equal, 0)
            open_ = open_[(equal == 8) & (shared[open_] < most)]
        shared[before < 0] = 0
        known[:live] = np.minimum(shared, most)
        out[own] = known[:live]
    return out


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Zero bytes at the high end of numbers that are not 0."""
    out = np.zeros(len(differ), dtype=np.int64)
    for half in (4, 2, 1):
        small = differ < np.uint64(1) << np.uint64(64 - 8 * half)
        out += half * small
        differ = np.where(small, differ << np.uint64(8 * half), differ)
    return out


def compared(data: np.ndarray, words: np.ndarray, a: np.ndarray, other: np.ndarray, other_words: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1: how the ``length`` bytes at ``a`` compare with those at ``b`` of another shard, which may end before."""
    out = np.zeros(len(a), dtype=np.int8)
    open_ = np.arange(len(a))
    for k in range(0, length, 8):
        x, y = a[open_] + k, b[open_] + k
        left = np.where(x < len(data), words[np.minimum(x, len(data) - 1)], np.uint64(0))
        right = np.where(y < len(other), other_words[np.minimum(y, len(other) - 1)], np.uint64(0))
        if length - k < 8:
            drop = np.uint64(8 * (8 - (length - k)))
            left, right = left >> drop, right >> drop
        out[open_[left < right]] = -1
        out[open_[left > right]] = 1
        open_ = open_[left == right]
        if not len(open_):
            break
    return out


class Shard:
    """Windows of some parts, sorted through the shard's suffix array.

    ``counts`` says how often each part occurs. Windows are the first
    ``size - width + 1`` places of a part. ``repeated`` tells the windows whose
    bytes also start elsewhere, in the shard or in those merged with it.
    """

    def __init__(self, parts: list[bytes], counts: np.ndarray, width: int):
        self.width = width
        self.data, self.starts = joined(parts)
        self.words = words_at(self.data)
        sizes = np.diff(np.append(self.starts, len(self.data))) - 1
        self.windows = np.maximum(sizes - width + 1, 0)
        order, rank = suffix_array(self.data, width)
        # A suffix that is no window runs into a separator within ``width`` bytes, so it shares less with any window.
        shared = common_prefixes(self.data, order, rank, self.starts, width, self.windows)
        part = np.repeat(np.arange(len(parts)), sizes + 1)
        begins = (np.arange(len(self.data)) - self.starts[part]) < self.windows[part]
        group = np.cumsum(shared < width) - 1
        some = begins[order]
        self.order, group = order[some], group[some]
        names, first, self.group = np.unique(group, return_index=True, return_inverse=True)
        self.heads = self.order[first]
        self.repeated_group = np.bincount(self.group, weights=counts[part[self.order]], minlength=len(names)) > 1

    def merge(self, other: Shard) -> None:
        """Marks the windows that both shards hold, by binary search of one shard's windows among the other's."""
        if not len(self.heads) or not len(other.heads):
            return
        low, high = np.zeros(len(self.heads), dtype=np.int64), np.full(len(self.heads), len(other.heads))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            sign = compared(self.data, self.words, self.heads[open_], other.data, other.words, other.heads[middle], self.width)
            low[open_] = np.where(sign > 0, middle + 1, low[open_])
            high[open_] = np.where(sign > 0, high[open_], middle)
        inside = np.flatnonzero(low < len(other.heads))
        met = inside[compared(self.data, self.words, self.heads[inside], other.data, other.words, other.heads[low[inside]], self.width) == 0]
        self.repeated_group[met] = True
        other.repeated_group[low[met]] = True

    def repeated(self) -> list[np.ndarray]:
        """For every part, which of its windows are repeated."""
        flags = np.zeros(len(self.data), dtype=bool)
        flags[self.order] = self.repeated_group[self.group]
        return [flags[s:s + w] for s, w in zip(self.starts, self.windows, strict=True)]
