"""Suffix arrays of bytes by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller or larger than the next one; the leftmost smaller ones divide the text into substrings, which one
induced pass sorts and names. Where names repeat, the text of names, at most half as long, is sorted by naming pairs of names again and again.
A second induced pass makes the array from the sorted leftmost-smaller suffixes. A pass goes through the buckets of first bytes; all
suffixes of a bucket that wait for the same step are placed at once, so it is linear in the text.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last one is larger than the empty one that follows."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    up = np.zeros(n, bool)
    if len(change):
        grows = t[change + 1] > t[change]
        up[: change[-1] + 1] = np.repeat(grows, np.diff(np.concatenate([[-1], change])))
    return up


def _deal(sa: np.ndarray, place: np.ndarray, t: np.ndarray, found: list[np.ndarray], up: bool) -> None:
    """Put suffixes, in the order in which they were met, to the free ends of their buckets."""
    who = np.concatenate(found)
    if not len(who):
        return
    byte = t[who]
    order = np.argsort(byte, kind="stable")
    count = np.bincount(byte, minlength=256)
    within = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    base = np.repeat(place, count)
    sa[base + within if up else base - 1 - within] = who[order]
    place += count if up else -count


def _induced(t: np.ndarray, least: np.ndarray) -> np.ndarray:
    """All suffixes sorted, given the leftmost smaller ones in the order that is to be carried on, grouped by first byte."""
    n = len(t)
    size = np.bincount(t, minlength=256)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int32)
    heads, cut = begin.copy(), np.searchsorted(t[least], np.arange(257))
    sa[heads[t[n - 1]]] = n - 1
    heads[t[n - 1]] += 1
    present = np.flatnonzero(size).tolist()
    for b in present:
        done, onward = begin[b], []
        while done < heads[b]:
            who = sa[done : heads[b]]
            done = heads[b]
            before = who[who > 0] - 1
            byte = t[before]
            same = before[byte == b]
            onward.append(before[byte > b])
            sa[done : done + len(same)] = same
            heads[b] += len(same)
        who = least[cut[b] : cut[b + 1]]
        onward.append(who[who > 0] - 1)
        _deal(sa, heads, t, onward, True)
    tails = end.copy()
    for b in reversed(present):
        done, onward = end[b], []
        while tails[b] < done:
            who = sa[tails[b] : done][::-1]
            done = tails[b]
            before = who[who > 0] - 1
            byte = t[before]
            same = before[byte == b]
            onward.append(before[byte < b])
            sa[done - len(same) : done] = same[::-1]
            tails[b] -= len(same)
        who = sa[begin[b] : heads[b]][::-1]
        before = who[who > 0] - 1
        onward.append(before[t[before] < b])
        _deal(sa, tails, t, onward, False)
    return sa


def _named(t: np.ndarray, least: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings between leftmost smaller suffixes, by their order: `order` lists `least` as an induced pass sorts them."""
    m = len(least)
    place = np.empty(len(t), np.int32)
    place[least] = np.arange(m)
    at = place[order]
    length = np.diff(np.concatenate([least, [len(t) - 1]])) + 1
    a, b = order[:-1], order[1:]
    equal = (length[at[:-1]] == length[at[1:]]) & (at[:-1] != m - 1) & (at[1:] != m - 1)  # the last one ends with the text
    left, offset = np.flatnonzero(equal), 0
    while len(left):
        differ = t[a[left] + offset] != t[b[left] + offset]
        equal[left[differ]] = False
        offset += 1
        left = left[~differ]
        left = left[length[at[left]] > offset]
    names = np.empty(m, np.int64)
    names[at] = np.concatenate([[0], np.cumsum(~equal)])
    return names


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a text of names: pairs of neighbouring names are named until all differ."""
    m = len(names)
    count = np.bincount(names)
    rank = (np.cumsum(count) - count)[names]  # how many are surely smaller
    same = np.bincount(rank, minlength=m)
    left, step = np.flatnonzero(same[rank] > 1), 1
    while len(left):
        after = np.where(left + step < m, rank[np.minimum(left + step, m - 1)] + 1, 0)
        order = np.lexsort((after, rank[left]))
        left, after, old = left[order], after[order], rank[left][order]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(left))
        rank[left] = old + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        alone = part & np.concatenate([part[1:], [True]])
        left, step = left[~alone], 2 * step
    order = np.empty(m, np.int64)
    order[rank] = np.arange(m)
    return order


def suffix_array(text: bytes | np.ndarray) -> np.ndarray:
    """The starts of all suffixes of the bytes, in their order; the shorter one of two that agree comes first."""
    t = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    if len(t) < 2:
        return np.arange(len(t), dtype=np.int32)
    up = _smaller(t)
    leftmost = np.zeros(len(t), bool)
    leftmost[1:] = up[1:] & ~up[:-1]
    least = np.flatnonzero(leftmost).astype(np.int32)
    if len(least) > 1:
        rough = _induced(t, least[np.argsort(t[least], kind="stable")])
        names = _named(t, least, rough[leftmost[rough]])
        least = least[_sorted_names(names)]
    return _induced(t, least)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, common), by place in the text: the suffix that comes just before in the array (-1: none) and the length of what both begin with.

    Where the bytes in front of a suffix and of the one before it agree, the length is that of the place to the left less one; only the others,
    the irreducible ones, are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[0]], before[sa[1:]] = -1, sa[:-1]
    alone = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0) + 1
    alone[inner] = t[inner - 1] != t[before[inner] - 1]
    at = np.flatnonzero(alone)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]
    other = before[at]
    length = np.zeros(len(at), np.int64)
    most = np.where(other < 0, 0, n - np.maximum(at, other))
    left = np.flatnonzero(most > 0)
    while len(left):
        i, j = at[left] + length[left], other[left] + length[left]
        x = eight[i].view("<u8")[:, 0] ^ eight[j].view("<u8")[:, 0]
        bytes_equal = np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) // 8  # 8 if all are, as 0 - 1 has 64 bits
        length[left] += bytes_equal
        left = left[(bytes_equal == 8) & (length[left] < most[left])]
    length = np.minimum(length, most)
    here = np.maximum.accumulate(np.where(alone, np.arange(n), 0))
    common = np.zeros(n, np.int64)
    common[at] = length
    return before, common[here] - (np.arange(n) - here)
