"""Suffix arrays by difference covers, in numpy, to a bounded depth."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int, alphabet: int | None = None) -> np.ndarray:
    """Starts of all suffixes of s (positive integers), sorted; suffixes that agree in the first `depth` entries in any order.

    The difference cover modulo 3: triples at places 1 and 2 modulo 3 are sorted and named; the string of names is sorted
    in turn, unless all names differ or already stand for `depth` entries; places 0 modulo 3 follow from the sample; both
    are merged. The merge searches places 0 among the sample's places 1 and 2 by (entry, rank) and (entry, entry, rank).
    len(s) must be below 2**20, so that keys fit in 63 bits.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    k = int(s.max()) + 1 if alphabet is None else alphabet
    t = np.concatenate([s, np.zeros(3, np.int64)])
    end = n + (n % 3 == 1)  # one more place of the sample where 1 modulo 3 would lack its last
    ones, twos = np.arange(1, end, 3), np.arange(2, end, 3)
    sample = np.concatenate([ones, twos])
    if k < 1 << 20:
        key = (t[sample] * k + t[sample + 1]) * k + t[np.minimum(sample + 2, n + 2)]
    else:
        raise ValueError("too long")
    names, number, order = _named(key)
    if number < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3), number + 1)
    sorted_sample = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    zeros = np.arange(0, n, 3)
    wide = len(sample) + 2
    pair = lambda i: t[i] * wide + rank[i + 1]
    triple = lambda i: (t[i] * k + t[i + 1]) * wide + rank[i + 2]
    keys = pair(zeros)
    zeros = zeros[np.argsort(keys)]  # not a stable sort, which takes three times as long: keys differ
    of_one, of_two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(pair(of_one), pair(zeros)) + np.searchsorted(triple(of_two), triple(zeros))
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zeros)) + np.maximum.accumulate(before)] = zeros
    out[out < 0] = sorted_sample
    return out


def _named(key: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """1, 2, ... for the least, second, ... of the keys; how many differ; the keys' order, equal ones in any."""
    order = np.argsort(key)
    fresh = np.ones(len(key), np.int64)
    fresh[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(fresh)
    return names, int(fresh.sum()), order


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer (zeros past the end)."""
    w = np.concatenate([data.astype(np.uint64), np.zeros(8, np.uint64)])
    for span in (1, 2, 4):
        w[:-span] = w[:-span] << np.uint64(8 * span) | w[span:]
    return w


def equal_runs(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Number of the run of equal prefixes of `length` (8 or more) bytes, for each of the sorted places."""
    w = words8(data)
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        x = w[order + at]
        same &= x[1:] == x[:-1]
    return np.r_[0, np.cumsum(~same)] if len(order) else order
