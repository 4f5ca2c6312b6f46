"""Karmarkar-Karp multiway differencing over piece lengths."""

from __future__ import annotations

import heapq

import numpy as np


def partition(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal `lengths` to `windows` bins; returns the bin of each length and each bin's sum.

    Every length starts as a partial partition with one filled bin. The two partial partitions of
    largest spread are merged, the fullest bins of one onto the emptiest of the other, until one is
    left. Partial partitions keep only their filled bins, in falling order of their sums.
    """
    n = len(lengths)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    sums: list[np.ndarray | None] = [np.array([x], np.int64) for x in lengths]
    merged: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x) if windows > 1 else 0, i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums[a], sums[b]
        over = max(0, len(x) + len(y) - windows)  # filled bins of y that must share a bin of x
        both = np.concatenate([x, y[: len(y) - over]])
        if over:
            both[len(x) - over : len(x)] += y[len(y) - over :][::-1]
        order = np.argsort(-both, kind="stable")
        both, node = both[order], len(sums)
        merged.append((a, b, order))
        sums[a] = sums[b] = None
        sums.append(both)
        spread = both[0] - (both[-1] if len(both) == windows else 0)
        heapq.heappush(heap, (-int(spread), node))
    root = len(sums) - 1
    place: dict[int, np.ndarray] = {root: np.arange(len(sums[root]))}
    counts = {i: 1 for i in range(n)}
    for k, (a, b, order) in enumerate(merged):
        counts[n + k] = len(order)
    for k in range(len(merged) - 1, -1, -1):  # from the last merge back to the single lengths
        a, b, order = merged[k]
        own = np.empty(len(order), np.int64)
        own[order] = place.pop(n + k)
        na, nb = counts[a], counts[b]
        over = na + nb - len(order)
        place[a] = own[:na]
        place[b] = np.concatenate([own[na:], own[na - over : na][::-1]])
    bins = np.array([place[i][0] for i in range(n)], np.int64)
    totals = np.zeros(windows, np.int64)
    np.add.at(totals, bins, lengths)
    return bins, totals


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bins of near-equal sum, none above `capacity`: the bin count rises until that holds."""
    total = int(lengths.sum())
    windows = max(1, -(-total // capacity))
    while True:
        bins, sums = partition(lengths, windows)
        worst = int(sums.max(initial=0))
        if worst <= capacity:
            return bins, windows
        # near-equal bins shift together, so the excess of the fullest says how many bins are short
        windows += max(1, (worst - capacity) * windows // capacity)
