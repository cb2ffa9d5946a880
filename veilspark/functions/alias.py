"""Alias tables: a weighted draw from n entries with two keyed draws and one look-up, whatever the weights."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 1 << 53


def alias_table(weights: Sequence[int]) -> tuple[list[int], list[int]]:
    """For each entry a cut and another entry: an entry drawn evenly stands if a number below STEPS is under its cut, else the other does.

    Weights are whole numbers; the chances are theirs within n / STEPS. Entries are paired from both ends: each with less than the even
    share is filled up by one with more.
    """
    n, total = len(weights), sum(weights)
    if total <= 0:
        raise ValueError("no weight is above 0")
    cuts, others = [STEPS] * n, list(range(n))
    rest = [w * n for w in weights]
    small, large = [i for i in range(n) if rest[i] < total], [i for i in range(n) if rest[i] >= total]
    while small and large:
        i, j = small.pop(), large[-1]
        cuts[i], others[i] = rest[i] * STEPS // total, j
        rest[j] -= total - rest[i]
        if rest[j] < total:
            small.append(large.pop())
    return cuts, others
