"""Runs (maximal repetitions) of a sequence from its Lyndon arrays, after Ellert and Fischer.

For each position i, the next smaller suffix j > i bounds the longest Lyndon word
at i. If a run of period p continues into something smaller, its Lyndon roots
are exactly such words of length p, so all runs are found from the pairs (i, j)
of the order of the alphabet and of its reverse, by extending each pair to both
sides. Symbols are only compared; there is no suffix structure and no hash.

Positions are taken from right to left. The candidates for j form a chain of
ever smaller suffixes, on which what is known of one pair decides the next one or
says from where on to compare. A pair that has matched over a whole period goes on
with the extension of the pair one period later, which is known, so that a long
repetition is compared once and not once for each of its positions.
"""

from __future__ import annotations

#: Follows the last symbol and is smaller than any.
END = -1


def next_smaller(symbols: list[int]) -> tuple[list[int], list[int]]:
    """Of each position i, the next smaller suffix j (the length, if none) and how far i and j match.

    Symbols are integers from 0 on. That the suffix at the length is END's makes
    it the smallest, so a chain ends there.
    """
    n = len(symbols)
    a = [*symbols, END]
    after, match = [n] * (n + 1), [0] * (n + 1)
    before, matched = [END] * (n + 1), [0] * (n + 1)  # the pairs in which the later suffix is the larger one, by the later
    for i in range(n - 2, -1, -1):
        x, j = a[i], i + 1
        while a[j] > x:
            j = after[j]
        if a[j] == x:
            k = 1
            while True:
                # k symbols are known to match
                period = j - i
                while k < period and a[i + k] == a[j + k]:
                    k += 1
                if k >= period:
                    later = j + period
                    if after[j] == later:
                        k = period + match[j]
                    elif later < n and before[later] == j:
                        k = period + matched[later]
                    else:
                        while a[i + k] == a[j + k]:
                            k += 1
                if a[j + k] < a[i + k]:
                    match[i] = k
                    break
                # j's suffix is larger: on to the next on its chain, which matches j over m
                before[j], matched[j] = i, k
                m, j = match[j], after[j]
                while m > k:
                    before[j], matched[j] = i, k
                    m, j = match[j], after[j]
                if m < k:
                    match[i] = m
                    break
        after[i] = j
    return after, match


def _extended(a: list[int], least: int, exponent: int, found: set[tuple[int, int, int]]) -> None:
    after, match = next_smaller(a)
    n = len(a)
    for i, (j, k) in enumerate(zip(after, match)):
        period = j - i
        # to the left less than a period: the first of a run's roots is enough
        if k and j < n and k + 2 * period > max(least, exponent * period):
            left = 0
            while left < period and left < i and a[i - 1 - left] == a[j - 1 - left]:
                left += 1
            length = left + period + k
            if left < period and length >= max(least, exponent * period):
                found.add((i - left, length, period))


def runs(symbols: list[int], least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """All runs of at least `least` symbols and `exponent` (2 or more) periods: (start, length, smallest period), by start and period.

    Symbols are integers from 0 on, in any order.
    """
    found: set[tuple[int, int, int]] = set()
    if symbols:
        top = max(symbols)
        _extended(symbols, least, exponent, found)
        _extended([top - x for x in symbols], least, exponent, found)
    return sorted(found, key=lambda r: (r[0], r[2]))
