"""Sets of intervals of one text."""

from __future__ import annotations

from bisect import bisect_left


class IntervalSet:
    """The union of half-open intervals, as ascending stretches that don't overlap.

    Whether an interval overlaps one that was added takes the logarithm of their number:
    stretches ascend by start and so by end, so only the last one that starts before the
    interval's end can reach into it.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def overlaps(self, start: int, end: int) -> bool:
        """Whether some added interval starts before ``end`` and ends after ``start``."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        """Adds an interval; those it overlaps become one stretch with it (neighbours that only touch don't)."""
        high = bisect_left(self.starts, end)
        low = high
        while low and self.ends[low - 1] > start:
            low -= 1
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]


def accepted(first: list[tuple[int | None, int | None]], later: list[tuple[int | None, int | None]]) -> list[bool]:
    """Which of the ``later`` intervals, one after the other, overlap neither a ``first`` one nor one accepted before.

    An interval without a start or an end overlaps nothing.
    """
    taken = IntervalSet()
    for a, b in first:
        if a is not None and b is not None:
            taken.add(a, b)
    out = []
    for a, b in later:
        known = a is not None and b is not None
        out.append(not (known and taken.overlaps(a, b)))
        if known and out[-1]:
            taken.add(a, b)
    return out
