"""Banded edit distance of two sequences, by bit-parallel diagonals."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence, b: Sequence, limit: int) -> int | None:
    """The least insertions, deletions and replacements from a to b, or None if over limit.

    Only the band of `limit` diagonals on either side is computed, a column at a
    time in one integer (the band slides down a row with each column).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_b and a[start] == b[start]:
        start += 1
    while end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if not len(b):
        return len(a) if len(a) <= limit else None
    band = min(limit, len(a))
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    plus, minus, dist = full ^ ((1 << band) - 1), 0, band
    turn = len(a) - band  # from this column on the last row is inside the band
    mark = top >> 1
    for j, x in enumerate(b):
        rows = at.get(x, 0)
        same = (rows >> (j - band) if j >= band else rows << (band - j)) & full
        diagonal = (((((same & plus) + plus) & full) ^ plus) | same | minus) & full
        across_up = (minus | ~(diagonal | plus)) & full
        across_down = diagonal & plus
        if j < turn:
            dist += not diagonal & top
        else:
            dist += bool(across_up & mark) - bool(across_down & mark)
            mark >>= 1
        if dist > limit + (len(b) - max(turn, 0)):
            return None
        shifted = diagonal >> 1
        plus = (across_down | ~(shifted | across_up)) & full
        minus = shifted & across_up
    return dist if dist <= limit else None
