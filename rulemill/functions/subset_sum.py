"""Subset sums over size multiplicities by bitsets (Python integers as bit arrays)."""

from __future__ import annotations

#: Bits of one program; a larger goal is first filled proportionally down to this size.
SPAN = 1 << 17
#: Items of each size that the proportional part leaves for the exact one.
RESERVE = 64


def nearest_subset(sizes: list[int], counts: list[int], goal: int, may_exceed: bool = False, span: int = SPAN) -> dict[int, int]:
    """How many items of each size to take so that the sum is as close to ``goal`` as can be.

    Sums stay at or below the goal unless ``may_exceed``; of two equally near sums the lower one
    is taken. Where the goal is above ``span``, a proportional part of every size is taken first
    and the rest is solved exactly: each count is split into powers of two, and each part shifts
    the bitset of reachable sums. Sizes of 0 and counts of 0 are never taken.

    Up to ``span`` the sum is the nearest there is. Above, it misses the goal by less than the least
    size of which an item is left over, as that item would fit otherwise; so a sum that meets the goal
    is proved to be the nearest, and no other can be nearer by that size or more.
    """
    order = sorted((n, c) for n, c in zip(sizes, counts, strict=True) if n > 0 and c > 0)
    total = sum(n * c for n, c in order)
    if total <= goal:
        return dict(order)
    taken, spare, left = dict.fromkeys((n for n, _ in order), 0), dict(order), max(0, goal)
    for exact in (False, True):
        for n, c in reversed(order):
            if left <= span * (1 + exact):  # the small sizes are kept for the exact part
                break
            k = max(0, min(spare[n], (left - span) // n if exact else min(c - RESERVE, c * (goal - span) // total)))
            taken[n] += k
            spare[n] -= k
            left -= k * n
    room = left + (max((n for n in spare if spare[n] and n <= 2 * left + 1), default=0) if may_exceed else 0)
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n, _ in order:
        c, part = min(spare[n], room // n), 1
        while c > 0:
            k = min(part, c)
            new = (reach | (reach << (n * k))) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
            c -= k
            part *= 2
        if reach >> left & 1:
            break
    at = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    if above:
        up = left + (above & -above).bit_length()
        if up - left < left - at:
            at = up
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return taken
