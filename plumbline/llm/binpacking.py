"""Bin completion over a histogram of sizes.

A bin is a filling: how many documents of each size it holds. Work depends on the number of
distinct sizes, at most the capacity, and not on the number of documents.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter

Filling = tuple[tuple[int, int], ...]  # (size, how many), sizes descending
Bins = list[tuple[int, Filling]]  # (how many such bins, filling)
DESCENTS = 4
DIGITS = bytes([48, 49, *range(2, 256)])


def lower_bound(sizes: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: the waste bound of Martello and Toth over all thresholds."""
    items = sorted(sizes)
    best = -(-sum(s * n for s, n in sizes.items()) // capacity)
    for least in [0, *[s for s in items if 2 * s <= capacity]]:
        alone = sum(n for s, n in sizes.items() if s > capacity - least)
        half = [(s, n) for s, n in sizes.items() if capacity < 2 * s <= 2 * (capacity - least)]
        room = sum((capacity - s) * n for s, n in half)
        rest = sum(s * n for s, n in sizes.items() if least <= s and 2 * s <= capacity)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(sizes: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing: each document goes into the fullest bin that still takes it.

    Bins of one filling are kept together, and one step fills all of them.
    """
    by_room: dict[int, list[tuple[int, Filling]]] = {}
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        for room in sorted(r for r in by_room if r >= size):
            fits, groups, kept = room // size, by_room.pop(room), []
            while groups and left:
                bins, filling = groups.pop()
                whole = min(bins, left // fits)
                for n, each in ((whole, fits), (int(whole < bins and left - whole * fits > 0), left - whole * fits)):
                    if n:
                        by_room.setdefault(room - each * size, []).append((n, (*filling, (size, each))))
                        bins, left = bins - n, left - n * each
                if bins:
                    kept.append((bins, filling))
            if groups or kept:
                by_room.setdefault(room, []).extend(groups + kept)
            if not left:
                break
        fits = capacity // size
        for n, each in ((left // fits, fits), (int(left % fits > 0), left % fits)):
            if n:
                by_room.setdefault(capacity - each * size, []).append((n, ((size, each),)))
    return [group for groups in by_room.values() for group in groups]


def dominated(filling: Filling, room: int, others: list[int] | int) -> bool:
    """Whether a larger document not in the filling could replace some of its documents.

    Such a filling never beats the replaced one, since the freed documents fit wherever the larger
    one would have gone. `others`: sizes left, or a number with their bits.
    """
    slack = room - sum(s * n for s, n in filling)
    bits = others if isinstance(others, int) else sum(1 << x for x in set(others))
    bits &= (1 << (room + 1)) - 1
    sums = 1
    for size, n in filling:
        for _ in range(n):
            sums |= sums << size
    reach, width = sums, 1  # sums and what is at most `slack` above one
    while width <= slack:
        step = min(width, slack + 1 - width)
        reach, width = reach | reach << step, width + step
    own = sum(1 << s for s, _ in filling)
    if reach & bits & ~own:
        return True
    for x, _ in filling:  # a document of its own size it need not replace
        low = max(0, x - slack)
        if bits >> x & 1 and (sums >> low) & ((1 << (x - low)) - 1):
            return True
    return False


def fillings(room: int, sizes: list[int], counts: Counter, waste: int, width: int, effort: int) -> list[Filling]:
    """Undominated fillings of `room` that waste at most `waste`, the fullest first.

    Documents are tried from the largest down. `width` fillings are kept, `effort` steps made.
    """
    found: list[tuple[int, int, Filling]] = []
    perfect, steps = 0, effort

    def extend(left: int, end: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal perfect, steps
        steps -= 1
        for i in range(min(end, bisect_right(sizes, left)) - 1, -1, -1):
            for n in range(min(counts[sizes[i]], left // sizes[i]), 0, -1):
                if steps <= 0 or perfect >= width:
                    return
                extend(left - n * sizes[i], i, [*chosen, (sizes[i], n)])
        if left <= waste:
            found.append((left, len(found), tuple(chosen)))
            perfect += left == 0

    extend(room, len(sizes), [])
    kept: list[Filling] = []
    flags = bytearray(room + 1)  # one for each size that fits
    for s in sizes[: bisect_right(sizes, room)]:
        flags[room - s] = 1
    every = int(flags.translate(DIGITS).decode(), 2)
    for left, _, filling in heapq.nsmallest(8 * width, found):
        gone = sum(1 << s for s, n in filling if counts[s] <= n)
        if not dominated(filling, room, every & ~gone):
            kept.append(filling)
        if len(kept) == width:
            break
    return kept


def complete(sizes: dict[int, int], capacity: int, target: int, best: int, effort: int) -> Bins | None:
    """A packing into fewer than `best` bins, found by branch and bound, or None.

    Each step takes the largest document left and branches over the undominated fillings around it;
    one filling is used for as many bins as its documents allow. A branch ends as soon as the space
    it has wasted exceeds what `best - 1` bins can waste. Each packing found is the next incumbent.
    The search stops at `target` bins, which no packing beats, or after `effort` steps.
    """
    total = sum(s * n for s, n in sizes.items())
    incumbent: Bins | None = None
    counts = Counter(sizes)
    left_effort = effort

    def branches(wasted: int) -> tuple[int, list[Filling]]:
        order = sorted(s for s, n in counts.items() if n)
        largest = order[-1]
        counts[largest] -= 1
        order = [s for s in order if counts[s]]
        allowed = (best - 1) * capacity - total - wasted
        tried = fillings(capacity - largest, order, counts, allowed, 4, min(2_000, left_effort))
        counts[largest] += 1
        return largest, tried

    bins: Bins = []
    stack: list[tuple[int, list[Filling], int]] = []  # largest, fillings not tried yet, space wasted so far
    wasted = used = 0
    descend = True
    while left_effort > 0:
        if descend:
            if not +counts:
                incumbent, best = list(bins), used
                if best <= target:
                    break
                descend = False
                continue
            left_effort -= 1 + len(counts) // 64
            stack.append((*branches(wasted), wasted))
        largest, tried, before = stack[-1]
        if not tried:
            stack.pop()
            if not stack:
                break
            n, filling = bins.pop()
            for size, each in filling:
                counts[size] += n * each
            used, descend = used - n, False
            continue
        around = tried.pop(0)
        need = Counter(dict(around))
        need[largest] += 1
        filling = tuple(sorted(need.items(), reverse=True))
        n = min(counts[s] // each for s, each in filling)
        spare = capacity - sum(s * each for s, each in filling)
        allowed = (best - 1) * capacity - total - before
        if spare:
            n = min(n, allowed // spare)
        if n <= 0:
            continue
        for size, each in filling:
            counts[size] -= n * each
        bins.append((n, filling))
        used, wasted, descend = used + n, before + n * spare, True
    return incumbent


def plan(sizes: dict[int, int], capacity: int, effort: int = 40_000) -> Bins:
    """Bins for all documents: the best of best-fit decreasing and what bin completion finds.

    The search has `effort` beside that of some whole descents, which grows with the distinct sizes.
    """
    if not sizes:
        return []
    if min(sizes) <= 0 or max(sizes) > capacity:
        raise ValueError("sizes must be between 1 and the capacity")
    bins = best_fit(sizes, capacity)
    used = sum(n for n, _ in bins)
    if used > -(-sum(s * n for s, n in sizes.items()) // capacity):
        least = lower_bound(sizes, capacity)
        if used > least:
            whole = len(sizes) * (1 + len(sizes) // 64)  # of a descent in which each step uses up a size
            bins = complete(sizes, capacity, least, used, effort + DESCENTS * whole) or bins
    return bins
