"""Shortest-pack-first packing over a histogram of lengths."""

from __future__ import annotations

from collections import defaultdict


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs as (how many, [(length, how often in each)]), lengths in the order in which they were placed.

    Lengths are taken longest first. Each goes to the packs with the most room left (the shortest ones), as many at a
    time as there are such packs or pieces; packs of a pattern are counted, never listed. Where the emptiest pack
    has no room, new packs take the length's pieces, each as many as fit. There are at most twice as many patterns as lengths, since each step uses up either a
    length's pieces (two more patterns) or a pattern's packs (none more), and each holds at most sqrt(2 * size) lengths.
    """
    room: dict[int, list[list]] = defaultdict(list)
    widest = 0
    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a length of {length} doesn't fit in {size}")
        left = counts[length]
        while left:
            while widest and not room.get(widest):
                room.pop(widest, None)
                widest = max(room, default=0)
            if widest < length:
                full, rest = divmod(left, size // length)
                for many, times in ((full, size // length), (1, rest)):
                    if many and times:
                        room[size - times * length].append([many, [(length, times)]])
                        widest = max(widest, size - times * length)
                break
            space = widest
            many, pattern = room[widest].pop()
            if many > left:
                room[widest].append([many - left, pattern])
                many = left
            grown = list(pattern)
            if grown and grown[-1][0] == length:
                grown[-1] = (length, grown[-1][1] + 1)
            else:
                grown.append((length, 1))
            room[space - length].append([many, grown])
            widest = max(widest, space - length)
            left -= many
    return [(many, pattern) for space in sorted(room) for many, pattern in room[space]]
