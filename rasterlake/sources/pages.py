"""Where a TIFF's pages stand, from a few of its headers.

Files that a camera writes have pages of one shape, a constant stride apart. Two
headers give the stride; a page is where it should be if the header found there has
the first page's shape, its strips at the same distance, and points one stride on or
nowhere. The last such page is found by binary search, and has to end the chain.
Whatever doesn't fit gives no index, and the caller follows the pointers instead.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PageIndex:
    first: int
    stride: int
    count: int

    def offset(self, k: int) -> int:
        return self.first + k * self.stride


def measured(tiff, size: int) -> PageIndex | None:
    """The index of an open file of ``size`` bytes, if its pages have one."""
    first = tiff.header(tiff.first)
    if first is None or first.next_off == 0:
        return PageIndex(tiff.first, 0, 1) if first else None
    stride = first.next_off - first.off
    if stride <= 0:
        return None

    def found(k: int):
        off = first.off + k * stride
        page = tiff.header(off)
        same = page is not None and page.shape == first.shape and page.next_off in (0, off + stride)
        return page if same and page.places == tuple(x + k * stride for x in first.places) else None

    low, high = 0, (size - first.off) // stride + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if found(middle) else (low, middle)
    last, before = found(low), found(low - 1) if low else None
    if not low or last is None or last.next_off or before is None or before.next_off != last.off:
        return None
    return PageIndex(first.off, stride, low + 1)
