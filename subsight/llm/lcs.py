"""Longest common subsequences by bit-parallel rows: one whole number per row."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Above so many cells the first sequence is halved, so that memory stays bounded.
CELLS = 1 << 26


def masks_of(sequence: Sequence[Hashable]) -> dict[Hashable, int]:
    """Where each element stands in a sequence, as bits."""
    masks: dict[Hashable, int] = {}
    for j, x in enumerate(sequence):
        masks[x] = masks.get(x, 0) | 1 << j
    return masks


def lcs_bits(a: Sequence[Hashable], masks: dict[Hashable, int], length: int) -> int:
    """The last row for ``a`` against a sequence of ``length`` with these masks.

    Bit j is 0 if the common subsequence grows at place j.
    """
    full = (1 << length) - 1
    row = full
    for x in a:
        met = row & masks.get(x, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    return row


def lcs_length(a: Sequence[Hashable], masks: dict[Hashable, int], length: int) -> int:
    return length - lcs_bits(a, masks, length).bit_count()


def aligned(a: Sequence[Hashable], b: Sequence[Hashable], offset: int = 0) -> list[int]:
    """Places in ``a`` that a longest common subsequence with ``b`` takes."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    left, right = a[lo : len(a) - hi], b[lo : len(b) - hi]
    found = list(range(offset, offset + lo))
    if left and right:
        found += _inner(left, right, offset + lo)
    return found + list(range(offset + len(a) - hi, offset + len(a)))


def _inner(a: Sequence[Hashable], b: Sequence[Hashable], offset: int) -> list[int]:
    if len(a) == 1:
        return [offset] if a[0] in b else []
    masks, length = masks_of(b), len(b)
    if len(a) * length > CELLS:
        half = len(a) // 2
        down = lcs_bits(a[:half], masks, length)
        up = lcs_bits(a[half:][::-1], masks_of(b[::-1]), length)
        before = _grown(down, length)
        after = _grown(up, length)
        cut = max(range(length + 1), key=lambda j: before[j] + after[length - j])
        return aligned(a[:half], b[:cut], offset) + aligned(a[half:], b[cut:], offset + half)
    full = (1 << length) - 1
    rows = [full]
    for x in a:
        row = rows[-1]
        met = row & masks.get(x, 0)
        rows.append(((row + met) | (row - met)) & full)
    taken, j = [], length
    for i in range(len(a), 0, -1):
        # In row i the subsequence with b[:j] is longer than in row i - 1: a[i-1] is in it.
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() < (rows[i - 1] & low).bit_count():
            taken.append(offset + i - 1)
            met = masks[a[i - 1]] & low
            # Step to the last place of b where this element still completes the length.
            want = j - (rows[i] & low).bit_count()
            while met:
                place = met.bit_length() - 1
                below = (1 << place) - 1
                if place - (rows[i - 1] & below).bit_count() == want - 1:
                    j = place
                    break
                met &= below
    return taken[::-1]


def _grown(row: int, length: int) -> list[int]:
    total, lengths = 0, [0]
    for j in range(length):
        total += not row >> j & 1
        lengths.append(total)
    return lengths
