"""A bidirectional FM-index over word numbers, for phrases up to a fixed depth.

The words of a shard are numbered from 1 and joined to one sequence in which a 0
stands around every piece. Positions are sorted by the words that follow (and, for the
other direction, by those that come before) only as deep as phrases reach; that is
enough for intervals of phrases up to that depth. All intervals of a level are
extended at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4


def bwt(sequence: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The word before each position of a cyclic sequence, positions sorted by their next ``depth`` words.

    Positions alike that deep stand in any order: no interval of a phrase up to that
    depth ends between them.
    """
    rank, known = sequence.astype(np.int64), 1
    order = np.argsort(rank)
    while known < depth:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -known)
        known = min(2 * known, depth)
        order = np.argsort(key)
        if known < depth:
            rank = np.empty(len(key), dtype=np.int64)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    return np.roll(sequence, 1)[order].astype(np.int32)


def index(sequence: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The transforms of the reverse of a sequence and of the sequence itself."""
    return bwt(sequence[::-1], depth), bwt(sequence, depth)


@dataclass(frozen=True)
class Phrases:
    """Phrases of one length with their counts and their intervals in both directions.

    ``words`` has one row per phrase, ``owners`` the phrase of the level before that was extended.
    """

    words: np.ndarray
    counts: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    owners: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.counts)

    def where(self, kept: np.ndarray) -> Phrases:
        owners = None if self.owners is None else self.owners[kept]
        return Phrases(self.words[kept], self.counts[kept], self.forward[kept], self.backward[kept], owners)


class FMIndex:
    """Counts and one-word extensions of phrases, from the two transforms of a shard.

    Without the forward one, phrases can only be extended to the right.
    """

    def __init__(self, backward: np.ndarray, forward: np.ndarray | None = None):
        self._last = {"left": forward, "right": backward}
        self._step: dict[str, np.ndarray] = {}
        counts = np.bincount(backward, minlength=1)
        self._starts = np.cumsum(counts) - counts
        self._counts = counts

    def _steps(self, side: str) -> np.ndarray:
        """Where each position's word begins among the sorted positions (the LF mapping)."""
        if side not in self._step:
            last = self._last[side]
            step = np.empty(len(last), dtype=np.int32)
            step[np.argsort(last, kind="stable")] = np.arange(len(last), dtype=np.int32)
            self._step[side] = step
        return self._step[side]

    def words(self) -> Phrases:
        """All single words."""
        found = np.flatnonzero(self._counts[1:]) + 1
        starts = self._starts[found]
        return Phrases(found[:, None].astype(np.int32), self._counts[found], starts, starts)

    def extend(self, phrases: Phrases, side: str) -> Phrases:
        """All phrases one word longer on one side ("left" or "right"), with their counts.

        The interval on that side is stepped by the mapping; the one on the other
        side shrinks by the smaller words beside the phrase.
        """
        own, other = (phrases.forward, phrases.backward) if side == "left" else (phrases.backward, phrases.forward)
        counts = phrases.counts
        total = int(counts.sum())
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(total) + np.repeat(own - (ends - counts), counts)
        beside = self._last[side][at]
        key, first, number = np.unique(
            owner * np.int64(len(self._counts)) + beside, return_index=True, return_counts=True
        )
        owner, word = np.divmod(key, len(self._counts))
        before = np.cumsum(number) - number
        smaller = before - before[np.searchsorted(owner, owner)] if len(owner) else before
        grown = word > 0
        owner, word, number, first, smaller = (x[grown] for x in (owner, word, number, first, smaller))
        stepped = self._steps(side)[at[first]].astype(np.int64)
        kept = other[owner] + smaller
        beside = word[:, None].astype(np.int32)
        if side == "left":
            return Phrases(np.hstack([beside, phrases.words[owner]]), number, stepped, kept, owner)
        return Phrases(np.hstack([phrases.words[owner], beside]), number, kept, stepped, owner)
