"""Words of a text as bytes, as the operators on shingles take them."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A worker's word cache is emptied beyond so many words.
CACHE_WORDS = 300_000


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), with A-Z in lower case."""
    return text.translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, each made once; at most ``CACHE_WORDS`` are kept."""

    def __init__(self, seed: int = 42):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values: all bits depend on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; fewer words make one shingle, none make none."""
    count = max(len(hashes) - size + 1, min(len(hashes), 1))
    taken = min(size, len(hashes))
    total = np.full(count, taken, dtype=np.uint64)
    for i in range(taken):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count]
    return mixed(total)
