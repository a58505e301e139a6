"""Words and hashed word shingles of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers that mix the words of a shingle by position.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SHIFT = np.uint64(29)


#: Texts that are turned into Python strings at once.
SLICE = 256


def slices(batches):
    """The same rows in short batches, so that few texts are Python strings at a time."""
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it has grown large."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, memo: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; fewer words are one shingle, none gives none."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    size = min(size, len(h))
    n = len(h) - size + 1
    s = np.full(n, size, np.uint64)
    for k in range(size):
        s = (s ^ h[k:k + n]) * _ODD[k % 5]
        s ^= s >> _SHIFT
    return np.unique(s)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
