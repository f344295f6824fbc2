"""Sets of word shingles as 64-bit hashes of one hash function."""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes that a worker keeps.
MOST_WORDS = 100_000

FACTOR = np.uint64(0x9E3779B97F4A7C15)

# Only A-Z become lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = value
        return value


_known = Words()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The hashes, ascending, of the distinct runs of ``width`` words; of the whole sequence where there are fewer words.

    Words are what the six ASCII white-space characters separate, with A-Z lowered. Without words the set is empty.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(own))
    n = len(own) - width + 1
    value = np.full(n, width, np.uint64)
    for k in range(width):
        value = mixed(value * FACTOR + own[k : k + n])
    return np.unique(value)


def signature(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(values.tobytes())
