"""Words and shingles as arrays of 64-bit hashes.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D], which is what ``bytes.split`` gives.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
SIZE = 5
#: Odd multipliers that set the places of a window apart.
_ODD = np.random.default_rng(20240607).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None, fold: bool = False) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased if ``fold``."""
    if not isinstance(text, str):
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if fold else data).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows_of(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each window of ``size`` consecutive values; none if there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(seed))
    for k in range(size):
        total += hashes[k : k + count] * _ODD[(seed + k) % len(_ODD)]
    return mixed(total)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash for each row of a table of 64-bit values."""
    return mixed((rows * _ODD[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def shingle_set(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes; of fewer words the whole sequence; of none nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = hashes_of(words)
    size = min(size, len(hashes))
    # a short sequence is told apart from longer ones by its length
    return np.unique(windows_of(hashes, size, seed=SIZE - size))
