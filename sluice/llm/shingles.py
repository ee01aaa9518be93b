"""Sets of hashed word shingles of many texts at once.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a shingle is `width` words in
a row, or the whole sequence where a text has fewer words. Hashes have 64 bits.
"""

import numpy as np

from .common import SPACES
from .vectors import mixed

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), SPACES)
#: Odd weights of a byte by its place in the word, and of a word by its place in the shingle.
WEIGHTS = mixed(np.arange(1, 4097)) | np.uint64(1)


def weights(place: np.ndarray) -> np.ndarray:
    out = WEIGHTS[np.minimum(place, 4095)]
    far = np.flatnonzero(place > 4095)
    out[far] = mixed(place[far] + 1) | np.uint64(1)
    return out


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and byte after the last of every word."""
    n = len(ends) - 1
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    solid, first = ~SPACE[raw], np.zeros(len(raw) + 1, bool)
    first[ends] = True
    start = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | first[:-1]))
    stop = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | first[1:])) + 1
    if not len(start):
        return start.astype(np.uint64), start, start, start
    at = np.arange(start[0], len(raw))
    place = at - np.repeat(start, np.diff(np.append(start, len(raw))))
    worth = weights(place) * (LOWER[raw[start[0] :]].astype(np.uint64) + np.uint64(1))
    worth[~solid[start[0] :]] = 0
    total = np.add.reduceat(worth, start - start[0]) + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(total), np.minimum(np.searchsorted(ends, start, "right") - 1, n - 1), start, stop


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles one after the other, and where each row's begin and end. bounds: of the rows' words."""
    n_words = np.diff(bounds)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    upto = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(bounds[:-1] - upto[:-1], n) + np.arange(upto[-1])
    size = np.repeat(np.minimum(n_words, width), n)
    out, padded = size.astype(np.uint64), np.concatenate((words, np.zeros(width, np.uint64)))
    for k in range(width):
        out += np.where(size > k, padded[at + k] * WEIGHTS[4000 + k], np.uint64(0))
    return mixed(out), upto


def shingle_sets(raw: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, row, _, _ = word_hashes(raw, ends)
    bounds = np.searchsorted(row, np.arange(len(ends)))
    flat, upto = shingle_hashes(words, bounds, width)
    return [np.unique(flat[i:j]) for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
