"""Word shingles of texts as 64-bit hashes, and SuperMinHash signatures of sets of them, in numpy.

A word is a run of bytes other than ``\\x20\\x09-\\x0D`` after A-Z are put in lower case. Words are hashed by
differences of a running polynomial sum over all bytes of a batch, with no Python step per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix64

#: Bytes hashed at once; a longer stretch without white space is one chunk.
CHUNK = 1 << 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_U = np.uint64
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64((np.arange(256, dtype=np.uint64) + _U(1)) * GOLDEN)[_LOWER]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word."""
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            power, inverse = _powers(1 << max(10, (len(raw) - 1).bit_length()))
            total = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * power[: len(raw)])])
            hashes.append(mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64)))
            firsts.append(start + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle together."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    words, firsts = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(firsts, offsets)
    factors = mix64((np.arange(width, dtype=np.uint64) + _U(7)) * GOLDEN) | _U(1)
    if len(words) >= width:
        n = len(words) - width + 1
        windows = np.zeros(n, np.uint64)
        for t in range(width):
            windows += words[t : t + n] * factors[t]
        windows = mix64(windows)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(windows[lo : hi - width + 1]))
        elif hi > lo:
            out.append(mix64(np.array([(words[lo:hi] * factors[: hi - lo]).sum() ^ _U(int(GOLDEN) * int(hi - lo) % (1 << 64))], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class SuperMinHash:
    """Signatures of m slots (252 at most) of sets of 64-bit hashes.

    Every element walks its own random permutation of the slots and offers level + a random fraction to
    the slot it is at. All elements of a batch take a level together. A slot filled at some level can't be
    lowered by a later one, so a set leaves as soon as all its slots are filled. Values are 64-bit
    integers: the level in the top byte, the fraction below it.
    """

    def __init__(self, m: int, most: int = 1 << 15):
        if not 0 < m <= 252:
            raise ValueError("m must be between 1 and 252")
        self.m, self.most = m, most

    def _draw(self, x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        u = mix64(x + _U(int(GOLDEN) * (level + 1) % (1 << 64)))
        place = level + ((u & _U(0xFFFFFFFF)) * _U(self.m - level) >> _U(32)).astype(np.int64)
        return place, _U(level) << _U(56) | u >> _U(8)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """An array (sets x m); rows of empty sets hold the largest value."""
        out = np.full((len(sets), self.m), np.iinfo(np.uint64).max, np.uint64)
        start, total = 0, 0
        for i, s in enumerate(sets):
            if i > start and total + len(s) > self.most:
                self._fill(sets[start:i], out[start:i])
                start, total = i, 0
            total += len(s)
        self._fill(sets[start:], out[start:])
        return out

    def _fill(self, sets: list[np.ndarray], out: np.ndarray) -> None:
        counts = np.array([len(s) for s in sets], np.int64)
        if not counts.sum():
            return
        x, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
        place, value = self._draw(x, 0)
        np.minimum.at(out.reshape(-1), owner * self.m + place, value)
        walk, level = None, 0
        while True:
            level += 1
            open_sets = (counts > 0) & (out >= _U(level) << _U(56)).any(axis=1) if level < self.m else np.zeros(len(sets), bool)
            stay = open_sets[owner]
            if not stay.any():
                return
            if walk is None:
                x, owner, place = x[stay], owner[stay], place[stay]
                walk = np.tile(np.arange(self.m, dtype=np.uint8), (len(x), 1))
                rows = np.arange(len(x))
                walk[:, 0], walk[rows, place] = place, 0
            elif not stay.all():
                x, owner, walk = x[stay], owner[stay], walk[stay]
                rows = np.arange(len(x))
            place, value = self._draw(x, level)
            slot, here = walk[rows, place], walk[:, level].copy()
            walk[rows, place] = here
            walk[:, level] = slot
            np.minimum.at(out.reshape(-1), owner * self.m + slot, value)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature (sets x bands); keys of different bands differ."""
    cut = signatures[:, : bands * rows].reshape(-1, bands, rows)
    key = mix64(np.tile((np.arange(bands, dtype=np.uint64) + _U(1)) * GOLDEN, (len(cut), 1)))
    for r in range(rows):
        key = mix64(key ^ mix64(cut[:, :, r]) + GOLDEN)
    return key
