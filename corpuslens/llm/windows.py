"""Anchors of byte windows: a few places per text that equal windows have in common."""

from __future__ import annotations

import numpy as np

from corpuslens.llm.common import mixed

#: Texts are looked at in stretches of this many bytes; a place inside one fits 20 bits.
STRETCH = (1 << 20) - 1

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            step, have = np.uint64(base), 1
            with np.errstate(over="ignore"):
                while have < size:
                    out[have : 2 * have] = out[:have] * step
                    step, have = step * step, 2 * have
            tables.append(out)
        _powers[:] = tables
    return _powers[0], _powers[1]


class Rolling:
    """Hash of any slice of a text in constant time."""

    def __init__(self, text: np.ndarray):
        up, self.down = _power_tables(len(text) + 1)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTE[text] * up[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and first and last window start that has each.

    The anchor of a window of ``w`` grams is its leftmost least gram, so equal windows have
    their anchors at equal offsets.
    """
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 20) - 1)
    at = (_sliding_min((grams & ~low) | place, w) & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[new], new, np.r_[new[1:], len(at)] - 1
