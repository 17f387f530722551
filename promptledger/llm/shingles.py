"""Distinct word shingles of a text as 64-bit hashes."""

from __future__ import annotations

import numpy as np

WORDS = 5
SEGMENT_WORDS = 100_000

_BASE = 0x9E3779B97F4A7C15
_SIGNS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = 32


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as texts have needed them."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
                                  for b in (np.uint64(_BASE), np.uint64(inverse)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, which are joined by one space each."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(raw == _SPACE)
    starts = np.concatenate([[0], gaps + 1])[:len(words) - width + 1]
    ends = np.concatenate([gaps, [len(raw)]])[width - 1:]
    up, down = _POWERS.upto(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SIGNS[raw] * up)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none.

    A-Z is lower-cased and words end at space, tab and line ends only. Runs are hashed by differences of one
    running sum, so long texts cost as much per word as short ones.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        # No shingle of full width has this hash but by chance.
        return mixed(_windows(words, len(words)) + np.uint64(len(words)))
    step = SEGMENT_WORDS
    parts = [_windows(words[i:i + step + width - 1], width) for i in range(0, max(1, len(words) - width + 1), step)]
    return np.unique(np.concatenate(parts))


def signature(shingles: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    total = np.add.reduce(mixed(shingles ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])
