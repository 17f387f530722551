"""Arrays of numbers as compressed bytes, for rows that carry many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def packed(values: np.ndarray) -> bytes:
    """Numbers, with their count in front, compressed; bytes of equal weight lie together."""
    raw = np.int64(len(values)).tobytes() + np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, _CODEC, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), _CODEC, asbytes=True)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(values: np.ndarray) -> np.ndarray:
    """A number's distance from the one before; undone by a running sum."""
    return np.diff(values, prepend=values.dtype.type(0))
