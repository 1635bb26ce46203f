"""Numpy columns shuffled as binary rows: one row per (batch, bucket) instead of one per value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' values of each bucket, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    kept = bucket[order]
    cuts = np.flatnonzero(np.diff(kept)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(kept)]):
        at = order[lo:hi]
        yield int(kept[lo]), [c[at] for c in columns]


def joined(blobs, dtype) -> np.ndarray:
    """One array from binary values."""
    return np.frombuffer(b"".join(blobs), dtype=dtype)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit over all output bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
