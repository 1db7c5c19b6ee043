"""Sorted names as packed arrays, for questions that chunks of rows put to buckets.

A chunk sends its distinct names, dealt out by their leading bits, as one array for each bucket, and gets one bit back for each:
a name that a third of all rows hold is sent once by each chunk, and no row travels for each name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def bits_for(count: int, more: int) -> int:
    """Bits of a name of which ``count`` exist, ``more`` beyond those that number them."""
    return min(64, max(1, count).bit_length() + more)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first; small ones take fewer."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    values = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    values[:, :width] = planes.T
    return values.view("<u8").ravel()


def ascending(values: np.ndarray) -> bytes:
    """Sorted unsigned integers, by their differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def restored(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def bits(values: np.ndarray, count: int) -> bytes:
    """The lowest ``count`` bits of each."""
    return b"".join(np.packbits(values >> np.uint64(n) & np.uint64(1) > 0).tobytes() for n in range(count))


def unbits(data: bytes, count: int, size: int) -> np.ndarray:
    values, each = np.zeros(size, np.uint64), (size + 7) // 8
    for n in range(count):
        values |= np.unpackbits(np.frombuffer(data, np.uint8, each, n * each), count=size).astype(np.uint64) << np.uint64(n)
    return values


def marked(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def marks(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count).astype(bool)


def dealt(names: np.ndarray, bits: int, spread: int) -> Iterator[tuple[int, slice]]:
    """The buckets, 2 ** ``spread`` in all, of sorted names of ``bits`` bits, and where each lies."""
    heads = (names >> np.uint64(bits - spread)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, np.int64)
    for first, last in zip(edges, np.append(edges[1:], len(heads))):
        yield int(heads[first]), slice(int(first), int(last))


def runs(names: np.ndarray) -> np.ndarray:
    """Where each group of equal sorted names begins."""
    return np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)


def held(sorted_names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among ``sorted_names``."""
    if not len(sorted_names):
        return np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(sorted_names, wanted)
    at[at == len(sorted_names)] = 0
    return sorted_names[at] == wanted
