"""Sorted integer columns as byte planes: many small entries travel through a shuffle as a few binary rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard

_U = np.uint64


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane; planes of zeros cost next to nothing once compressed."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, _U), dtype=_U)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each key; rising with the key."""
    return ((keys >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)


def cuts(group: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Group, begin and end of each run in a rising array."""
    if not len(group):
        return
    at = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(group[a]), a, b


def squeezed(a: np.ndarray) -> bytes:
    """As pack(), compressed: for columns of small numbers."""
    return zstandard.ZstdCompressor(level=1).compress(pack(a))


def unsqueezed(raw: bytes, kind) -> np.ndarray:
    return unpack(zstandard.ZstdDecompressor().decompress(raw), kind)


def slice_name(*columns: np.ndarray) -> int:
    """A 64-bit name of a slice from what identifies its rows: made anew, it is the same."""
    x = hashlib.blake2b(digest_size=8)
    for c in columns:
        x.update(np.ascontiguousarray(c).tobytes())
    return int.from_bytes(x.digest(), "little", signed=True)
