"""Views of Arrow string arrays as numpy byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLANK_1 = np.zeros(256, bool)
_BLANK_1[[9, 10, 11, 12, 13, 32]] = True


def view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of len+1 starting at 0, valid mask) of a string array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.string():
        arr = arr.cast(pa.string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if arr.null_count == 0 else ~np.asarray(arr.is_null())
    return raw[off[0] : off[-1]], off - off[0], valid


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings hold at most ``most`` bytes; a longer row is a run of its own.

    The masks over a buffer take many times its size, so their memory gets a bound.
    """
    _, off, _ = view(batch.column(column))
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The substrings [start, end) of ``buf`` as one string array."""
    lens = ends - starts
    new = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=new[1:])
    idx = np.repeat(starts - new[:-1], lens) + np.arange(new[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(new.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[idx])))


def places(buf: np.ndarray, char: str) -> np.ndarray:
    """Mask of the first byte of each occurrence of a character, or of a longer mark."""
    raw = char.encode()
    out = np.zeros(len(buf), bool)
    if 0 < len(raw) <= len(buf):
        n = len(buf) - len(raw) + 1
        out[:n] = buf[:n] == raw[0]
        for i, byte in enumerate(raw[1:], 1):
            out[:n] &= buf[i : n + i] == byte
    return out


def blanks(buf: np.ndarray) -> np.ndarray:
    """Mask of the bytes of white space, no-break and ideographic blanks included."""
    out = _BLANK_1[buf]
    if len(buf) > 1:
        nb = (buf[:-1] == 0xC2) & (buf[1:] == 0xA0)
        out[:-1] |= nb
        out[1:] |= nb
    for ch in ("　", " ", " "):
        m = np.flatnonzero(places(buf, ch))
        for k in range(3):
            out[m + k] = True
    return out


def trim(blank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves both ends of each span inwards over blank bytes; a blank span becomes empty."""
    solid = np.flatnonzero(~blank)
    if len(solid) == 0:
        return starts.copy(), starts.copy()
    i = np.searchsorted(solid, starts)
    s = np.where(i < len(solid), solid[np.minimum(i, len(solid) - 1)], len(blank))
    j = np.searchsorted(solid, ends) - 1
    e = np.where(j >= 0, solid[np.maximum(j, 0)] + 1, 0)
    empty = s >= ends
    return np.where(empty, starts, s), np.where(empty, starts, e)
