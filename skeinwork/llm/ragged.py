"""The texts of an Arrow batch as flat numpy arrays, and the words in them.

A batch is handled in slices of about SLICE_BYTES of text, so that memory stays
bounded whatever the number of rows; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits; equal inputs stay equal."""
    x = x * _M1
    x = x ^ (x >> np.uint64(32))
    x = x * _M2
    return x ^ (x >> np.uint64(29))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows."""
    data, at = text_bytes(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run outside space and \\x09-\\x0D, and each row's first word."""
    if not data.size:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    some = at[:-1] < at[1:]
    begin, end = at[:-1][some], at[1:][some] - 1
    first[begin] = solid[begin]
    last[end] = solid[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, eight bytes a step."""
    out = mix((ends - starts).astype(np.uint64))
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    todo, at = None, starts
    left = ends - starts
    while at.size:
        block = view[at].view("<u8")[:, 0] & _KEEP[np.minimum(left, 8)]
        if todo is None:
            out = mix(out ^ block)
            todo = np.flatnonzero(left > 8)
        else:
            out[todo] = mix(out[todo] ^ block)
            todo = todo[left > 8]
        at, left = at[left > 8] + 8, left[left > 8] - 8
    return out


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each word of data has the bytes of the word beside it in other, eight bytes a step."""
    out = ends - starts == other_ends - other_starts
    todo = np.flatnonzero(out)
    one, two = (np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(8, np.uint8)]), 8) for x in (data, other))
    a, b, left = starts[todo], other_starts[todo], (ends - starts)[todo]
    while todo.size:
        keep = _KEEP[np.minimum(left, 8)]
        same = (one[a].view("<u8")[:, 0] & keep) == (two[b].view("<u8")[:, 0] & keep)
        out[todo[~same]] = False
        go = same & (left > 8)
        todo, a, b, left = todo[go], a[go] + 8, b[go] + 8, left[go] - 8
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... for every i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if ends.size else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
