"""Datasets of HDF5 files of the early format: what is needed to find them, to read a range of their rows, and to write them.

Read: superblock 0 or 1, groups by symbol table, object headers 1, integers and floats,
compact, contiguous and chunked layouts, deflate and shuffle. Later formats are an
error that says so. A matrix is stored column by column, as its users write it: the
last axis of the file is the row, and a vector has one axis or a first axis of 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

ReadAt = Callable[[int, int], bytes]

# Signatures and numbers of the file format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
SPACE, TYPE, FILL, LAYOUT, FILTERS, CONTINUED, GROUP = 0x1, 0x3, 0x5, 0x8, 0xB, 0x10, 0x11
DEFLATE, SHUFFLE = 1, 2
NOWHERE = (1 << 64) - 1
LEAF_K, TREE_K, CHUNK_K = 64, 16, 32


@dataclass
class Dataset:
    """Where a dataset lies: shape by the file's axes, and its chunks as (offsets, address, bytes, skipped filters)."""

    shape: tuple[int, ...]
    dtype: np.dtype
    at: int = NOWHERE
    chunk: tuple[int, ...] | None = None
    filters: tuple[int, ...] = ()
    chunks: list[tuple[tuple[int, ...], int, int, int]] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return self.shape[-1] if self.shape else 1


def _messages(read: ReadAt, at: int) -> Iterator[tuple[int, bytes]]:
    version, _, count, _, size = struct.unpack("<BBHII", read(at, 12))
    if version != 1:
        raise ValueError("an object header of a later format")
    todo = [(at + 16, size)]
    while todo and count:
        at, size = todo.pop(0)
        body, k = read(at, size), 0
        while k + 8 <= size and count:
            kind, n = struct.unpack_from("<HH", body, k)
            data = body[k + 8 : k + 8 + n]
            k, count = k + 8 + n, count - 1
            if kind == CONTINUED:
                todo.append(struct.unpack("<QQ", data[:16]))
            else:
                yield kind, data


def _dtype(data: bytes) -> np.dtype:
    kind, order, size = data[0] & 15, "<>"[data[1] & 1], struct.unpack_from("<I", data, 4)[0]
    if kind == 0:
        return np.dtype(f"{order}{'i' if data[1] & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    raise ValueError(f"a datatype of class {kind}; integers and floats are read")


def _children(read: ReadAt, tree: int, key: int) -> Iterator[tuple[bytes, int]]:
    """(key, address) of the leaves' children of a B-tree, in order."""
    sign, _, level, n = struct.unpack("<4sBBH", read(tree, 8))
    if sign != b"TREE":
        raise ValueError("not a node of a tree")
    body = read(tree + 24, n * (key + 8))
    for k in range(n):
        at = k * (key + 8)
        child = struct.unpack_from("<Q", body, at + key)[0]
        if level:
            yield from _children(read, child, key)
        else:
            yield body[at : at + key], child


def _members(read: ReadAt, header: int) -> dict[str, int]:
    """Object headers of a group's members by name; none for what is no group."""
    for kind, data in _messages(read, header):
        if kind == GROUP:
            tree, heap = struct.unpack("<QQ", data[:16])
            size, _, at = struct.unpack("<QQQ", read(heap + 8, 24))
            names, out = read(at, size), {}
            for _, node in _children(read, tree, 8):
                count = struct.unpack("<H", read(node + 6, 2))[0]
                for name, own in struct.iter_unpack("<QQ24x", read(node + 8, 40 * count)):
                    out[names[name : names.index(b"\0", name)].decode()] = own
            return out
    return {}


def _dataset(read: ReadAt, header: int) -> Dataset | None:
    found = dict(_messages(read, header))
    if not {SPACE, TYPE, LAYOUT} <= set(found):
        return None
    space, layout = found[SPACE], found[LAYOUT]
    skip = {1: 8, 2: 4}[space[0]]
    out = Dataset(struct.unpack_from(f"<{space[1]}Q", space, skip), _dtype(found[TYPE]))
    if layout[0] != 3:
        raise ValueError("a layout of another version")
    if layout[1] == 1:
        out.at = struct.unpack_from("<Q", layout, 2)[0]
    elif layout[1] == 2:
        n = layout[2]
        tree, *dims = struct.unpack_from(f"<Q{n}I", layout, 3)
        out.chunk = tuple(dims[:-1])
        if FILTERS in found:
            data, at = found[FILTERS], 8
            for _ in range(data[1]):
                kind, name, _, values = struct.unpack_from("<HHHH", data, at)
                at += 8 + (name + 7) // 8 * 8 + 4 * (values + values % 2)
                out.filters += (kind,)
            if not set(out.filters) <= {DEFLATE, SHUFFLE}:
                raise ValueError(f"filters {out.filters}; deflate and shuffle are read")
        for key, at in _children(read, tree, 8 + 8 * n) if tree != NOWHERE else ():
            size, mask = struct.unpack_from("<II", key)
            out.chunks.append((struct.unpack_from(f"<{n - 1}Q", key, 8), at, size, mask))
    else:
        raise ValueError("a compact layout")
    return out


def datasets(read: ReadAt, group: str) -> dict[str, Dataset]:
    """The datasets of a group, such as a/b, by name."""
    head = read(0, 96)
    if head[:8] != SIGNATURE or head[8] > 1:
        raise ValueError("not an HDF5 file of the early format")
    at = struct.unpack_from("<Q", head, 64 + 4 * head[8])[0]
    for name in filter(None, group.split("/")):
        at = _members(read, at)[name]
    found = {name: _dataset(read, own) for name, own in _members(read, at).items()}
    return {name: d for name, d in found.items() if d is not None}


def rows_of(read: ReadAt, d: Dataset, low: int, high: int) -> np.ndarray:
    """Rows low to high as (rows, columns): only the bytes or chunks that hold them are read."""
    lines = int(np.prod(d.shape[:-1], dtype=np.int64))
    out = np.zeros((lines, high - low), d.dtype)
    if d.chunk is None and d.at != NOWHERE:
        for k in range(lines):
            out[k] = np.frombuffer(read(d.at + (k * d.rows + low) * d.dtype.itemsize, (high - low) * d.dtype.itemsize), d.dtype)
        return out.T
    own = out.reshape(*d.shape[:-1], high - low)
    for offset, at, size, mask in d.chunks:
        a, b = max(offset[-1], low), min(offset[-1] + d.chunk[-1], high, d.rows)
        if a >= b:
            continue
        data = read(at, size)
        for k, kind in reversed(list(enumerate(d.filters))):
            if not mask >> k & 1:
                data = zlib.decompress(data) if kind == DEFLATE else np.frombuffer(data, np.uint8).reshape(d.dtype.itemsize, -1).T.tobytes()
        block = np.frombuffer(data, d.dtype).reshape(d.chunk)
        axes = tuple(slice(o, min(o + c, s)) for o, c, s in zip(offset[:-1], d.chunk[:-1], d.shape[:-1], strict=True))
        inner = tuple(slice(0, x.stop - x.start) for x in axes)
        own[(*axes, slice(a - low, b - low))] = block[(*inner, slice(a - offset[-1], b - offset[-1]))]
    return out.T


def _message(kind: int, data: bytes) -> bytes:
    data += b"\0" * (-len(data) % 8)
    return struct.pack("<HHB3x", kind, len(data), 0) + data


def _header(*messages: bytes) -> bytes:
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _type(dtype: np.dtype) -> bytes:
    if dtype.kind == "f":
        exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[dtype.itemsize]
        bits = 8 * dtype.itemsize
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits - 1, 0, dtype.itemsize, 0, bits, mantissa, exponent, 0, mantissa, bias)
    return struct.pack("<BBBBIHH", 0x10, 8 if dtype.kind == "i" else 0, 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)


class _Out:
    """Bytes that are laid down one after another; put() tells where."""

    def __init__(self) -> None:
        self.parts: list[bytes] = [b"\0" * 96]
        self.at = 96

    def put(self, data: bytes) -> int:
        at = self.at
        data += b"\0" * (-len(data) % 8)
        self.parts.append(data)
        self.at += len(data)
        return at


def _group(out: _Out, members: dict[str, int]) -> tuple[int, int, int]:
    """Object header, tree and heap of a group."""
    names = sorted(members, key=str.encode)
    if len(names) > 2 * LEAF_K:
        raise ValueError(f"more than {2 * LEAF_K} members of a group")
    heap, places = b"\0" * 8, []
    for name in names:
        places.append(len(heap))
        raw = name.encode() + b"\0"
        heap += raw + b"\0" * (-len(raw) % 8)
    entries = b"".join(struct.pack("<QQ24x", p, members[n]) for p, n in zip(places, names, strict=True))
    node = out.put(b"SNOD" + struct.pack("<BxH", 1, len(names)) + entries.ljust(80 * LEAF_K, b"\0"))
    keys = struct.pack("<QQQ", 0, node, places[-1] if places else 0)
    tree = out.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + keys.ljust(8 * (4 * TREE_K + 1), b"\0"))
    own = out.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, out.at + 32))
    out.put(heap)
    return out.put(_header(_message(GROUP, struct.pack("<QQ", tree, own)))), tree, own


def _chunked(out: _Out, values: np.ndarray, step: int) -> tuple[bytes, bytes]:
    """Layout and filter messages of a matrix (lines, rows), deflated by ranges of rows."""
    lines, rows = values.shape
    step = max(step, -(-rows // (2 * CHUNK_K)), 1)
    key = "<IIQQQ"
    body = b""
    for a in range(0, rows, step):
        block = np.zeros((lines, step), values.dtype)
        block[:, : min(step, rows - a)] = values[:, a : a + step]
        data = zlib.compress(block.tobytes(), 6)
        body += struct.pack(key, len(data), 0, 0, a, 0) + struct.pack("<Q", out.put(data))
    n = -(-rows // step)
    body += struct.pack(key, 0, 0, lines, n * step, 0)
    tree = out.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, n, NOWHERE, NOWHERE) + body.ljust(2 * CHUNK_K * 40 + 32, b"\0"))
    layout = struct.pack("<BBBQIII", 3, 2, 3, tree, lines, step, values.dtype.itemsize)
    return _message(LAYOUT, layout), _message(FILTERS, struct.pack("<BB6xHHHHII", 1, 1, DEFLATE, 0, 1, 1, 6, 0))


def written(group: str, columns: dict[str, np.ndarray], step: int = 4096) -> bytes:
    """A file with a group of datasets: vectors (rows,) as 1 x rows in one piece, matrices (rows, columns) deflated by ranges of step rows."""
    out, made = _Out(), {}
    for name, x in columns.items():
        lines = np.ascontiguousarray((x.reshape(1, -1) if x.ndim == 1 else x.T).astype(x.dtype.newbyteorder("<")))
        if x.ndim == 2 and lines.size:
            layout = _chunked(out, lines, step)
        else:
            layout = (_message(LAYOUT, struct.pack("<BBQQ", 3, 1, out.put(lines.tobytes()) if lines.size else NOWHERE, lines.nbytes)),)
        space = _message(SPACE, struct.pack("<BBBx4xQQ", 1, 2, 0, *lines.shape))
        made[name] = out.put(_header(space, _message(TYPE, _type(lines.dtype)), _message(FILL, struct.pack("<BBBB", 2, 2, 2, 0)), *layout))
    root, tree, heap = _group(out, {group: _group(out, made)[0]})
    head = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, LEAF_K, TREE_K, 0) + struct.pack("<QQQQ", 0, NOWHERE, out.at, NOWHERE)
    out.parts[0] = head + struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap)
    return b"".join(out.parts)
