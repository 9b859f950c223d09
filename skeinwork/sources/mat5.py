"""Structs of level-5 MAT files: fields of equal length as numpy columns, and back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Numbers of the file format, storage types and classes of arrays.
STORED = {1: "<i1", 2: "<u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8", 16: "<u1", 17: "<u2"}
CLASSES = {6: "<f8", 7: "<f4", 8: "<i1", 9: "<u1", 10: "<i2", 11: "<u2", 12: "<i4", 13: "<u4", 14: "<i8", 15: "<u8"}
MATRIX, COMPRESSED, CELL, STRUCT, CHAR = 14, 15, 1, 2, 4
INT8, UINT16, INT32, UINT32 = 1, 4, 5, 6


def elements(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(type, content) one after another; compressed ones are opened."""
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        elif kind == COMPRESSED:
            yield from elements(zlib.decompress(data[at + 8 : at + 8 + size]))
            at += 8 + size
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + -size % 8


def array(content: bytes) -> tuple[str, object]:
    """(name, value) of a matrix: numbers as numpy by their axes, text as a list of rows, cells as a list, a struct as a dict."""
    parts = elements(content)
    kind = next(parts)[1][0]
    dims = struct.unpack(f"<{len(d := next(parts)[1]) // 4}i", d)
    name = next(parts)[1].decode()
    if kind == STRUCT:
        width = struct.unpack("<i", next(parts)[1])[0]
        names = next(parts)[1]
        fields = [names[k : k + width].split(b"\0")[0].decode() for k in range(0, len(names), width)]
        return name, {f: array(body)[1] for f, (_, body) in zip(fields, parts, strict=False)}
    if kind == CELL:
        return name, [array(body)[1] for _, body in parts]
    stored, body = next(parts, (UINT16, b""))
    if kind == CHAR:
        if stored in (2, 16) and dims[0] <= 1:
            return name, [body.decode()] if body else [""] * dims[0]
        rows = np.frombuffer(body, STORED[stored]).reshape(dims, order="F")
        return name, [r.astype("<u2").tobytes().decode("utf-16-le") for r in rows]
    if kind not in CLASSES:
        raise ValueError(f"an array of class {kind}")
    return name, np.frombuffer(body, STORED[stored]).astype(CLASSES[kind]).reshape(dims, order="F")


def columns(data: bytes, group: str) -> dict[str, np.ndarray | list[str]]:
    """The fields of the struct of that name: vectors, matrices by row, or lists of text."""
    if data[124:128] != b"\0\1IM":
        raise ValueError("not a level-5 MAT file of little end")
    for kind, content in elements(data, 128):
        if kind == MATRIX:
            name, value = array(content)
            if name == group and isinstance(value, dict):
                return {f: _column(v) for f, v in value.items()}
    raise KeyError(f"no struct {group}")


def _column(value: object) -> np.ndarray | list[str]:
    if isinstance(value, list):  # cells of text, or text itself
        return ["".join(v) if isinstance(v, list) else str(np.asarray(v).ravel()[0]) if np.size(v) else "" for v in value] if any(not isinstance(v, str) for v in value) else value
    value = np.asarray(value)
    return value.ravel() if 1 in value.shape or value.ndim == 1 else value


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(kind: int, dims: tuple[int, ...], name: str, *content: bytes) -> bytes:
    head = _element(UINT32, struct.pack("<II", kind, 0)) + _element(INT32, struct.pack(f"<{len(dims)}i", *dims)) + _element(INT8, name.encode())
    return _element(MATRIX, head + b"".join(content))


def _numbers(x: np.ndarray) -> bytes:
    code = x.dtype.newbyteorder("<").str.replace("|", "<")
    kind = next(k for k, v in CLASSES.items() if v == code)
    stored = next(k for k, v in STORED.items() if v == code)
    rows = x.reshape(-1, 1) if x.ndim == 1 else x
    return _matrix(kind, rows.shape, "", _element(stored, rows.astype(code).tobytes(order="F")))


def _texts(x: list[str]) -> bytes:
    cells = [_matrix(CHAR, (min(1, len(t)), len(raw := t.encode("utf-16-le")) // 2), "", _element(UINT16, raw)) for t in x]
    return _matrix(CELL, (len(x), 1), "", *cells)


def written(group: str, fields: dict[str, np.ndarray | list[str]]) -> bytes:
    """A file with one deflated struct: numbers as vectors or matrices, text as cells."""
    names = [f.encode() for f in fields]
    width = max(map(len, names)) + 1
    length = struct.pack("<HHi", INT32, 4, width)
    body = [_texts(x) if isinstance(x, list) else _numbers(x) for x in fields.values()]
    made = _matrix(STRUCT, (1, 1), group, length, _element(INT8, b"".join(n.ljust(width, b"\0") for n in names)), *body)
    packed = zlib.compress(made)
    return b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + b"\0\1IM" + struct.pack("<II", COMPRESSED, len(packed)) + packed
