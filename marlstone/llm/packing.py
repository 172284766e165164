"""Compact messages between tasks: byte planes of integer columns, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""


def pack(sorted_keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending keys as differences, columns as they are, booleans as bits."""
    steps = np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))
    raw = b"".join([_planes(steps), *(np.packbits(c).tobytes() if c.dtype == bool else _planes(c) for c in columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, *dtypes: type) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for dtype in dtypes:
        kind = np.dtype(dtype)
        if kind == bool:
            size = -(-n // 8)
            out.append(bits(raw[at : at + size], n))
        else:
            size = n * kind.itemsize
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
