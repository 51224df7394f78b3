"""Kernels on arrow arrays of whole batches of reads, for column functions that built-in expressions express only base by base."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators import kernels

_HEX = np.frombuffer(b"0123456789ABCDEF", np.uint8)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and each value's length (0 for null)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]] if len(ends) else data[:0], np.diff(ends)


def _ends(sizes: np.ndarray, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(kind)


def _strings(data: np.ndarray, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(_ends(sizes)), pa.py_buffer(data.tobytes())).cast(pa.string())
    return pc.if_else(pc.is_valid(like), out, pa.scalar(None, pa.string())) if like.null_count else out


def _lists(values: np.ndarray, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    ends = pa.array(_ends(sizes, np.int32), mask=np.append(pc.is_null(like).to_numpy(zero_copy_only=False), False) if like.null_count else None)
    return pa.ListArray.from_arrays(ends, pa.array(values.astype(np.int32)))


def pack_hex(bases: pa.Array) -> pa.Array:
    flat, sizes = _flat(bases)
    packed, room = kernels.packed(flat, sizes)
    return _strings(np.stack([_HEX[packed >> 4], _HEX[packed & 15]], 1).reshape(-1), 2 * room, bases)


def unpack_hex(digits: pa.Array, lengths: pa.Array, positions: pa.Array) -> pa.Array:
    flat, _ = _flat(digits)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _strings(_marked(kernels.unpack(bytes.fromhex(flat.tobytes().decode()), sizes), sizes, positions), sizes, digits)


def overlaid(bases: pa.Array, positions: pa.Array) -> pa.Array:
    flat, sizes = _flat(bases)
    return _strings(_marked(flat, sizes, positions), sizes, bases)


def _marked(flat: np.ndarray, sizes: np.ndarray, positions: pa.Array) -> np.ndarray:
    """flat with an N at each value's positions."""
    out = flat.copy()
    many = pc.fill_null(pc.list_value_length(positions), 0).to_numpy(zero_copy_only=False)
    out[np.repeat(_ends(sizes)[:-1], many) + pc.list_flatten(positions).to_numpy(zero_copy_only=False)] = ord("N")
    return out


def ambiguous(bases: pa.Array, most: int) -> pa.Array:
    flat, sizes = _flat(bases)
    at = np.flatnonzero(kernels.unclear(flat))
    record = np.repeat(np.arange(len(sizes)), sizes)[at]
    place = at - _ends(sizes)[:-1][record]
    keep = place < most
    return _lists(place[keep], np.bincount(record[keep], minlength=len(sizes)), bases)


def delta(values: pa.Array) -> pa.Array:
    x, sizes = _numbers(values)
    out = np.diff(x, prepend=0)
    first = _ends(sizes)[:-1][sizes > 0]
    out[first] = x[first]
    return _lists(out & 255, sizes, values)


def undelta(values: pa.Array) -> pa.Array:
    x, sizes = _numbers(values)
    run = np.concatenate([[0], np.cumsum(x)])
    return _lists((run[1:] - np.repeat(run[_ends(sizes)[:-1]], sizes)) & 255, sizes, values)


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(values).to_numpy(zero_copy_only=False).astype(np.int64), sizes


def scrambled(bases: pa.Array, rows: pa.Array, seed: str) -> pa.Array:
    out = []
    for s, row in zip(bases.to_pylist(), rows.to_pylist(), strict=True):
        if s is None or row is None:
            out.append(None)
            continue
        start = md5(f"{seed}:{row}:".encode())
        keyed = []
        for i, c in enumerate(s):
            h = start.copy()
            h.update(b"%d" % i)
            keyed.append((h.digest(), c))
        keyed.sort()
        out.append("".join([c for _, c in keyed]))
    return pa.array(out, pa.string())
