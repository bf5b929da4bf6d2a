"""Boxes as arrays: numpy over the buffers of WKB columns.

How two boxes lie is told by their corners, so a whole Arrow batch is judged at once.
Each function returns which rows it has judged, and an array of results; rows of other
geometries, and of corners that are near each other but not the same, are the kernel's.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

BOX, LINE, POINT = struct.pack("<BIII", 1, 3, 1, 5), struct.pack("<BII", 1, 2, 2), struct.pack("<BI", 1, 1)
#: Corners nearer than this, times the largest coordinate, might be the same to the kernel; it takes up to 1e-9.
NEAR = 1e-8
BOUNDS = pa.struct([*((n, pa.float64()) for n in ("x0", "y0", "x1", "y1")), ("box", pa.bool_())])


def _plain(col: pa.Array, head: bytes, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and coordinates of the rows that have this head and so many finite points."""
    size = len(head) + 16 * points
    if not pa.types.is_binary(col.type) or not len(col) or col.buffers()[2] is None:
        return np.empty(0, np.int64), np.empty((0, points, 2))
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    rows = np.flatnonzero((np.diff(at) == size) & col.is_valid().to_numpy(zero_copy_only=False))
    raw = np.frombuffer(col.buffers()[2], np.uint8)[at[rows][:, None] + np.arange(size)]
    mine = (raw[:, : len(head)] == np.frombuffer(head, np.uint8)).all(axis=1)
    p = raw[mine, len(head) :].copy().view("<f8").reshape(-1, points, 2)
    finite = np.isfinite(p).all(axis=(1, 2))
    return rows[mine][finite], p[finite]


def _set(n: int, rows: np.ndarray, p: np.ndarray, q: np.ndarray, ok: np.ndarray) -> np.ndarray:
    out = np.full((n, 4), np.nan)
    out[rows[ok]] = np.concatenate([np.minimum(p, q), np.maximum(p, q)], axis=1)[ok]
    return out


def boxes(col: pa.Array) -> np.ndarray:
    """x0, y0, x1, y1 of each row; NaN where that is no polygon of four sides along the axes."""
    rows, p = _plain(col, BOX, 5)
    turns = np.diff(p, axis=1) == 0  # per side, whether it keeps x, and y
    along = turns[:, :, 0] != turns[:, :, 1]
    ok = along.all(axis=1) & (turns[:, :-1, 0] != turns[:, 1:, 0]).all(axis=1) & (p[:, 0] == p[:, 4]).all(axis=1)
    return _set(len(col), rows, p[:, 0], p[:, 2], ok)


def lines(col: pa.Array) -> np.ndarray:
    """x0, y0, x1, y1 of each row; NaN where that is no line of two points along an axis."""
    rows, p = _plain(col, LINE, 2)
    same = p[:, 0] == p[:, 1]
    return _set(len(col), rows, p[:, 0], p[:, 1], same[:, 0] != same[:, 1])


def _clear(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where corners are the same or well apart, so that exact comparison says what the kernel says."""
    far = NEAR * np.maximum(1.0, np.abs(np.concatenate([p, q], axis=1)).max(axis=1, initial=0.0))[:, None]
    d = np.abs(p[:, [0, 0, 2, 2, 1, 1, 3, 3]] - q[:, [0, 2, 0, 2, 1, 3, 1, 3]])
    sides = np.concatenate([p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]], axis=1)
    return ((d == 0) | (d > far)).all(axis=1) & ((sides == 0) | (sides > far)).all(axis=1)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, :2] <= b[:, 2:]) & (b[:, :2] <= a[:, 2:])).all(axis=1)


def inside_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, :2] < b[:, 2:]) & (b[:, :2] < a[:, 2:])).all(axis=1)


def cover(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, :2] <= b[:, :2]) & (b[:, 2:] <= a[:, 2:])).all(axis=1)


def cover_inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, :2] < b[:, :2]) & (b[:, 2:] < a[:, 2:])).all(axis=1)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return inside_meet(a, b) & ~cover(a, b) & ~cover(b, a)


def related(rule: Callable) -> Callable:
    """A relation of two boxes."""

    def judge(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, pa.Array]:
        p, q = boxes(a), boxes(b)
        return _clear(p, q), pa.array(rule(p, q))

    return judge


def crosses(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lines and boxes, in either order: a line crosses where it is inside and outside."""
    done, out = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for line, box in ((a, b), (b, a)):
        p, q = lines(line), boxes(box)
        mine = _clear(p, q)
        done |= mine
        out |= mine & inside_meet(p, q) & ~cover(q, p)
    return done, pa.array(out)


def within_distance(a: pa.Array, b: pa.Array, d: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Boxes beside each other; of those that lie askew the kernel measures the corners."""
    p, q = boxes(a), boxes(b)
    if not pa.types.is_float64(d.type):
        return np.zeros(len(a), bool), pa.array(np.zeros(len(a), bool))
    most = d.to_numpy(zero_copy_only=False)
    gap = np.maximum(np.maximum(p[:, :2] - q[:, 2:], q[:, :2] - p[:, 2:]), 0.0)
    return _clear(p, q) & (gap.min(axis=1, initial=np.inf) == 0) & ~np.isnan(most), pa.array(gap.max(axis=1, initial=0.0) <= most)


def _numbers(*cols: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a number in all columns, and the numbers."""
    if not all(pa.types.is_floating(c.type) or pa.types.is_integer(c.type) for c in cols):
        return np.zeros(len(cols[0]), bool), np.zeros((len(cols[0]), len(cols)))
    v = np.stack([c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in cols], axis=1)
    return ~np.isnan(v).any(axis=1), v


def _wkb(head: bytes, p: np.ndarray) -> pa.Array:
    """Geometries of the same head and number of coordinates."""
    n, size = len(p), len(head) + 8 * p.shape[1]
    out = np.empty((n, size), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    out[:, len(head) :] = np.ascontiguousarray(p, "<f8").view(np.uint8).reshape(n, -1)
    at = np.arange(n + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(out)])


def made(*cols: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Boxes of x0, y0, x1, y1."""
    done, v = _numbers(*cols[:4])
    for c in cols[4:]:
        done &= _numbers(c)[0]
    return done, _wkb(BOX, v[:, [0, 1, 0, 3, 2, 3, 2, 1, 0, 1]])


def bounds(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds, of boxes and points."""
    v = boxes(col)
    rows, p = _plain(col, POINT, 1)
    v[rows] = np.concatenate([p[:, 0], p[:, 0]], axis=1)
    done = ~np.isnan(v[:, 0])
    return done, pa.StructArray.from_arrays([*(pa.array(v[:, i]) for i in range(4)), pa.array(done)], fields=list(BOUNDS))
