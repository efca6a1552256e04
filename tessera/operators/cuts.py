"""Cuts of many convex polygons at once, in arrays: what ``space`` does with columns, for batches in tasks.

Polygons stand in arrays ``(polygons, corners, 2)`` with the number of corners of each; the places behind these are not read.
Simple shapes of as many edges are swept together (``decomposed``), others one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Edges of a shape that is swept with others, and numbers held by such a sweep.
EDGES, BLOCK = 24, 1 << 21


def flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a column of rings, and how many each has; NULL has none."""
    points = rings.flatten()
    return np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in range(2)], axis=1), rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def padded(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    points, n = flat(rings)
    out = np.zeros((len(n), max(1, int(n.max(initial=0))), 2))
    out[np.arange(out.shape[1]) < n[:, None]] = points
    return out, n


def ring_array(shape: np.ndarray, n: np.ndarray) -> pa.ListArray:
    points = shape[np.arange(shape.shape[1]) < n[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, c])) for c in range(2)], ["x", "y"]))


def _next(n: np.ndarray, corners: int) -> np.ndarray:
    after = np.arange(1, corners + 1)
    return np.where(after < n[:, None], after, 0)


def signed(shape: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the area, positive if counter-clockwise."""
    x, y = shape[..., 0], shape[..., 1]
    after = _next(n, shape.shape[1])
    terms = x * np.take_along_axis(y, after, 1) - np.take_along_axis(x, after, 1) * y
    return np.where(np.arange(shape.shape[1]) < n[:, None], terms, 0.0).sum(1)


def turned(shape: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The polygons counter-clockwise; those that are not are read backwards."""
    back = np.maximum(n[:, None] - 1 - np.arange(shape.shape[1]), 0)
    return np.where((signed(shape, n) < 0)[:, None, None], np.take_along_axis(shape, back[..., None], 1), shape)


def cut(shape: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What lies left of the edge from ``p`` to ``q`` of each polygon, the edge included; an edge of no length cuts nothing."""
    valid, after = np.arange(shape.shape[1]) < n[:, None], _next(n, shape.shape[1])
    way = q - p
    side = way[:, None, 0] * (shape[..., 1] - p[:, None, 1]) - way[:, None, 1] * (shape[..., 0] - p[:, None, 0])
    beyond = np.take_along_axis(side, after, 1)
    stays = valid & (side >= 0)
    meets = valid & ((side > 0) & (beyond < 0) | (side < 0) & (beyond > 0))
    size = stays.astype(np.int64) + meets
    at = np.cumsum(size, axis=1) - size
    left = size.sum(1)
    out = np.zeros((len(n), max(1, int(left.max(initial=0))), 2))
    row, k = np.nonzero(stays)
    out[row, at[row, k]] = shape[row, k]
    row, k = np.nonzero(meets)
    a, b, sa = shape[row, k], shape[row, after[row, k]], side[row, k][:, None]
    out[row, at[row, k] + stays[row, k]] = a + (b - a) * sa / (sa - beyond[row, k][:, None])
    return out, left


def _edge(ring: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the ``k``-th edge of each ring; of no length where there is none."""
    row = np.arange(len(n))
    p = ring[:, min(k, ring.shape[1] - 1)]
    q = ring[row, np.where(k + 1 < n, min(k + 1, ring.shape[1] - 1), 0)]
    return p, np.where((k < n)[:, None], q, p)


def clipped(shape: np.ndarray, n: np.ndarray, ring: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons inside convex rings."""
    ring = turned(ring, corners)
    for k in range(ring.shape[1]):
        shape, n = cut(shape, n, *_edge(ring, corners, k))
    return shape, n


def difference(shape: np.ndarray, n: np.ndarray, ring: np.ndarray, corners: np.ndarray, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex polygons without convex rings, as ``(row, pieces, corners of each)``: for each edge, what lies right of it and left of those before."""
    ring, found = turned(ring, corners), []
    for k in range(ring.shape[1]):
        p, q = _edge(ring, corners, k)
        away, m = cut(shape, n, q, p)
        rows = np.flatnonzero((k < corners) & (m > 2) & (np.abs(signed(away, m)) / 2 > least))
        found.append((rows, away[rows], m[rows]))
        shape, n = cut(shape, n, p, q)
    row, m = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
    out = np.zeros((len(row), max([1, *(f[1].shape[1] for f in found)]), 2))
    at = 0
    for rows, away, _ in found:
        out[at : at + len(rows), : away.shape[1]] = away
        at += len(rows)
    order = np.argsort(row, kind="stable")
    return row[order], out[order], m[order]


def nested(row: np.ndarray, rings: pa.ListArray, rows: int) -> pa.ListArray:
    """Rings (``row`` ascending) as a list for each of ``rows``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), rings)


def _strips(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``polygons.swept`` without union of many shapes with as many edges (``(shapes, edges, 4)``, lower end first): shape, corners, and which of these stay."""
    tiny = 1e-12 * (1 + np.abs(e).max(axis=(1, 2)))
    ys = np.sort(np.concatenate([e[..., 1], e[..., 3]], axis=1), axis=1)
    kept = np.c_[np.ones(len(e), bool), np.diff(ys, axis=1) > tiny[:, None]]
    # the heights that stay first, the last of them repeated: strips without height hold nothing
    ys = np.take_along_axis(ys, np.argsort(~kept, axis=1, kind="stable"), 1)
    count = kept.sum(1)
    ys = np.where(np.arange(ys.shape[1]) < count[:, None], ys, ys[np.arange(len(e)), count - 1][:, None])
    e = np.take_along_axis(e, np.argsort(e[..., 1], axis=1, kind="stable")[..., None], 1)
    slope = (e[..., 2] - e[..., 0]) / (e[..., 3] - e[..., 1])
    low, high = ys[:, :-1], ys[:, 1:]
    real = np.arange(low.shape[1]) < (count - 1)[:, None]
    middle = (low + high) / 2
    live = real[..., None] & (e[:, None, :, 1] < middle[..., None]) & (e[:, None, :, 3] > middle[..., None])
    at = lambda y: e[:, None, :, 0] + (y[..., None] - e[:, None, :, 1]) * slope[:, None]
    order = np.argsort(np.where(live, at(middle), np.inf), axis=2, kind="stable")
    n = live.sum(2)
    there = np.arange(e.shape[1]) < n[..., None]
    for y in (low, high):
        xs = np.where(there, np.take_along_axis(at(y), order, 2), np.inf)
        with np.errstate(invalid="ignore"):
            if (np.diff(xs, axis=2) < -1e3 * tiny[:, None, None]).any():
                raise ValueError("a ring crosses itself or another ring of its shape")
    if (n % 2).any():
        raise ValueError("a ring is not closed")
    shape, strip, pair = np.nonzero(there[..., ::2])
    left, right = order[shape, strip, 2 * pair], order[shape, strip, 2 * pair + 1]
    by = np.lexsort((strip, right, left, shape))
    shape, strip, left, right = shape[by], strip[by], left[by], right[by]
    new = np.r_[True, (shape[1:] != shape[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (strip[1:] != strip[:-1] + 1)] if len(shape) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(shape)][: len(starts)] - 1
    shape, left, right, bottom, top = shape[starts], left[starts], right[starts], low[shape[starts], strip[starts]], high[shape[starts], strip[ends]]
    x = lambda k, y: e[shape, k, 0] + (y - e[shape, k, 1]) * slope[shape, k]
    corners = np.stack([x(left, bottom), bottom, x(right, bottom), bottom, x(right, top), top, x(left, top), top], axis=1).reshape(-1, 4, 2)
    return shape, corners, np.abs(corners - np.roll(corners, 1, axis=1)).max(axis=2) > tiny[shape, None]


def decomposed(shapes: pa.ListArray, one) -> pa.ListArray:
    """Disjoint convex pieces of shapes, lists of rings by the even-odd rule; ``one`` sweeps a shape of many edges (a list of rings)."""
    rings = shapes.flatten()
    points, n = flat(rings)
    shape = np.repeat(np.arange(len(shapes)), shapes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    after = np.arange(len(points)) + 1
    after = np.where(after < (first + n)[of], after, first[of])
    e, row = np.c_[points, points[after]], shape[of]
    real = (n[of] > 2) & (e[:, 1] != e[:, 3])
    e, row = e[real], row[real]
    down = e[:, 3] < e[:, 1]
    e[down] = e[down][:, [2, 3, 0, 1]]
    edges = np.bincount(row, minlength=len(shapes))
    many = edges > EDGES
    many[row[~np.isfinite(e).all(1)]] = True
    found = [(np.empty(0, np.int64), np.empty((0, 4, 2)), np.empty((0, 4), bool))]
    begin = np.cumsum(edges) - edges
    for k in np.unique(edges[~many & (edges > 0)]):
        rows = np.flatnonzero(~many & (edges == k))
        step = max(1, BLOCK // (2 * int(k) ** 2))
        for part in (rows[a : a + step] for a in range(0, len(rows), step)):
            at, corners, keep = _strips(e[begin[part][:, None] + np.arange(k)])
            wide = keep.sum(1) > 2
            found.append((part[at[wide]], corners[wide], keep[wide]))
    for k in np.flatnonzero(many):
        # such a shape's trapezoids come as they are, triangles with a corner less
        own = [points[a : a + m] for a, m in zip(first[shape == k], n[shape == k], strict=True)]
        for ring in one(own):
            corners = np.zeros((1, 4, 2))
            corners[0, : len(ring)] = ring
            found.append((np.array([k]), corners, np.arange(4)[None] < len(ring)))
    row, corners, keep = (np.concatenate([f[k] for f in found]) for k in range(3))
    by = np.argsort(row, kind="stable")
    row, corners, keep = row[by], corners[by], keep[by]
    count = keep.sum(1)
    packed = np.take_along_axis(corners, np.argsort(~keep, axis=1, kind="stable")[..., None], 1)
    return nested(row, ring_array(packed, count), len(shapes))


def boxed(shape: np.ndarray, n: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons cut at the sides of a box, which the cuts meet exactly, so that neighbouring boxes agree on them."""
    for axis, border, way in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        valid, after = np.arange(shape.shape[1]) < n[:, None], _next(n, shape.shape[1])
        over = (shape[..., axis] - border) * way
        beyond = np.take_along_axis(over, after, 1)
        stays, meets = valid & (over >= 0), valid & (over * beyond < 0)
        if (stays == valid).all():
            continue
        size = stays.astype(np.int64) + meets
        at, n = np.cumsum(size, axis=1) - size, size.sum(1)
        out = np.zeros((len(n), max(1, int(n.max(initial=0))), 2))
        row, k = np.nonzero(stays)
        out[row, at[row, k]] = shape[row, k]
        row, k = np.nonzero(meets)
        a, b = shape[row, k], shape[row, after[row, k]]
        met = a + (b - a) * (over[row, k] / (over[row, k] - beyond[row, k]))[:, None]
        met[:, axis] = border
        out[row, at[row, k] + stays[row, k]] = met
        shape = out
    return shape, n


def sides(shape: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``polygons.edges_of`` the polygons, all counter-clockwise; those of fewer than three corners have none."""
    shape, n = shape[n > 2], n[n > 2]
    back = np.maximum(n[:, None] - 1 - np.arange(shape.shape[1]), 0)
    shape = np.where((signed(shape - shape[:, :1], n) < 0)[:, None, None], np.take_along_axis(shape, back[..., None], 1), shape)
    after = np.take_along_axis(shape, _next(n, shape.shape[1])[..., None], 1)
    e = np.concatenate([shape, after], axis=2)[np.arange(shape.shape[1]) < n[:, None]]
    e = e[e[:, 1] != e[:, 3]]
    down = e[:, 3] < e[:, 1]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return np.c_[e, np.where(down, 1.0, -1.0)]
