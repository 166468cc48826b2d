"""Vector geometry: WKB polygons in numpy, and the column functions on them.

Polygons are lists of rings, multipolygons lists of polygons; a ring is an array (n, 2) and
closes itself. Column functions take a WKB column and work on Arrow batches.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popquilt.operators.ranks import percentiles

Parts = list[list[np.ndarray]]
BOUNDS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")])


def read_wkb(data: bytes) -> Parts:
    """Polygon or multipolygon, either byte order, further ordinates and an SRID ignored."""
    parts: Parts = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if kind & 0x20000000:
            at += 4
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + (kind & 0xFFFF) // 1000 - ((kind & 0xFFFF) // 1000 == 2) - ((kind & 0xFFFF) // 1000 == 3)
        kind = (kind & 0xFFFF) % 1000
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == 6:
            for _ in range(n):
                at = read(at)
            return at
        if kind != 3:
            raise ValueError(f"geometry type {kind} is not a polygon")
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            at += 4
            ring = np.frombuffer(data, order + "f8", m * dims, at).reshape(m, dims)[:, :2].astype(float)
            at += m * dims * 8
            rings.append(ring[:-1] if m > 1 and (ring[0] == ring[-1]).all() else ring)
        parts.append(rings)
        return at

    read(0)
    return parts


def write_wkb(parts: Parts) -> bytes:
    """Little-endian polygon, or multipolygon if there is not one part."""
    polygons = []
    for rings in parts:
        body = b"".join(struct.pack("<I", len(r) + 1) + np.vstack([r, r[:1]]).astype("<f8").tobytes() for r in rings)
        polygons.append(struct.pack("<BII", 1, 3, len(rings)) + body)
    return polygons[0] if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons)


def box(x0: float, y0: float, x1: float, y1: float) -> Parts:
    return [[np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)]]


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def area(parts: Parts) -> float:
    return sum(ring_area(r[0]) - sum(map(ring_area, r[1:])) for r in parts if r)


def bounds(parts: Parts) -> tuple[float, float, float, float]:
    p = np.vstack([r[0] for r in parts])
    return (*p.min(0), *p.max(0))


def clip_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Sutherland and Hodgman's clipping of a ring to a rectangle."""
    for axis, limit, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if len(ring) == 0:
            break
        nxt = np.roll(ring, -1, axis=0)
        a, b = (ring[:, axis] - limit) * keep, (nxt[:, axis] - limit) * keep
        out = []
        for p, q, s, t in zip(ring, nxt, a, b):
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                cross = p + (q - p) * (s / (s - t))
                cross[axis] = limit
                out.append(cross)
        ring = np.array(out).reshape(-1, 2)
    return ring


def clip(parts: Parts, x0: float, y0: float, x1: float, y1: float) -> Parts:
    found = [[c for c in (clip_ring(r, x0, y0, x1, y1) for r in rings) if len(c) >= 3] for rings in parts]
    return [rings for rings in found if rings and ring_area(rings[0]) > 0]


def edges_of(parts: Parts) -> np.ndarray:
    """All rings' edges as rows (ax, ay, bx, by); outer rings run counter-clockwise, holes clockwise."""
    out = [np.empty((0, 4))]
    for rings in parts:
        for k, ring in enumerate(rings):
            x, y = (ring - ring[0]).T
            turn = float(x @ np.roll(y, -1) - y @ np.roll(x, -1))
            ring = ring if (turn >= 0) == (k == 0) else ring[::-1]
            out.append(np.hstack([ring, np.roll(ring, -1, axis=0)]))
    return np.vstack(out)


def inside_edges(edges: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Points inside, by crossings of a ray; edges are half open, so that neighbours share no point."""
    ax, ay, bx, by = edges[edges[:, 1] != edges[:, 3]].T
    out = np.zeros(len(x), dtype=bool)
    step = max(1, most // max(1, len(ax)))
    for at in range(0, len(x) if len(ax) else 0, step):
        px, py = x[at : at + step, None], y[at : at + step, None]
        crossed = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        out[at : at + step] = crossed.sum(1) % 2 == 1
    return out


def contains(parts: Parts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``inside_edges``, for points of any shape."""
    x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
    return inside_edges(edges_of(parts), x.ravel(), y.ravel()).reshape(x.shape)


def cells_of(edges: np.ndarray, size: float, first: int, last: int) -> list[tuple[int, int, np.ndarray | None]]:
    """(cx, cy, edges) of the cells in rows first to last that a polygon meets.

    Edges are None where the whole cell is inside. Elsewhere they are those that decide
    whether a point of the cell is: of the cell's row, and not left of it.
    """
    out: list[tuple[int, int, np.ndarray | None]] = []
    low_y, high_y, high_x = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 0], edges[:, 2])
    for cy in range(first, last + 1):
        y0, y1 = cy * size, (cy + 1) * size
        near = (high_y >= y0) & (low_y <= y1)
        if not near.any():
            continue
        own, right = edges[near], high_x[near]
        ax, ay, bx, by = own.T
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = np.where(by == ay, 0.0, (y0 - ay) / (by - ay)).clip(0, 1), np.where(by == ay, 1.0, (y1 - ay) / (by - ay)).clip(0, 1)
        p, q = ax + t0 * (bx - ax), ax + t1 * (bx - ax)
        slack = size * 1e-9
        start, stop = np.floor((np.minimum(p, q) - slack) / size).astype(np.int64), np.floor((np.maximum(p, q) + slack) / size).astype(np.int64)
        base, width = int(start.min()), int(stop.max() - start.min() + 1)
        touched = np.cumsum(np.bincount(start - base, minlength=width + 1) - np.bincount(stop - base + 1, minlength=width + 1))[:width] > 0
        middle = (y0 + y1) / 2
        cross = (ay > middle) != (by > middle)
        at = np.sort(ax[cross] + (middle - ay[cross]) / (by[cross] - ay[cross]) * (bx[cross] - ax[cross]))
        centres = (base + np.arange(width) + 0.5) * size
        full = ~touched & ((len(at) - np.searchsorted(at, centres, "right")) % 2 == 1)
        out += [(base + int(k), cy, None) for k in np.flatnonzero(full)]
        out += [(base + int(k), cy, own[right >= (base + k) * size - slack]) for k in np.flatnonzero(touched)]
    return out


def coverage(edges: np.ndarray, cell: float, x_origin: float, y_origin: float, first: int, last: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, rows, areas) of a grid's cells in rows first to last that the polygon of these edges covers.

    Edges are cut at the grid's lines; a piece of height dy adds dy times what lies right of
    it to its own cell, and dy times the width to all cells right of that.
    """
    ax, ay, bx, by = ((edges - [x_origin, y_origin] * 2) / cell).T
    keep = (np.maximum(ay, by) > first) & (np.minimum(ay, by) < last + 1) & (ay != by)
    ax, ay, bx, by = ax[keep], ay[keep], bx[keep], by[keep]
    none = np.empty(0, np.int64)
    if not len(ax):
        return none, none, np.empty(0)
    left, columns = int(np.floor(np.minimum(ax, bx).min())), 0
    columns = int(np.floor(np.maximum(ax, bx).max())) - left + 1
    if (last - first + 1) * columns > most and last > first:
        middle = (first + last) // 2
        halves = [coverage(edges, cell, x_origin, y_origin, a, b, most) for a, b in ((first, middle), (middle + 1, last))]
        return tuple(np.concatenate(x) for x in zip(*halves))
    owner, t = [np.arange(len(ax))] * 2, [np.zeros(len(ax)), np.ones(len(ax))]
    for a, b in ((ax, bx), (ay, by)):
        low, high = np.ceil(np.minimum(a, b)), np.floor(np.maximum(a, b))
        n = np.where(a == b, 0, np.maximum(0, high - low + 1)).astype(np.int64)
        own = np.repeat(np.arange(len(a)), n)
        line = low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner.append(own)
        t.append(((line - a[own]) / (b - a)[own]).clip(0, 1))
    owner, t = np.concatenate(owner), np.concatenate(t)
    order = np.lexsort((t, owner))
    owner, t = owner[order], t[order]
    piece = np.flatnonzero((owner[1:] == owner[:-1]) & (t[1:] > t[:-1]))
    o, t0, t1 = owner[piece], t[piece], t[piece + 1]
    x0, x1 = ax[o] + t0 * (bx - ax)[o], ax[o] + t1 * (bx - ax)[o]
    y0, y1 = ay[o] + t0 * (by - ay)[o], ay[o] + t1 * (by - ay)[o]
    row, col = np.floor((y0 + y1) / 2).astype(np.int64), np.floor((x0 + x1) / 2).astype(np.int64) - left
    mine = (row >= first) & (row <= last)
    row, col, dy, x = row[mine] - first, col[mine], (y1 - y0)[mine], ((x0 + x1) / 2)[mine] - left
    place, shape = row * (columns + 1) + col, (last - first + 1) * (columns + 1)
    here = np.bincount(place, dy * (col + 1 - x), shape).reshape(-1, columns + 1)
    beyond = np.cumsum(np.bincount(place + 1, dy, shape).reshape(-1, columns + 1), axis=1)
    covered = -(here + beyond)[:, :columns]  # counter-clockwise: the left sides run down
    r, c = np.nonzero(covered > 1e-9)
    return c + left, r + first, covered[r, c] * cell * cell


def near_edges(edges: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, distance: float, most: int = 1 << 19) -> np.ndarray:
    """Which boxes have an edge no farther than a distance; edges that cross a box are at distance 0."""
    out = np.zeros(len(x0), bool)
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    ax, ay, bx, by = edges.T
    dx, dy = bx - ax, by - ay
    length = np.maximum(dx * dx + dy * dy, 1e-300)
    step = max(1, most // max(1, len(edges)))
    for at in range(0, len(x0), step):
        u0, v0, u1, v1 = (c[at : at + step, None] for c in (x0, y0, x1, y1))
        # Only edges whose bounds are that near.
        k, e = np.nonzero((low[:, 0] <= u1 + distance) & (high[:, 0] >= u0 - distance) & (low[:, 1] <= v1 + distance) & (high[:, 1] >= v0 - distance))
        u0, v0, u1, v1 = (c[k, 0] for c in (u0, v0, u1, v1))
        best = np.full(len(k), np.inf)
        for px, py in ((ax[e], ay[e]), (bx[e], by[e])):  # ends to the box
            best = np.minimum(best, np.maximum(np.maximum(u0 - px, px - u1), 0) ** 2 + np.maximum(np.maximum(v0 - py, py - v1), 0) ** 2)
        for px, py in ((u0, v0), (u1, v0), (u1, v1), (u0, v1)):  # corners to the edge
            t = (((px - ax[e]) * dx[e] + (py - ay[e]) * dy[e]) / length[e]).clip(0, 1)
            best = np.minimum(best, (ax[e] + t * dx[e] - px) ** 2 + (ay[e] + t * dy[e] - py) ** 2)
        start, stop = np.zeros(len(k)), np.ones(len(k))
        for a, d, lo, hi in ((ax[e], dx[e], u0, u1), (ay[e], dy[e], v0, v1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                s, t = (lo - a) / d, (hi - a) / d
            level = d == 0
            start = np.where(level, np.where((a < lo) | (a > hi), 2, start), np.maximum(start, np.minimum(s, t)))
            stop = np.where(level, stop, np.minimum(stop, np.maximum(s, t)))
        hit = (best <= distance * distance) | (start <= stop)
        out[at + k[hit]] = True
    return out


def meets_box(parts: Parts, x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether a polygon has a point in common with a closed rectangle."""
    corners = contains(parts, np.array([x0, x1, x1, x0]), np.array([y0, y0, y1, y1]))
    if corners.any():
        return True
    for rings in parts:
        for ring in rings:
            if ((ring[:, 0] >= x0) & (ring[:, 0] <= x1) & (ring[:, 1] >= y0) & (ring[:, 1] <= y1)).any():
                return True
            p, d = ring, np.roll(ring, -1, axis=0) - ring
            low, high = np.zeros(len(p)), np.ones(len(p))
            for axis, lo, hi in ((0, x0, x1), (1, y0, y1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    s, t = (lo - p[:, axis]) / d[:, axis], (hi - p[:, axis]) / d[:, axis]
                level = d[:, axis] == 0
                off = level & ((p[:, axis] < lo) | (p[:, axis] > hi))
                low = np.where(level, np.where(off, 2, low), np.maximum(low, np.minimum(s, t)))
                high = np.where(level, high, np.minimum(high, np.maximum(s, t)))
            if (low <= high).any():
                return True
    return False


def distance_to_box(parts: Parts, x0: float, y0: float, x1: float, y1: float) -> float:
    """Least distance of a polygon and a rectangle: 0 if they meet. A buffer test is a comparison with it."""
    if meets_box(parts, x0, y0, x1, y1):
        return 0.0
    best = np.inf
    corners = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]])
    for rings in parts:
        for ring in rings:
            nxt = np.roll(ring, -1, axis=0)
            best = min(best, _points_to_edges(corners, ring, nxt), _points_to_edges(ring, corners, np.roll(corners, -1, axis=0)))
    return float(best)


def _points_to_edges(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    d = b - a
    length = np.maximum((d * d).sum(1), 1e-300)
    t = (((p[:, None] - a[None]) * d[None]).sum(2) / length).clip(0, 1)
    return float(np.sqrt((((a[None] + t[..., None] * d[None]) - p[:, None]) ** 2).sum(2)).min())


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


# Whole columns: points of all rings in one array, so that small polygons do not cost a call each

#: Columns of polygons: points (n, 2), where rings begin and end among them, and each ring's row, part of the row and whether it is a hole; rows ascend.
Flat = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_HEAD = np.frombuffer(struct.pack("<BII", 1, 3, 1), np.uint8)
#: Points of a row up to which hulls of rows with as many are made together.
HULL_TOGETHER = 64


def ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def read_column(wkb: pd.Series | pa.Array) -> Flat:
    """All rings of a column of polygons. Those of one ring in this module's byte order are read together, others one by one."""
    column = wkb if isinstance(wkb, pa.Array) else pa.array(wkb, pa.binary(), from_pandas=True)
    column = column.cast(pa.large_binary())
    known = np.flatnonzero(np.asarray(column.is_valid()))
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    length = np.diff(off)[known]
    points, sizes, row, part, hole, rest = [np.empty((0, 2))], [np.empty(0, np.int64)], [], [], [], []
    for size in np.unique(length):
        own = known[length == size]
        n = (int(size) - 13) // 16
        if n < 2 or n * 16 + 13 != size:
            rest.append(own)
            continue
        raw = data[off[own][:, None] + np.arange(size)]
        plain = (raw[:, :9] == _HEAD).all(axis=1) & (np.ascontiguousarray(raw[:, 9:13]).view("<u4")[:, 0] == n)
        rest.append(own[~plain])
        xy = np.ascontiguousarray(raw[plain, 13:]).view("<f8").reshape(-1, n, 2).astype(float)
        closed = (xy[:, 0] == xy[:, -1]).all(axis=1)
        for some, ends in ((closed, n - 1), (~closed, n)):
            if some.any():
                points.append(xy[some, :ends].reshape(-1, 2))
                sizes.append(np.full(some.sum(), ends))
                row.append(own[plain][some])
    count = sum(map(len, row))
    part, hole = [np.zeros(count, np.int64)], [np.zeros(count, bool)]
    for i in np.sort(np.concatenate([np.empty(0, np.int64), *rest])).tolist():
        for k, rings in enumerate(read_wkb(data[off[i] : off[i + 1]].tobytes())):
            points += rings
            sizes.append(np.array([len(r) for r in rings], np.int64))
            row.append(np.full(len(rings), i))
            part.append(np.full(len(rings), k))
            hole.append(np.arange(len(rings)) > 0)
    return _in_order(*map(np.concatenate, (points, sizes, [np.empty(0, np.int64), *row], part, hole)))


def _in_order(points: np.ndarray, sizes: np.ndarray, row: np.ndarray, part: np.ndarray, hole: np.ndarray) -> Flat:
    order = np.argsort(row, kind="stable")
    start, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    return points[np.repeat(start, n) + ramp(n)], np.concatenate([[0], np.cumsum(n)]), row[order], part[order], hole[order]


def write_column(flat: Flat, rows: int) -> list[bytes | None]:
    """The polygons of each row; None for a row without rings."""
    points, off, row, part, _ = flat
    out: list[bytes | None] = [None] * rows
    sizes, single = np.diff(off), np.bincount(row, minlength=rows)[row] == 1
    for size in np.unique(sizes[single]):
        own = np.flatnonzero(single & (sizes == size))
        xy = points[off[own][:, None] + np.append(np.arange(size), 0)].astype("<f8")
        head = np.frombuffer(_HEAD.tobytes() + struct.pack("<I", int(size) + 1), np.uint8)
        raw = np.hstack([np.broadcast_to(head, (len(own), 13)), xy.reshape(len(own), -1).view(np.uint8)])
        made, wide = raw.tobytes(), raw.shape[1]
        for k, i in enumerate(row[own].tolist()):
            out[i] = made[k * wide : (k + 1) * wide]
    many = np.flatnonzero(~single)
    for own in np.split(many, np.flatnonzero(np.diff(row[many])) + 1) if len(many) else []:
        parts: dict[int, list[np.ndarray]] = {}
        for k in own.tolist():
            parts.setdefault(int(part[k]), []).append(points[off[k] : off[k + 1]])
        out[int(row[own[0]])] = write_wkb(list(parts.values()))
    return out


def ring_areas(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Signed areas of rings, those that run counter-clockwise positive."""
    n = np.diff(off)
    ring, at = np.repeat(np.arange(len(n)), n), ramp(n)
    start = np.repeat(off[:-1], n)
    local = points - points[start]
    after = local[start + (at + 1) % np.repeat(n, n)]
    return (np.bincount(ring, local[:, 0] * after[:, 1], len(n)) - np.bincount(ring, local[:, 1] * after[:, 0], len(n))) / 2


def clip_column(flat: Flat, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Flat:
    """As ``clip``, for all rings; limits are given for each ring."""
    points, off, row, part, hole = flat
    n = np.diff(off)
    for axis, limit, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        ring, start = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
        nxt = start + (ramp(n) + 1) % np.repeat(n, n)
        s = (points[:, axis] - limit[ring]) * keep
        t = s[nxt]
        stays, crosses = s >= 0, (s >= 0) != (t >= 0)
        made = stays.astype(np.int64) + crosses
        at = np.cumsum(made) - made
        out = np.empty((int(made.sum()), 2))
        out[at[stays]] = points[stays]
        k = np.flatnonzero(crosses)
        cut = points[k] + (points[nxt[k]] - points[k]) * (s[k] / (s[k] - t[k]))[:, None]
        cut[:, axis] = limit[ring[k]]
        out[at[k] + stays[k]] = cut
        points, n = out, np.bincount(ring, made, len(n)).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    kept = n >= 3
    # A part is left while its first ring has area.
    new = np.flatnonzero(kept)
    first = np.concatenate([[True], (row[new][1:] != row[new][:-1]) | (part[new][1:] != part[new][:-1])])[: len(new)]
    area_ = np.abs(ring_areas(points, off))[new]
    whole = (area_[first] > 0)[np.cumsum(first) - 1] if len(new) else np.empty(0, bool)
    kept[new[~whole]] = False
    hole = hole.copy()
    hole[new] = ~first
    return points[np.repeat(kept, n)], np.concatenate([[0], np.cumsum(n[kept])]), row[kept], part[kept], hole[kept]


def _by_row(flat: Flat, known: np.ndarray, values: np.ndarray) -> pd.Series:
    """Sums of rings' values by row; None where the polygon is."""
    sums = np.bincount(flat[2], values, len(known))
    return pd.Series(np.where(known, sums, np.nan)).astype(object).where(known, None) if not known.all() else pd.Series(sums)


@F.pandas_udf(T.DoubleType())
def st_area(wkb: pd.Series) -> pd.Series:
    flat = read_column(wkb)
    own = np.abs(ring_areas(*flat[:2]))
    return _by_row(flat, wkb.notna().to_numpy(), np.where(flat[4], -own, own))


@F.pandas_udf(BOUNDS)
def st_bounds(wkb: pd.Series) -> pd.DataFrame:
    points, off, row, _, hole = read_column(wkb)
    n = np.where(hole, 0, np.diff(off))
    own = points[np.repeat(off[:-1], n) + ramp(n)]
    rows, first = np.unique(np.repeat(row, n), return_index=True)
    out = np.full((len(wkb), 4), np.nan)
    if len(rows):
        out[rows] = np.hstack([np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)])
    made = pd.DataFrame(out, columns=["minx", "miny", "maxx", "maxy"])
    return made if len(rows) == len(wkb) else made.astype(object).where(made.notna(), None)


@F.pandas_udf(T.BinaryType())
def st_clip(wkb: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """NULL where nothing is left."""
    flat = read_column(wkb)
    cut = clip_column(flat, *(b.to_numpy(float)[flat[2]] for b in (x0, y0, x1, y1)))
    return pd.Series(write_column(cut, len(wkb)), dtype=object)


def convex_hulls(points: np.ndarray) -> list[np.ndarray]:
    """Hulls of rows of as many points each (rows, points, 2), by the steps of ``convex_hull`` for all rows at a time."""
    count, m = points.shape[:2]
    order = np.lexsort((points[..., 1], points[..., 0]))
    p = np.take_along_axis(points, order[..., None], axis=1)
    rows = np.arange(count)

    def chain(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stack, size = np.empty((count, m, 2)), np.zeros(count, np.int64)
        for k in range(m):
            q, some = p[:, k], rows[size > 1]
            while len(some):
                a, b = stack[some, size[some] - 2], stack[some, size[some] - 1]
                d, e = b - a, q[some] - a
                some = some[d[:, 0] * e[:, 1] <= d[:, 1] * e[:, 0]]
                size[some] -= 1
                some = some[size[some] > 1]
            stack[rows, size] = q
            size += 1
        return stack, size - 1

    different = 1 + (p[:, 1:] != p[:, :-1]).any(axis=2).sum(axis=1)
    (low, i), (high, j) = chain(p), chain(p[:, ::-1])
    return [np.concatenate([low[k, : i[k]], high[k, : j[k]]]) if different[k] > 2 else convex_hull(p[k]) for k in range(count)]


@F.pandas_udf(T.BinaryType())
def st_hull(wkb: pd.Series) -> pd.Series:
    points, off, row, _, _ = read_column(wkb)
    rows, first = np.unique(row, return_index=True)
    start, stop = off[first], off[np.append(first[1:], len(row))]
    hulls: list[np.ndarray] = [np.empty((0, 2))] * len(rows)
    for m in np.unique(stop - start):
        own = np.flatnonzero(stop - start == m)
        if m > HULL_TOGETHER:
            found = [convex_hull(points[start[k] : stop[k]]) for k in own]
        else:
            found = convex_hulls(points[start[own][:, None] + np.arange(m)])
        for k, h in zip(own.tolist(), found):
            hulls[k] = h
    sizes, zero = np.array([len(h) for h in hulls], np.int64), np.zeros(len(rows), np.int64)
    made = (np.concatenate([np.empty((0, 2)), *hulls]), np.concatenate([[0], np.cumsum(sizes)]), rows, zero, zero > 0)
    return pd.Series(write_column(made, len(wkb)), dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def st_parts(wkb: pd.Series) -> pd.Series:
    points, off, row, part, hole = read_column(wkb)
    first = np.flatnonzero(~hole)
    parts = np.cumsum(~hole) - 1
    made = write_column((points, off, parts, parts * 0, hole), len(first))
    out: list[list | None] = [None if g is None else [] for g in wkb]
    for i, g in zip(row[first].tolist(), made):
        out[i].append(g)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def st_box(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    n = len(x0)
    corners = np.stack([v.to_numpy(float) for v in (x0, y0, x1, y0, x1, y1, x0, y1)], axis=1).reshape(-1, 2)
    return pd.Series(write_column((corners, np.arange(n + 1) * 4, np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)), n), dtype=object)


@F.arrow_udf(T.BinaryType())
def st_polygon(ring: pa.Array) -> pa.Array:
    """A polygon of one ring, an array of structs (x, y)."""
    known = np.flatnonzero(np.asarray(ring.is_valid()))
    n = ring.value_lengths().drop_null().to_numpy().astype(np.int64)
    corners = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in ring.flatten().flatten()])
    flat = (corners, np.concatenate([[0], np.cumsum(n)]), known, known * 0, known < 0)
    return pa.array(write_column(flat, len(ring)), pa.binary())


def count_corners(wkb: pd.Series) -> pd.Series:
    """Corners of all rings."""
    flat = read_column(wkb)
    return _by_row(flat, wkb.notna().to_numpy(), np.diff(flat[1]).astype(float)).map(lambda v: None if v is None else int(v))


def with_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds minx, miny, maxx and maxy as columns, which Parquet keeps statistics of."""
    return df.withColumn("_b", st_bounds(geometry)).select(*df.columns, "_b.*")


def meets_bounds(x0: float | Column, y0: float | Column, x1: float | Column, y1: float | Column) -> Column:
    """Filter on the bounds' columns; it is pushed to the scan for constant bounds."""
    return (F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1)


def bounds_of(x: None | tuple | bytes | Parts) -> tuple[float, float, float, float] | None:
    """Bounds from bounds, WKB or parts."""
    if x is None:
        return None
    if isinstance(x, tuple) and len(x) == 4:
        return tuple(map(float, x))
    if isinstance(x, (bytes, bytearray)):
        return bounds(read_wkb(bytes(x)))
    if isinstance(x, list):
        return bounds(x)
    raise TypeError(f"{type(x).__name__} has no bounds")


def working_crs(minx: Column, maxx: Column) -> Column:
    """The equal-area system for a block: the one about the anti-meridian where all of it is beyond 170 degrees."""
    return F.when((minx > 170) | (maxx < -170), "equal_area_anti_meridian").otherwise("equal_area")


def unwrapped(minx: Column, maxx: Column, threshold: float = 100.0) -> Column:
    """Longitude bounds (x0, x1) of a shape that may cross the anti-meridian: a span over the threshold goes the other way round."""
    wide = maxx - minx > threshold
    return F.when(wide, F.struct(maxx.alias("x0"), (minx + 360).alias("x1"))).otherwise(F.struct(minx.alias("x0"), maxx.alias("x1")))


def valid_spans(frame: DataFrame, slack: float = 1.001) -> DataFrame:
    """Adds ``valid``: the tile's width is under the median's by the slack; others were broken by a reprojection."""
    span = F.col("maxx") - F.col("minx")
    (middle,) = percentiles(frame.select(span.alias("span")), "span", [0.5])
    return frame.withColumn("valid", span < F.lit(middle).cast("double") * slack)
