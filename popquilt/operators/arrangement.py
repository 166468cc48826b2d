"""What edges enclose: edges cut where they meet, those that bound the inside, and rings made of them.

Coordinates are whole multiples of a cell's 2^-26, so that what two tasks find on a cell's
border is the same and sides are told exactly. A cell knows the winding number at a point of
its own; that anywhere else in it follows from the edges between, which are all in the cell.
All pairs of a cell's edges are compared, in slices of bounded size; cells should hold some
thousand edges at most.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from popquilt.operators import geometry as G

#: Units of a cell's side, as a power of two, and how far beyond a cell its edges are looked for.
BITS, SLACK = 26, 4
UNITS = 1 << BITS
#: Where in a cell the winding number is known, in doubled units: off all vertices, whose doubled coordinates are even.
REF = (2 * int(UNITS * 0.4142) + 1, 2 * int(UNITS * 0.7321) + 1)


def to_units(edges: np.ndarray, size: float) -> np.ndarray:
    """Edges as whole units of a cell of that size, without those that are points then."""
    whole = np.rint(edges * (UNITS / size)).astype(np.int64)
    return whole[(whole[:, :2] != whole[:, 2:]).any(axis=1)]


def raw_edges(parts: G.Parts) -> np.ndarray:
    """All rings' edges as they run."""
    return np.vstack([np.empty((0, 4)), *(np.hstack([r, np.roll(r, -1, axis=0)]) for rings in parts for r in rings if len(r))])


def place(edges: np.ndarray) -> list[tuple[int, int, int, np.ndarray | None]]:
    """(cx, cy, winding at the cell's point, edges of the cell) for the cells that edges touch, and without edges for those they go round."""
    out: list[tuple[int, int, int, np.ndarray | None]] = []
    if not len(edges):
        return out
    ax, ay, bx, by = edges.T.astype(float)
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    for cy in range(int((low.min() - SLACK) // UNITS), int((high.max() + SLACK) // UNITS) + 1):
        y0, y1 = cy * UNITS - SLACK, (cy + 1) * UNITS + SLACK
        near = np.flatnonzero((high >= y0) & (low <= y1))
        if not len(near):
            continue
        p, q, r, s = ax[near], ay[near], bx[near], by[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = np.where(s == q, 0.0, (y0 - q) / (s - q)).clip(0, 1), np.where(s == q, 1.0, (y1 - q) / (s - q)).clip(0, 1)
        u, v = p + t0 * (r - p), p + t1 * (r - p)
        start, stop = np.floor((np.minimum(u, v) - SLACK) / UNITS).astype(np.int64), np.floor((np.maximum(u, v) + SLACK) / UNITS).astype(np.int64)
        base, width = int(start.min()), int(stop.max() - start.min() + 1)
        level = cy * UNITS + REF[1] / 2
        cross = (q > level) != (s > level)
        at = p[cross] + (level - q[cross]) / (s[cross] - q[cross]) * (r[cross] - p[cross])
        order = np.argsort(at)
        behind = np.concatenate([np.cumsum(np.where(s[cross] > q[cross], 1, -1)[order][::-1])[::-1], [0]])  # windings right of each crossing
        winding = behind[np.searchsorted(at[order], (base + np.arange(width)) * UNITS + REF[0] / 2, "right")]
        by_cell = np.argsort(np.repeat(start, stop - start + 1) + _ramp(stop - start + 1), kind="stable")
        cell = (np.repeat(start, stop - start + 1) + _ramp(stop - start + 1))[by_cell] - base
        owner = np.repeat(near, stop - start + 1)[by_cell]
        cuts = np.searchsorted(cell, np.arange(width + 1))
        for k in range(width):
            own = owner[cuts[k] : cuts[k + 1]]
            if len(own) or winding[k]:
                out.append((base + k, cy, int(winding[k]), edges[own] if len(own) else None))
    return out


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _rows(count: int, wide: int, most: int = 1 << 22) -> list[slice]:
    """Slices of so many rows that a matrix with the other side stays small."""
    step = max(1, most // max(1, wide))
    return [slice(k, k + step) for k in range(0, count, step)]


def cut_at_each_other(edges: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The pieces within a box (closed) of edges cut where they cross or touch each other and where they cross the box's sides.

    All ends and crossings, rounded to whole units, are points. An edge goes through its own
    points and through any whose square of a unit it passes. Pieces then meet at ends only,
    and as points and edges do not depend on the box, boxes side by side agree.
    """
    edges = edges[np.lexsort(edges.T)]  # one order, so that a crossing is the same point in every box
    x0, y0, x1, y1 = box
    e = edges.astype(float)
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    # Products of differences are exact: whole numbers, or those of more bits where edges are long.
    exact = edges.astype(np.int64 if np.abs(edges[:, 2:] - edges[:, :2]).max() < 1 << 30 else np.longdouble)
    span = exact[:, 2:] - exact[:, :2]
    own = np.arange(len(edges))
    owners, points = [own, own], [edges[:, :2], edges[:, 2:]]
    for axis, limits in ((0, (x0, x1)), (1, (y0, y1))):
        for limit in limits:
            k = np.flatnonzero((lo[:, axis] < limit) & (hi[:, axis] > limit))
            at = np.floor(a[k] + d[k] * ((limit - a[k, axis]) / d[k, axis])[:, None] + 0.5).astype(np.int64)
            at[:, axis] = limit
            owners.append(k)
            points.append(at)
    for part in _rows(len(edges), len(edges)):
        meet = ((lo[part, None] <= hi[None]) & (hi[part, None] >= lo[None])).all(axis=2)
        i, j = np.nonzero(meet)
        i += part.start
        i, j = i[i < j], j[i < j]
        cross = span[i, 0] * span[j, 1] - span[i, 1] * span[j, 0]
        i, j, cross = i[cross != 0], j[cross != 0], cross[cross != 0]
        gap = exact[j, :2] - exact[i, :2]
        t, u = ((gap[:, 0] * span[j, 1] - gap[:, 1] * span[j, 0]) / cross).astype(float), ((gap[:, 0] * span[i, 1] - gap[:, 1] * span[i, 0]) / cross).astype(float)
        proper = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        at = np.floor(a[i[proper]] + d[i[proper]] * t[proper, None] + 0.5).astype(np.int64)
        owners += [i[proper], j[proper]]
        points += [at, at]
    owner, points = np.concatenate(owners), np.concatenate(points)
    near = (points[:, 0] >= x0 - SLACK) & (points[:, 0] <= x1 + SLACK) & (points[:, 1] >= y0 - SLACK) & (points[:, 1] <= y1 + SLACK)
    if not near.any():
        return np.empty((0, 4), np.int64)
    points, at = np.unique(points[near], axis=0, return_inverse=True)
    owner, at = [owner[near]], [at.ravel()]
    for part in _rows(len(edges), len(points)):
        close = ((points[None] >= lo[part, None] - 0.5) & (points[None] <= hi[part, None] + 0.5)).all(axis=2)
        i, j = np.nonzero(close)
        i += part.start
        off = points[j] - a[i]
        on = np.abs(off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) < (0.5 - 1e-6) * np.abs(d[i]).sum(axis=1)
        owner.append(i[on])
        at.append(j[on])
    owner, at = np.unique(np.column_stack([np.concatenate(owner), np.concatenate(at)]), axis=0).T
    along = ((points[at] - a[owner]) * d[owner]).sum(axis=1)
    order = np.lexsort((along, owner))
    owner, found = owner[order], points[at[order]]
    pieces = np.hstack([found[:-1], found[1:]])[owner[1:] == owner[:-1]]
    low, high = np.minimum(pieces[:, :2], pieces[:, 2:]), np.maximum(pieces[:, :2], pieces[:, 2:])
    return pieces[(low >= [x0, y0]).all(axis=1) & (high <= [x1, y1]).all(axis=1)]


def _turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Positive where r is left of the way from p to q; exact for whole numbers within a cell."""
    return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])


def _change(pieces: np.ndarray, start: np.ndarray, ends: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """By how much the winding number changes from a point to each of others; pieces and points are doubled. ``skip`` leaves out pieces for each point."""
    p, q = pieces[None, :, :2], pieces[None, :, 2:]
    s, m = start[None, None], ends[:, None]
    there, here = _turn(s, m, p) >= 0, _turn(s, m, q) >= 0
    left, then = _turn(p, q, s) > 0, _turn(p, q, m) > 0
    crossed = (there != here) & (left != then)
    if skip is not None:
        crossed &= ~skip
    return np.where(crossed, np.where(left, -1, 1), 0).sum(axis=1)


def bounding(edges: np.ndarray, winding: int, box: tuple[int, int, int, int], at: tuple[int, int], odd: bool = False) -> np.ndarray:
    """The pieces in a box that part inside from outside, the inside on their left.

    ``winding`` is that of all edges (also those elsewhere) at a point, in doubled units, of
    the box. Inside is where it is above 0 or, with ``odd``, odd; then the direction of edges
    does not matter. Pieces on the box's left and lower sides are its own.
    """
    x0, y0, x1, y1 = box
    near = (np.minimum(edges[:, 0], edges[:, 2]) <= x1 + SLACK) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0 - SLACK) & (np.minimum(edges[:, 1], edges[:, 3]) <= y1 + SLACK) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0 - SLACK)
    edges = edges[near]
    if not len(edges):
        return np.empty((0, 4), np.int64)
    pieces = cut_at_each_other(edges, box)
    if not len(pieces):
        return pieces
    flip = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    straight = np.where(flip[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    one, of = np.unique(straight, axis=0, return_inverse=True)
    of = of.ravel()
    net = np.bincount(of, np.where(flip, -1, 1), len(one)).astype(np.int64)  # how much more the winding is on the left
    middle = one[:, :2] + one[:, 2:]
    start = np.array(at)
    change = np.zeros(len(one), np.int64)
    for part in _rows(len(one), len(pieces), 1 << 21):
        change[part] = _change(2 * pieces, start, middle[part], np.arange(len(one))[part, None] == of[None])
    before = winding + change  # on the side where the cell's point is
    on_left = _turn(2 * one[:, :2], 2 * one[:, 2:], start) > 0
    left = np.where(on_left, before, before + net)
    right = np.where(on_left, before - net, before)
    if odd:
        left, right = left % 2, right % 2
    within, beyond = left > 0, right > 0
    mine = (middle[:, 0] >= 2 * x0) & (middle[:, 0] < 2 * x1) & (middle[:, 1] >= 2 * y0) & (middle[:, 1] < 2 * y1)
    keep = (within != beyond) & mine
    return np.where(within[keep, None], one[keep], one[keep][:, [2, 3, 0, 1]])


def rings_of(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed edges, the inside on their left; where several leave a point, the ring turns as far left as it can."""
    points, ids = np.unique(edges.reshape(-1, 2), axis=0, return_inverse=True)
    ids = ids.reshape(-1, 2)
    leaving: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(ids[:, 0].tolist()):
        leaving[s].append(k)
    way = np.arctan2(edges[:, 3] - edges[:, 1], edges[:, 2] - edges[:, 0])
    ends, used, rings = ids[:, 1].tolist(), np.zeros(len(edges), bool), []
    for first in range(len(edges)):
        if used[first]:
            continue
        ring, k = [], first
        while not used[k]:
            used[k] = True
            ring.append(k)
            after = [n for n in leaving[ends[k]] if not used[n] or n == first]
            if not after:
                raise ValueError("edges do not close")
            if len(after) > 1:  # the first one clockwise from the way back
                back = way[k] + np.pi
                k = min(after, key=lambda n: (back - way[n]) % (2 * np.pi) or 2 * np.pi)
            else:
                k = after[0]
        rings.append(points[ids[ring, 0]])
    return rings


def _without_cuts(ring: np.ndarray) -> np.ndarray:
    """The ring without points that only a cell's side put on a straight edge."""
    sided = (ring % UNITS == 0).any(axis=1)
    if not sided.any() or sided.all():
        return ring
    ring, sided = (np.roll(x, -int(np.argmin(sided)), axis=0) for x in (ring, sided))  # the first one stays
    kept = [ring[0]]
    for k in range(1, len(ring)):
        before, after = kept[-1].astype(float), ring[(k + 1) % len(ring)].astype(float)  # of two points near a corner one stays
        d, off = after - before, ring[k] - before
        length = np.hypot(*d)
        if not sided[k] or length == 0 or abs(off[0] * d[1] - off[1] * d[0]) > 2 * length or not 0 < off @ d < length * length:
            kept.append(ring[k])
    return np.array(kept) if len(kept) >= 3 else ring


def polygons_of(edges: np.ndarray, size: float) -> G.Parts:
    """Polygons of directed edges in units, with their holes."""
    unit = size / UNITS
    rings = [_without_cuts(r) for r in rings_of(edges)]
    signed = []
    for r in rings:
        x, y = (r - r[0]).astype(float).T
        signed.append(float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)
    outer = [k for k, s in enumerate(signed) if s > 0]
    parts = [[rings[k] * unit] for k in outer]
    order = sorted(range(len(outer)), key=lambda k: signed[outer[k]])
    spans = [(rings[k].min(axis=0), rings[k].max(axis=0)) for k in outer]
    for k, s in enumerate(signed):
        if s >= 0:
            continue
        r = rings[k].astype(float)
        middles = (r + np.roll(r, -1, axis=0)) / 2
        for at in order:  # the smallest ring around it
            if (spans[at][0] <= r.min(axis=0)).all() and (spans[at][1] >= r.max(axis=0)).all() and signed[outer[at]] > -s:
                if G.contains([[rings[outer[at]].astype(float)]], *middles.T).mean() > 0.5:
                    parts[at].append(rings[k] * unit)
                    break
    return parts


# Many small groups of edges at a time: the same points, pieces and sides as above, found by sweeps over all groups

#: Cells that are worked on together (their number goes into keys), squares of their edges, and the edges of a cell and cells of a polygon beyond which it goes alone.
TOGETHER, PAIRS, CROWDED, SPREAD = 512, 1 << 22, 1 << 10, 64


def place_many(edges: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of polygons (``owner``, ascending) by cell: (polygon, cx, cy, winding) of the cells that have edges, (edge, cell) of these, and the polygons left out, which touch many cells."""
    has = np.bincount(owner, minlength=count)
    start = (np.cumsum(has) - has)[has > 0]
    own = np.flatnonzero(has)
    low, high = np.minimum(edges[:, :2], edges[:, 2:]) - SLACK, np.maximum(edges[:, :2], edges[:, 2:]) + SLACK
    none = np.empty((0, 2), np.int64)
    first = np.minimum.reduceat(low, start) >> BITS if len(own) else none
    last = np.maximum.reduceat(high, start) >> BITS if len(own) else none
    wide, tall = (last - first + 1).T
    left_out = own[wide * tall > SPREAD]
    fits = wide * tall <= SPREAD
    own, first, wide, n = own[fits], first[fits], wide[fits], (wide * tall)[fits]
    at, k = np.repeat(np.arange(len(own)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    polygon, cx, cy = own[at], first[at, 0] + k % wide[at], first[at, 1] + k // wide[at]
    # Every edge of a polygon with every cell of it.
    m, begin = has[polygon], (np.cumsum(has) - has)[polygon]
    cell, edge = np.repeat(np.arange(len(polygon)), m), np.repeat(begin, m) + _ramp(m)
    ax, ay, bx, by = edges[edge].T.astype(float)
    level, ref = (cy * UNITS + REF[1] / 2)[cell], (cx * UNITS + REF[0] / 2)[cell]
    cross = np.flatnonzero((ay > level) != (by > level))
    c = cross[ax[cross] + (level[cross] - ay[cross]) / (by[cross] - ay[cross]) * (bx[cross] - ax[cross]) > ref[cross]]
    winding = np.bincount(cell[c], np.where(by[c] > ay[c], 1, -1), len(polygon)).astype(np.int64)
    x0, y0 = (cx << BITS)[cell], (cy << BITS)[cell]
    near = (low[edge, 0] <= x0 + UNITS) & (high[edge, 0] >= x0) & (low[edge, 1] <= y0 + UNITS) & (high[edge, 1] >= y0)
    edge, cell = edge[near], cell[near]
    some, cell = np.unique(cell, return_inverse=True)
    return polygon[some], cx[some], cy[some], winding[some], edge, cell.ravel(), left_out


def cut_many(edges: np.ndarray, cell: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``cut_at_each_other`` for at most TOGETHER cells: (points, their cells, first and last point of each piece); points ascend by cell, x and y."""
    order = np.lexsort((*edges.T, cell))
    edges, cell = edges[order], cell[order]
    corner = np.column_stack([x0, y0])[cell]
    e = edges.astype(float)
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    span = edges[:, 2:] - edges[:, :2]
    far = np.abs(span).max(axis=1) >= 1 << 30
    own = np.arange(len(edges))
    owners, points = [own, own], [edges[:, :2], edges[:, 2:]]
    for axis in range(2):
        for limit in (corner[:, axis], corner[:, axis] + UNITS):
            k = np.flatnonzero((lo[:, axis] < limit) & (hi[:, axis] > limit))
            at = np.floor(a[k] + d[k] * ((limit[k] - a[k, axis]) / d[k, axis])[:, None] + 0.5).astype(np.int64)
            at[:, axis] = limit[k]
            owners.append(k)
            points.append(at)
    # Pairs that meet near the cell: neighbours in the order of their left ends there.
    left, right = np.maximum(lo[:, 0] - corner[:, 0], -SLACK - 2) + SLACK + 2, np.minimum(hi[:, 0] - corner[:, 0], UNITS + SLACK + 2) + SLACK + 2
    key = (cell << 28) + left
    turn = np.argsort(key, kind="stable")
    n = np.maximum(np.searchsorted(key[turn], ((cell << 28) + right)[turn], "right") - np.arange(len(turn)) - 1, 0)
    first = np.repeat(np.arange(len(turn)), n)
    i, j = turn[first], turn[first + 1 + _ramp(n)]
    meet = (lo[i, 1] <= hi[j, 1]) & (hi[i, 1] >= lo[j, 1])
    i, j = np.minimum(i[meet], j[meet]), np.maximum(i[meet], j[meet])
    for some, kind in ((~(far[i] | far[j]), np.int64), (far[i] | far[j], np.longdouble)):
        k, m = i[some], j[some]
        s, r = span[k].astype(kind), span[m].astype(kind)
        cross = s[:, 0] * r[:, 1] - s[:, 1] * r[:, 0]
        k, m, s, r, cross = (v[cross != 0] for v in (k, m, s, r, cross))
        gap = (edges[m, :2] - edges[k, :2]).astype(kind)
        t, u = ((gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / cross).astype(float), ((gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / cross).astype(float)
        proper = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        at = np.floor(a[k[proper]] + d[k[proper]] * t[proper, None] + 0.5).astype(np.int64)
        owners += [k[proper], m[proper]]
        points += [at, at]
    owner, points = np.concatenate(owners), np.concatenate(points)
    local = points - corner[owner] + SLACK
    near = ((local >= 0) & (local <= UNITS + 2 * SLACK)).all(axis=1)
    owner, local = owner[near], local[near]
    place, at = np.unique((cell[owner] << 54) + (local[:, 0] << 27) + local[:, 1], return_inverse=True)
    of = place >> 54
    points = np.column_stack([(place >> 27) & ((1 << 27) - 1), place & ((1 << 27) - 1)]) - SLACK + np.column_stack([x0, y0])[of]
    # Points that edges pass.
    begin = np.searchsorted(place, (cell << 54) + (np.clip(lo[:, 0] - corner[:, 0] + SLACK, 0, UNITS + 2 * SLACK + 1) << 27))
    end = np.searchsorted(place, (cell << 54) + (np.clip(hi[:, 0] - corner[:, 0] + SLACK + 1, 0, UNITS + 2 * SLACK + 1) << 27))
    n = np.maximum(end - begin, 0)
    i, j = np.repeat(own, n), np.repeat(begin, n) + _ramp(n)
    close = (points[j, 1] >= lo[i, 1]) & (points[j, 1] <= hi[i, 1])
    i, j = i[close], j[close]
    off = points[j] - a[i]
    on = np.abs(off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) < (0.5 - 1e-6) * np.abs(d[i]).sum(axis=1)
    wide = max(1, len(points))
    owner, at = np.divmod(np.unique(np.concatenate([owner, i[on]]) * wide + np.concatenate([at.ravel(), j[on]])), wide)
    along = ((points[at] - a[owner]) * d[owner]).sum(axis=1)
    order = np.lexsort((along, owner))
    owner, at = owner[order], at[order]
    within = ((points >= corner_of(x0, y0, of)) & (points <= corner_of(x0, y0, of) + UNITS)).all(axis=1)
    kept = (owner[1:] == owner[:-1]) & within[at[:-1]] & within[at[1:]]
    return points, of, at[:-1][kept], at[1:][kept]


def corner_of(x0: np.ndarray, y0: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.column_stack([x0[cell], y0[cell]])


def _turns(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0])


def bounding_many(edges: np.ndarray, cell: np.ndarray, winding: np.ndarray, x0: np.ndarray, y0: np.ndarray, odd: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``bounding`` for at most TOGETHER cells: (pieces, their cells).

    The winding number goes from the cell's point up or down to the height of a piece's
    middle, a hair above it, and from there sideways; only pieces at these heights are looked at.
    """
    points, of, start, stop = cut_many(edges, cell, x0, y0)
    flip, wide = start > stop, max(1, len(points))
    one, back = np.unique(np.minimum(start, stop) * wide + np.maximum(start, stop), return_inverse=True)
    net = np.bincount(back.ravel(), np.where(flip, -1, 1), len(one)).astype(np.int64)
    i, j = np.divmod(one, wide)
    c = of[i]
    local = 2 * (points - corner_of(x0, y0, of))
    p, q = local[i], local[j]
    x, y = ((p + q) // 2).T
    rx, ry = REF[0], REF[1]
    order = np.argsort((c << 29) + y, kind="stable")
    heights, cells = ((c << 29) + y)[order], c[order]
    value = winding[c]
    # Up or down at the point's x.
    k = np.flatnonzero((p[:, 0] < rx) & (q[:, 0] > rx) & (net != 0))
    begin, end = np.searchsorted(cells, c[k], "left"), np.searchsorted(cells, c[k], "right")
    k, begin, n = np.repeat(k, end - begin), np.repeat(begin, end - begin), end - begin
    m = order[begin + _ramp(n)]
    above = (_turns(p[k], q[k], np.full(len(k), rx), y[m]) >= 0).astype(np.int64) - (_turns(p[k], q[k], np.full(len(k), rx), np.full(len(k), ry)) > 0)
    value = value + np.bincount(m, above * net[k], len(one)).astype(np.int64)
    # Sideways.
    k = np.flatnonzero((p[:, 1] != q[:, 1]) & (net != 0))
    up = np.where(q[:, 1] > p[:, 1], net, -net)
    bottom, top = np.where((q[:, 1] > p[:, 1])[:, None], p, q), np.where((q[:, 1] > p[:, 1])[:, None], q, p)
    begin, end = np.searchsorted(heights, (c[k] << 29) + bottom[k, 1], "left"), np.searchsorted(heights, (c[k] << 29) + top[k, 1], "left")
    k, begin, n = np.repeat(k, end - begin), np.repeat(begin, end - begin), end - begin
    m = order[begin + _ramp(n)]
    at = _turns(bottom[k], top[k], np.full(len(k), rx), y[m])
    left = (_turns(bottom[k], top[k], x[m], y[m]) > 0).astype(np.int64) - ((at > 0) | ((at == 0) & (top[k, 0] > bottom[k, 0])))
    value = value + np.bincount(m, left * up[k], len(one)).astype(np.int64)
    rising = q[:, 1] > p[:, 1]
    on_left = np.where(rising, value + net, value)
    on_right = on_left - net
    if odd:
        on_left, on_right = on_left % 2, on_right % 2
    keep = ((on_left > 0) != (on_right > 0)) & (x >= 0) & (x < 2 * UNITS) & (y >= 0) & (y < 2 * UNITS)
    inside = (on_left > 0)[keep]
    a, b = np.where(inside, i[keep], j[keep]), np.where(inside, j[keep], i[keep])
    return np.hstack([points[a], points[b]]), c[keep]


def chunks(cell: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Ranges of cells to be worked on together."""
    work = np.bincount(cell, minlength=count) ** 2
    out, at, held = [], 0, 0
    for k, w in enumerate(work.tolist()):
        if k > at and (k - at >= TOGETHER or held + w > PAIRS):
            out.append((at, k))
            at, held = k, 0
        held += w
    return [*out, (at, count)] if count else []


def enclosed_many(edges: np.ndarray, owner: np.ndarray, count: int, size: float, odd: bool) -> G.Flat:
    """What the edges of each of many polygons enclose, as rings of a column; ``owner`` ascends."""
    polygon, cx, cy, winding, edge, cell, left_out = place_many(edges, owner, count)
    order = np.argsort(cell, kind="stable")
    edge, cell = edge[order], cell[order]
    bounds = np.searchsorted(cell, np.arange(len(polygon) + 1))
    x0, y0 = cx << BITS, cy << BITS
    found, owners = [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]
    for first, last in chunks(cell, len(polygon)):
        own = slice(bounds[first], bounds[last])
        if last - first == 1 and bounds[last] - bounds[first] > CROWDED:
            box = (int(x0[first]), int(y0[first]), int(x0[first]) + UNITS, int(y0[first]) + UNITS)
            kept = bounding(edges[edge[own]], int(winding[first]), box, (2 * box[0] + REF[0], 2 * box[1] + REF[1]), odd)
            of = np.full(len(kept), first)
        else:
            kept, of = bounding_many(edges[edge[own]], cell[own] - first, winding[first:last], x0[first:last], y0[first:last], odd)
            of = of + first
        found.append(kept)
        owners.append(polygon[of])
    for k in left_out.tolist():
        for x, y, w, own in place(edges[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]):
            if own is not None:
                box = (x << BITS, y << BITS, (x + 1) << BITS, (y + 1) << BITS)
                found.append(bounding(own, w, box, (2 * box[0] + REF[0], 2 * box[1] + REF[1]), odd))
                owners.append(np.full(len(found[-1]), k))
    kept, of = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return rings_many(kept[order], of[order], size)


def rings_many(kept: np.ndarray, of: np.ndarray, size: float) -> G.Flat:
    """As ``polygons_of`` for each owner of edges. Where one ring goes through every point once it is read off directly."""
    unit = size / UNITS
    ends, whose = kept.reshape(-1, 2), np.repeat(of, 2)
    order = np.lexsort((ends[:, 1], ends[:, 0], whose))
    e, w = ends[order], whose[order]
    new = np.concatenate([[True], (e[1:] != e[:-1]).any(axis=1) | (w[1:] != w[:-1])])[: len(e)]
    ids = np.empty(len(e), np.int64)
    ids[order] = np.cumsum(new) - 1
    start, stop = ids[::2], ids[1::2]
    total = int(new.sum())
    single = (np.bincount(start, minlength=total) == 1) & (np.bincount(stop, minlength=total) == 1)
    leaving = np.zeros(total, np.int64)
    leaving[start] = np.arange(len(kept))
    following = leaving[stop].tolist()
    rows = np.unique(of)
    begin = np.append(np.searchsorted(of, rows), len(of)).tolist()
    plain = np.ones(len(rows), bool)
    plain[np.searchsorted(rows, of[~(single[start] & single[stop])])] = False
    points, sizes, row, part, hole = [np.empty((0, 2))], [], [], [], []
    for k, (r, a, b, simple) in enumerate(zip(rows.tolist(), begin[:-1], begin[1:], plain.tolist())):
        ring = []
        if simple:
            at = a
            while True:
                ring.append(at)
                at = following[at]
                if at == a:
                    break
        if len(ring) == b - a:
            xy = kept[ring, :2]
            parts = [[_without_cuts(xy) * unit]] if _positive(xy) else []
        else:
            parts = polygons_of(kept[a:b], size)
        for n, rings in enumerate(parts):
            points += rings
            sizes += [len(x) for x in rings]
            row += [r] * len(rings)
            part += [n] * len(rings)
            hole += [m > 0 for m in range(len(rings))]
    return np.concatenate(points), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]), np.array(row, np.int64), np.array(part, np.int64), np.array(hole, bool)


def _positive(ring: np.ndarray) -> bool:
    x, y = (ring - ring[0]).astype(float).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) > 0
