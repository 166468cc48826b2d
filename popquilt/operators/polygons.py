"""Polygons made of polygons: union, repair, buffers.

Polygons are cut to the cells of a grid, each cell's edges are cut at each other and those
kept that part inside from outside (see ``arrangement``), and a group's edges are joined to
rings. Cells of a group are worked on apart, so that a large group is spread over tasks until
its outline, which is one value in the end, is put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from popquilt.functions import projections as P
from popquilt.functions.constants import Crs
from popquilt.operators import arrangement as A
from popquilt.operators import geometry as G

#: Sides of the polygon that stands for a circle.
ROUND = 32
#: Bytes of a polygon that is worked on in one task; a larger one is cut to cells that go to several.
SMALL = 1 << 15
#: Degrees beyond which a polygon is taken to go round the other way, and the most pieces of an edge.
WIDE, MOST_PIECES = 180.0, 4096


#: Edges that are taken to cells together.
AT_ONCE = 1 << 14


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as the session shuffles to: polygons are few bytes and much work, so that a small file would be one task."""
    session = df.sparkSession
    return df.repartition(max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def _enclosed(polygons: DataFrame, by: list[str], size: float, edges_of: Callable[[G.Parts], np.ndarray], odd: bool) -> DataFrame:
    """(by, geometry): what the edges of each group enclose, without groups that enclose nothing."""
    keys = [polygons.schema[c] for c in by]
    cell = T.StructType([*keys, *(T.StructField(n, t) for n, t in (("_cx", T.LongType()), ("_cy", T.LongType()), ("_winding", T.LongType()), ("_edges", T.BinaryType())))])
    some = T.StructType([*keys, T.StructField("_edges", T.BinaryType())])
    whole = T.StructType([*keys, T.StructField("geometry", T.BinaryType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, wkb in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = A.place(A.to_units(edges_of(G.read_wkb(wkb)), size))
                if found:
                    cx, cy, winding, edges = zip(*found)
                    at = pa.array(np.full(len(found), i))
                    columns = [*(batch.column(k).take(at) for k in range(len(by))), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(winding, pa.int64()), pa.array([e if e is None else e.tobytes() for e in edges], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(cell))

    def solve(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        cx, cy = key[-2].as_py(), key[-1].as_py()
        edges = [np.frombuffer(e, np.int64).reshape(-1, 4) for e in group.column("_edges").to_pylist() if e is not None]
        box = (cx << A.BITS, cy << A.BITS, (cx + 1) << A.BITS, (cy + 1) << A.BITS)
        point = (2 * box[0] + A.REF[0], 2 * box[1] + A.REF[1])
        winding = sum(group.column("_winding").to_pylist())
        kept = A.bounding(np.concatenate(edges), winding, box, point, odd) if edges else []
        if not len(kept):
            return to_arrow_schema(some).empty_table()
        return pa.Table.from_arrays([*(pa.array([k.as_py()], f.type) for k, f in zip(key[: len(by)], to_arrow_schema(some))), pa.array([kept.tobytes()], pa.binary())], schema=to_arrow_schema(some))

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        edges = np.concatenate([np.frombuffer(e, np.int64).reshape(-1, 4) for e in group.column("_edges").to_pylist()])
        made = G.write_wkb(A.polygons_of(edges, size))
        return pa.Table.from_arrays([*(pa.array([k.as_py()], f.type) for k, f in zip(key[: len(by)], to_arrow_schema(whole))), pa.array([made], pa.binary())], schema=to_arrow_schema(whole))

    placed = polygons.filter(F.col("geometry").isNotNull()).select(*by, "geometry").mapInArrow(place, cell)
    solved = placed.groupBy(*by, "_cx", "_cy").applyInArrow(solve, some)
    return solved.groupBy(*by).applyInArrow(join, whole)


def union(polygons: DataFrame, by: list[str], size: float) -> DataFrame:
    """(by, geometry, bounds): the polygons of each group as one, however they overlap, touch or lie apart.

    Polygons are valid (see ``repaired``). Vertices move by up to 2^-27 of ``size``, the side
    of a cell, of which a polygon should have a moderate number. Shared edges vanish; rings
    that touch in a point stay apart. Edges that run beside a cell's side at a distance of
    about a unit (2^-26 of ``size``) may not close; that stops the job with an error, and
    another ``size`` helps. Null geometries count for nothing, null keys are a
    group, and a group without area has no row.
    """
    # A polygon adds nothing to itself: of equal ones in a group, one is enough.
    different = polygons.select(*by, "geometry").distinct()
    return G.with_bounds(_enclosed(different, by, size, G.edges_of, odd=False))


def repaired(polygons: DataFrame, key: list[str], size: float) -> DataFrame:
    """The polygons with ``geometry`` made valid: the points around which an odd number of edges goes.

    Rings that cross themselves or each other are cut there, spikes and edges that run twice
    vanish, holes outside become parts. ``key`` tells polygons apart; one without area gets
    NULL.
    """
    return _each(polygons, key, size, A.raw_edges, _raw, odd=True)


def _each(polygons: DataFrame, key: list[str], size: float, edges_of: Callable[[G.Parts], np.ndarray], edges_of_all: Callable[[G.Flat], tuple[np.ndarray, np.ndarray]], odd: bool) -> DataFrame:
    """Polygons with what the edges of each enclose. Small ones are worked on many at a time, large ones are spread over tasks."""

    @F.pandas_udf("binary")
    def enclosed(wkb: pd.Series) -> pd.Series:
        number, different = pd.factorize(wkb)  # equal polygons of a batch are worked on once
        found = [*_alone(different, size, edges_of_all, odd), None]
        return pd.Series([found[k] for k in number], dtype=object)

    large = F.coalesce(F.octet_length("geometry") > SMALL, F.lit(False))
    own = spread(polygons.filter(~large)).withColumn("geometry", enclosed("geometry"))
    made = _enclosed(polygons.filter(large), key, size, edges_of, odd).withColumnRenamed("geometry", "_made")
    other = [f"_k{i}" for i in range(len(key))]
    made = made.select(*(F.col(k).alias(o) for k, o in zip(key, other)), "_made")
    both = polygons.filter(large).join(made, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(key, other)], "left")
    return own.unionByName(both.select(*(F.col("_made").alias("geometry") if c == "geometry" else F.col(c) for c in polygons.columns)))


def _alone(wkb: np.ndarray, size: float, edges_of_all: Callable[[G.Flat], tuple[np.ndarray, np.ndarray]], odd: bool) -> list[bytes | None]:
    """All cells of each polygon."""
    out: list[bytes | None] = []
    step = 256
    for at in range(0, len(wkb), step):
        some = wkb[at : at + step]
        edges, row = edges_of_all(G.read_column(pd.Series(some, dtype=object)))
        units = np.rint(edges * (A.UNITS / size)).astype(np.int64)
        kept = (units[:, :2] != units[:, 2:]).any(axis=1)
        units, row = units[kept], row[kept]
        first = 0
        while first < len(some):  # a slice of polygons of so many edges, one polygon at least
            begin = np.searchsorted(row, first)
            last = len(some) if len(row) - begin <= AT_ONCE else max(first + 1, int(row[begin + AT_ONCE]))
            end = np.searchsorted(row, last)
            out += G.write_column(A.enclosed_many(units[begin:end], row[begin:end] - first, last - first, size, odd), last - first)
            first = last
    return out


def _raw(flat: G.Flat) -> tuple[np.ndarray, np.ndarray]:
    """(edges, row): all rings' edges as they run."""
    points, off, row, *_ = flat
    n = np.diff(off)
    after = np.repeat(off[:-1], n) + (G.ramp(n) + 1) % np.repeat(n, n)
    return np.hstack([points, points[after]]), np.repeat(row, n)


def _turned(flat: G.Flat) -> tuple[np.ndarray, np.ndarray]:
    """As ``_raw``, outer rings counter-clockwise and holes clockwise."""
    edges, row = _raw(flat)
    wrong = np.repeat((G.ring_areas(*flat[:2]) >= 0) == flat[4], np.diff(flat[1]))
    return np.where(wrong[:, None], edges[:, [2, 3, 0, 1]], edges), row


def _covers(distance: float) -> Callable[[G.Flat], tuple[np.ndarray, np.ndarray]]:
    """``_cover`` for all polygons of a column."""

    def covers(flat: G.Flat) -> tuple[np.ndarray, np.ndarray]:
        (run, row), (edges, _) = _raw(flat), _turned(flat)
        d = run[:, 2:] - run[:, :2]
        length = np.hypot(*d.T)
        some = length > 0
        a, b, d = run[some, :2], run[some, 2:], d[some] / length[some, None]
        side = distance * np.column_stack([d[:, 1], -d[:, 0]])
        corners = np.stack([a + side, b + side, b - side, a - side], axis=1)
        angle = 2 * np.pi * np.arange(ROUND) / ROUND
        around = run[:, None, :2] + distance * np.column_stack([np.cos(angle), np.sin(angle)])
        boxes, circles = (np.concatenate([r, np.roll(r, -1, axis=1)], axis=2).reshape(-1, 4) for r in (corners, around))
        rows = np.concatenate([row, np.repeat(row[some], 4), np.repeat(row, ROUND)])
        order = np.argsort(rows, kind="stable")
        return np.concatenate([edges, boxes, circles])[order], rows[order]

    return covers


def faults(polygons: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, fault, x, y): where a polygon is not valid.

    ``crossing``: edges of a ring cross, or more than two of them end in a point; ``overlap``:
    edges run along each other, as in a spike or between parts. A polygon whose rings cross
    or lie in each other wrongly has one row ``nesting`` without a place; rings may touch.
    """
    keys = [polygons.schema[c] for c in key]
    found = T.StructType([*keys, T.StructField("_ring", T.IntegerType()), T.StructField("fault", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("_n", T.LongType())])
    unit = size / A.UNITS

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                at, ring, overlap, x, y, n = _faults_of(batch.column(batch.num_columns - 1), size)
                keep = overlap | (ring >= 0)
                at, kinds = pa.array(at[keep]), np.where(overlap[keep], "overlap", "crossing").astype(object)
                made = [pa.array(ring[keep], pa.int32()), pa.array(kinds, pa.string()), pa.array(x[keep] * unit), pa.array(y[keep] * unit), pa.array(n[keep])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(key))), *made], schema=to_arrow_schema(found))

    some = polygons.filter(F.col("geometry").isNotNull()).select(*key, "geometry")
    # Pieces that end in a point on a cell's side are of several cells; each piece is one cell's own.
    places = spread(some).mapInArrow(look, found).groupBy(*key, "_ring", "fault", "x", "y").agg(F.sum("_n").alias("_n"))
    places = places.filter("fault = 'overlap' or _n > 2").drop("_n", "_ring").distinct()
    # Rings of a valid polygon enclose the shell's area less the holes'.
    made = repaired(some, key, size).withColumn("_after", F.coalesce(G.st_area("geometry"), F.lit(0.0))).drop("geometry")
    other = [f"_k{i}" for i in range(len(key))]
    made = made.select(*(F.col(k).alias(o) for k, o in zip(key, other)), "_after")
    both = some.withColumn("_before", G.st_area("geometry")).join(made, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(key, other)])
    nesting = both.filter(F.abs(F.col("_before") - F.col("_after")) > 1e-6 * F.greatest(F.abs("_before"), F.col("_after")) + size * size * 1e-12)
    nesting = nesting.join(places.select(*key).distinct(), key, "left_anti").select(*key, F.lit("nesting").alias("fault"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return places.unionByName(nesting)


def _faults_of(wkb: pa.Array, size: float) -> tuple[np.ndarray, ...]:
    """(row, ring, is an overlap, x, y, pieces) of what ``_meetings`` finds in all cells: of each ring by itself, and of several rings together, which are ring -1."""
    flat = G.read_column(wkb)
    edges, row = _raw(flat)
    units = np.rint(edges * (A.UNITS / size)).astype(np.int64)
    first = np.searchsorted(flat[2], flat[2])
    number = np.arange(len(flat[2])) - first
    ring = np.repeat(number, np.diff(flat[1]))
    several = np.bincount(flat[2], minlength=len(wkb))[row] > 1
    units, row, ring = np.concatenate([units, units[several]]), np.concatenate([row, row[several]]), np.concatenate([ring, np.full(several.sum(), -1)])
    kept = (units[:, :2] != units[:, 2:]).any(axis=1)
    order = np.lexsort((ring, row))
    order = order[kept[order]]
    units, row, ring = units[order], row[order], ring[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (ring[1:] != ring[:-1])])[: len(row)]
    owner = np.cumsum(new) - 1
    of, rings, count = row[new], ring[new], int(new.sum())
    out: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, t) for t in (np.int64, bool, float, float, np.int64))]
    begin = 0
    while begin < len(owner):
        end = len(owner) if len(owner) - begin <= AT_ONCE else int(np.searchsorted(owner, max(owner[begin] + 1, owner[begin + AT_ONCE])))
        out += _faults_in(units[begin:end], owner[begin:end], count, size)
        begin = end
    owner, *rest = (np.concatenate(c) for c in zip(*out))
    return of[owner], rings[owner], *rest


def _faults_in(units: np.ndarray, owner: np.ndarray, count: int, size: float) -> list[tuple[np.ndarray, ...]]:
    polygon, cx, cy, _, edge, cell, left_out = A.place_many(units, owner, count)
    order = np.argsort(cell, kind="stable")
    edge, cell = edge[order], cell[order]
    bounds = np.searchsorted(cell, np.arange(len(polygon) + 1))
    x0, y0, out = cx << A.BITS, cy << A.BITS, []

    def alone(k: int, own: np.ndarray, x: int, y: int) -> None:
        found = _meetings(own, (x << A.BITS, y << A.BITS, (x + 1) << A.BITS, (y + 1) << A.BITS))
        if found:
            kinds, px, py, n = zip(*found)
            out.append((np.full(len(found), k), np.array([f == "overlap" for f in kinds]), np.array(px, float), np.array(py, float), np.array(n, np.int64)))

    for first, last in A.chunks(cell, len(polygon)):
        own = slice(bounds[first], bounds[last])
        if last - first == 1 and bounds[last] - bounds[first] > A.CROWDED:
            alone(int(polygon[first]), units[edge[own]], int(cx[first]), int(cy[first]))
            continue
        a, b = x0[first:last], y0[first:last]
        points, of, start, stop = A.cut_many(units[edge[own]], cell[own] - first, a, b)
        wide = max(1, len(points))
        one, n = np.unique(np.minimum(start, stop) * wide + np.maximum(start, stop), return_counts=True)
        i, j = np.divmod(one, wide)
        middle, corner = (points[i] + points[j]) / 2, A.corner_of(a, b, of)
        mine = ((middle >= corner[i]) & (middle < corner[i] + A.UNITS)).all(axis=1)
        some = mine & (n > 1)
        out.append((polygon[first + of[i[some]]], np.ones(some.sum(), bool), middle[some, 0], middle[some, 1], np.full(some.sum(), 2)))
        degree = np.bincount(np.concatenate([i[mine], j[mine]]), minlength=len(points))
        side = ((points == corner) | (points == corner + A.UNITS)).any(axis=1)
        at = np.flatnonzero((degree > 0) & (side | (degree > 2)))
        out.append((polygon[first + of[at]], np.zeros(len(at), bool), points[at, 0].astype(float), points[at, 1].astype(float), degree[at]))
    for k in left_out.tolist():
        for x, y, _, own in A.place(units[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]):
            if own is not None:
                alone(k, own, x, y)
    return out


def _meetings(edges: np.ndarray, box: tuple[int, int, int, int]) -> list[tuple[str, float, float, int]]:
    """A cell's overlaps, and its points at which pieces end with the number of its own pieces that do; inner points only if these are more than two."""
    pieces = A.cut_at_each_other(edges, box)
    x0, y0, x1, y1 = box
    flip = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    one, n = np.unique(np.where(flip[:, None], pieces[:, [2, 3, 0, 1]], pieces), axis=0, return_counts=True)
    middle = (one[:, :2] + one[:, 2:]) / 2
    mine = (middle[:, 0] >= x0) & (middle[:, 0] < x1) & (middle[:, 1] >= y0) & (middle[:, 1] < y1)
    out = [("overlap", x, y, 2) for x, y in middle[(n > 1) & mine].tolist()]
    ends, degree = np.unique(one[mine].reshape(-1, 2), axis=0, return_counts=True)
    side = (ends[:, 0] == x0) | (ends[:, 0] == x1) | (ends[:, 1] == y0) | (ends[:, 1] == y1)
    some = side | (degree > 2)
    return out + [("crossing", float(x), float(y), int(k)) for (x, y), k in zip(ends[some].tolist(), degree[some])]


def _cover(parts: G.Parts, distance: float) -> np.ndarray:
    """Edges of a polygon, a box along each of its edges as wide as the distance on both sides, and a circle about each vertex."""
    angle = 2 * np.pi * np.arange(ROUND) / ROUND
    circle = distance * np.column_stack([np.cos(angle), np.sin(angle)])
    out = [G.edges_of(parts)]
    for rings in parts:
        for ring in rings:
            after = np.roll(ring, -1, axis=0)
            d = after - ring
            length = np.hypot(*d.T)
            a, b, d = ring[length > 0], after[length > 0], d[length > 0] / length[length > 0, None]
            side = distance * np.column_stack([d[:, 1], -d[:, 0]])  # to the right, so that boxes run counter-clockwise
            corners = np.stack([a + side, b + side, b - side, a - side], axis=1)
            out.append(np.concatenate([corners, np.roll(corners, -1, axis=1)], axis=2).reshape(-1, 4))
            around = ring[:, None] + circle
            out.append(np.concatenate([around, np.roll(around, -1, axis=1)], axis=2).reshape(-1, 4))
    return np.vstack(out)


def buffered(polygons: DataFrame, key: list[str], distance: float, size: float) -> DataFrame:
    """The polygons with ``geometry`` grown by a distance, 0 or more; circles have ROUND sides and lie inside the true ones.

    ``key`` tells polygons apart. By 0 a polygon is repaired.
    """
    if distance < 0:
        raise ValueError("the distance is negative")
    if distance == 0:
        return repaired(polygons, key, size)
    return _each(polygons, key, size, lambda parts: _cover(parts, distance), _covers(distance), odd=False)


RINGS = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("points", T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))]))


def _cut_at_seam(wkb: pa.Array, meridian: float, least: float, most: float) -> pa.Array:
    """Rings in degrees east of a meridian, from -180 to 180, of polygons in longitude and latitude; what crosses the other side is cut there."""
    points, off, row, part, hole = G.read_column(wkb)
    n = np.diff(off)
    at = np.repeat(row, n)
    low, high = np.full(len(wkb), np.inf), np.full(len(wkb), -np.inf)
    outer = np.repeat(~hole, n)
    np.minimum.at(low, at[outer], points[outer, 0])
    np.maximum.at(high, at[outer], points[outer, 0])
    wide = (high - low > WIDE)[at]  # the other way round is shorter
    points = np.column_stack([np.where(wide & (points[:, 0] < 0), points[:, 0] + 360, points[:, 0]), points[:, 1]])
    turns = []
    for turn in range(-2, 3):
        shift = meridian + 360.0 * turn
        limits = (np.full(len(row), v) for v in (shift - 180, least, shift + 180, most))
        p, *rest = G.clip_column((points, off, row, part, hole), *limits)
        turns.append((p - [shift, 0.0], *rest))
    sizes, row, part, hole = (np.concatenate([np.diff(t[k]) if k == 1 else t[k] for t in turns]) for k in (1, 2, 3, 4))
    turn = np.repeat(np.arange(len(turns)), [len(t[2]) for t in turns])
    points = np.concatenate([t[0] for t in turns])
    order = np.argsort(row, kind="stable")  # by row, then turn, then part
    start, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    points, row, part, turn = points[np.repeat(start, n) + G.ramp(n)], row[order], part[order], turn[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (turn[1:] != turn[:-1]) | (part[1:] != part[:-1])])[: len(row)]
    number = np.cumsum(first) - 1
    begin = np.searchsorted(row, np.arange(len(wkb) + 1))
    number -= np.append(number, 0)[begin[:-1]][row] if len(row) else 0
    xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, k])) for k in range(2)], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), xy)
    rings = pa.StructArray.from_arrays([pa.array(number, pa.int32()), rings], ["part", "points"])
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rings, mask=wkb.is_null())


def _joined(lists: pa.ListArray) -> pa.Array:
    """Polygons of lists of rings; NULL where there are none."""
    rings, count = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
    xy, n = rings.field("points").flatten(), rings.field("points").value_lengths().to_numpy().astype(np.int64)
    part, row = rings.field("part").to_numpy().astype(np.int64), np.repeat(np.arange(len(lists)), count)
    points = np.column_stack([c.to_numpy(zero_copy_only=False) for c in xy.flatten()])
    return pa.array(G.write_column((points, np.concatenate([[0], np.cumsum(n)]), row, part, part < 0), len(lists)), pa.binary())


def reprojected(polygons: DataFrame, crs: Crs, tolerance: float) -> DataFrame:
    """Polygons in longitude and latitude with ``geometry`` in another system, without bounds.

    A polygon wider than WIDE degrees is taken to cross the anti-meridian; what crosses the
    seam opposite the system's central meridian is cut there into parts. Edges are split so
    that a projected chord is about as near as ``tolerance``, in the system's units, to the
    projected edge; at most MOST_PIECES times. Latitudes that a Mercator system has no place
    for are cut off. Holes that are cut by the seam stay rings of their part. NULL stays NULL.
    """
    limit = 85.0 if crs.projection in ("merc", "webmerc") else 90.0
    to = lambda x, y: P.project(crs.projection, x, y, 0)  # noqa: E731  longitudes are from the system's meridian already

    def edges(points: Column) -> Column:
        """(ax, ay, bx, by, n): the edges and into how many pieces they go."""
        n = F.size(points)
        pairs = F.zip_with(points, F.concat(F.slice(points, 2, n), F.slice(points, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

        def pieces(e: Column) -> Column:
            (ax, ay), (bx, by) = to(e["ax"], e["ay"]), to(e["bx"], e["by"])
            length = F.hypot(bx - ax, by - ay)
            off = []
            for t in (0.25, 0.5, 0.75):
                x, y = to(e["ax"] + (e["bx"] - e["ax"]) * t, e["ay"] + (e["by"] - e["ay"]) * t)
                off.append(F.when(length > 0, F.abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / length).otherwise(F.hypot(x - ax, y - ay)))  # from the chord
            return F.greatest(F.lit(1), F.least(F.ceil(F.sqrt(F.greatest(*off) / tolerance)).cast("int"), F.lit(MOST_PIECES)))

        return F.transform(pairs, lambda e: F.struct(*(e[c].alias(c) for c in ("ax", "ay", "bx", "by")), pieces(e).alias("n")))

    def split(e: Column) -> Column:
        def point(k: Column) -> Column:
            x, y = to(e["ax"] + (e["bx"] - e["ax"]) * k / e["n"], e["ay"] + (e["by"] - e["ay"]) * k / e["n"])
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(F.sequence(F.lit(0), e["n"] - 1), point)

    meridian = crs.meridian

    @F.arrow_udf(RINGS)
    def cut(wkb: pa.Array) -> pa.Array:
        return _cut_at_seam(wkb, meridian, -limit, limit)

    rings = F.transform("_rings", lambda r: F.struct(r["part"].alias("part"), F.flatten(F.transform(edges(r["points"]), split)).alias("points")))
    kept = [f for f in polygons.schema.fields if f.name not in ("geometry", "minx", "miny", "maxx", "maxy")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _joined(batch.column("_rings"))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], names=[*(f.name for f in kept), "geometry"])

    split_up = spread(polygons).withColumn("_rings", cut("geometry")).select(*(f.name for f in kept), rings.alias("_rings"))
    made = split_up.mapInArrow(join, T.StructType([*kept, T.StructField("geometry", T.BinaryType())]))
    return made.select(*(c for c in polygons.columns if c not in ("minx", "miny", "maxx", "maxy")))
