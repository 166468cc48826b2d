"""Spatial joins: both sides meet in cells of a grid, and an exact test follows.

Polygons are read once and cut to the cells; a cell that lies inside needs no test, and any
other takes along the edges that matter in it. Points and boxes of an Arrow batch that are in
the same cell travel as one row, so that a polygon's edges are not copied beside each of
them and a test is one vectorised call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from popquilt.operators import geometry as G

#: Rows of cells that a polygon is cut to at once; a tall polygon is cut in several tasks.
BANDS = 64
#: Points or boxes that travel as one row: an Arrow batch is a number of rows, so that longer lists would make it any size.
PACKED = 128


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of the cells (cx, cy) that bounds touch."""
    along = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(along(x0, x1), lambda cx: F.transform(along(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def _mapped(df: DataFrame, schema: T.StructType, each: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = each(batch) if batch.num_rows else None
            if out is not None and out.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns, names)], schema=names)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame) -> DataFrame:
    """(_cx, _cy, _rows): the rows of an Arrow batch that have the same cell ``_c``, as lists of at most PACKED structs without it."""
    rest = [f for f in df.schema.fields if f.name != "_c"]
    schema = T.StructType([T.StructField("_cx", T.LongType()), T.StructField("_cy", T.LongType()), T.StructField("_rows", T.ArrayType(T.StructType(rest)))])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell = batch.column(batch.schema.get_field_index("_c"))
        x, y = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cell.flatten())
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        within = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.flatnonzero(within % PACKED == 0)
        own = batch.take(pa.array(order))
        rows = pa.StructArray.from_arrays([own.column(own.schema.get_field_index(f.name)) for f in rest], [f.name for f in rest])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(x)), pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), lists], names=["_cx", "_cy", "_rows"])

    return _mapped(df.filter("_c.cx is not null and _c.cy is not null"), schema, each)


def _kept(batch: pa.RecordBatch, test: Callable[[int, pa.StructArray], np.ndarray | None]) -> pa.RecordBatch:
    """The batch with each list ``_rows`` cut to what the test of its row number lets through; None lets all through."""
    place = batch.schema.get_field_index("_rows")
    lists = batch.column(place)
    rows, off = lists.values, lists.offsets.to_numpy()
    keep, counts = [], []
    for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
        passed = test(i, rows.slice(a, b - a))
        at = np.arange(a, b) if passed is None else a + np.flatnonzero(passed)
        keep.append(at)
        counts.append(len(at))
    new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), rows.take(pa.array(np.concatenate(keep), pa.int64())))
    columns = [new if k == place else c for k, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _number(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def banded(polygons: DataFrame, size: float, y_origin: float = 0.0) -> DataFrame:
    """Polygons once for every BANDS rows of the grid that they touch, as rows ``_first`` to ``_last``, dealt evenly."""
    low, high = F.floor((F.col("miny") - y_origin) / size), F.floor((F.col("maxy") - y_origin) / size)
    some = polygons.filter(F.col("geometry").isNotNull()).withColumn("_first", F.explode(F.sequence(low, high, F.lit(BANDS).cast("long"))))
    return some.withColumn("_last", F.least(F.col("_first") + BANDS - 1, high)).repartition(F.xxhash64("minx", "miny", "maxx", "maxy", "_first"))


def cut(polygons: DataFrame, size: float) -> DataFrame:
    """(polygon columns without geometry, _cx, _cy, _edges): polygons by cell; without edges where the cell is inside."""
    bands = banded(polygons, size)
    kept = [f for f in polygons.schema.fields if f.name != "geometry"]
    schema = T.StructType([*kept, T.StructField("_cx", T.LongType()), T.StructField("_cy", T.LongType()), T.StructField("_edges", T.BinaryType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        row, cx, cy, edges = [], [], [], []
        for i, (wkb, first, last) in enumerate(zip(*(column[c].to_pylist() for c in ("geometry", "_first", "_last")))):
            for x, y, own in G.cells_of(G.edges_of(G.read_wkb(wkb)), size, first, last):
                row.append(i)
                cx.append(x)
                cy.append(y)
                edges.append(None if own is None else own.tobytes())
        at = pa.array(row, pa.int64())
        made = [pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(edges, pa.binary())]
        return pa.RecordBatch.from_arrays([*(column[f.name].take(at) for f in kept), *made], names=[*(f.name for f in kept), "_cx", "_cy", "_edges"])

    return _mapped(bands, schema, each)


def pairs(polygons: DataFrame, boxes: DataFrame, size: float, distance: float = 0.0) -> DataFrame:
    """Polygons (minx … maxy, others, without geometry) with the boxes (bx0, by0, bx1, by1, others) no farther than a distance.

    A box goes to the cells that it touches with the distance around it, where the polygon's
    edges tell: one is near enough, or the box lies in the polygon. A pair that meets in
    several cells is kept once.
    """
    d = float(distance)
    left = cut(polygons.withColumn("_p", F.monotonically_increasing_id()), size)
    around = cells(F.col("bx0") - d, F.col("by0") - d, F.col("bx1") + d, F.col("by1") + d, size)
    right = packed(boxes.withColumn("_b", F.monotonically_increasing_id()).withColumn("_c", F.explode(around)))
    met = left.join(right, ["_cx", "_cy"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        cx, cy, edges = (batch.column(names.index(c)).to_pylist() for c in ("_cx", "_cy", "_edges"))

        def test(i: int, rows: pa.StructArray) -> np.ndarray:
            box = [_number(rows, c) for c in ("bx0", "by0", "bx1", "by1")]
            x, y = cx[i] * size, cy[i] * size
            if edges[i] is None:  # the whole cell is inside
                gap = [np.maximum(np.maximum(low - (v + size), v - high), 0) for low, high, v in ((box[0], box[2], x), (box[1], box[3], y))]
                return gap[0] ** 2 + gap[1] ** 2 <= d * d
            own = np.frombuffer(edges[i]).reshape(-1, 4)
            near = G.near_edges(own, *box, d)
            px, py = np.maximum(box[0], x), np.maximum(box[1], y)
            rest = ~near & (px < x + size) & (py < y + size) & (box[2] >= x) & (box[3] >= y)
            near[rest] = G.inside_edges(own, px[rest], py[rest])
            return near

        return _kept(batch, test)

    rest = [c for c in polygons.columns if c != "geometry"]
    found = _mapped(met, met.schema, each).withColumn("_r", F.explode("_rows")).select("_p", *rest, "_r.*")
    return found.dropDuplicates(["_p", "_b"]).select(*rest, *boxes.columns)


def overlay(polygons: DataFrame, cell: float, x_origin: float = 0.0, y_origin: float = 0.0) -> DataFrame:
    """Polygons cut by a grid: (polygon columns but geometry, grid_col, grid_row, isection_area), without empty pieces.

    Rows count upwards from the origin. All cells' areas of a polygon come from one walk
    along its edges; pieces under a billionth of a cell are empty.
    """
    kept = [f for f in polygons.schema.fields if f.name != "geometry"]
    schema = T.StructType([*kept, T.StructField("grid_col", T.LongType()), T.StructField("grid_row", T.LongType()), T.StructField("isection_area", T.DoubleType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        found = [
            G.coverage(G.edges_of(G.read_wkb(wkb)), cell, x_origin, y_origin, first, last)
            for wkb, first, last in zip(*(column[c].to_pylist() for c in ("geometry", "_first", "_last")))
        ]
        at = pa.array(np.repeat(np.arange(len(found)), [len(c) for c, _, _ in found]))
        made = [pa.array(np.concatenate(x)) for x in zip(*found)]
        return pa.RecordBatch.from_arrays([*(column[f.name].take(at) for f in kept), *made], names=[f.name for f in schema.fields])

    return _mapped(banded(polygons, cell, y_origin), schema, each)


def points_in(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Points (x, y, others) with the polygons that hold them; a point on a shared edge is in one of them."""
    left = packed(points.withColumn("_c", F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))))
    met = left.join(cut(polygons, size), ["_cx", "_cy"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        edges = batch.column(batch.schema.get_field_index("_edges"))

        def test(i: int, rows: pa.StructArray) -> np.ndarray | None:
            own = edges[i].as_py()
            return None if own is None else G.inside_edges(np.frombuffer(own).reshape(-1, 4), _number(rows, "x"), _number(rows, "y"))

        return _kept(batch, test)

    rest = [c for c in polygons.columns if c != "geometry"]
    return _mapped(met, met.schema, each).withColumn("_r", F.explode("_rows")).select(*(f"_r.{c}" for c in points.columns), *rest)


def zonal_sum(points: DataFrame, polygons: DataFrame, size: float, by: list[str], value: str = "value") -> DataFrame:
    """Sum of the points' values by polygon; polygons without any get 0."""
    sums = points_in(points, polygons, size).groupBy(*by).agg(F.sum(value).alias("_s"))
    return polygons.select(*by).distinct().join(sums, by, "left").select(*by, F.coalesce("_s", F.lit(0.0)).alias(value))


def labelled(points: DataFrame, polygons: DataFrame, size: float, keys: list[str], ordinal: str, label: str) -> DataFrame:
    """Points with the label of the last polygon over them, or NULL outside all."""
    top = points_in(points, polygons, size).groupBy(*keys).agg(F.max_by(label, ordinal).alias(label))
    return points.join(top, keys, "left")


def dissolve(tiles: DataFrame, by: str) -> DataFrame:
    """Bounds of rectangular tiles that together make rectangles."""
    return tiles.groupBy(by).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def neighbours(blocks: DataFrame, distance: float, size: float) -> DataFrame:
    """(block_key, neighbour): blocks whose rectangles are no farther apart, themselves included."""
    a = blocks.withColumn("_c", F.explode(cells(F.col("minx") - distance, F.col("miny") - distance, F.col("maxx") + distance, F.col("maxy") + distance, size)))
    b = blocks.select(F.col("block_key").alias("neighbour"), *(F.col(c).alias(f"n_{c}") for c in ("minx", "miny", "maxx", "maxy")))
    b = b.withColumn("_c", F.explode(cells(F.col("n_minx"), F.col("n_miny"), F.col("n_maxx"), F.col("n_maxy"), size)))
    dx = F.greatest(F.col("n_minx") - F.col("maxx"), F.col("minx") - F.col("n_maxx"), F.lit(0.0))
    dy = F.greatest(F.col("n_miny") - F.col("maxy"), F.col("miny") - F.col("n_maxy"), F.lit(0.0))
    return a.join(b, "_c").filter(dx * dx + dy * dy <= distance * distance).select("block_key", "neighbour").distinct()
