"""Raster operators on long tables of pixels, and on tiles where a whole neighbourhood is needed.

A tile table has one row per chunk (see ``sources.schemas.RASTER_TILE``); the long view has
(block_key, row, col, value) with missing pixels as NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from popquilt.functions.constants import AVERAGE_NOISE, LEAST_DENSITY, LEAST_HEIGHT
from popquilt.functions.keys import group_key
from popquilt.functions.semantics import nan_to_null, suppress_noise

CELL = ["block_key", "row", "col"]


def pixels(tiles: DataFrame, keep: tuple[str, ...] = (), beside: tuple[str, ...] = ()) -> DataFrame:
    """Long view of a tile table: row and column in the block, cell centre, value; no-data is NULL.

    ``beside`` names further arrays as long as ``data``, which are spread along with it.
    """
    t = F.col("transform")  # (x0, dx, y0, dy): the upper left corner and the cell's size, dy < 0
    held = ("block_key", "chunk_row", "chunk_col", "height", "width", "transform", "nodata")
    long = tiles.select(*keep, *held, F.posexplode(F.arrays_zip("data", *beside)).alias("_p", "_z"))
    long = long.select(*keep, *held, "_p", F.col("_z.data").alias("_v"), *(F.col(f"_z.{b}").alias(b) for b in beside))
    value = nan_to_null(F.col("_v").cast("double"))
    row, col = F.col("chunk_row") * F.col("height") + F.floor(F.col("_p") / F.col("width")), F.col("chunk_col") * F.col("width") + F.col("_p") % F.col("width")
    return long.withColumns({"row": row.cast("int"), "col": col.cast("int")}).select(
        *keep, *beside, "block_key", "row", "col",
        (t[0] + (F.col("col") + 0.5) * t[1]).alias("x"), (t[2] + (F.col("row") + 0.5) * t[3]).alias("y"),
        F.when(value != F.coalesce("nodata", F.lit(float("nan"))), value).alias("value"),
    )


def to_tiles(long: DataFrame, height: int, width: int, by: tuple[str, ...] = ("block_key",), fill: float | None = None) -> DataFrame:
    """(by, chunk_row, chunk_col, height, width, data): pixels gathered into chunks, row by row; absent ones get ``fill``.

    A chunk's pixels are sorted by place once, and the gaps between neighbours are filled in
    the same pass, so that the work is in proportion to the chunk. A pixel that comes twice
    keeps its largest value.
    """
    place = ((F.col("row") % height) * width + F.col("col") % width).cast("int")
    chunk = [F.floor(F.col("row") / height).cast("int").alias("chunk_row"), F.floor(F.col("col") / width).cast("int").alias("chunk_col")]
    end = F.struct(F.lit(height * width).alias("p"), F.lit(None).cast("float").alias("v"))  # one place beyond the last
    cells = long.groupBy(*by, *chunk).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("value").cast("float").alias("v")))).alias("_m"))
    cells = cells.withColumn("_m", F.array_append("_m", end))
    # Of each pixel the places since the one before, which are absent, and itself; a pixel's next one tells whether it is repeated.
    before = F.concat(F.array(F.lit(-1)), F.transform("_m", lambda x: x["p"]))
    gaps = F.zip_with("_m", F.slice(before, 1, F.size("_m")), lambda x, b: F.struct((x["p"] - b).alias("step"), x["p"].alias("p"), x["v"].alias("v")))
    absent = F.lit(fill).cast("float")
    following = F.slice(F.concat(F.transform("_m", lambda x: x["p"]), F.array(F.lit(-1))), 2, F.size("_m"))
    pieces = F.zip_with(
        gaps,
        following,
        lambda x, n: F.concat(
            F.when(x["step"] > 1, F.array_repeat(absent, x["step"] - 1)).otherwise(F.array().cast("array<float>")),
            F.when((x["p"] == n) | (x["p"] == height * width), F.array().cast("array<float>")).otherwise(F.array(F.coalesce(x["v"], absent))),
        ),
    )
    return cells.select(*by, "chunk_row", "chunk_col", F.lit(height).alias("height"), F.lit(width).alias("width"), F.flatten(pieces).alias("data"))


def derived_measures(bands: DataFrame) -> DataFrame:
    """(cell, measure, value) of the six measures from bands (cell, density, height, proportion_residential).

    Where there is density but no height the block's smallest positive height stands in.
    """
    least = F.min(F.when(F.col("height") > 0, F.col("height"))).over(Window.partitionBy("block_key"))
    h = F.when((F.col("density") >= LEAST_DENSITY) & (F.col("height") == 0), F.coalesce("_least", F.lit(LEAST_HEIGHT))).otherwise(F.col("height"))
    d, p = F.col("density"), F.col("proportion_residential")
    measures = {
        "density": d,
        "residential_density": d * p,
        "nonresidential_density": d * (1 - p),
        "volume": h * d,
        "residential_volume": h * d * p,
        "nonresidential_volume": h * d * (1 - p),
    }
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in measures.items()))
    return bands.withColumn("_least", least).select(*CELL, F.explode(rows).alias("m")).select(*CELL, "m.measure", "m.value")


def kernel(resolution: float, radius: float, kind: str = "uniform") -> np.ndarray:
    """Weights of a neighbourhood that sum to 1: a disc, or a Gaussian over the whole square."""
    r = int(radius // resolution)
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    if kind == "uniform":
        w = (x * x + y * y < r * r).astype(float)
    elif kind == "gaussian":
        w = np.exp(-(x * x + y * y) / max(1, r * r))
    else:
        raise ValueError(f"unknown kernel {kind!r}")
    return w / w.sum() if w.sum() else np.ones((1, 1))


def kernel_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    r = len(weights) // 2
    return spark.createDataFrame([(int(j - r), int(i - r), float(w)) for (i, j), w in np.ndenumerate(weights) if w], "dx int, dy int, w double")


def average_by_offsets(long: DataFrame, weights: np.ndarray) -> DataFrame:
    """Neighbourhood average as a join with the kernel's offsets, for kernels of some dozens of cells.

    Missing is 0, and so is what lies beyond the block; see ``finish_average``.
    """
    offsets = F.broadcast(kernel_table(long.sparkSession, weights))  # as many rows as the kernel has cells
    spread = long.select("block_key", "row", "col", F.coalesce("value", F.lit(0.0)).alias("_v")).crossJoin(offsets)
    sums = spread.groupBy("block_key", (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col")).agg(F.sum(F.col("_v") * F.col("w")).alias("value"))
    return finish_average(long.select(*CELL).join(sums, CELL, "left"))


def finish_average(averaged: DataFrame) -> DataFrame:
    """Less the block's minimum; what is then under the threshold is 0."""
    least = F.min("value").over(Window.partitionBy("block_key"))
    return averaged.withColumn("value", suppress_noise(F.col("value") - least, AVERAGE_NOISE))


def convolve(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Centre part of the linear convolution, zeros beyond the edge, by FFT."""
    shape = [n + k - 1 for n, k in zip(a.shape, w.shape)]
    size = [1 << (n - 1).bit_length() for n in shape]
    full = np.fft.irfft2(np.fft.rfft2(a, size) * np.fft.rfft2(w, size), size)
    r, c = w.shape[0] // 2, w.shape[1] // 2
    return full[r : r + a.shape[0], c : c + a.shape[1]]


def average_tiles(tiles: DataFrame, resolution: float, radius: float, kind: str = "gaussian") -> DataFrame:
    """Neighbourhood average of whole tiles (block_key, height, width, data), for large kernels; one tile in memory at a time."""
    w = kernel(resolution, radius, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, n, data in zip(batch["height"], batch["width"], batch["data"]):
                a = np.nan_to_num(np.array(data, dtype=np.float64).reshape(h, n))
                a = convolve(a, w)
                a -= a.min()
                a[a < AVERAGE_NOISE] = 0
                out.append(a.astype(np.float32).ravel())
            yield batch.assign(data=out)

    return tiles.select("block_key", "height", "width", "data").mapInPandas(run, "block_key string, height int, width int, data array<float>")


def average_with_neighbours(tiles: DataFrame, cell: float, radius: float, kind: str = "gaussian") -> DataFrame:
    """Neighbourhood average of tiles (with their transform), across the edges of tiles and blocks.

    Missing cells and what is beyond the outermost tiles count as 0. Each block's least
    average is taken off; what is then under the threshold is 0.
    """
    w = kernel(cell, radius, kind)
    r = len(w) // 2
    mean = neighbourhoods(tiles, r, lambda wide: convolve(np.nan_to_num(wide), w)[r : len(wide) - r, r : wide.shape[1] - r])
    least = F.min(F.array_min("_made")).over(Window.partitionBy("block_key"))
    data = F.transform("_made", lambda v: suppress_noise(v - F.col("_least"), AVERAGE_NOISE).cast("float"))
    return mean.withColumn("_least", least).select("block_key", "chunk_row", "chunk_col", "height", "width", data.alias("data"))


def neighbourhoods(tiles: DataFrame, reach: int, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(block_key, chunk_row, chunk_col, height, width, _made): what ``work`` makes of each tile with a margin of ``reach`` cells.

    A tile goes whole to its own group and in strips to its neighbours' as far as the margin
    reaches; a group holds one tile and its margin. All tiles are of one size and lie on one
    grid, by their transform. Missing cells and what is beyond the outermost tiles are NaN.
    """
    r = reach
    part = T.StructType.fromDDL("_ty long, _tx long, _top int, _left int, _h int, _w int, height int, width int, block_key string, chunk_row int, chunk_col int, _part array<double>")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("data")
            place = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for k, tile in enumerate(batch.drop_columns(["data"]).to_pylist()):
                h, n = tile["height"], tile["width"]
                a = values[place[k] : place[k + 1]].reshape(h, n)
                x0, dx, y0, dy = tile["transform"]
                ty, tx, rows = round(y0 / dy) // h, round(x0 / dx) // n, []
                for oy in range(-(-(-r // h)) if r else 0, (-(-r // h)) + 1):
                    for ox in range(-(-(-r // n)) if r else 0, (-(-r // n)) + 1):
                        top, left = -oy * h + r, -ox * n + r  # of this tile in the other one's margin
                        y, x = slice(max(0, -top), min(h, h + 2 * r - top)), slice(max(0, -left), min(n, n + 2 * r - left))
                        if y.start >= y.stop or x.start >= x.stop:
                            continue
                        own = (oy, ox) == (0, 0)
                        piece = a[y, x]
                        rows.append((ty + oy, tx + ox, top + y.start, left + x.start, *piece.shape, h, n, *((tile[c] if own else None) for c in ("block_key", "chunk_row", "chunk_col")), piece.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to_arrow_schema(part))], schema=to_arrow_schema(part))

    out = T.StructType.fromDDL("block_key string, chunk_row int, chunk_col int, height int, width int, _made array<double>")

    def gather(group: pa.Table) -> pa.Table:
        rows, parts = group.drop_columns(["_part"]).to_pylist(), group.column("_part")
        own = [x for x in rows if x["block_key"] is not None]
        if not own:
            return to_arrow_schema(out).empty_table()
        h, n = own[0]["height"], own[0]["width"]
        wide = np.full((h + 2 * r, n + 2 * r), np.nan)
        for x, piece in zip(rows, parts):
            wide[x["_top"] : x["_top"] + x["_h"], x["_left"] : x["_left"] + x["_w"]] = piece.values.to_numpy(zero_copy_only=False).reshape(x["_h"], x["_w"])
        made = pa.ListArray.from_arrays(pa.array([0, h * n], pa.int32()), pa.array(work(wide).ravel()))
        keys = [pa.array([own[0][c]], to_arrow_schema(out).field(c).type) for c in ("block_key", "chunk_row", "chunk_col", "height", "width")]
        return pa.Table.from_arrays([*keys, made.cast(to_arrow_schema(out).field("_made").type)], schema=to_arrow_schema(out))

    return tiles.select("block_key", "chunk_row", "chunk_col", "height", "width", "transform", F.col("data").cast("array<double>").alias("data")).mapInArrow(spread, part).groupBy("_ty", "_tx").applyInArrow(gather, out)


def with_halo(long: DataFrame, blocks: DataFrame, size: int, halo: int) -> DataFrame:
    """Pixels of each block and of its neighbours up to ``halo`` cells away, in the block's own coordinates.

    ``blocks`` has (block_key, block_x, block_y); blocks are ``size`` cells wide and rows
    count downwards. A pixel goes to at most nine blocks.
    """
    at = blocks.select("block_key", "block_x", "block_y")
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int"))
    moved = (
        long.join(at, "block_key")
        .withColumns({"gx": F.col("block_x") * size + F.col("col"), "gy": F.col("block_y") * size + F.col("row")})
        .withColumn("block_x", F.explode(span("gx")))
        .withColumn("block_y", F.explode(span("gy")))
        .drop("block_key")
    )
    return moved.join(at, ["block_x", "block_y"]).select(
        "block_key", (F.col("gy") - F.col("block_y") * size).cast("int").alias("row"), (F.col("gx") - F.col("block_x") * size).cast("int").alias("col"), "value"
    )


def resample(long: DataFrame, factor: int, how: str, by: tuple[str, ...] = ("block_key",)) -> DataFrame:
    """Cells of ``factor`` times the size: their sum (keeps totals) or the mean of what is not missing."""
    value = {"sum": F.sum("value"), "average": F.avg("value")}.get(how)
    if value is None:
        raise ValueError(f"unknown statistic {how!r}")
    return long.groupBy(*by, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(value.alias("value"))


def warp(long: DataFrame, x: Column, y: Column, bounds: tuple[float, float, float, float], cell: float, how: str) -> DataFrame:
    """(row, col, value) on another grid: each pixel goes to the cell that its reprojected centre is in.

    Totals are kept by ``sum`` for all pixels within the bounds.
    """
    x0, y0, x1, y1 = bounds
    inside = (x >= x0) & (x < x1) & (y > y0) & (y <= y1)
    moved = long.filter(inside).withColumns({"row": F.floor((y1 - y) / cell).cast("int"), "col": F.floor((x - x0) / cell).cast("int")})
    return resample(moved, 1, how, ())


def warp_footprints(long: DataFrame, footprint: tuple[Column, Column, Column, Column], bounds: tuple[float, float, float, float], cell: float, how: str) -> DataFrame:
    """(row, col, value) on another grid, each pixel by the shares of its footprint that lie in the grid's cells.

    ``footprint`` has a pixel's bounds (x0, y0, x1, y1) in the grid's system, where a
    cylindrical projection keeps it a rectangle. By ``sum`` a pixel's value is dealt out by
    these shares, so that totals are kept; by ``average`` they are the weights of a mean of
    what is not missing, so that a grid finer than the pixels has no holes. Only cells that
    a pixel touches are made.
    """
    if how not in ("sum", "average"):
        raise ValueError(f"unknown statistic {how!r}")
    bx0, by0, bx1, by1 = bounds
    rows, cols = math.ceil((by1 - by0) / cell - 1e-9), math.ceil((bx1 - bx0) / cell - 1e-9)
    at = long.filter("value is not null").select("value", *(c.alias(n) for n, c in zip(("_x0", "_y0", "_x1", "_y1"), footprint)))
    at = at.filter((F.col("_x1") > bx0) & (F.col("_x0") < bx1) & (F.col("_y1") > by0) & (F.col("_y0") < by1))
    left, right, top, bottom = (F.col("_x0") - bx0) / cell, (F.col("_x1") - bx0) / cell, (by1 - F.col("_y1")) / cell, (by1 - F.col("_y0")) / cell

    def touched(low: Column, high: Column, n: int) -> Column:
        first = F.greatest(F.floor(low), F.lit(0)).cast("int")
        last = F.least(F.ceil(high) - 1, F.lit(n - 1)).cast("int")
        return F.explode(F.sequence(first, F.greatest(first, last)))

    def share(low: Column, high: Column, k: str) -> Column:
        return F.greatest(F.least(high, F.col(k) + 1) - F.greatest(low, F.col(k)), F.lit(0.0)) / (high - low)

    met = at.withColumn("row", touched(top, bottom, rows)).withColumn("col", touched(left, right, cols))
    weight = share(left, right, "col") * share(top, bottom, "row")
    if how == "average":  # weights are areas, and pixels' footprints need not be of one size
        weight = weight * (right - left) * (bottom - top)
    met = met.select("row", "col", "value", weight.alias("_w")).filter("_w > 1e-12")
    total = F.sum(F.col("value") * F.col("_w"))
    return met.groupBy("row", "col").agg((total if how == "sum" else total / F.sum("_w")).alias("value"))


def pyramid(long: DataFrame, levels: int, how: str = "average") -> list[DataFrame]:
    """Overviews, each of half the size of the one before."""
    out = []
    for _ in range(levels):
        long = resample(long, 2, how)
        out.append(long)
    return out


def mosaic(blocks: DataFrame) -> DataFrame:
    """Tiles or pixels with the key of their 10 by 10 group."""
    return blocks.withColumn("group_key", group_key(F.col("block_key")))


def merge(*layers: DataFrame) -> DataFrame:
    """By cell, the first layer's value that is not missing."""
    parts = [x.select(*CELL, "value", F.lit(k).alias("_k")) for k, x in enumerate(layers)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy(*CELL).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("_k"))).alias("value"))


def last_wins(labels: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("block_key", "row", "col")) -> DataFrame:
    """Cells of a grid with the label of the last polygon (largest ordinal) that covers them, or NULL."""
    top = labels.groupBy(*keys).agg(F.max_by("label", "ordinal").alias("label"))
    return grid.select(*keys).join(top, list(keys), "left")


def fill_nearest(tiles: DataFrame, distance: int = 100) -> DataFrame:
    """Tiles whose missing cells take the nearest known cell's value, up to a distance in cells.

    Tiles have height, width and data; other columns stay. Each tile is filled from itself
    (see ``fill_across``); one is in memory at a time.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in tiles.withColumn("data", F.col("data").cast("array<float>")).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(data=[nearest_fill(np.array(d, dtype=np.float64).reshape(h, w), distance).astype(np.float32).ravel() for h, w, d in zip(batch["height"], batch["width"], batch["data"])])

    return tiles.mapInPandas(run, schema)


def fill_across(tiles: DataFrame, distance: int = 100, how: str = "interpolate") -> DataFrame:
    """Tiles (with their transform) whose missing cells are filled from known ones up to a distance in cells, also in neighbouring tiles.

    ``interpolate`` takes the nearest known cell of each quadrant, weighted by 1 / distance;
    ``nearest`` the nearest one, by row and then column where several are as near. Cells with
    nothing known in reach stay NaN.
    """
    fill = {"interpolate": interpolated_fill, "nearest": nearest_fill}.get(how)
    if fill is None:
        raise ValueError(f"unknown way to fill {how!r}")
    r = distance
    made = neighbourhoods(tiles, r, lambda wide: fill(wide, r, (slice(r, len(wide) - r), slice(r, wide.shape[1] - r))))
    place = ["block_key", "chunk_row", "chunk_col"]
    return tiles.drop("data").join(made.select(*place, F.col("_made").cast("array<float>").alias("data")), place).select(*tiles.columns)


def _known_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell how many rows above it (0 for its own) and below it (1 or more) the nearest known cell of its column is; a large number for none."""
    far = 1 << 20
    rows = np.arange(len(a))[:, None]
    known = ~np.isnan(a)
    above = rows - np.maximum.accumulate(np.where(known, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(known, rows, 2 * far)[::-1], axis=0)[::-1] - rows
    below = np.vstack([below[1:] + 1, np.full((1, a.shape[1]), far)]) if len(a) else below
    return np.minimum(above, far), np.minimum(below, far)


def _shifts(width: int, part: slice, dx: int) -> tuple[slice, slice]:
    """Columns of a part that have a column dx to their right (left, if negative) in the whole, and these columns."""
    first, last = max(part.start, -dx), min(part.stop, width - dx)
    return slice(first - part.start, max(first, last) - part.start), slice(first + dx, max(first, last) + dx)


def nearest_fill(a: np.ndarray, distance: int, part: tuple[slice, slice] | None = None) -> np.ndarray:
    """Missing cells with the nearest known value, by distance, then row, then column; of the whole or a part of it.

    Two passes: down and up the columns for the nearest known row, and along the rows for the
    column whose known row is nearest, so that the work is cells times distance.
    """
    h, w = a.shape
    rows, cols = part or (slice(0, h), slice(0, w))
    out = a[rows, cols].copy()
    todo = np.isnan(out)
    if not todo.any() or np.isnan(a).all():
        return out
    above, below = (x[rows].astype(np.int64) for x in _known_rows(a))
    up = above <= below  # the upper one of two as near
    near = np.where(up, above, below)
    # Squared distance, row and column in one number, so that the least is the first in order; distances are below 2^14.
    reach = near <= distance
    key = (np.where(reach, near * near, distance * distance + 1) << 34) + (np.where(reach, np.where(up, -near, near), 0) + (1 << 16) << 17) + (1 << 16)
    best = np.full(out.shape, np.iinfo(np.int64).max)
    worst = distance * distance
    for step in range(min(distance, w) + 1):
        if step * step > worst:
            break
        for dx in {step, -step}:
            here, there = _shifts(w, cols, dx)
            if here.start < here.stop:
                best[:, here] = np.minimum(best[:, here], key[:, there] + (dx * dx << 34) + dx)
        if step % 8 == 7:
            worst = min(worst, int((best[todo] >> 34).max()))
    found = todo & (best >> 34 <= distance * distance)
    y, x = np.nonzero(found)
    b = best[found]
    out[y, x] = a[y + rows.start + (b >> 17 & 0x1FFFF) - (1 << 16), x + cols.start + (b & 0x1FFFF) - (1 << 16)]
    return out


def interpolated_fill(a: np.ndarray, distance: int, part: tuple[slice, slice] | None = None) -> np.ndarray:
    """Missing cells with the mean, weighted by 1 / distance, of the nearest known cells of the four quadrants; of the whole or a part of it.

    A cell's own column belongs to the left quadrants and its own row to the upper ones; of
    cells as near, the one in the nearer column counts.
    """
    h, w = a.shape
    rows, cols = part or (slice(0, h), slice(0, w))
    out = a[rows, cols].copy()
    todo = np.isnan(out)
    if not todo.any() or np.isnan(a).all():
        return out
    at = np.arange(rows.start, rows.stop)[:, None]
    value, weight = np.zeros(out.shape), np.zeros(out.shape)
    for side, (gap, sign) in ((s, g) for s in (-1, 1) for g in zip(_known_rows(a), (-1, 1))):
        gap = gap[rows].astype(np.int64)
        own = a[np.clip(at + sign * gap, 0, h - 1), np.arange(w)]
        square = gap * gap
        nearest, held = np.full(out.shape, distance * distance + 1), np.zeros(out.shape)
        for step in range(0 if side < 0 else 1, min(distance, w) + 1):
            here, there = _shifts(w, cols, side * step)
            if here.start < here.stop:
                d = square[:, there] + step * step
                closer = d < nearest[:, here]
                np.copyto(nearest[:, here], d, where=closer)
                np.copyto(held[:, here], own[:, there], where=closer)
            if step % 8 == 7 and step * step >= nearest[todo].max():
                break
        hit = nearest <= distance * distance
        share = np.where(hit & todo, 1 / np.sqrt(np.maximum(nearest, 1)), 0.0)
        value += share * held
        weight += share
    filled = todo & (weight > 0)
    out[filled] = value[filled] / weight[filled]
    return out


def night_lights(long: DataFrame) -> DataFrame:
    """(cell, value, log_value): missing light is none."""
    v = F.coalesce("value", F.lit(0.0))
    return long.select(*CELL, v.alias("value"), F.log1p(v).alias("log_value"))
