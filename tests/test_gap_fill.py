"""Gaps of rasters, against cells one by one."""

import time

import numpy as np
import pytest

from popquilt.operators import raster


def plain(a, distance, how):
    out = a.copy()
    known = [tuple(k) for k in np.argwhere(~np.isnan(a))]
    for y, x in np.argwhere(np.isnan(a)):
        near = [((v - y) ** 2 + (u - x) ** 2, v - y, u - x) for v, u in known if (v - y) ** 2 + (u - x) ** 2 <= distance**2]
        if near and how == "nearest":
            _, dy, dx = min(near)
            out[y, x] = a[y + dy, x + dx]
        elif near:
            quadrants = {}
            for d, dy, dx in near:
                q = (dx > 0, dy > 0)
                quadrants[q] = min(quadrants.get(q, (np.inf,)), (d, abs(dx), a[y + dy, x + dx]))
            out[y, x] = sum(v / d**0.5 for d, _, v in quadrants.values()) / sum(1 / d**0.5 for d, _, _ in quadrants.values())
    return out


@pytest.mark.parametrize("how", ["nearest", "interpolate"])
def test_fills_are_the_plain_ones(how):
    fill = {"nearest": raster.nearest_fill, "interpolate": raster.interpolated_fill}[how]
    rng = np.random.default_rng(0)
    for share in (0.0, 0.02, 0.1, 0.5, 1.0):
        for shape in ((13, 17), (1, 9), (20, 3)):
            a = np.where(rng.random(shape) < share, rng.uniform(1, 9, shape), np.nan)
            for distance in (1, 3, 6, 40):
                want = plain(a, distance, how)
                np.testing.assert_allclose(fill(a, distance), want, rtol=1e-12)
                part = (slice(2, 11), slice(1, 3))
                np.testing.assert_allclose(fill(a, distance, part), want[part], rtol=1e-12)


def test_one_known_cell_fills_a_large_tile_at_once():
    a = np.full((512, 512), np.nan)
    a[300, 200] = 7
    for fill, most in ((raster.nearest_fill, 2), (raster.interpolated_fill, 8)):
        began = time.time()
        out = fill(a, 100)
        assert time.time() - began < most
        y, x = np.mgrid[:512, :512]
        assert (np.isclose(out, 7) == ((y - 300) ** 2 + (x - 200) ** 2 <= 10_000)).all()


@pytest.mark.parametrize("how", ["nearest", "interpolate"])
@pytest.mark.parametrize("distance", [3, 11])
def test_tiles_are_filled_across_their_edges(spark, how, distance):
    """Two by three tiles of eight cells, also where the reach is wider than a tile."""
    rng = np.random.default_rng(distance)
    whole = np.where(rng.random((16, 24)) < 0.04, rng.uniform(1, 9, (16, 24)), np.nan)
    rows = [
        (f"b{by}{bx}", 0, 0, 8, 8, [8.0 * bx, 1.0, -8.0 * by, -1.0], "x", [None if np.isnan(v) else float(v) for v in whole[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8].ravel()])
        for by in range(2)
        for bx in range(3)
    ]
    tiles = spark.createDataFrame(rows, "block_key string, chunk_row int, chunk_col int, height int, width int, transform array<double>, crs string, data array<float>")
    filled = raster.fill_across(tiles, distance, how)
    assert filled.columns == tiles.columns
    want = plain(whole.astype(np.float32).astype(float), distance, how)
    for r in filled.collect():
        by, bx = int(r["block_key"][1]), int(r["block_key"][2])
        np.testing.assert_allclose(np.array(r["data"], float).reshape(8, 8), want[8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8], rtol=1e-6)
    with pytest.raises(ValueError, match="unknown way"):
        raster.fill_across(tiles, distance, "guess")
