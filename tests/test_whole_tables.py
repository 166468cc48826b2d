"""Queries that take whole tables, on tables whose ids go beyond every subset."""

import numpy as np
import pytest

from popquilt.plans import catalogue


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Folder of a table of 777 vectors, and the absolute values of their tiles."""
    sf = str(tmp_path_factory.mktemp("vectors"))
    data = np.random.default_rng(7).normal(0, 0.15, (777, 64)).round(3)
    rows = [(k, k % 3, [float(x) for x in v]) for k, v in enumerate(data)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    return sf, np.abs(data).round(3).reshape(-1, 8, 8)


def test_gaps_of_all_tiles_are_filled(spark, vectors):
    sf, tiles = vectors
    got = {(r["vec_id"], r["row"], r["col"]): r["value"] for r in catalogue.QUERIES["nearest_gap_fill"](spark, sf).collect()}
    assert len(got) == tiles.size
    for v in (0, 3, 776):
        known = [(y, x) for y in range(8) for x in range(8) if tiles[v, y, x] >= 0.2]
        for y in range(8):
            for x in range(8):
                near = min((((a - y) ** 2 + (b - x) ** 2, a - y, b - x) for a, b in known), default=(99,))
                want = tiles[v, y + near[1], x + near[2]] if near[0] <= 16 else None
                assert got[v, y, x] == (None if want is None else pytest.approx(want))


def test_every_block_has_its_halo(spark, vectors):
    sf, tiles = vectors
    rows = catalogue.QUERIES["block_halo"](spark, sf).collect()
    got = {(r["vec_id"], r["row"], r["col"]): r["value"] for r in rows}
    high = -(-len(tiles) // 5) * 8
    whole = np.full((high + 4, 44), np.nan)
    for v, t in enumerate(tiles):
        whole[v // 5 * 8 + 2 : v // 5 * 8 + 10, v % 5 * 8 + 2 : v % 5 * 8 + 10] = t
    want = {}
    for v in range(len(tiles)):
        part = whole[v // 5 * 8 : v // 5 * 8 + 12, v % 5 * 8 : v % 5 * 8 + 12]
        want |= {(v, int(y) - 2, int(x) - 2): part[y, x] for y, x in zip(*np.nonzero(~np.isnan(part)))}
    assert len(rows) == len(got) and got == pytest.approx(want)


def test_every_block_has_its_neighbours(spark, vectors):
    sf, tiles = vectors
    blocks = {}
    for v in range(len(tiles)):
        x, y = v % 25, v // 25
        a = blocks.setdefault((x // 5, y // 5), [x, y, x + 1, y + 1])
        blocks[x // 5, y // 5] = [min(a[0], x), min(a[1], y), max(a[2], x + 1), max(a[3], y + 1)]
    gap = lambda a, b, k: max(b[k] - a[k + 2], a[k] - b[k + 2], 0) * 10
    want = {("%d_%d" % p, "%d_%d" % q) for p, a in blocks.items() for q, b in blocks.items() if gap(a, b, 0) ** 2 + gap(a, b, 1) ** 2 <= 625}
    rows = [tuple(r) for r in catalogue.QUERIES["block_neighbours"](spark, sf).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_no_population_is_lost_when_pixels_are_made_dense(spark, tmp_path):
    sf = str(tmp_path)
    lines = [(k % 3, t, 100 * k, 1.0 + k, 0.05) for t in range(1, 8) for k in range(1, 10)]
    spark.createDataFrame(lines, "l_suppkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(k, 1000.0 + k) for k in range(3)], "s_suppkey long, s_acctbal double").write.parquet(f"{sf}/supplier.parquet")
    spark.createDataFrame([(k,) for k in range(1, 901)], "p_partkey long").write.parquet(f"{sf}/part.parquet")
    rows = catalogue.QUERIES["pixel_densify"](spark, sf).collect()
    assert len({(r["tile_key"], r["pixel_id"]) for r in rows}) == len(rows) == 7 * 901
    assert sum(r["pixel_population"] for r in rows) == pytest.approx(3003, abs=0.01)
    assert sum(r["pixel_population"] > 0 for r in rows) == 7 * 9


def test_all_tiles_are_interpolated(spark, vectors):
    sf, tiles = vectors
    rows = catalogue.QUERIES["raster_interpolation"](spark, sf).collect()
    got = {(r["cell_group"], r["row"], r["col"]): r["value"] for r in rows if r["time_point"] == "2002q3"}
    half = (tiles[:-1] + tiles[1:]) / 2
    want = {(int(v), int(y), int(x)): h if h >= 0.01 else 0.0 for (v, y, x), h in np.ndenumerate(half) if abs(h - 0.01) > 1e-6}
    assert len(rows) == 3 * half.size and len(got) == half.size
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-5)
