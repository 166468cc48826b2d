"""Union, repair and buffers of polygons, against points and against each other."""

import numpy as np
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from popquilt.operators import arrangement as A
from popquilt.operators import geometry as G
from popquilt.operators import polygons as PG
from popquilt.operators import spatial_join


def enclosed(polygons, size, odd=False):
    """What Spark spreads over cells, in a loop."""
    cells = {}
    for parts in polygons:
        for cx, cy, winding, edges in A.place(A.to_units(A.raw_edges(parts) if odd else G.edges_of(parts), size)):
            cell = cells.setdefault((cx, cy), [0, []])
            cell[0] += winding
            cell[1] += [] if edges is None else [edges]
    found = [np.empty((0, 4), np.int64)]
    for (cx, cy), (winding, edges) in cells.items():
        if edges:
            box = (cx << A.BITS, cy << A.BITS, (cx + 1) << A.BITS, (cy + 1) << A.BITS)
            found.append(A.bounding(np.concatenate(edges), winding, box, (2 * box[0] + A.REF[0], 2 * box[1] + A.REF[1]), odd))
    found = np.concatenate(found)
    return A.polygons_of(found, size) if len(found) else []


ring = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=3, max_size=7)
GRID = [(i + 0.3141593, j + 0.1732051) for i in range(8) for j in range(8)] + [(i + 0.7718282, j + 0.5878116) for i in range(8) for j in range(8)]


@settings(max_examples=80, deadline=None, phases=[Phase.generate])
@given(st.lists(ring, min_size=1, max_size=4), st.sampled_from([1.0, 2.5, 100.0]))
def test_what_rings_enclose(rings, size):
    """On whole numbers, where ends, edges and cells' sides coincide. Ends a unit beside cells' sides are not tested: see the README."""
    rings = [np.array(r, float) for r in rings]
    x, y = np.array(GRID).T
    odd = [G.inside_edges(A.raw_edges([[r]]), x, y) for r in rings]
    repaired = [enclosed([[[r]]], size, odd=True) for r in rings]
    for r, got, want in zip(rings, repaired, odd):
        assert (G.contains(got, x, y) if got else np.zeros(len(x), bool)).tolist() == want.tolist(), r.tolist()
    both = enclosed([[rings]], size, odd=True)
    assert (G.contains(both, x, y) if both else np.zeros(len(x), bool)).tolist() == (np.sum(odd, axis=0) % 2 == 1).tolist()
    valid = [p for p in repaired if p]
    union = enclosed(valid, size)
    assert (G.contains(union, x, y) if union else np.zeros(len(x), bool)).tolist() == np.any(odd, axis=0).tolist()
    assert G.area(union) == pytest.approx(G.area(enclosed(valid, 37.0)), abs=1e-4)  # holes are of the parts around them
    assert all(G.ring_area(p[0]) > 0 for p in union)


def frame(spark, shapes):
    return spark.createDataFrame([(k, None if p is None else bytearray(G.write_wkb(p))) for k, p in shapes], "id int, geometry binary")


def area_of(row):
    return None if row["geometry"] is None else round(G.area(G.read_wkb(bytes(row["geometry"]))), 6)


def test_union_of_groups(spark):
    ringed = [[G.box(0, 0, 9, 9)[0][0], G.box(3, 3, 6, 6)[0][0]]]
    shapes = [(1, G.box(0, 0, 2, 1)), (1, G.box(1, 0, 3, 1)), (1, G.box(5, 5, 6, 6)), (2, ringed), (2, G.box(4, 4, 5, 5)), (None, G.box(0, 0, 1, 1)), (None, G.box(1, 0, 2, 1)), (3, None)]
    got = {r["id"]: r for r in PG.union(frame(spark, shapes), ["id"], 2.0).collect()}
    assert {k: area_of(r) for k, r in got.items()} == {1: 4.0, 2: 73.0, None: 2.0}
    parts = {k: sorted(len(rings) for rings in G.read_wkb(bytes(r["geometry"]))) for k, r in got.items()}
    assert parts == {1: [1, 1], 2: [1, 2], None: [1]}
    assert 4 <= len(G.read_wkb(bytes(got[None]["geometry"]))[0][0]) <= 6 and (got[1]["minx"], got[1]["maxx"]) == (0.0, 6.0)
    assert PG.union(frame(spark, []), ["id"], 2.0).collect() == []


@pytest.mark.parametrize("small", [0, 1 << 15])
def test_repair_and_faults(spark, small, monkeypatch):
    """Also with every polygon spread over cells."""
    monkeypatch.setattr(PG, "SMALL", small)
    P = lambda *points: [[np.array(points, float)]]
    shapes = {
        1: P((0, 0), (4, 4), (4, 0), (0, 4)),  # crosses itself
        2: P((0, 0), (3, 0), (5, 0), (3, 0), (3, 3), (0, 3)),  # a spike
        3: G.box(0, 0, 5, 5),
        4: [[G.box(0, 0, 2, 2)[0][0], G.box(5, 5, 6, 6)[0][0]]],  # a hole outside
        5: [[G.box(0, 0, 6, 6)[0][0], G.box(1, 1, 2, 2)[0][0]]],
        6: P((0, 0), (1, 1), (2, 2)),  # no area
        7: None,
        8: P((0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2)),  # two boxes that touch in a point
    }
    df = frame(spark, shapes.items())
    done = {r["id"]: r for r in PG.repaired(df, ["id"], 2.0).collect()}
    assert {k: area_of(r) for k, r in done.items()} == {1: 8.0, 2: 9.0, 3: 25.0, 4: 5.0, 5: 35.0, 6: None, 7: None, 8: 8.0}
    assert len(G.read_wkb(bytes(done[8]["geometry"]))) == 2
    wrong = {(r["id"], r["fault"]) for r in PG.faults(df, ["id"], 2.0).collect()}
    assert wrong == {(1, "crossing"), (2, "crossing"), (2, "overlap"), (4, "nesting"), (6, "overlap"), (8, "crossing")}
    at = [(r["x"], r["y"]) for r in PG.faults(df.filter("id = 1"), ["id"], 3.0).collect()]
    assert at == [(pytest.approx(2.0), pytest.approx(2.0))]
    again = PG.faults(PG.repaired(df, ["id"], 2.0), ["id"], 2.0).collect()
    assert again == []


def test_buffers(spark):
    d = 0.5
    circle = PG.ROUND / 2 * np.sin(2 * np.pi / PG.ROUND) * d * d
    triangle = np.array([[0, 0], [4, 0], [1, 3.0]])
    around = sum(np.hypot(*(triangle - np.roll(triangle, 1, axis=0)).T))
    shapes = {1: G.box(0, 0, 3, 2), 2: [[triangle]], 3: [[G.box(0, 0, 9, 9)[0][0], G.box(4, 4, 4.5, 4.5)[0][0]]], 4: None, 5: G.box(0, 0, 1, 1) + G.box(1.5, 0, 2.5, 1)}
    got = {r["id"]: area_of(r) for r in PG.buffered(frame(spark, shapes.items()), ["id"], d, 4.0).collect()}
    assert got[1] == pytest.approx(6 + 10 * d + circle, abs=1e-5)
    assert got[2] == pytest.approx(6 + around * d + np.pi * d * d, rel=3e-3) and got[4] is None
    assert got[3] == pytest.approx(81 + 36 * d + circle, abs=1e-5)  # the hole is closed
    assert 2.5 + 7 * d < got[5] < 2 * (1 + 4 * d + circle)  # both grow into the gap
    with pytest.raises(ValueError, match="negative"):
        PG.buffered(frame(spark, []), ["id"], -1.0, 4.0)


@pytest.mark.parametrize(("distance", "size"), [(0.0, 3.0), (1.5, 3.0), (7.0, 2.0)])
def test_pairs_are_those_near_enough(spark, distance, size):
    """Boxes in, around, across and beside polygons, with the distance wider than a cell too."""
    rng = np.random.default_rng(int(size * 10 + distance))
    shapes = {}
    for k in range(8):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 9))
        shapes[k] = [[rng.uniform(0, 30, 2) + (rng.uniform(2, 9, 9) * [np.cos(angle), np.sin(angle)]).T]]
    shapes[8] = [[G.box(2, 2, 28, 28)[0][0], G.box(8, 8, 22, 22)[0][0]]]
    boxes = [(int(k), *map(float, (*c, *(c + s)))) for k, (c, s) in enumerate(zip(rng.uniform(-5, 35, (60, 2)), rng.choice([0.2, 2.0, 9.0], 60)))]
    boxes += [(60, 0.0, 0.0, 30.0, 30.0), (61, 12.0, 12.0, 13.0, 13.0), (61, 12.0, 12.0, 13.0, 13.0)]
    got = spatial_join.pairs(G.with_bounds(frame(spark, shapes.items())), spark.createDataFrame(boxes, "box_id int, bx0 double, by0 double, bx1 double, by1 double"), size, distance)
    assert got.columns == ["id", "minx", "miny", "maxx", "maxy", "box_id", "bx0", "by0", "bx1", "by1"]
    want = sorted((k, b[0]) for k, p in shapes.items() for b in boxes if G.distance_to_box(p, *b[1:]) <= distance)
    assert sorted((r["id"], r["box_id"]) for r in got.collect()) == want


def test_pairs_of_a_large_polygon(spark):
    import time

    angle = 2 * np.pi * np.arange(500) / 500
    star = [[(1000 * (1 + 0.2 * (np.arange(500) % 2)) * [np.cos(angle), np.sin(angle)]).T]]
    rows = [(i, float(x), float(y), float(x) + 20.0, float(y) + 20.0) for i, (x, y) in enumerate(np.random.default_rng(0).uniform(-1300, 1300, (5000, 2)))]
    df, boxes = G.with_bounds(frame(spark, [(1, star)])), spark.createDataFrame(rows, "box_id int, bx0 double, by0 double, bx1 double, by1 double").cache()
    spatial_join.pairs(df, boxes, 200.0, 10.0).count()
    began = time.time()
    found = {r["box_id"] for r in spatial_join.pairs(df, boxes, 200.0, 10.0).collect()}
    assert time.time() - began < 8
    assert {i for i, *b in rows[:200] if G.distance_to_box(star, *b) <= 10.0} == {i for i in found if i < 200}


def test_reprojection_follows_the_projected_edges(spark):
    """A triangle's area where areas are kept, points along its edges elsewhere, and what is at the seam."""
    from popquilt.functions.constants import CRS

    triangle = [[np.array([[10, 5], [60, 20], [25, 70.0]])]]
    lon, lat = np.meshgrid(np.arange(0.05, 70, 0.1), np.arange(0.05, 75, 0.1))
    inside = G.contains(triangle, lon, lat)
    sphere = 6378137.0**2 * np.sum(np.cos(np.radians(lat[inside]))) * np.radians(0.1) ** 2
    across = [[np.array([[170, -5], [-165, -5], [-165, 5], [170, 5.0]])]]
    shapes = frame(spark, [(1, triangle), (2, across), (3, None)])
    flat = {r["id"]: r["geometry"] for r in PG.reprojected(shapes, CRS["mollweide"], 100.0).collect()}
    assert G.area(G.read_wkb(bytes(flat[1]))) == pytest.approx(sphere, rel=2e-3) and flat[3] is None
    assert len(G.read_wkb(bytes(flat[1]))[0][0]) > 30 and len(G.read_wkb(bytes(flat[2]))) == 2
    turned = G.read_wkb(bytes(PG.reprojected(shapes.filter("id = 2"), CRS["world_cylindrical_anti_meridian"], 100.0).first()["geometry"]))
    assert len(turned) == 1 and len(turned[0][0]) == 4
    x = turned[0][0][:, 0]
    assert sorted(set(np.round(x / 6378137.0 * 180 / np.pi, 6))) == [-10.0, 15.0]
    coarse, fine = (len(G.read_wkb(bytes(PG.reprojected(shapes.filter("id = 1"), CRS["mollweide"], t).first()["geometry"]))[0][0]) for t in (10_000.0, 100.0))
    assert coarse < fine
