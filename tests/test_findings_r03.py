"""Work on columns of polygons, splits of few tiles, and windows of whole texts: as one by one, and spread over tasks."""

import time

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import SMALL, queries
from popquilt.functions.constants import CRS
from popquilt.llm import secrets, spm
from popquilt.operators import arrangement as A
from popquilt.operators import geometry as G
from popquilt.operators import model
from popquilt.operators import polygons as PG
from popquilt.operators import spatial_join
from popquilt.plans import inputs as I


def shapes(count):
    rng = np.random.default_rng(count)
    ring = lambda k: rng.integers(0, 7, (rng.integers(1, 9), 2)) * (1.0 if k % 2 else 0.37)
    made = [None if k % 7 == 0 else [[ring(k)]] if k % 7 < 4 else [[ring(k), ring(k)]] if k % 7 < 6 else [[ring(k)], [ring(k), ring(k)]] for k in range(count)]
    return made, pd.Series([None if p is None else G.write_wkb(p) for p in made], dtype=object)


def test_f7_columns_are_clipped_as_polygons_are():
    made, wkb = shapes(500)
    box = (1.0, 0.5, 3.3, 4.0)
    flat = G.read_column(wkb)
    got = G.write_column(G.clip_column(flat, *(np.full(len(flat[2]), v) for v in box)), len(wkb))
    assert got == [None if p is None or not (c := G.clip(p, *box)) else G.write_wkb(c) for p in made]


def test_f8_hulls_of_rows_are_those_of_points():
    points = np.random.default_rng(0).integers(0, 4, (400, 6, 2)).astype(float)
    for p, got in zip(points, G.convex_hulls(points)):
        assert got.tolist() == G.convex_hull(p).tolist()


def test_f8_polygons_of_parts_are_not_one_task(spark):
    assert I.table(spark, SMALL, "part").rdd.getNumPartitions() == 1
    assert queries()["hulls_and_parts"](spark, SMALL).rdd.getNumPartitions() >= 4
    made = I.part_shapes(spark, SMALL)
    assert made.count() == made.distinct().count() == I.table(spark, SMALL, "part").count()


def frame(spark, n):
    return spark.createDataFrame([(k, bytearray(G.write_wkb(G.box(0.0, 0.0, 1 + k % 50, 2 + k % 7)))) for k in range(n)], "id int, geometry binary").coalesce(1)


def test_f1_equal_polygons_of_a_group_cost_nothing(spark):
    df = frame(spark, 700).selectExpr("0 as g", "geometry").crossJoin(spark.range(60)).select("g", "geometry").cache()
    df.count()
    began = time.time()
    (row,) = PG.union(df, ["g"], 16.0).collect()
    assert time.time() - began < 40 and row["maxx"] == 50.0


def test_f2_f3_f10_a_small_file_is_not_one_task(spark):
    df = frame(spark, 100)
    assert df.rdd.getNumPartitions() == 1
    for out in (PG.buffered(df, ["id"], 0.75, 64.0), PG.repaired(df, ["id"], 32.0), PG.reprojected(df, CRS["equal_area"], 10.0)):
        assert out.rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("size", [2.5, 30.0, 64.0])
@pytest.mark.parametrize("kind", ["repaired", "buffered"])
def test_f2_f3_many_polygons_together_are_as_each_alone(size, kind):
    rng = np.random.default_rng(5)
    some = [[[rng.integers(0, 9, (rng.integers(3, 9), 2)) * (1.0 if k % 2 else 0.37) for _ in range(1 + k % 2)]] for k in range(60)]
    odd = kind == "repaired"
    got = PG._alone(np.array([G.write_wkb(p) for p in some], object), size, PG._raw if odd else PG._covers(0.75), odd)
    for p, g in zip(some, got):
        found = [np.empty((0, 4), np.int64)]
        for cx, cy, winding, own in A.place(A.to_units(A.raw_edges(p) if odd else PG._cover(p, 0.75), size)):
            if own is not None:
                box = (cx << A.BITS, cy << A.BITS, (cx + 1) << A.BITS, (cy + 1) << A.BITS)
                found.append(A.bounding(own, winding, box, (2 * box[0] + A.REF[0], 2 * box[1] + A.REF[1]), odd))
        kept = np.concatenate(found)
        assert g == (G.write_wkb(A.polygons_of(kept, size)) if len(kept) else None)


def test_f6_rows_of_few_tiles_are_not_shuffled_by_tile(spark):
    rows = spark.range(1000).selectExpr("case when id < 0 then 'd' else 'abc' end as tile_key", "cast(id as double) as y", "1.0D as built", "cast(id as double) as x")
    parts = spark.createDataFrame([("abc", "train"), ("d", "test")], "tile_key string, split string")
    out = model.scores(rows, parts, model.Linear(0.0), "population", "population", "y", metrics=("mae",))
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString() and out.first()["rows"] == 1000


def test_f4_windows_hold_every_letter():
    text = "Words, 1 and 2; more of them " * 37 + "End7"
    letters = "".join(c for c in text if c.isalnum()).lower()
    for length in secrets.STRATA:
        own = [w for w in secrets.text_windows(text) if len(w) == length]
        assert len(own) == -(-len(letters) // length)
        left = len(letters) % length
        assert "".join(own[:-1]) + own[-1][length - left if left else 0 :] == letters
    assert sum(secrets.window_counts([text, text]).values()) == 2 * len(secrets.text_windows(text))


def test_f5_lists_of_points_are_short(spark):
    points = spark.range(5000).selectExpr("id", "named_struct('cx', id div 3000, 'cy', 0L) as _c").coalesce(1)
    rows = spatial_join.packed(points).collect()
    assert max(len(r["_rows"]) for r in rows) <= spatial_join.PACKED
    assert sorted(x["id"] for r in rows for x in r["_rows"]) == list(range(5000))
    assert all(x["id"] // 3000 == r["_cx"] for r in rows for x in r["_rows"])


def test_op3_edges_are_drawn_as_characters_come():
    v = spm.vocabulary()
    text = "thequickbrownfoxjumpsoverthelazydog" * 20
    trellis, ids = spm.Viterbi(v), []
    for c in text:
        ids += trellis.push(c)
        assert trellis.window[-1] is not None
    ids += trellis.finish()
    assert trellis.most <= 2 * v.longest and "".join(v.pieces[i] for i in ids) == text and ids == spm.Encoder(v).run(text)


def test_op3_windows_outlive_boundaries_without_a_path():
    class Gaps:
        kind, pieces, scores, longest = "unigram", ["abc", "cab", "bca", "aabb", "b", "ccc"], [-1.0, -2.0, -1.5, -1.2, -3.0, -0.5], 4
        ids = {p: i for i, p in enumerate(pieces)}
        tree = spm.tree_of(ids)

    def best(text):
        return max((Gaps.scores[i] + best(text[len(p) :]) for p, i in Gaps.ids.items() if text.startswith(p)), default=0.0 if not text else float("-inf"))

    rng = np.random.default_rng(0)
    for _ in range(300):
        text = "".join(Gaps.pieces[k] for k in rng.integers(0, 6, rng.integers(1, 9)))
        trellis = spm.Viterbi(Gaps)
        ids = [i for c in text for i in trellis.push(c)] + trellis.finish()
        assert "".join(Gaps.pieces[i] for i in ids) == text and sum(Gaps.scores[i] for i in ids) == pytest.approx(best(text))


def test_op3_a_worker_keeps_its_stretches():
    own = spm.encoder_of("piece_bpe_32k.model", "bpe")
    ids = own.ids("Words that are kept")
    assert "▁kept" in spm.encoder_of("piece_bpe_32k.model", "bpe").memo and ids.tolist() == own.encode("Words that are kept")
