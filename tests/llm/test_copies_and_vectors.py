"""Exact copies by fingerprints, whitening, and product codes."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popquilt.llm import codes, fingerprints, whitening

# Exact copies


def polynomial(data, point):
    h = 0
    for b in data:
        h = (h * point + b) % fingerprints.PRIME
    return h


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=300)), max_size=8))
def test_hashes_are_polynomials(texts):
    got = fingerprints.chunk_hashes(pa.array(texts, pa.binary()))
    for point, h in zip(fingerprints.POINTS, got):
        assert h.tolist() == [polynomial(t or b"", point) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, fingerprints.PRIME - 1), st.integers(0, fingerprints.PRIME - 1)), min_size=1))
def test_products_are_exact(pairs):
    a, b = (np.array(x, np.uint64) for x in zip(*pairs))
    assert fingerprints.product(a, b).tolist() == [x * y % fingerprints.PRIME for x, y in pairs]


def test_hashes_compose():
    a, b = b"one part " * 50, b"and another" * 70
    for point in fingerprints.POINTS:
        assert polynomial(a + b, point) == (polynomial(a, point) * pow(point, len(b), fingerprints.PRIME) + polynomial(b, point)) % fingerprints.PRIME
    full = bytes([255]) * fingerprints.CHUNK  # the largest sums that a chunk can have
    assert [int(h[0]) for h in fingerprints.chunk_hashes(pa.array([full]))] == [polynomial(full, p) for p in fingerprints.POINTS]


def plain_copies(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def corpus(rng):
    texts = [None, "", "", "a", "A", "a ", "é" * 50, "x" * 200, "x" * 201, "x" * 199 + "y", "y" + "x" * 199]
    texts += [" ".join(rng.choices("abcdef", k=rng.randint(1, 200))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts * 2 + texts[:20])]
    return rows + [(500 + i, "hot") for i in range(200)] + [(7, "a"), (7, "a"), (7, "b" * 300), (None, "x" * 200), (None, "lone"), (None, None), (-5, "minus" * 40), (-6, "minus" * 40)]


@pytest.mark.parametrize(("chunk", "bits"), [(fingerprints.CHUNK, 61), (64, 61), (100, 3), (fingerprints.CHUNK, 0)])
def test_copies_are_the_plain_ones(spark, chunk, bits):
    """Also with chunks of a few bytes, and with so few bits that different texts share a fingerprint."""
    from popquilt.llm.common import prepare

    rows = corpus(random.Random(5))
    if not bits:
        rows = [r for r in rows if len(r[1] or "") < 12]  # each round settles one text of those with as many bytes
    docs = prepare(spark).createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, sha string, n int").repartition(3)
    got = fingerprints.exact_copies(docs, chunk, bits).collect()
    assert sorted(map(tuple, got), key=str) == plain_copies(rows)


def test_copies_of_nothing_and_of_long_texts(spark, tmp_path):
    from popquilt.llm.common import prepare

    prepare(spark)
    assert fingerprints.exact_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    long = "0123456789abcdef" * 120_000
    rows = [(1, long), (2, long), (3, long[:-1] + "!"), (4, "!" + long[1:])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op11_polynomial_fingerprints(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain_copies(rows)


# Whitening


def vectors(spark, rows, kind="float"):
    from popquilt.llm.common import prepare

    return prepare(spark).createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, vector string").repartition(3)


def odd_rows(size=5):
    bad = [None, [None] * size, [float("nan")] * size, [1.0] * (size - 1) + [math.inf], [1.0] * (size - 1), []]
    return [(1000 + i, v, None, "v") for i, v in enumerate(bad)]


@pytest.mark.parametrize("tile", [2, 32])
def test_whitening_is_plain_numpy(spark, tile):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [3, -2, 0, 1, 0]).astype(np.float32)
    rows = [(i % 290, v.tolist(), 0, "v") for i, v in enumerate(x)] + [(None, x[0].tolist(), 1, "v")]
    got = whitening.whitened(vectors(spark, rows + odd_rows()), tile=tile).collect()
    exact = [[math.floor(64 * float(c)) + 1_000_000 for c in r[1]] for r in rows]
    n, sums = len(rows), [sum(c) for c in zip(*exact)]
    far = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in exact]
    assert len(got) == 5 * n and {r["n"] for r in got} == {n}
    assert sorted((r["deviation"], str(r["vec_id"])) for r in got if r["component"] == 1) == sorted((d, str(r[0])) for d, r in zip(far, rows))
    centred = np.array(exact) - np.array(sums) / n
    values, base = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ base[:, ::-1] / np.sqrt(values[::-1])
    for k in range(5):
        mine = sorted((r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        own = sorted(zip(far, want[:, k]))
        sign = np.sign(np.dot([w for _, w in mine], [w for _, w in own]))
        assert np.allclose([sign * w for _, w in mine], [w for _, w in own], atol=1e-7)
        (share,) = {r["explained"] for r in got if r["component"] == k + 1}
        assert share == pytest.approx(values[::-1][k] / values.sum(), rel=1e-6)
    assert {r["identity_error"] for r in got}.pop() < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_whitening_of_few_equal_and_large_vectors(spark):
    assert whitening.whitened(vectors(spark, odd_rows(3)[:4])).collect() == []
    same = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0, ""), (1, [1.0, 2.0], 0, "")])).collect()
    assert [(r["vec_id"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(1, 0, None, None, None)] * 4
    line = whitening.whitened(vectors(spark, [(i, [float(i), 2.0 * i], 0, "") for i in range(9)])).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {None} and {r["identity_error"] for r in line}.pop() < 1e-9
    large = whitening.whitened(vectors(spark, [(i, [1e30 * i, float(i), -3.0], 0, "") for i in range(4)], "double")).collect()
    assert {r["deviation"] for r in large} == {None} and all(abs(r["whitened"]) < 2 for r in large if r["component"] == 1)
    wide = whitening.whitened(vectors(spark, [(i, np.random.default_rng(i).normal(size=70).tolist(), 0, "") for i in range(200)])).collect()
    assert len(wide) == 200 * whitening.COMPONENTS and {r["identity_error"] for r in wide}.pop() < 1e-8


# Product codes


def nearest(p, book):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in book]
    return min(range(len(d)), key=lambda k: (d[k], k)), min(d)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.integers(1, 200), st.integers(1, 9), st.integers(1, 40), st.randoms(use_true_random=False))
def test_walks_assign_each_part_to_its_nearest_entry(dims, n, k, spread, rng):
    points = np.array([[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(n)])
    book = np.array([[rng.randint(-spread, spread) for _ in range(dims)] for _ in range(k)])
    for kind in (np.int64, object):
        found, sums, counts, _ = codes.walk(codes.build(points.astype(kind), 4), book.astype(kind))
        want = [nearest(p, book)[0] for p in points]
        assert found.tolist() == want
        assert counts.tolist() == [want.count(e) for e in range(k)]
        assert sums.tolist() == [[int(sum(p[j] for p, w in zip(points, want) if w == e)) for j in range(dims)] for e in range(k)]


def test_whole_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    middles = rng.integers(-40_000, 40_000, (16, 8))
    points = middles[rng.integers(0, 16, 8000)] + rng.integers(-300, 300, (8000, 8))
    _, _, counts, compared = codes.walk(codes.build(points), middles)
    assert counts.sum() == 8000 and compared < 800


def plain_codes(rows, parts, entries=16, rounds=6):
    x = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], label) for i, v, label, _ in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = -(-len(x[0][1]) // parts)
    cut = [[(v + [0] * (m * parts))[p * m : (p + 1) * m] for p in range(parts)] for _, v, _ in x]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by = {}
    for (_, _, label), e in zip(x, errors):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for e, _ in f), d, by[label], digest) for (i, _, label), f, d in zip(x, found, errors)], key=str)


@pytest.mark.parametrize(("n", "size", "block"), [(150, 16, 4096), (150, 16, 20), (90, 11, 7), (5, 8, 4096)])
def test_codes_are_the_plain_ones(spark, n, size, block):
    rng = np.random.default_rng(n + size)
    x = np.round(rng.normal(size=(n, size)), 1).astype(np.float32)
    rows = [(int(i) % 140, v.tolist(), None if i % 5 == 0 else int(i % 3), "v") for i, v in enumerate(x)]
    rows += rows[:3] + [(None, x[0].tolist(), 1, "v")]
    got = codes.product_codes(vectors(spark, rows + odd_rows(size)), block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain_codes(rows, 8)


def test_codes_of_large_components_and_of_nothing(spark):
    assert codes.product_codes(vectors(spark, odd_rows(8)[:4])).collect() == []
    rows = [(i, [float(np.float32(1e6 * i * j)) for j in range(8)], i % 2, "") for i in range(20)] + [(99, [1e30] + [0.0] * 7, None, "")]
    got = codes.product_codes(vectors(spark, rows)).collect()
    want = [(a, b, *(None if v >= 2**63 else v for v in (c, d)), e) for a, b, c, d, e in plain_codes(rows, 8)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
