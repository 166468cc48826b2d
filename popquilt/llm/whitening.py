"""Whitening of embeddings by principal components, with a covariance made of tiles.

Dimensions are cut into blocks, and pairs of blocks are the tiles of the covariance. Rows are
cut into row-blocks; each block of columns of a row-block goes to the tiles that it is part
of, keyed by tile and row-block, where two blocks are multiplied. A task adds up the products
of its row-blocks, and a tile is the sum over tasks. No task holds more of the matrix than
tiles, nor more rows than a row-block; the driver gets the tiles, whose number follows the
dimensions and not the rows, and finds the components.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, table
from popquilt.llm.vectors import floors, kept_vectors, longs, matrix

#: Columns of a tile, and rows of a row-block.
TILE, ROWS = 32, 4096
#: Components that come back.
COMPONENTS = 32
#: Beyond these, whole numbers are Python's: their multiples by the number of rows, or their squares' sums, would not fit.
BOUND = 1 << 44
SCALE, SHIFT = 64, 1_000_000

_PART = "first int, second int, product binary"


def _row_blocks(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[np.ndarray]:
    """The last column of a task's batches as matrices of at most ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = matrix(batch.column(batch.num_columns - 1).slice(at, rows), size)
            if n + len(part) > rows:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield np.concatenate(held)


def tiled_products(vectors: DataFrame, size: int, centre: Callable[[np.ndarray], np.ndarray], tile: int = TILE, length: int | None = None, rows: int = ROWS) -> np.ndarray:
    """The sum over all vectors of c * c', where c is what ``centre`` makes of a vector, of ``size`` entries.

    ``vectors`` has one column of lists of doubles, of that size unless ``length`` is given.
    """
    edges = list(range(0, size, tile)) + [size]
    blocks = len(edges) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, x in enumerate(_row_blocks(batches, length or size, rows)):
            c = centre(x)
            columns = [np.ascontiguousarray(c[:, edges[b] : edges[b + 1]]).tobytes() for b in range(blocks)]
            keys = [(i, j, i) for i in range(blocks) for j in range(i, blocks)] + [(i, j, j) for i in range(blocks) for j in range(i + 1, blocks)]
            first, second, block = (pa.array(x, pa.int32()) for x in zip(*keys))
            yield pa.RecordBatch.from_arrays(
                [first, second, pa.array([task << 32 | k] * len(keys), pa.int64()), block, pa.array([columns[b] for *_, b in keys], pa.binary())],
                names=["first", "second", "row_block", "block", "entries"],
            )

    def multiply(key: tuple[pa.Scalar, ...], pair: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        found = {b: np.frombuffer(e) for b, e in zip(pair.column("block").to_pylist(), pair.column("entries").to_pylist())}
        a, b = (found[k].reshape(-1, edges[k + 1] - edges[k]) for k in (i, j))
        return pa.table([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([(a.T @ b).tobytes()], pa.binary())], names=["first", "second", "product"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(1))
        for batch in batches:
            for i, j, product in zip(*(c.to_pylist() for c in batch.columns)):
                sums[i, j] = sums[i, j] + np.frombuffer(product)
        for (i, j), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["first", "second", "product"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(batches)

    dealt = vectors.mapInArrow(cut, "first int, second int, row_block long, block int, entries binary")
    products = dealt.groupBy("first", "second", "row_block").applyInArrow(multiply, _PART).mapInArrow(total, _PART)
    whole = np.zeros((size, size))
    for r in products.groupBy("first", "second").applyInArrow(meet, _PART).collect():  # a row for each tile
        i, j = slice(edges[r["first"]], edges[r["first"] + 1]), slice(edges[r["second"]], edges[r["second"] + 1])
        whole[i, j] = np.frombuffer(r["product"]).reshape(i.stop - i.start, j.stop - j.start)
        whole[j, i] = whole[i, j].T
    return whole


def totals(vectors: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], length: int | None = None, rows: int = ROWS) -> tuple[int, np.ndarray]:
    """The number of vectors and the sums of the ``size`` entries that ``of`` makes of each, exact where they are whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, object)
        for x in _row_blocks(batches, length or size, rows):
            n, sums = n + len(x), sums + of(x).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([repr(s) for s in sums.tolist()], pa.string())], names=["place", "n", "total"])

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            total += sum(float(v) if set(v) & set(".en") else int(v) for v in batch.column("total").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([repr(total)])], names=["place", "n", "total"])

    schema = "place int, n long, total string"
    found = sorted(vectors.mapInArrow(add, schema).groupBy("place").applyInArrow(meet, schema).collect())  # a row for each dimension
    out = np.empty(size, object)
    out[:] = [float(r["total"]) if set(r["total"]) & set(".en") else int(r["total"]) for r in found]
    return found[0]["n"], out


def deviations(values: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums as exact whole numbers, x being whole numbers made of ``values``."""
    x = floors(values, SCALE, BOUND) + SHIFT
    most = max([abs(int(s)) for s in sums] + [1])
    if x.dtype != object and n * (int(np.abs(x).max(initial=0)) + 1) + most < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _square_sums(d: np.ndarray) -> np.ndarray:
    if d.dtype != object and len(d) and d.shape[1] * int(np.abs(d).max()) ** 2 >= 2**63:
        d = d.astype(object)
    return (d * d).sum(axis=1)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Entries c count as x = floor(64 c) + 1,000,000. Vectors that are null or hold null or
    non-finite entries are left out, and so are those that have not the commonest length.
    Components without variance (an eigenvalue of no more than rounding errors of the largest
    one) have a null ``whitened`` and take no part in identity_error, which is null where no
    component has any; explained is null if all rows are equal. A deviation beyond a long is
    null. Null and repeated keys stay as they are, repeated rows count as often as they come;
    other columns are not read; an empty table gives no rows. Components whose eigenvalues are
    equal are any base of their space.
    """
    spark = df.sparkSession
    rows, size = kept_vectors(df, column, F.col(key).cast("long").alias("vec_id"))
    if not size:
        return spark.createDataFrame([], f"vec_id long, {SCHEMA}")
    vectors = rows.select("vector")
    n, sums = totals(vectors, size, lambda v: floors(v, SCALE, BOUND) + SHIFT)

    def centred(v: np.ndarray) -> np.ndarray:
        return deviations(v, n, sums).astype(float) / n

    covariance = tiled_products(vectors, size, centred, tile) / n
    values, base = np.linalg.eigh(covariance)
    values, base = values[::-1][:components], base[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    varied = values > size * np.finfo(float).eps * max(float(values[0]), 0.0)
    to_unit = base[:, varied] / np.sqrt(values[varied])
    known, count = int(varied.sum()), len(values)

    # What the whitened vectors' covariance really is, by the same tiles.
    error = None
    if known:
        means = totals(vectors, known, lambda v: centred(v) @ to_unit, size)[1].astype(float) / n
        products = tiled_products(vectors, known, lambda v: centred(v) @ to_unit - means, tile, size)
        error = float(np.abs(products / n - np.eye(known)).max())
    explained = [float(e) / trace for e in values] if trace > 0 else [None] * count

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("vector"), size)
            d = deviations(v, n, sums)
            w = np.zeros((len(v), count))
            w[:, :known] = d.astype(float) / n @ to_unit
            m = len(v)
            place = np.tile(np.arange(1, count + 1, dtype=np.int32), m)
            back = pa.array(np.repeat(np.arange(m), count))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(back), pa.array(place), pa.array(np.full(m * count, n)), longs(_square_sums(d)).take(back),
                 pa.array(w.ravel(), mask=place > known), pa.array(explained * m, pa.float64()), pa.array([error] * (m * count), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, f"vec_id long, {SCHEMA}")


def op12_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(prepare(spark), sf_dir, "embeddings"))


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12's exact part: each vector's deviation from the mean."""
    return op12_tiled_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


DEVIATIONS_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT r, vec_id, unnest(range(1, len(e) + 1)) AS p, (floor(64 * unnest(e)::DOUBLE) + 1000000)::HUGEINT AS x FROM v),
s AS (SELECT p, count(*)::HUGEINT AS n, sum(x)::HUGEINT AS s FROM x GROUP BY p)
SELECT vec_id, any_value(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM x JOIN s USING (p) GROUP BY r, vec_id
"""
