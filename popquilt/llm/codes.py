"""Product codes of embeddings, with codebooks by filtering Lloyd iterations.

Vectors of whole numbers are cut into equal parts, and the parts at a position have a
codebook. Each Spark partition cuts its rows into blocks and builds a kd-tree over each
position's parts in a block, whose nodes keep their bounding box and the sum and number of
the parts below. The trees are written once. A round walks down each tree with the entries
that may still be nearest: an entry is dropped where another is nearer to every point of a
box, and where one entry is left, the whole subtree is its own through the cached sum and
number (Kanungo and others, 2002). A round sends sums and counts, of the codebooks' size for
each task, and never rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, remove, shared_name, table, written
from popquilt.llm.vectors import floors, kept_vectors, longs, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block, whose trees are one row of the table of trees, and parts of a leaf.
BLOCK, LEAF = 4096, 32
#: Labels whose sums are sent to all tasks; more are joined.
FEW_LABELS = 100_000


@dataclass
class Tree:
    """A kd-tree. A node's parts are points[start:end]; order has their rows; a leaf's left is -1, and right is left + 1."""

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Cuts at the median of the widest dimension, until a node has no more than ``leaf`` parts or all are equal."""
    order = np.arange(len(points))
    start, end, left, low, high, total = [0], [len(points)], [-1], [], [], []
    for k in range(2 * len(points)):
        if k == len(start):
            break
        at, to = start[k], end[k]
        own = points[order[at:to]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        total.append(own.sum(axis=0))
        widths = high[k] - low[k]
        if to - at > leaf and widths.max() > 0:
            middle = (to - at) // 2
            order[at:to] = order[at:to][np.argsort(own[:, int(np.argmax(widths))], kind="stable")]
            left[k] = len(start)
            start += [at, at + middle]
            end += [at + middle, to]
            left += [-1, -1]
    return Tree(points[order], order, *(np.array(x) for x in (start, end, left, low, high, total)))


def _spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of spans, and for each place the number of its span."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def walk(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (the lowest of several), the entries' sums and counts, and the number of parts that were compared one by one."""
    k = len(entries)
    codes = np.zeros(len(tree.order), np.int64)
    sums, counts, compared = np.zeros_like(entries), np.zeros(k, np.int64), 0
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle = _nearest((((low + high)[:, None] - 2 * entries) ** 2).sum(axis=2), alive)
        best = entries[middle]
        # The corner that favours an entry most over the best one of the box's middle: if even that is no nearer, no point of the box is.
        corner = np.where(entries > best[:, None], high[:, None], low[:, None])
        own, other = ((entries - corner) ** 2).sum(axis=2), ((best[:, None] - corner) ** 2).sum(axis=2)
        alive = alive & ~((own > other) | ((own == other) & (np.arange(k) > middle[:, None])))
        one, leaf = alive.sum(axis=1) == 1, tree.left[nodes] < 0
        if one.any():
            which, at = np.argmax(alive[one], axis=1), nodes[one]
            np.add.at(sums, which, tree.total[at])
            np.add.at(counts, which, tree.end[at] - tree.start[at])
            place, owner = _spans(tree.start[at], tree.end[at])
            codes[tree.order[place]] = which[owner]
        rest = leaf & ~one
        if rest.any():
            place, owner = _spans(tree.start[nodes[rest]], tree.end[nodes[rest]])
            own = tree.points[place]
            found = _nearest(((own[:, None] - entries) ** 2).sum(axis=2), alive[rest][owner])
            np.add.at(sums, found, own)
            np.add.at(counts, found, 1)
            codes[tree.order[place]] = found
            compared += len(place)
        inner = ~leaf & ~one
        left = tree.left[nodes[inner]]
        nodes, alive = np.concatenate([left, left + 1]), np.concatenate([alive[inner]] * 2)
    return codes, sums, counts, compared


def _nearest(distances: np.ndarray, alive: np.ndarray) -> np.ndarray:
    return np.argmin(np.where(alive, distances, distances.max(initial=0) + 1), axis=1).astype(np.int64)


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """A matrix's columns in equal consecutive parts; a length that parts do not divide is filled up with zeros."""
    if x.shape[1] % parts:
        x = np.concatenate([x, np.zeros((len(x), -x.shape[1] % parts), x.dtype)], axis=1)
    return np.split(x, parts, axis=1)


def product_codes(df: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector; see ``codebooks`` for what a code means.

    Components x count as floor(4096 x). Vectors that are null or hold null or non-finite
    components are left out, and so are those that have not the commonest length; a length
    that is no multiple of ``parts`` is filled up with zeros. Codebooks start as the parts of
    the vectors of the smallest keys (nulls last, ties by the vector; all, if there are fewer);
    at most 256 entries. Rows of a null key, repeated rows, null and NaN labels count as all
    others; other columns are not read; an empty table gives no rows. Errors beyond a long
    are null, and so are the sums that they are part of.
    """
    spark = df.sparkSession
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows, size = kept_vectors(df, column, F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"))
    if not size:
        return spark.createDataFrame([], schema)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    wide = -(-size // parts)
    # Below this, no sum of squares of differences of doubled components leaves 64 bits.
    bound = int((2**62 / (16 * wide)) ** 0.5)
    books = [b.astype(object) for b in cut(floors(np.array([r["vector"] for r in first]), SCALE, bound), parts)]
    k = len(first)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            trees = [build(p) for p in cut(floors(matrix(one.column("vector"), size), SCALE, bound), parts)]
            columns = [pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), one.column(c)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(trees)], pa.binary())], names=["vec_ids", "labels", "trees"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block:
                    yield made()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield made()

    kind = rows.schema["label"].dataType.simpleString()
    at = shared_name(spark, "trees")
    trees = written(rows.mapInArrow(plant, f"vec_ids array<long>, labels array<{kind}>, trees binary"), at)

    def fitting(book: np.ndarray, tree: Tree) -> np.ndarray:
        """The codebook in the tree's kind of numbers, or both in Python's."""
        if tree.points.dtype != object and np.abs(book).max() < bound:
            return book.astype(np.int64)
        for name in ("points", "low", "high", "total"):
            setattr(tree, name, getattr(tree, name).astype(object))
        return book

    def round_of(books: list[np.ndarray]) -> list[np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [(np.zeros_like(b), np.zeros(k, np.int64)) for b in books]
            for batch in batches:
                for blob in batch.column("trees"):
                    for p, tree in enumerate(pickle.loads(blob.as_py())):
                        _, s, n, _ = walk(tree, fitting(books[p], tree))
                        sums[p] = sums[p][0] + s, sums[p][1] + n
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([pickle.dumps(s) for s in sums], pa.binary())], names=["part", "sums"])

        def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s, n = 0, 0
            for batch in batches:
                for blob in batch.column("sums"):
                    more = pickle.loads(blob.as_py())
                    s, n = s + more[0], n + more[1]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps((s, n))], pa.binary())], names=["part", "sums"])

        found = trees.select("trees").mapInArrow(add, "part int, sums binary").groupBy("part").applyInArrow(meet, "part int, sums binary").collect()
        new = [b.copy() for b in books]
        for r in found:  # a row for each part
            s, n = pickle.loads(r["sums"])
            new[r["part"]][n > 0] = s[n > 0] // n[n > 0].astype(object)[:, None]
        return new

    for _ in range(rounds):
        books = round_of(books)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                codes, error = [], 0
                for p, tree in enumerate(pickle.loads(batch.column("trees")[j].as_py())):
                    book = fitting(books[p], tree)
                    found = walk(tree, book)[0]
                    own = np.empty_like(tree.points)
                    own[tree.order] = tree.points
                    error = error + ((own - book[found]) ** 2).sum(axis=1).astype(object)
                    codes.append(found)
                hexes = np.stack(codes, axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[j].values, batch.column("labels")[j].values, pa.array([r.tobytes().hex() for r in hexes]), longs(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    coded = trees.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long").checkpoint()
    remove(spark, at)
    whole = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    sums = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "of").checkpoint()
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(prepare(spark), sf_dir, "embeddings"))


def _op13_sql() -> str:
    nearest = """SELECT r, part, arg_min(entry, d * 100 + entry) AS entry, min(d) AS d FROM (
  SELECT r, x.part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN {book} USING (part, pos) GROUP BY r, x.part, entry) GROUP BY r, part"""
    rounds = "".join(
        f""",
a{k} AS MATERIALIZED ({nearest.format(book=f"c{k}")}),
c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(new, c) AS c FROM c{k} LEFT JOIN (
  SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS new FROM x JOIN a{k} USING (r, part) GROUP BY part, entry, pos) USING (part, entry, pos))"""
        for k in range(ROUNDS)
    )
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT r, len(e) // {PARTS} AS m, unnest(range(0, len(e))) AS p, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM v),
x AS MATERIALIZED (SELECT r, p // m AS part, p % m AS pos, x FROM u),
c0 AS MATERIALIZED (SELECT part, r AS entry, pos, x AS c FROM x WHERE r < {ENTRIES}){rounds},
f AS ({nearest.format(book=f"c{ROUNDS}")}),
g AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h
"""


OP13_SQL = _op13_sql()
