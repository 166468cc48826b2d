"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are built on the driver from a bounded sample of vectors: a node splits at the
median of the sample's projections on the difference of two of its vectors. Every row is
then indexed in every tree. A query walks all trees through one priority queue, largest
margin first, and takes leaves until they hold enough rows; how many is measured on a bounded
sample of queries against all rows, so that it is what the data need. A leaf's rows and the
queries that took it meet in blocks of bounded size, where cosines are a matrix product and
only the best of each query go on; the last step sorts these by their exact cosines.

What reaches the driver is the sample and one count per leaf, whose number the sample bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popquilt.llm.common import prepare, table

#: Rows of a leaf, and queries, that meet in one block.
ROWS, QUERIES = 8192, 8192
#: More than the rounding error of a matrix product of unit vectors.
ERROR = 1e-12


@dataclass
class Tree:
    """Nodes in the order of their numbers; a leaf's children are -1."""

    direction: np.ndarray
    middle: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.low[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            above = np.einsum("ij,ij->i", x[inner], self.direction[node]) > self.middle[node]
            at[inner] = np.where(above, self.high[node], self.low[node])


def build_tree(x: np.ndarray, rng: np.random.Generator, leaf_rows: int) -> Tree:
    direction, middle, low, high = [], [], [], []

    def split(rows: np.ndarray) -> int:
        k = len(direction)
        for a, v in ((direction, np.zeros(x.shape[1])), (middle, 0.0), (low, -1), (high, -1)):
            a.append(v)
        for _ in range(3 if len(rows) > leaf_rows else 0):
            i, j = rng.choice(rows, 2, replace=False)
            d = x[i] - x[j]
            if not (size := np.linalg.norm(d)):
                continue
            p = x[rows] @ (d / size)
            m = float(np.median(p))
            if (p > m).any():
                direction[k], middle[k] = d / size, m
                low[k] = split(rows[p <= m])
                high[k] = split(rows[p > m])
                break
        return k

    split(np.arange(len(x)))
    return Tree(np.array(direction), np.array(middle), np.array(low), np.array(high))


def search(trees: list[Tree], sizes: dict[tuple[int, int], int], q: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """The leaves (tree, node) that a query takes until they hold ``rows`` rows."""
    margins = [t.direction @ q - t.middle for t in trees]
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    taken, held = [], 0
    while queue and held < rows:
        p, t, k = heapq.heappop(queue)
        if trees[t].low[k] < 0:
            if size := sizes.get((t, k), 0):
                taken.append((t, k))
                held += size
            continue
        m = float(margins[t][k])
        heapq.heappush(queue, (max(p, m), t, int(trees[t].low[k])))
        heapq.heappush(queue, (max(p, -m), t, int(trees[t].high[k])))
    return taken


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part: not null or zero, with finite components only."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null").filter(finite & some)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows; the same for equal rows wherever they stand."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def least_ids(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep, in the order of their ids: of equal vectors those with the ``most`` smallest ids.

    The others score the same and lose every tie, so that no query's nearest change.
    """
    order = np.argsort(ids, kind="stable")
    kind = np.unique(np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1]
    key = np.lexsort((ids[order], kind))
    k, i = kind[key], ids[order][key]
    first, again = np.concatenate([[True], k[1:] != k[:-1]]), np.concatenate([[False], (k[1:] == k[:-1]) & (i[1:] == i[:-1])])
    place = np.cumsum(~again)
    place -= place[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    return order[np.sort(key[~again & (place < most)])]


def nearest_in_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` nearest distinct ids, ties to the smaller id; a query isn't its own.

    ``ids`` ascend. The matrix product only narrows down; what is within its error of the
    ``k``-th is scored again, by the measure that is returned.
    """
    near = _unit(q) @ _unit(x).T
    near[q_ids[:, None] == ids[None]] = -np.inf
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    by_id = near if len(starts) == len(ids) else np.maximum.reduceat(near, starts, axis=1)
    if (extra := by_id.shape[1] - k) > 0:
        near[near < np.partition(by_id, extra, axis=1)[:, extra, None] - ERROR] = -np.inf
    i, j = np.nonzero(near > -np.inf)
    score = cosine(q[i], x[j])
    best = np.lexsort((ids[j], -score, i))
    i, j, score = i[best], j[best], score[best]
    once = np.sort(np.unique(np.stack([i, ids[j]], axis=1), axis=0, return_index=True)[1]) if len(i) else np.empty(0, np.int64)
    i, j, score = i[once], j[once], score[once]
    own = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[own], j[own], score[own]


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, queries, rows = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not queries or not rows:
                return
            q_ids, ids = np.array([a for a, _ in queries]), np.array([a for a, _ in rows])
            q, x = np.stack([v for _, v in queries]), np.stack([v for _, v in rows])
            few = least_ids(x, ids, k + 1)
            ids, x = ids[few], x[few]
            for at in range(0, len(q), 512):
                i, j, score = nearest_in_block(q[at : at + 512], q_ids[at : at + 512], x, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + i]), pa.array(ids[j]), pa.array(score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            x = _matrix(batch.column(3)) if batch.num_rows else np.empty((0, 1))
            for r, (b, is_row, vec_id) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if b != block:
                    yield from done()
                    block, queries, rows = b, [], []
                (rows if is_row else queries).append((vec_id, x[r]))
        yield from done()

    return run


def needed_rows(trees: list[Tree], sizes: dict[tuple[int, int], int], q: np.ndarray, leaves: list[list[int]]) -> list[int]:
    """For rows given by their leaf in each tree: how many rows the query has taken when it takes the first of these leaves."""
    held, at = 0, {}
    for leaf in search(trees, sizes, q, sum(sizes.values())):
        held += sizes[leaf]
        at[leaf] = held
    return [min(at[leaf] for leaf in enumerate(own)) for own in leaves]


def nearest(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    trees: int = 8,
    sample: int = 20_000,
    leaf_rows: int = 800,
    recall: float = 0.95,
    trial: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    A query takes leaves until they hold a number of rows (a row counts once for each tree)
    that the data decide: about ``trial`` queries, twice that at most, are compared with all
    rows, and the number is the least that finds the share ``recall`` of their nearest. It is
    small where vectors have structure, and most of the table where they have none.

    Vectors that are null, zero or not finite, of another length than most, or without
    vec_id take no part. Rows that repeat a vec_id count once, by the nearest; with fewer
    than ``k`` candidates all are returned. Other columns are not read; an empty table gives
    no rows.
    """
    spark = vectors.sparkSession
    known = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    most = known.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dims, total = most["n"], most["count"]
    known = known.filter(F.size("x") == dims)

    def drawn(df: DataFrame, salt: str, n: int, of: int) -> list[tuple[int, list[float]]]:
        place = F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
        return sorted((r["vec_id"], r["x"]) for r in df.filter(place < min(1.0, n / max(1, of))).limit(2 * n).collect())

    fitted = _unit(np.array([x for _, x in drawn(known, "forest", sample, total)] or [[1.0] * dims]))
    least = max(16, leaf_rows * len(fitted) // total)
    forest = [build_tree(fitted, np.random.default_rng(seed), least) for seed in range(trees)]

    def leaves_of(x: np.ndarray) -> np.ndarray:
        unit = _unit(x)
        return np.stack([t.leaf_of(unit) for t in forest], axis=1)

    def fewer_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(least_ids(_matrix(batch.column(1)), batch.column(0).to_numpy(), k + 1)))

    indexed = known.mapInArrow(fewer_copies, "vec_id long, x array<double>")
    asked = known.filter(F.col("vec_id") % every == 0)
    tried = drawn(asked, "trial", trial, asked.count())
    trial_ids, trial_x = np.array([i for i, _ in tried], np.int64), np.array([x for _, x in tried]).reshape(-1, dims)

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tree, leaf, n) of the leaves' sizes and, with a query, of a trial query's nearest rows and their leaves."""
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            leaves = leaves_of(x)
            for t, column in enumerate(leaves.T):
                for leaf, n in zip(*np.unique(column, return_counts=True)):
                    counts[t, int(leaf)] = counts.get((t, int(leaf)), 0) + int(n)
            if len(trial_ids):
                i, j, score = nearest_in_block(trial_x, trial_ids, x, ids, k)
                yield _counts({}, trial_ids[i], ids[j], score, leaves[j])
        yield _counts(counts)

    def _counts(counts: dict, q=(), ids=(), score=(), leaves=()) -> pa.RecordBatch:
        cols = list(zip(*((t, leaf, n) for (t, leaf), n in counts.items()))) or [[], [], []]
        n, m = len(cols[0]), len(q)
        return pa.RecordBatch.from_arrays(
            [pa.array([*c, *[None] * m], pa.int64()) for c in cols]
            + [pa.array([*[None] * n, *c], t) for c, t in ((q, pa.int64()), (ids, pa.int64()), (score, pa.float64()), ([x.tolist() for x in leaves], pa.list_(pa.int64())))],
            names=["tree", "leaf", "n", "query_id", "vec_id", "score", "leaves"],
        )

    seen = indexed.mapInArrow(count_rows, "tree long, leaf long, n long, query_id long, vec_id long, score double, leaves array<long>").checkpoint()
    sizes = {(r["tree"], r["leaf"]): r["n"] for r in seen.filter("n is not null").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()}
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = seen.filter("query_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max_by("leaves", "score").alias("leaves"))
    truth = one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "leaves").collect()  # k rows a trial query
    unit = dict(zip(trial_ids.tolist(), _unit(trial_x) if len(trial_ids) else ()))
    needed = sorted(n for q, rows in _by_query(truth).items() for n in needed_rows(forest, sizes, unit[q], rows))
    wanted = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1

    def count_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for q in _unit(_matrix(batch.column(1))) if batch.num_rows else ():
                for leaf in search(forest, sizes, q, wanted):
                    counts[leaf] = counts.get(leaf, 0) + 1
        cols = list(zip(*((t, leaf, n) for (t, leaf), n in counts.items()))) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tree", "leaf", "n"])

    counted = asked.mapInArrow(count_queries, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    visits = {(r["tree"], r["leaf"]): r["n"] for r in counted}

    def blocks(leaf: tuple[int, int]) -> tuple[int, int]:
        return -(-sizes.get(leaf, 0) // ROWS), -(-visits.get(leaf, 0) // QUERIES)

    def deal(of_rows: bool):
        """Rows go to one block of the leaf's rows and all of its queries, queries the other way round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_pylist()
                unit = None if of_rows else _unit(_matrix(batch.column(1)))
                own = leaves_of(_matrix(batch.column(1))) if of_rows else None
                names, take = [], []
                for i, vec_id in enumerate(ids):
                    for leaf in enumerate(own[i].tolist()) if of_rows else search(forest, sizes, unit[i], wanted):
                        n_rows, n_queries = blocks(leaf)
                        mine = (vec_id * 0x9E3779B97F4A7C15 >> 20) % (1 << 40)
                        others = range(n_queries if of_rows else n_rows)
                        for o in others:
                            r, q = (mine % n_rows, o) if of_rows else (o, mine % n_queries)
                            names.append(f"{leaf[0]}:{leaf[1]}:{r}:{q}")
                            take.append(i)
                at = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([of_rows] * len(names), pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)],
                    names=["block", "is_row", "vec_id", "x"],
                )

        return run

    dealt = "block string, is_row boolean, vec_id long, x array<double>"
    found = (
        indexed.mapInArrow(deal(True), dealt)
        .union(asked.mapInArrow(deal(False), dealt))
        .repartition("block")
        .sortWithinPartitions("block", "is_row")
        .mapInArrow(_meet(k), "query_id long, vec_id long, score double")
    )
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_query(rows: list) -> dict[int, list[list[int]]]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(r["leaves"])
    return out


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(prepare(spark), sf_dir, "embeddings"))
