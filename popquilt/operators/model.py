"""Splits of tiles, the linear model of log occupancy, and its predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popquilt.functions.metrics import METRICS
from popquilt.functions.transforms import PIXEL_AREA, targets
from popquilt.operators.ranks import percentiles

SPLITS, TEST, VALIDATE = 10, 0.2, 0.1
#: Tiles up to which their parts go to the rows. Few tiles have many rows each, which a shuffle by tile would bring into as few tasks.
FEW_TILES = 1 << 16
TRAIN_NAMES = ("train", "validate", "test")


def _place(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))


def split(tiles: DataFrame, number: int, key: str = "tile_key", test: float = TEST, validate: float = VALIDATE) -> DataFrame:
    """(key, split): the part that each tile has in split ``number``.

    A tile's place comes from a digest of its key and the split, so that it stays when tiles
    are added: the first digits below ``test`` of their range are the test part, and those of
    a second digest below ``validate * (1 - test)`` of the rest the validation part.
    """
    share = lambda salt: F.conv(F.substring(_place(key, f"{salt}-{number}-"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    part = F.when(share("test") < test, "test").when(share("validate") < validate * (1 - test), "validate").otherwise("train")
    return tiles.select(key, part.alias("split"))


def splits(tiles: DataFrame, key: str = "tile_key", count: int = SPLITS) -> DataFrame:
    """(key, split_number, split) for all splits, long."""
    one = [split(tiles, k, key).withColumn("split_number", F.lit(k)) for k in range(count)]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def ranked_split(tiles: DataFrame, number: int, key: str = "tile_key", test: float = TEST, validate: float = VALIDATE) -> DataFrame:
    """Like ``split`` with exact shares, in the order of digests and, for ties, keys.

    A tile's rank is its rank among those with the same leading digits, of which there are
    at most 4,096, and the number of tiles before these.
    """
    place = _place(key, f"split-{number}-")
    lead = F.substring("_place", 1, 3)
    placed = tiles.select(key, place.alias("_place")).withColumn("_lead", lead)
    counts = sorted((r["_lead"], r["count"]) for r in placed.groupBy("_lead").count().collect())
    n = sum(c for _, c in counts)
    n_test = int(np.ceil(test * n))
    n_validate = int(np.ceil(validate * (1 - test) * (n - n_test)))
    before = np.cumsum([0, *(c for _, c in counts)])
    offsets = tiles.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(counts, before)], "_lead string, _before long")
    k = F.col("_before") + F.row_number().over(Window.partitionBy("_lead").orderBy("_place", key))
    ranked = placed.join(F.broadcast(offsets), "_lead").withColumn("_k", k)
    k = F.col("_k")
    return ranked.select(key, F.when(k <= n_test, "test").when(k <= n_test + n_validate, "validate").otherwise("train").alias("split"))


def part(rows: DataFrame, parts: DataFrame, name: str, key: str = "tile_key") -> DataFrame:
    return rows.join(parts.filter(F.col("split") == name).select(key), key, "left_semi")


@dataclass
class Specification:
    """What a model is trained on and how. The kind of model is ``linear``."""

    denominator: str
    resolution: str = "100"
    features: list[str] = field(default_factory=list)
    split: int = 0
    target: str = "admin_log_occupancy_rate"
    version: str = ""
    kind: str = "linear"
    random_seed: int = 42
    #: What the loss compares, with its level; empty for the target itself. A model of pixels may be compared on units.
    loss_target: str = ""
    loss_metric: str = "mae"
    optimizer: str = "damped"
    learning_rate: float = 0.05
    rounds: int = 100
    patience: int = 10

    def __post_init__(self):
        if self.kind != "linear":
            raise ValueError(f"unknown model {self.kind!r}")
        self.loss_target = self.loss_target or self.target
        levels = [t.split("_", 1)[0] for t in (self.target, self.loss_target)]
        if not set(levels) <= {"admin", "pixel"} or levels == ["admin", "pixel"]:
            raise ValueError(f"no way from {self.target!r} to {self.loss_target!r}")
        if levels[0] == "admin" and self.loss_target != self.target:
            raise ValueError("a model of units is fitted to its own target")
        if not 0 <= self.split < SPLITS:
            raise ValueError("split is out of range")


@dataclass
class Linear:
    """Coefficients of log occupancy."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def output(self) -> Column:
        return sum((F.col(f) * w for f, w in self.weights.items()), F.lit(self.intercept))

    def population(self, built: str = "built") -> Column:
        """exp of the output times built density: an expression, so that prediction is part of the scan."""
        return F.exp(self.output()) * F.col(built)


def fit_least_absolute(rows: DataFrame, target: str, features: list[str] = (), rounds: int = 60, tolerance: float = 1e-9) -> Linear:
    """Least absolute deviations.

    Without features it is the exact median. With some, iteratively reweighted least squares:
    a round is one aggregate of the normal equations, of which only the matrix reaches the
    driver. The objective is convex, so that the result does not depend on a start.
    """
    y = F.col(target)
    clean = rows.select(target, *features).dropna()
    if not features:
        (found,) = percentiles(clean, target, [0.5])
        if found is None:
            raise ValueError("no rows to fit")
        return Linear(float(found))
    clean = clean.cache()
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    beta, before = np.zeros(len(columns)), np.inf
    for k in range(rounds):
        r = y - sum((c * float(b) for c, b in zip(columns, beta)), F.lit(0.0))
        w = F.lit(1.0) if k == 0 else 1 / F.greatest(F.abs(r), F.lit(1e-8))
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        row = clean.agg(*(F.sum(w * columns[i] * columns[j]) for i, j in pairs), *(F.sum(w * c * y) for c in columns), F.sum(F.abs(r))).first()
        if row[0] is None:
            clean.unpersist()
            raise ValueError("no rows to fit")
        m = np.zeros((len(columns),) * 2)
        for (i, j), v in zip(pairs, row):
            m[i, j] = m[j, i] = v
        beta = np.linalg.lstsq(m, np.array(row[len(pairs) : -1], dtype=float), rcond=None)[0]
        if k > 1 and abs(before - row[-1]) <= tolerance * max(1.0, before):
            break
        before = row[-1]
    clean.unpersist()
    return Linear(float(beta[0]), dict(zip(features, map(float, beta[1:]))))


def predict(pixels: DataFrame, model: Linear, built: str = "built") -> DataFrame:
    return pixels.withColumn("population", model.population(built))


def score(rows: DataFrame, model: Linear, kind: str, target: str, truth: str, metrics: tuple[str, ...] = tuple(METRICS), built: str = "built", area: float | Column = PIXEL_AREA) -> DataFrame:
    """One row of metrics: the model's output, which is of a ``kind``, is turned into ``target`` and compared with the column ``truth``."""
    y, p = F.col("_y"), F.col("_p")
    both = rows.select(F.col(truth).cast("double").alias("_y"), targets(kind, model.output(), F.col(built), area)[target].alias("_p")).dropna()
    return both.agg(F.count(F.lit(1)).alias("rows"), *(METRICS[m](y, p).alias(m) for m in metrics))


def with_part(rows: DataFrame, parts: DataFrame, key: str = "tile_key") -> DataFrame:
    """Rows with the ``split`` of their tile; those of other tiles are left out."""
    own = parts.select(key, "split")
    few = own.limit(FEW_TILES + 1).count() <= FEW_TILES
    return rows.join(F.broadcast(own) if few else own, key)


def scores(rows: DataFrame, parts: DataFrame, model: Linear, kind: str, target: str, truth: str, key: str = "tile_key", **of) -> DataFrame:
    """(split, rows, metrics) for the training, validation and test tiles, one scan."""
    y, p = F.col("_y"), F.col("_p")
    metrics = of.pop("metrics", tuple(METRICS))
    output = targets(kind, model.output(), F.col(of.pop("built", "built")), of.pop("area", PIXEL_AREA))[target]
    both = with_part(rows, parts, key).select("split", F.col(truth).cast("double").alias("_y"), output.alias("_p")).dropna()
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *(METRICS[m](y, p).alias(m) for m in metrics))


def renamed(units: DataFrame, denominator: str, prefix: str = "admin_") -> DataFrame:
    """Units with the prefix taken off their columns (but for the key), and ``built`` under the denominator's name."""
    short = {c: c.removeprefix(prefix) for c in units.columns if c.startswith(prefix) and c != f"{prefix}id"}
    return units.withColumnsRenamed(short).withColumnRenamed("built", denominator)


def todo(blocks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks without a result yet."""
    return blocks.join(done.select(*keys).distinct(), keys, "left_anti")
