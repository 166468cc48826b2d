"""A model of pixels that is fitted to what is known of units.

A pixel's output z is linear in its features. A transform makes it an occupancy rate or a
number of people, which are summed over a unit's pixels with area weights, and the loss
compares a target of the unit (or of the pixel itself) with what was counted. Rows are the
sparse weight table with the pixel's columns beside it: (unit, split, y, weight, built,
features). A step is one aggregate, by unit and then over all: sums, slopes, normal equations
and the losses of all parts of the split. Only these reach the driver, which holds the
optimiser's state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popquilt.functions.metrics import METRICS
from popquilt.functions.semantics import natural_log, ratio
from popquilt.functions.transforms import PIXEL_AREA, TARGETS, TRANSFORMS
from popquilt.operators.model import Linear

ROW = ("unit", "split", "y", "weight", "built")
#: Losses that a step can lower.
LOSSES = ("mae", "mse", "rmse")
#: Residuals below this count as so large in the weights of the absolute loss.
LEAST_RESIDUAL = 1e-8


@dataclass
class Fit:
    """A fitted model, and the losses of the split's parts after every step that was taken."""

    model: Linear
    history: list[dict[str, float]] = field(default_factory=list)


def _exponential(kind: str) -> bool:
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown target {kind!r}; known are {sorted(TRANSFORMS)}")
    return kind.startswith("log_")


def _factor(kind: str, target: str, b: Column, a: Column) -> Column:
    """What a unit's quantity (occupancy rate, people, or people by area) is for each of z, or exp(z) for a kind that is a logarithm."""
    people = {"occupancy_rate": b * a, "population": F.lit(1.0), "population_density": a}[kind.removeprefix("log_")]
    return {"occupancy_rate": ratio(people, b * a), "population": people, "population_density": people / a}[target.removeprefix("log_")]


def predictions(rows: DataFrame, kind: str, target: str, model: Linear, area: float = PIXEL_AREA, slopes: bool = False) -> DataFrame:
    """(unit, split, y, p): each unit's target by the model; with ``slopes``, also dp for the intercept and each weight as g0, g1, ...

    A pixel-level target has the pixel as unit and a weight of 1. A density's area is a
    pixel's for pixels and units alike. p is null where its logarithm has no value.
    """
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}; known are {sorted(TARGETS)}")
    z = model.output()
    u = F.exp(z) if _exponential(kind) else z
    share = F.col("weight") * _factor(kind, target, F.col("built"), F.lit(float(area)))
    slope = share * (u if _exponential(kind) else F.lit(1.0))
    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in model.weights)] if slopes else []
    # Slopes are named before they are summed, so that the exponential is taken once for each row.
    each = rows.select("unit", "split", F.col("y").cast("double").alias("y"), (share * u).alias("_v"), slope.alias("_s"), *(c.alias(f"_x{k}") for k, c in enumerate(columns)))
    sums = each.groupBy("unit", "split").agg(F.min("y").alias("y"), F.sum("_v").alias("_v"), *(F.sum(F.col("_s") * F.col(f"_x{k}")).alias(f"g{k}") for k in range(len(columns))))
    v = F.col("_v")
    if target.startswith("log_"):
        return sums.select("unit", "split", "y", natural_log("_v").alias("p"), *(F.when(v > 0, F.col(f"g{k}") / v).alias(f"g{k}") for k in range(len(columns))))
    return sums.select("unit", "split", "y", v.alias("p"), *(f"g{k}" for k in range(len(columns))))


def _start(rows: DataFrame, kind: str, target: str, features: list[str], area: float) -> np.ndarray:
    """An intercept with which the training units' targets are right on the whole; no slope."""
    flat = predictions(rows.filter("split = 'train'"), kind, target, Linear(0.0 if _exponential(kind) else 1.0, dict.fromkeys(features, 0.0)), area).dropna()
    if target.startswith("log_"):
        found = flat.agg(F.exp(F.avg(F.col("y") - F.col("p")))).first()[0]
    else:
        found = flat.agg(ratio(F.sum("y"), F.sum("p"))).first()[0]
    if found is None:
        raise ValueError("no rows to fit")
    first = np.log(found) if _exponential(kind) and found > 0 else 0.0 if _exponential(kind) else found
    return np.array([first] + [0.0] * len(features))


def _step(rows: DataFrame, kind: str, target: str, metric: str, features: list[str], beta: np.ndarray, area: float) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Losses by part, and the training units' normal matrix and right side, weighted so that the latter is the loss's downward slope."""
    k = len(beta)
    r = F.col("y") - F.col("p")
    w = 1 / F.greatest(F.abs(r), F.lit(LEAST_RESIDUAL)) if metric == "mae" else F.lit(1.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    units = predictions(rows, kind, target, Linear(float(beta[0]), dict(zip(features, map(float, beta[1:])))), area, slopes=True).dropna()
    sums = [F.sum(w * F.col(f"g{i}") * F.col(f"g{j}")) for i, j in pairs] + [F.sum(w * F.col(f"g{i}") * r) for i in range(k)]
    parts = {row["split"]: row for row in units.groupBy("split").agg(METRICS[metric](F.col("y"), F.col("p")).alias("loss"), F.count(F.lit(1)).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).collect()}
    losses = {s: float(row["loss"]) for s, row in parts.items()}
    matrix, side = np.zeros((k, k)), np.zeros(k)
    if "train" in parts:
        values = [parts["train"][f"s{i}"] / parts["train"]["n"] for i in range(len(sums))]
        for (i, j), v in zip(pairs, values):
            matrix[i, j] = matrix[j, i] = v
        side = np.array(values[len(pairs) :])
    return losses, matrix, side


def fit(
    rows: DataFrame, kind: str, target: str, features: list[str] = (), metric: str = "mae", optimizer: str = "damped", learning_rate: float = 0.05,
    rounds: int = 100, tolerance: float = 1e-10, patience: int = 10, area: float = PIXEL_AREA,
) -> Fit:
    """Fits intercept and weights by full-batch steps on the training part; a step is one job.

    ``damped`` takes Gauss-Newton steps, damped as far as a step would raise the loss (an
    absolute loss is reweighted at every step); ``adam`` takes first-order steps of about the
    learning rate. Fitting ends when steps change the training loss by no more than the
    tolerance, after ``rounds`` jobs, or when the validation loss (if there is such a part)
    has not been lower for ``patience`` steps; the model with the lowest validation loss is
    kept. Rows with a null or NaN in any column take no part.
    """
    if metric not in LOSSES:
        raise ValueError(f"no steps for {metric!r}; known are {LOSSES}")
    if optimizer not in ("damped", "adam"):
        raise ValueError(f"unknown optimizer {optimizer!r}")
    features = list(features)
    # Rows stay where they are: a step sums a unit's rows in each task before it shuffles, so that a large unit is no burden.
    rows = rows.select(*ROW[:2], *(F.col(c).cast("double").alias(c) for c in (*ROW[2:], *features))).dropna().cache()
    try:
        beta = _start(rows, kind, target, features, area)
        losses, matrix, side = _step(rows, kind, target, metric, features, beta, area)
        if not np.isfinite(losses.get("train", np.nan)):
            raise ValueError("no rows to fit")
        history, best, damping, still = [losses], beta, 1e-3, 0
        moment, spread = np.zeros(len(beta)), np.zeros(len(beta))
        validated = lambda x: x.get("validate", x["train"])
        lowest, since = validated(losses), 0
        for k in range(1, rounds + 1):
            if optimizer == "adam":
                slope = -side if metric == "mae" else -2 * side if metric == "mse" else -side / max(losses["train"], 1e-300)
                moment, spread = 0.9 * moment + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
                move = -learning_rate * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-8)
            else:
                move = np.linalg.lstsq(matrix + damping * np.diag(np.maximum(np.diag(matrix), 1e-300)), side, rcond=None)[0]
            new, m, s = _step(rows, kind, target, metric, features, beta + move, area)
            gain = losses["train"] - new.get("train", np.nan)
            if optimizer == "damped" and not gain >= 0:  # also where the loss has no value
                damping *= 10
                if damping > 1e12:
                    break
                if -gain > tolerance * losses["train"] or not np.isfinite(gain):
                    continue
            damping = max(damping / 10, 1e-12)
            still = still + 1 if abs(gain) <= tolerance * max(losses["train"], 1e-300) else 0
            if gain >= 0 or optimizer == "adam":
                beta, losses, matrix, side = beta + move, new, m, s
                history.append(losses)
                since += 1
                if validated(losses) < lowest:
                    best, lowest, since = beta, validated(losses), 0
            if still >= 2 or ("validate" in losses and since >= patience):
                break
    finally:
        rows.unpersist()
    return Fit(Linear(float(best[0]), dict(zip(features, map(float, best[1:])))), history)


def scores(rows: DataFrame, kind: str, target: str, model: Linear, metrics: tuple[str, ...] = tuple(METRICS), area: float = PIXEL_AREA) -> DataFrame:
    """(split, rows, metrics) of the units' target for every part of the split, one scan; y is the target's truth."""
    y, p = F.col("y"), F.col("p")
    units = predictions(rows, kind, target, model, area).dropna()
    return units.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *(METRICS[m](y, p).alias(m) for m in metrics))


def unit_rows(weights: DataFrame, pixels: DataFrame, truth: DataFrame, features: list[str]) -> DataFrame:
    """Rows for a loss on units: weights (admin_id, tile_key, pixel_id, weight), pixels (tile_key, pixel_id, built, features), truth (admin_id, split, y)."""
    known = truth.select(F.col("admin_id").alias("unit"), "split", "y")
    inside = weights.withColumnRenamed("admin_id", "unit").join(pixels.select("tile_key", "pixel_id", "built", *features), ["tile_key", "pixel_id"])
    return inside.join(known, "unit").select(*ROW, *features)


def pixel_rows(pixels: DataFrame, features: list[str]) -> DataFrame:
    """Rows for a loss on pixels: pixels (tile_key, pixel_id, split, y, built, features), each its own unit."""
    return pixels.select(F.struct("tile_key", "pixel_id").alias("unit"), "split", "y", F.lit(1.0).alias("weight"), "built", *features)
