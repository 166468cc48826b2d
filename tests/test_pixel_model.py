"""A model of pixels fitted to units, against numpy; and what else came with it."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from popquilt.operators import census, pixel_model, ranks
from popquilt.operators import raking_population as R
from popquilt.operators.model import Linear, Specification

AREA = 4.0
QUANTITY = {  # people of a pixel for u = z or exp(z)
    "occupancy_rate": lambda b: b * AREA,
    "population": lambda b: np.ones_like(b),
    "population_density": lambda b: np.full_like(b, AREA),
}


def plain_targets(data, kind, target, beta):
    """{unit: (y, p)} of the training part."""
    z = beta[0] + data["x"] @ beta[1:]
    u = np.exp(z) if kind.startswith("log_") else z
    people = u * QUANTITY[kind.removeprefix("log_")](data["built"])
    value = {"occupancy_rate": people / (data["built"] * AREA), "population": people, "population_density": people / AREA}[target.removeprefix("log_")]
    out = {}
    for k in np.unique(data["unit"]):
        own = data["unit"] == k
        p = float(np.sum(value[own] * data["weight"][own]))
        out[int(k)] = (float(data["y"][own][0]), np.log(p) if target.startswith("log_") else p)
    return out


def loss(data, kind, target, metric, beta):
    y, p = map(np.array, zip(*plain_targets(data, kind, target, beta).values()))
    return np.mean(np.abs(y - p)) if metric == "mae" else np.mean((y - p) ** 2) if metric == "mse" else np.sqrt(np.mean((y - p) ** 2))


def world(spark, kind, target, seed=0, noise=0.1):
    rng = np.random.default_rng(seed)
    n = 400
    data = {"unit": rng.integers(0, 40, n), "weight": rng.uniform(0.1, 1, n), "built": rng.uniform(0.2, 0.9, n), "x": rng.uniform(0, 1, (n, 2))}
    data["y"] = np.zeros(n)
    true = plain_targets(data, kind, target, np.array([0.4, 0.7, -0.3]))
    off = {k: p + rng.normal() * noise for k, (_, p) in true.items()}
    data["y"] = np.array([off[int(k)] for k in data["unit"]])
    rows = [(int(k), "train" if k % 4 else "validate", float(y), float(w), float(b), float(x[0]), float(x[1])) for k, y, w, b, x in zip(data["unit"], data["y"], data["weight"], data["built"], data["x"])]
    rows += [(99, "test", 1.0, 1.0, 0.5, 0.1, 0.1), (98, "train", None, 1.0, 0.5, 0.1, 0.1), (97, "train", 1.0, 1.0, 0.5, float("nan"), 0.1)]
    table = spark.createDataFrame(rows, "unit long, split string, y double, weight double, built double, f double, g double")
    train = data["unit"] % 4 > 0
    return table, {k: v[train] for k, v in data.items()}


@pytest.mark.parametrize(("kind", "target", "metric"), [("log_occupancy_rate", "log_occupancy_rate", "mse"), ("log_occupancy_rate", "population", "rmse"), ("population_density", "population", "mse"), ("log_population_density", "occupancy_rate", "mae"), ("log_occupancy_rate", "log_population_density", "mae")])
def test_no_other_model_is_nearer(spark, kind, target, metric):
    rows, data = world(spark, kind, target)
    fitted = pixel_model.fit(rows.filter("split <> 'validate'"), kind, target, ["f", "g"], metric, area=AREA)
    beta = np.array([fitted.model.intercept, *fitted.model.weights.values()])
    least = loss(data, kind, target, metric, beta)
    assert fitted.history[-1]["train"] == pytest.approx(least, rel=1e-9) and fitted.history[-1]["train"] < fitted.history[0]["train"]
    slack = 1e-3 if metric == "mae" else 1e-7  # an absolute loss has edges, along which steps get short
    for move in np.vstack([np.eye(3), -np.eye(3), np.random.default_rng(1).normal(size=(30, 3))]):
        for size in (1e-3, 1e-1):
            assert loss(data, kind, target, metric, beta + size * move) >= least * (1 - slack)


def test_slopes_are_differences(spark):
    rows, data = world(spark, "log_occupancy_rate", "log_population_density")
    beta = np.array([0.1, 0.2, -0.5])
    got = {r["unit"]: r for r in pixel_model.predictions(rows.filter("split = 'train'").dropna(), "log_occupancy_rate", "log_population_density", Linear(0.1, {"f": 0.2, "g": -0.5}), AREA, slopes=True).collect()}
    for k in range(3):
        up, down = (plain_targets(data, "log_occupancy_rate", "log_population_density", beta + s * np.eye(3)[k]) for s in (1e-5, -1e-5))
        for unit in up:
            assert got[unit][f"g{k}"] == pytest.approx((up[unit][1] - down[unit][1]) / 2e-5, abs=1e-6)


def test_adam_and_early_stopping(spark):
    rows, data = world(spark, "log_occupancy_rate", "population")
    exact = pixel_model.fit(rows.filter("split <> 'validate'"), "log_occupancy_rate", "population", ["f", "g"], "mse", area=AREA)
    adam = pixel_model.fit(rows.filter("split <> 'validate'"), "log_occupancy_rate", "population", ["f", "g"], "mse", "adam", 0.1, rounds=60, area=AREA)
    assert exact.history[-1]["train"] <= adam.history[-1]["train"] < 0.5 * adam.history[0]["train"]
    stopped = pixel_model.fit(rows, "log_occupancy_rate", "population", ["f", "g"], "mse", "adam", 0.5, rounds=60, patience=3, area=AREA)
    assert set(stopped.history[0]) == {"train", "validate", "test"} and len(stopped.history) < 60
    kept = {r["split"]: r["mse"] for r in pixel_model.scores(rows.dropna().filter("f = f"), "log_occupancy_rate", "population", stopped.model, ("mse",), AREA).collect()}
    assert kept["validate"] == pytest.approx(min(h["validate"] for h in stopped.history))


def test_odd_input_of_fits(spark):
    rows, _ = world(spark, "occupancy_rate", "population")
    for bad in ({"metric": "r2"}, {"optimizer": "sgd"}):
        with pytest.raises(ValueError, match="no steps|unknown optimizer"):
            pixel_model.fit(rows, "occupancy_rate", "population", ["f"], **bad)
    with pytest.raises(ValueError, match="no rows"):
        pixel_model.fit(rows.filter("split = 'test'"), "occupancy_rate", "population", ["f"])
    with pytest.raises(ValueError, match="unknown target"):
        pixel_model.predictions(rows, "x", "population", Linear(0.0))
    assert Specification("d", target="pixel_log_occupancy_rate", loss_target="admin_population").loss_target == "admin_population"
    for target, other in (("admin_population", "pixel_population"), ("admin_population", "admin_occupancy_rate"), ("whole_population", "")):
        with pytest.raises(ValueError, match="no way|its own target"):
            Specification("d", target=target, loss_target=other)
    pixels = spark.createDataFrame([("t", "0_0", "train", 2.0, 0.5, 1.0), ("t", "0_1", "train", 4.0, 0.5, 2.0)], "tile_key string, pixel_id string, split string, y double, built double, f double")
    fitted = pixel_model.fit(pixel_model.pixel_rows(pixels, ["f"]), "occupancy_rate", "occupancy_rate", ["f"], "mse").model
    assert fitted.intercept == pytest.approx(0, abs=1e-6) and fitted.weights["f"] == pytest.approx(2.0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=1, max_size=20))
def test_ranks_of_any_numbers(spark, values):
    got = ranks.values_at(spark.createDataFrame([(v,) for v in values], "x double"), "x", list(range(len(values))))
    assert got == sorted(values)


def test_ranks_of_the_smallest_numbers(spark):
    for values in ([0.0, 5e-324], [5e-324, 0.0, 1e-323, -5e-324], [1e-310, 5e-324, 0.0]):
        assert ranks.values_at(spark.createDataFrame([(v,) for v in values], "x double"), "x", list(range(len(values)))) == sorted(values)


def test_each_census_has_its_deepest_level(spark):
    units = spark.createDataFrame([("A", 2000, 0, "a"), ("A", 2000, 1, "b"), ("A", 2010, 1, "c"), ("A", 2010, 2, "d"), ("B", 2000, 0, "e")], "iso3 string, year int, admin_level int, shape_id string")
    assert {r["shape_id"] for r in census.deepest(units, ("iso3", "year")).collect()} == {"b", "d", "e"}
    assert {r["shape_id"] for r in census.deepest(units).collect()} == {"d", "e"}


@pytest.mark.parametrize("levels", [1, 2, 12, 30])
def test_climbs_of_many_levels(spark, levels):
    """A chain to a goal, a chain to nothing, and circles of two and of five with a tail."""
    edges = [(k, k - 1) for k in range(1, levels + 1)] + [(100 + k, 100 + k - 1) for k in range(1, levels + 1)]
    edges += [(200, 201), (201, 200), (300, 301), (301, 302), (302, 303), (303, 304), (304, 300), (310, 300), (0, None)]
    parents = spark.createDataFrame(edges, "location_id int, parent_id int")
    wanted = parents.select("location_id").union(spark.createDataFrame([(999,)], "location_id int"))
    got = {r["location_id"]: r["ancestor_id"] for r in R.nearest_ancestor(wanted, parents, spark.createDataFrame([(0,), (555,)], "location_id int")).collect()}
    assert got == {k: 0 if k <= levels else None for k in [e[0] for e in edges] + [999]}
