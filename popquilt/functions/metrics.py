"""Aggregates that compare a truth ``y`` with a prediction ``p``; all of one table are one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from popquilt.functions.semantics import ratio


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def nrmsd(y: Column, p: Column) -> Column:
    return ratio(rmse(y, p), F.max(y) - F.min(y))


def mape(y: Column, p: Column) -> Column:
    return F.avg(ratio(F.abs(y - p), y))


def smape(y: Column, p: Column) -> Column:
    return F.avg(ratio(2 * F.abs(y - p), F.abs(y) + F.abs(p)))


def r2(y: Column, p: Column) -> Column:
    return 1 - ratio(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))


METRICS: dict[str, Callable[[Column, Column], Column]] = {f.__name__: f for f in (mae, mse, rmse, nrmsd, mape, smape, r2)}
