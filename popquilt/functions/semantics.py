"""Column expressions with the missing-value rules of the data model.

A missing number is NULL; NaN becomes NULL at ingest. Division says what it does with zero,
clipping keeps NULL, and a sum over nothing is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))


def clean(df: DataFrame) -> DataFrame:
    """Every floating column with NaN as NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in floats})


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """0 where both are 0, signed infinity where only the divisor is, else the quotient."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    at_zero = F.when(a == 0, F.lit(0.0)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def ratio(a: Column | str, b: Column | str) -> Column:
    """The quotient, NULL where the divisor is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def clip_low(x: Column | str, low: float = 0.0) -> Column:
    """Values below the bound become the bound; NULL stays."""
    return F.when(_c(x) < low, F.lit(low)).otherwise(_c(x))


def clamp(x: Column | str, low: Column | float, high: Column | float) -> Column:
    """Within the bounds; NULL stays."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), _c(low)), _c(high)))


def natural_log(x: Column | str) -> Column:
    """Logarithm with -infinity at 0 and NULL below."""
    return F.when(_c(x) == 0, F.lit(-INF)).otherwise(F.ln(_c(x)))


def suppress_noise(x: Column | str, threshold: float = 0.01, fill: float = 0.0) -> Column:
    return F.when(_c(x) < threshold, F.lit(fill)).otherwise(_c(x))


def finite_or(x: Column | str, value: float = 0.0) -> Column:
    """Infinite and NaN values become the value; NULL stays."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == INF), F.lit(value)).otherwise(x)


def precise_floor(x: Column | str, precision: int = 0) -> Column:
    return F.floor(_c(x) * 10**precision) / 10**precision


def significant(x: Column | str, figures: int) -> Column:
    """Rounded to that many significant figures."""
    x = _c(x)
    scale = F.pow(F.lit(10.0), F.lit(figures - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def cut(x: Column | str, edges: Sequence[float]) -> Column:
    """Number of the bin, from 0; bins are closed on the right, and the first one on the left too."""
    x = _c(x)
    found = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        above = x >= edges[k] if k == 0 else x > edges[k]
        found = F.when(above & (x <= edges[k + 1]), F.lit(k)).otherwise(found)
    return found


def total(x: Column | str) -> Column:
    """A sum that is 0 over nothing or only missing values."""
    return F.coalesce(F.sum(nan_to_null(_c(x).cast("double"))), F.lit(0.0))


def first_by(x: str, order: Column | str) -> Column:
    """The first value that is not missing, in an explicit order."""
    return F.min_by(F.col(x), F.when(F.col(x).isNotNull(), _c(order)))
