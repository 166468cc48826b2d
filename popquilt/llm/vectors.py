"""What the operators on whole vectors share: which rows take part, and whole numbers of any size in numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proper(column: str) -> Column:
    """True for vectors that are neither null nor hold null, NaN or infinite entries."""
    return F.coalesce(F.forall(column, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False))), F.lit(False))


def kept_vectors(df: DataFrame, column: str, *others: str) -> tuple[DataFrame, int]:
    """The rows whose vector takes part, with the vector as doubles named ``vector``, and its length.

    That are the proper vectors of the commonest length (of the longest, where several are as
    common); 0 where there are none. Only lengths and their counts are compared.
    """
    rows = df.select(*others, F.col(column).cast("array<double>").alias("vector")).filter(proper("vector"))
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    return rows.filter(F.size("vector") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of lists of that many doubles, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def floors(x: np.ndarray, scale: int, bound: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit numbers, or Python's where one is beyond ``bound``."""
    if not x.size or np.abs(x).max() * scale < bound:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as longs; null for those that no long holds."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if -(2**63) <= v < 2**63 else None for v in values], pa.int64())
