"""Exact order statistics of a column, however many distinct values it has.

Values are counted in bins between the least and the greatest; the bin that holds a rank is
cut into bins again, until it holds one value. A round is one aggregate with as many rows as
there are bins, which is all that reaches the driver or meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def values_at(df: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) among those that are not missing or NaN; raises ValueError beyond them."""
    x = F.col(column).cast("double")
    clean = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high, n = clean.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError("no value at this rank")
    found: dict[int, float] = {}
    todo = {(low, high, 0): sorted(set(ranks))}  # least and greatest value of a bin, values before it
    while todo:
        (low, high, before), wanted = todo.popitem()
        if low == high:
            found |= dict.fromkeys(wanted, low)
            continue
        width = high / 2 - low / 2
        # Neighbours among the smallest numbers have no half of a difference; there are two or three of them, each a bin.
        place = F.least(F.floor((F.col("x") / 2 - low / 2) / width * BINS), F.lit(BINS - 1)) if width else F.col("x")
        if math.isinf(low) or math.isinf(high):  # an infinite end is a bin of its own
            place = F.when(F.col("x") == -math.inf, -1).when(F.col("x") == math.inf, 1).otherwise(0)
        bins = clean.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy(place.alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            own = [w for w in wanted if before <= w < before + r["n"]]
            if own:
                todo[r["low"], r["high"], before] = own
            before += r["n"]
    return [found[r] for r in ranks]


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; None where there are no values."""
    x = F.col(column).cast("double")
    n = df.filter(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    values = values_at(df, column, [k for a in at for k in (math.floor(a), math.ceil(a))])
    return [lo if lo == hi else lo + (hi - lo) * (a - math.floor(a)) for a, lo, hi in zip(at, values[::2], values[1::2])]
