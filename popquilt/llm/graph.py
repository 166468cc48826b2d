"""Connected components of an edge table, by alternating star operations.

Each round points every vertex's larger neighbours at its smallest neighbour, and then every
vertex and its smaller neighbours at the smallest of them (Kiveris et al., Connected
Components in MapReduce and Beyond, 2014). Rounds grow with the logarithm of a component's
size. A round groups and joins on vertices, so that a vertex with very many edges is summed
before the shuffle and its join partition can be split; only a count and a checksum reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex with an edge; the component is its smallest vertex.

    Edges from a vertex to itself and edges with a null end count for nothing; repeated
    edges count once.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        now = small.select("e.u", "e.v").filter("u <> v").distinct().checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
