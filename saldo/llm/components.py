"""Connected components of an edge table, by rounds of large-star and small-star.

Every round is two aggregations and joins over the edges; nodes of any degree are reduced by partial minima, and a hot
node's edges are split by AQE's skew join. Nothing but a count and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger neighbours (large), or its smaller ones and itself (small), to its least neighbour."""
    if large:
        seen = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")).withColumn("m", F.least("at", "m"))
    joined = seen.join(least, F.col("u") == F.col("at"))
    if large:
        linked = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); the root is the component's least node."""
    current = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    before = None
    while True:
        current = stored(_star(_star(current, True), False), "star")
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
