"""Connected components of a link table, without bringing links or components to the driver.

Every vertex points to its smallest neighbour under a hash order, vertices that share a pointer are contracted,
and what is left of the links is contracted again. Under a random order each round leaves a fraction of the
vertices, and a star of any size falls together in one round. Links are made distinct before each round, and
minima are taken map-side first, so a vertex with very many links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(vertex, component): the vertices that have links, and the smallest vertex each one reaches."""
    node = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = links.where(F.col(a) != F.col(b)).select(node(a).alias("x"), node(b).alias("y"))
    left = spill(left.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    every = None  # (vertex, now): the contracted vertex that stands for each
    for _ in range(rounds):
        both = left.union(left.select("y", "x").toDF("x", "y"))
        point = both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("was"), F.least("x", "low").alias("to"))
        point = spill(point, "points")
        if every is None:
            every = spill(point.select(F.col("was").alias("vertex"), F.col("to").alias("now")), "every")
        else:
            every = spill(every.join(point, F.col("now") == F.col("was"), "left").select("vertex", F.coalesce("to", "now").alias("now")), "every")
        step = left.join(point, F.col("x") == F.col("was")).select(F.col("to").alias("x"), "y")
        step = step.join(point, F.col("y") == F.col("was")).select("x", F.col("to").alias("y")).where("x != y")
        left = spill(step.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
        if left.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    least = every.groupBy("now").agg(F.min("vertex.v").alias("component"))
    return every.join(least, "now").select(F.col("vertex.v").alias("vertex"), "component")
