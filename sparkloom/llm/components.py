"""Connected components by contraction.

Each round every vertex points to its smallest neighbour in a random order, pointers are followed twice, and edges are
rewritten to the vertices pointed at; loops and repeats vanish.  Vertices that are not locally smallest disappear, so few
rounds are needed, and no round gathers a neighbourhood: only minima are taken.  Lineage is cut each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each vertex of edges (a, b), the smallest vertex that it is linked with."""
    mix = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = settle(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    root = None
    while not both.isEmpty():
        up = both.groupBy("a").agg(F.min(mix("b")).alias("m"))
        up = settle(up.select(F.col("a").alias("id"), F.least(mix("a"), F.col("m")).getField("v").alias("up")), "up")
        next_ = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        jumped = up.join(next_, "up").select("id", F.col("up2").alias("to"))
        jumped = settle(jumped.join(next_.select(F.col("up").alias("to"), F.col("up2").alias("to2")), "to").select("id", F.col("to2").alias("to")), "jumped")
        root = jumped if root is None else settle(root.join(jumped.select(F.col("id").alias("to"), F.col("to").alias("n")), "to", "left").select("id", F.coalesce("n", "to").alias("to")), "root")
        a, b = jumped.select(F.col("id").alias("a"), F.col("to").alias("a2")), jumped.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        both = settle(both.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    if root is None:
        return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = root.groupBy("to").agg(F.min("id").alias("component"))
    return root.join(least, "to").select("id", "component")
