"""Connected components by alternating large and small stars.

Each round writes the remaining edges to the shared folder and deletes those of the round before, so
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.durable import discard, materialize, stage_path


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the smallest node reachable.

    Minima are taken with map-side aggregation; joins to them are left to adaptive execution, which
    splits the partition of a node with many edges.
    """
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    path = stage_path(spark)
    current, before = materialize(ordered, path), None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
        if mark == before or not mark[0]:
            return current
        before = mark
        both = current.union(current.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        parent = large.groupBy("node").agg(F.min("root").alias("m"))
        moved = large.join(parent, "node").filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        following = stage_path(spark)
        current = materialize(moved.union(parent).distinct(), following)
        discard(spark, path)
        path = following
