"""Connected components by minimum labels and pointer jumping, in Spark joins only.

Labels go to a written table each round, so lineage stays short and a lost executor costs
one round at most.  Hubs are safe: minima are pre-aggregated before each shuffle, and a
hub's edges are the splittable side of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; ``root`` is the component's least node.

    Edges may repeat and point either way; loops and edges with a null are no edges.  No edges give an empty table.
    """
    both = edges.filter("a <> b").select("a", "b").distinct()
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = written(labels.select("node", F.least("node", "m").alias("root"), F.lit(True).alias("changed")), "labels")
    while labels.filter("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        least = labels.select("node", "root").join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("new"))
        of = labels.select(F.col("node").alias("new"), F.col("root").alias("up"))
        jumped = least.join(of, "new", "left").select("node", F.least("new", "up").alias("root"), "old")
        labels = written(jumped.select("node", "root", (F.col("root") != F.col("old")).alias("changed")), "labels")
    return labels.select("node", "root")
