"""Connected components by label propagation with pointer jumping, for edges that may meet in one hub."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import discard, materialize, salted_join


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``; the root is the smallest node of the component.

    Nodes are BIGINT; self loops and repeated edges are allowed, null ends are left out, no edges give no rows. A hub
    that holds a large share of the edges is salted; each round is written to the shared folder.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    both = edges.union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = materialize(both.toDF("node", "other"), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    for _ in range(most_rounds):
        seen = salted_join(both, labels.select(F.col("node").alias("other"), "root"), "other")
        least = seen.groupBy("node").agg(F.min("root").alias("near"))
        hooked = labels.join(least, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        hooked = materialize(hooked, "hooked")
        jumped = salted_join(hooked, hooked.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        labels = materialize(jumped.select("node", F.least(F.col("root"), F.coalesce("far", "root")).alias("root"), "was"), "labels")
        if not labels.filter("root <> was").take(1):
            return labels.select("node", "root")
        discard(hooked)
        labels = labels.select("node", "root")
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
