"""Connected components by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash, unstash


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of all ids in edges (a, b): comp is the smallest id that edges reach.

    In each round a node takes the smallest label around it and then the label of that label, so long
    chains halve. Labels are written to the shared folder each round; rounds end when none changes.
    Mins are folded before each shuffle and joins on a hub's key are plain ones, which adaptive execution splits.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    label = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        best = label.join(near.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "m").alias("m"))
        up = label.select(F.col("id").alias("m"), F.col("comp").alias("top"))
        new = stash(best.join(up, "m").select("id", F.least("m", "top").alias("comp"), (F.least("m", "top") < F.col("comp")).alias("moved")), "label")
        moved = new.filter("moved").limit(1).count()
        unstash(label)
        label = new
        if not moved:
            unstash(both)
            return label.select("id", "comp")
