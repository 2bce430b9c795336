"""Connected components of an edge table, by smallest reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placerec.llm.shared import cut, drop


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component): label minima over neighbours with pointer jumping, until nothing changes.

    A node with very many links is summed up by partial minima; no group of links is ever gathered.
    Loops and repeated edges are allowed; without edges the result is empty.
    """
    e = edges.select(F.col(x).alias("u"), F.col(y).alias("v")).where("u <> v")
    both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "labels")
    while True:
        of = label.select(F.col("node").alias("v"), F.col("component").alias("c"))
        near = both.join(of, "v").groupBy("u").agg(F.min("c").alias("c"))
        low = label.join(near, label["node"] == near["u"]).select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        low = cut(low, "labels")
        up = low.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        new = cut(low.join(up, "component", "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "was"), "labels")
        done = new.where("component <> was").isEmpty()
        drop(label, low)
        label = new.select("node", "component")
        label._placerec_path = new._placerec_path
        if done:
            drop(both)
            return label
