"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, stored


@passing
def components(edges: DataFrame) -> DataFrame:
    """node, component for every endpoint of ``edges`` (a, b); the component is its smallest node.

    A distributed union-find: each round every node hooks to its smallest neighbour, the
    pointers are halved until they reach the roots, and the links are contracted to the
    roots. Rounds grow with the logarithm of the nodes, also for one long chain. Nothing
    but counts reaches the driver.
    """
    links = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while label is None or not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "to")
        up = stored(both.groupBy("node").agg(F.least("node", F.min("to")).alias("root")))
        while True:
            high = up.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = stored(up.join(high, up["root"] == high["mid"]).select("node", "top", (F.col("top") != F.col("root")).alias("moved")))
            up = jumped.select("node", F.col("top").alias("root"))
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = up.select("node", F.col("root").alias("component"))
        else:
            more = up.select(F.col("node").alias("component"), "root")
            label = stored(label.join(more, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = up.toDF("a", "ra"), up.toDF("b", "rb")
        links = stored(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return label
