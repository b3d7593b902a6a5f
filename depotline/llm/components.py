"""Connected components of a table of links, by hooking and pointer jumping.

Every round hooks each node to its smallest neighbour, shortens the paths
until every node points at a root, and contracts the links to those between
roots; the links shrink until none is left.  All tables stay in the shared
folder; the driver only learns whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import drop_table, write_table


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``links`` (a, b: long, not null); comp is the
    smallest node of its component."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = write_table(both.where("a <> b").distinct(), "links")
    label = write_table(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                        .withColumn("comp", F.col("node")), "labels")
    while not edges.isEmpty():
        parent = write_table(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            longer = write_table(parent.join(up, "p").select("a", F.col("pp").alias("p"),
                                                             (F.col("pp") != F.col("p")).alias("moved")), "parents")
            drop_table(parent)
            parent = longer
            if parent.where("moved").isEmpty():
                break
        to = parent.select(F.col("a").alias("comp"), "p")
        newer = write_table(label.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        ends = parent.select(F.col("a"), F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        fewer = write_table(edges.join(ends[0], "a").join(ends[1], "b").where("pa <> pb")
                            .select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        for old in (label, edges, parent):
            drop_table(old)
        label, edges = newer, fewer
    drop_table(edges)
    return label
