"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a minimum per node and a join back, so a node's links are never gathered in
one task (adaptive execution splits the join for a node with very many).  The links of a
round are checkpointed to the shared folder; links stop changing after about log2 of the
longest chain rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, root): every linked node with the smallest node it reaches."""
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    links = pinned(links.select(big, small).where("a <> b").distinct())
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its neighbours below go to the smallest of them
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        below = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = pinned(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
