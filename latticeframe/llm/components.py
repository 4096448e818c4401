"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) for all nodes of edges (a, b), both long and not null.

    Each round points every node at its smallest neighbour, jumps one pointer further and contracts the edges; the
    number of live edges falls geometrically. Labels, pointers and edges stay distributed; each round is stored.
    """
    size = edges.count()  # bounds the rows of every table below
    labels, live = None, kept(edges.select("a", "b").where("a <> b").distinct(), "edges", size)
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "pointers", 2 * size)
        onward = point.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jump = kept(point.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "jumps", 2 * size)
        ends = lambda side: jump.select(F.col("node").alias(side), F.col("to").alias(f"{side}2"))
        live = kept(live.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges", size)
        if labels is None:
            labels = jump.select("node", F.col("to").alias("comp"))
        else:
            labels = labels.join(jump.select(F.col("node").alias("comp"), F.col("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = kept(labels, "labels", 2 * size)
    if labels is None:
        labels = edges.sparkSession.createDataFrame([], "node long, comp long")
    return labels
