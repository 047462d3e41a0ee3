"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.plans.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Each round a node takes the smallest label among its own, its neighbours' and
    those of the node its label names, so labels travel over doubling distances.
    Every round is a table in the shared folder.  Loops and repeated edges do no harm.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, "edges", "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = scratch.keep(labels.select("node", F.least("node", "m").alias("comp")), "labels", "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("comp").alias("near")
        )
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        following = (
            labels.join(seen, "node")
            .join(jump, "comp")
            .select("node", F.least("comp", "near", "far").alias("next"), F.col("comp").alias("old"))
        )
        following = scratch.replace(following, "labels")
        labels = following.select("node", F.col("next").alias("comp"))
        if following.filter("next <> old").isEmpty():
            scratch.remove("edges")
            return labels
