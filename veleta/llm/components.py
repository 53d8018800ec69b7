"""Connected components by contraction, with the smallest node as the name of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veleta.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node and label for every node of ``links`` (a, b).

    Each round every node points to its smallest neighbour or itself, pointers are followed to their roots, and
    links between roots are kept once. Every component that has links left loses at least half of its nodes in a round, so
    rounds grow with the logarithm of its size. Tables are written between steps; the driver sees row counts only.
    """
    edges = stored(
        links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = edges.select("a").unionByName(edges.select(F.col("b").alias("a")))
    labels = both.distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(ends.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = stored(parents.join(up, "parent").select("node", "parent", "above"), "parents")
            settled = jumped.filter(F.col("parent") != F.col("above")).isEmpty()
            parents = jumped.select("node", F.col("above").alias("parent"))
            if settled:
                break
        roots = parents.select(F.col("node").alias("label"), F.col("parent").alias("root"))
        labels = stored(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        ra, rb = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}")) for c in "ab")
        moved = edges.join(ra, "a").join(rb, "b").filter(F.col("ra") != F.col("rb"))
        edges = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels
