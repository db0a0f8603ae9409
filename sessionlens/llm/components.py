"""Connected components by hooking and pointer jumping over edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import checkpointed

MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """id, comp for every id in edges (a, b of type long): comp is the smallest id reachable.

    Every round each component hooks onto its smallest neighbour, chains are
    halved by jumping until all point at their root, and edges inside a component
    vanish; rounds and jumps follow the logarithm of the longest path.  All state is in checkpoints.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = checkpointed(ids.select("id", F.col("id").alias("comp")))
    for _ in range(MOST_ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = checkpointed(up.withColumn("far", F.lit(True)))
        while up.where("far").head(1):  # chains halve until every node points at its root
            top = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = checkpointed(up.join(top, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.coalesce(F.col("q") != F.col("p"), F.lit(False)).alias("far")))
        to = up.where("a <> p").select("a", "p")
        labels = checkpointed(labels.join(to.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")))
        left = edges.join(to, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        left = left.join(to.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        edges = checkpointed(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not edges.head(1):
            return labels
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
