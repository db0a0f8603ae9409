"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROUNDS = 60


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is set and all runs on one machine (as in tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def components(edges: DataFrame) -> DataFrame:
    """id, comp of every id in edges (a, b): comp is the least id reachable."""
    edges = kept(edges.select("a", "b").where("a <> b").distinct())
    comp = kept(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("comp")))
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        parent = kept(parent.withColumn("far", F.lit(True)))
        while parent.where("far").head(1):  # chains halve until every node points at its root
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
            parent = kept(parent.join(above, "p", "left").select("a", F.coalesce("g", "p").alias("p"), F.coalesce(F.col("g") != F.col("p"), F.lit(False)).alias("far")))
        moved = parent.where("a <> p").select("a", "p")
        comp = kept(comp.join(moved.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")))
        edges = edges.join(moved, "a", "left").select(F.coalesce("p", "a").alias("a"), "b")
        edges = edges.join(moved.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("p", "b").alias("b"))
        edges = kept(edges.where("a <> b").distinct())
        if not edges.head(1):
            return comp
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
