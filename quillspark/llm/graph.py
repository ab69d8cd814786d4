"""Cutting lineage, and connected components of a table of links."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and Spark runs in one process.

    On a cluster executors would not see such a folder, so there the setting is demanded.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id of links (a, b) that is not itself its component's smallest id.

    Each round points every node at its smallest neighbour, follows pointers twice more and
    contracts the links, which shrink geometrically; stars take one round, chains of n links
    O(log n). A hot node is a skewed join key only, which adaptive execution splits; minima are
    aggregated before their shuffle.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    edges, labels = cut_lineage(edges), None
    while not edges.isEmpty():
        both = edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(edges.select("lo", "hi"))
        up = both.groupBy("x").agg(F.min("y").alias("p")).where("p < x")
        for _ in range(2):
            far = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            up = up.join(far, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        up = cut_lineage(up)
        a, b = up.select(F.col("x").alias("hi"), F.col("p").alias("ha")), up.select(F.col("x").alias("lo"), F.col("p").alias("la"))
        edges = edges.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("ha", "hi").alias("x"), F.coalesce("la", "lo").alias("y"))
        edges = cut_lineage(edges.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi > lo").distinct())
        new = up.select(F.col("x").alias("id"), F.col("p").alias("component"))
        if labels is not None:
            step = up.select(F.col("x").alias("component"), F.col("p").alias("q"))
            new = labels.join(step, "component", "left").select("id", F.coalesce("q", "component").alias("component")).unionAll(new)
        labels = new
    return cut_lineage(labels) if labels is not None else edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
