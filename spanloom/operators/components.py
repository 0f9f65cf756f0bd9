"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set and all tasks run in this process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark removes shuffle files, and checkpoints where cleanCheckpoints is set, once the driver has
    collected what refers to them, frames (which are in reference cycles) here and their plans in the
    JVM; both collections are asked for, as an idle driver may not collect for a long time while many
    rounds leave their files.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is one or two
    grouped shuffles of the edges, a hub's neighbours are never collected (a window over the hub
    would be; a grouped minimum joined back is not), and long chains take logarithmically many
    rounds. Self-loops and repeated edges don't matter; null ends are ignored. The only thing that
    comes to the driver is a count and a checksum of the edges, to see the fixed point.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    state = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is linked to the node's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below a node, and the node, are linked to its smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
