"""Connected components of a graph of links, by rounds of large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import session


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, and read from there from now on."""
    session.checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); the root is the smallest node of its component.

    A step gives each node's neighbours its smallest neighbour instead; minima are combined before the shuffle, and a
    node with very many links is split by the join. The links of each round are written, so a lost task repeats one
    step only. The number of rounds grows with the logarithm of the longest path.
    """
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = settled(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return settled(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
