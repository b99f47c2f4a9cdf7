"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), undirected, to (id, label): the smallest id reachable. Ids without a link
    do not occur. Each step is a minimum by key (summed before the shuffle) and a join; each
    round is written to the shared folder, and rounds grow with the logarithm of the longest chain."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select("u", F.col("m").alias("v")))
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    label = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    roots = edges.select(F.col("v").alias("id")).distinct().join(label.select("id"), "id", "left_anti")
    return label.unionByName(roots.withColumn("label", F.col("id")))
