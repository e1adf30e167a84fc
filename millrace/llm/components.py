"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two joins and two map-side-combined aggregations over the edges; no vertex list, label
or component ever comes to the driver. Both rounds only replace edges by edges inside the same
component, and they end in stars whose centres are the components' smallest nodes, after a number of
rounds that grows with the logarithm of the edge count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of longs → ``(node, root)`` for every node that has a link; root is the
    component's smallest node. Self-links and repeated links change nothing; an empty table gives an
    empty table."""
    spark = edges.sparkSession
    now, path = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        after, new_path = write_table(_small_star(_large_star(now)), "links")
        drop_path(spark, path)
        new = _mark(after)
        now, path = after, new_path
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
