"""Knowledge graph rows: endpoints, patterns, neighbours, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates


def rewrite_endpoints(edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends mapped (``old`` → ``new``), and those of which an end is unknown."""
    m = lambda c, n: mapping.select(F.col("old").alias(c), F.col("new").alias(n))
    both = edges.join(m("src", "__s"), "src", "left").join(m("dst", "__d"), "dst", "left")
    known = F.col("__s").isNotNull() & F.col("__d").isNotNull()
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return both.where(known).select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *others), both.where(~known).select("src", "dst", *others)


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("node").alias("src"))
    return edges.join(ids, "src", "left_semi").join(ids.select(F.col("src").alias("dst")), "dst", "left_semi")


def allowed(edges: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Edges whose (source kind, kind, target kind) is a pattern; patterns are configuration, so broadcast."""
    legal = edges.sparkSession.createDataFrame(patterns, "src_kind string, kind string, dst_kind string")
    return edges.join(F.broadcast(legal), ["src_kind", "kind", "dst_kind"], "left_semi")


def neighbours(of: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``node, neighbour`` over one undirected step; a self-loop gives the node itself; unknown nodes are left out."""
    chosen = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    both = chosen.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(chosen.select(F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    return both.join(of.select("node"), "node", "left_semi").distinct().join(nodes.select(F.col("node").alias("neighbour")), "neighbour", "left_semi").select("node", "neighbour")


def query_entities(entities: DataFrame, begin: Column | None = None, stop: Column | None = None, where: dict | None = None, limit: int | None = None) -> DataFrame:
    """Entities whose date overlaps (those without a date never do) and whose fields are equal; in order of id."""
    found = entities
    if begin is not None or stop is not None:
        no = F.lit(None).cast("date")
        found = found.where(F.col("has_date") & dates.overlaps(F.col("begin"), F.col("stop"), no if begin is None else begin, no if stop is None else stop))
    for k, v in (where or {}).items():
        found = found.where(F.col(k) == v)
    return found if limit is None else found.orderBy("entity_id").limit(limit)


def union_dates(members: DataFrame, keys: list[str]) -> DataFrame:
    """The span of a group's dates; open on a side where a member is."""
    some = F.col("has_date")
    return members.where(some).groupBy(*keys).agg(F.when(F.count("*") == F.count("begin"), F.min("begin")).alias("begin"), F.when(F.count("*") == F.count("stop"), F.max("stop")).alias("stop"))
