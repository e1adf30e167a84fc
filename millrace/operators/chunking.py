"""Chunks, their ids, metadata policies and embeddings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from ..functions.ids import chunk_id


def chunks(splits: DataFrame, source: Column | None = None) -> DataFrame:
    """One chunk a split, its id from source, split, ordinal and content."""
    source = source if source is not None else F.col("doc_id").cast("string")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return splits.select(
        chunk_id(source, F.col("split_sequence"), F.lit(0), digest).alias("chunk_id"), source.alias("source_id"), "split_sequence", "split_total", digest.alias("content_hash"), F.col("text").alias("prompt_content"), F.col("text").alias("embedding_content"), "n_tokens"
    )


def topic_chunks(splits: DataFrame, summaries: Column) -> DataFrame:
    """A chunk for each summary of a split, all with the split's text; without any, one chunk of the text itself."""
    fair = F.filter(summaries, lambda s: F.trim(s) != "")
    either = F.when(F.size(fair) > 0, fair).otherwise(F.array("text"))
    rows = splits.withColumn("__s", either).select(*splits.columns, F.posexplode("__s").alias("ordinal", "embedding_content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("split_sequence"), F.col("ordinal"), F.sha2("text", 256)))


def merge_metadata(first: Column, second: Column, policy: str = "first") -> Column:
    """Two string maps as one: on a clash the first or the second value, or none at all (``strict`` gives null)."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    only = lambda m, other: F.map_filter(m, lambda k, v: ~F.map_contains_key(other, k))
    if policy == "first":
        return F.map_concat(a, only(b, a))
    if policy == "second":
        return F.map_concat(only(a, b), b)
    if policy != "strict":
        raise ValueError(f"no policy {policy}")
    clash = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & (a[k] != b[k]))
    return F.when(~clash, F.map_concat(a, only(b, a)))


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Elements of two documents under one id: the second's follow the first's."""
    ends = first.groupBy("doc_id").agg((F.max("pos") + 1).alias("__end"))
    moved = second.join(ends, "doc_id", "left").withColumn("pos", (F.col("pos") + F.coalesce("__end", F.lit(0))).cast("int")).drop("__end")
    return first.unionByName(moved)


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 256):
    """A column function from texts to vectors; ``embed`` gets at most ``batch`` texts and must answer each."""

    @pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].fillna("").tolist()
            got = embed(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts, {len(got)} vectors")
            out += got
        return pd.Series(out)

    return run


def siblings(docs: DataFrame, parent: str = "parent_id", own: str = "doc_id") -> DataFrame:
    """``(doc_id, sibling_id)`` of documents with the same parent."""
    other = docs.select(F.col(parent), F.col(own).alias("sibling_id"))
    return docs.select(parent, own).join(other, parent).where(F.col(own) != F.col("sibling_id")).select(own, "sibling_id")
