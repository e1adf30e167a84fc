"""Splitting documents into parts that fit a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType


def split_by_headings(elements: DataFrame) -> DataFrame:
    """Adds ``split_id``: a part begins at a heading whose predecessor isn't one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    heading = F.col("element_type") == "heading"
    begins = heading & (F.lag("element_type").over(order) != "heading")
    marked = elements.withColumn("__b", F.coalesce(begins, F.lit(False)).cast("int"))
    return marked.withColumn("split_id", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__b")


def split_hierarchically(elements: DataFrame) -> DataFrame:
    """Adds ``split_level`` and ``split_id``: documents are cut at the headings of the highest level that
    occurs twice; what precedes the first of them joins the first part. Without such a level: one part."""
    counts = elements.where("element_type = 'heading'").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    chosen = counts.where("n >= 2").groupBy("doc_id").agg(F.min("level").cast("int").alias("split_level"))
    marked = elements.join(chosen, "doc_id", "left")
    cut = ((F.col("element_type") == "heading") & (F.col("level") == F.col("split_level"))).cast("int")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("__c", F.coalesce(cut, F.lit(0))).withColumn("split_id", F.greatest(F.sum("__c").over(order) - 1, F.lit(0)).cast("int")).drop("__c")


def heading_context(elements: DataFrame, levels: int = 6) -> DataFrame:
    """Adds ``context``: the last heading of each level before the element, in the order in which the levels
    first appeared. A higher heading doesn't clear deeper ones."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for k in range(1, levels + 1):
        mine = (F.col("element_type") == "heading") & (F.col("level") == k)
        last = F.last(F.when(mine, F.col("text")), ignorenulls=True).over(before)
        first = F.min(F.when(mine, F.col("pos"))).over(before)
        parts.append(F.when(last.isNotNull(), F.struct(first.alias("at"), last.alias("text"))))
    found = F.array_sort(F.filter(F.array(*parts), lambda s: s.isNotNull()))
    return elements.withColumn("context", F.array_join(F.transform(found, lambda s: s["text"]), " > "))


@pandas_udf(ArrayType(StructType([StructField("first", IntegerType()), StructField("n", IntegerType()), StructField("tokens", LongType())])))
def pack_in_order(sizes: pd.Series, budget: pd.Series) -> pd.Series:
    """Where each pack begins, how many sizes it takes and their sum: a new one begins where the next size would
    overfill a pack that isn't empty."""

    def one(xs, most: int):
        if xs is None:
            return None
        out, first, total = [], 0, 0
        for i, x in enumerate(xs):
            if i > first and total + x > most:
                out.append((first, i - first, total))
                first, total = i, 0
            total += x
        return [*out, (first, len(xs) - first, total)] if len(xs) else []

    return pd.Series([one(xs, int(b)) for xs, b in zip(sizes, budget)])


def greedy_packs(docs: DataFrame, units: Column, size, budget: int, joint: str = "\n") -> DataFrame:
    """``doc_id, split_sequence, split_total, n_units, n_tokens, text``: units of each row packed in order.

    Units stay inside their row: the sizes go through one Arrow function, each pack's slice is joined before
    packs become rows, so a text is copied once however many packs it has, and nothing is shuffled. Null
    and empty unit lists give no pack; repeated rows are packed each."""
    rows = docs.select("doc_id", units.alias("units")).withColumn("packs", pack_in_order(F.transform("units", size), F.lit(budget)))
    made = F.transform("packs", lambda p: F.struct(p["n"].alias("n"), p["tokens"].alias("tokens"), F.array_join(F.slice("units", p["first"] + 1, p["n"]), joint).alias("text")))
    parts = rows.select("doc_id", F.size("packs").alias("total"), F.posexplode(made).alias("k", "p"))
    return parts.select("doc_id", F.col("k").alias("split_sequence"), F.col("total").alias("split_total"), F.col("p.n").alias("n_units"), F.col("p.tokens").cast("int").alias("n_tokens"), F.col("p.text").alias("text"))


def token_windows(docs: DataFrame, text: str = "text", size: int = 200, overlap: int = 20) -> DataFrame:
    """Overlapping windows of words: ``doc_id, slice, start, n_tokens, text``."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the window's size")
    words = F.filter(F.split(F.col(text), "[ \t\n\r]+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    # Windows are cut before they become rows, so no row carries its whole text.
    mine = F.transform(starts, lambda at: F.struct(at.alias("start"), F.slice("w", at + 1, F.lit(size)).alias("w")))
    cut = rows.select("doc_id", F.posexplode(mine).alias("slice", "s"))
    return cut.select("doc_id", "slice", F.col("s.start").alias("start"), F.size("s.w").alias("n_tokens"), F.array_join("s.w", " ").alias("text"))
