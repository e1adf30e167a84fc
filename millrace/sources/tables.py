"""Text and conversation tables as normalised elements: ``doc_id, pos, element_type, level, html, text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape


def text_elements(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One paragraph for every line that isn't blank, in order. Narrow: nothing is shuffled."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    rows = docs.select(F.col(doc).alias("doc_id"), F.posexplode(lines).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.lit("paragraph").alias("element_type"), F.lit(None).cast("int").alias("level"), F.concat(F.lit("<p>"), escape(F.col("line")), F.lit("</p>")).alias("html"), F.col("line").alias("text"))


def conversation_elements(turns: DataFrame) -> DataFrame:
    """Each turn is a heading (user: level 2, assistant: level 3; none for others) and a paragraph."""
    level = F.when(F.col("role") == "user", 2).when(F.col("role") == "assistant", 3)
    title = F.concat_ws(" ", "role", F.col("turn").cast("string"))
    head = F.struct((F.col("turn") * 2).cast("int").alias("pos"), F.lit("heading").alias("element_type"), level.alias("level"), F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), escape(title), F.lit("</h"), level.cast("string"), F.lit(">")).alias("html"), title.alias("text"))
    body = F.struct((F.col("turn") * 2 + 1).cast("int").alias("pos"), F.lit("paragraph").alias("element_type"), F.lit(None).cast("int").alias("level"), F.concat(F.lit("<p>"), escape("text"), F.lit("</p>")).alias("html"), F.col("text"))
    both = F.filter(F.array(F.when(level.isNotNull(), head), body), lambda s: s.isNotNull())
    return turns.select(F.col("conv_id").alias("doc_id"), F.explode(both).alias("e")).select("doc_id", "e.*")
