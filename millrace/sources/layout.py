"""Layout JSON (pages of typed blocks with lines and spans) and document snapshots, read with a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape

SPAN = "struct<type:string,content:string,html:string,image_path:string>"
LINE = f"struct<bbox:array<double>,spans:array<{SPAN}>>"
INNER = f"struct<type:string,bbox:array<double>,lines:array<{LINE}>>"
BLOCK = f"struct<type:string,bbox:array<double>,lines:array<{LINE}>,blocks:array<{INNER}>>"
SCHEMA = f"pdf_info array<struct<page_idx:int,para_blocks:array<{BLOCK}>,discarded_blocks:array<{BLOCK}>>>"
SNAPSHOT = "id string, title string, source_id string, source_path string, source_hash string, elements array<struct<id:string,element_type:string,html:string,page:int>>, metadata map<string,string>"


def _all_lines(b: Column) -> Column:
    inner = F.flatten(F.transform(F.coalesce(b["blocks"], F.array().cast(f"array<{INNER}>")), lambda x: F.coalesce(x["lines"], F.array().cast(f"array<{LINE}>"))))
    return F.concat(F.coalesce(b["lines"], F.array().cast(f"array<{LINE}>")), inner)


def _text(b: Column, joint: str = " ") -> Column:
    """Spans joined by spaces, lines by ``joint``."""
    return F.array_join(F.transform(_all_lines(b), lambda ln: F.array_join(F.transform(ln["spans"], lambda s: F.coalesce(s["content"], F.lit(""))), " ")), joint)


def line_height(b: Column) -> Column:
    """Mean height of the lines, to one decimal, half to even."""
    tall = F.filter(F.transform(b["lines"], lambda ln: ln["bbox"][3] - ln["bbox"][1]), lambda h: h.isNotNull())
    return F.when(F.size(tall) > 0, F.bround(F.aggregate(tall, F.lit(0.0), lambda a, h: a + h) / F.size(tall), 1))


def layout_elements(docs: DataFrame, doc: str = "doc_id", body: str = "json") -> DataFrame:
    """``doc_id, json`` → elements in reading order; discarded blocks that begin with a number are footnotes,
    others raw text. Unreadable JSON gives no elements (see ``layout_errors``)."""
    parsed = docs.select(F.col(doc).alias("doc_id"), F.from_json(body, SCHEMA).alias("j"))
    pages = parsed.select("doc_id", F.explode("j.pdf_info").alias("p"))
    both = F.concat(F.transform("p.para_blocks", lambda b: F.struct(b.alias("b"), F.lit(False).alias("gone"))), F.transform(F.coalesce("p.discarded_blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: F.struct(b.alias("b"), F.lit(True).alias("gone"))))
    rows = pages.select("doc_id", F.col("p.page_idx").alias("page"), F.posexplode(both).alias("nth", "s")).select("doc_id", "page", "nth", "s.b", "s.gone")
    b, kind = F.col("b"), F.col("b.type")
    text = F.trim(_text(b))
    tagged = lambda tag, inner: F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))
    note = F.regexp_extract(text, r"^(\d+)\s*(.+)$", 1)
    table = F.get(F.filter(F.flatten(F.transform(_all_lines(b), lambda ln: ln["spans"])), lambda s: s["html"].isNotNull()), F.lit(0))["html"]
    items = F.array_join(F.transform(_all_lines(b), lambda ln: tagged("li", escape(F.array_join(F.transform(ln["spans"], lambda s: F.coalesce(s["content"], F.lit(""))), " ")))), "")
    made_of = lambda t, h: F.struct(F.lit(t).alias("t"), h.alias("h"))
    element = (
        F.when(F.col("gone") & (note != ""), made_of("footnote", tagged("aside", escape(F.regexp_extract(text, r"^(\d+)\s*(.+)$", 2)))))
        .when(F.col("gone"), made_of("raw_text", tagged("div", escape(text))))
        .when(kind == "title", made_of("heading", tagged("h1", escape(text))))
        .when(kind == "table", made_of("table", table))
        .when(kind == "list", made_of("list", tagged("ul", items)))
        .when(kind == "code", made_of("raw_text", F.concat(F.lit("<div><pre><code>"), escape(_text(b, "\n")), F.lit("</code></pre></div>"))))
        .when(kind.isin("image", "chart"), made_of("image", F.lit("<img/>")))
        .otherwise(made_of("paragraph", tagged("p", escape(text))))
    )
    made = rows.select("doc_id", "page", "nth", element.alias("e"), text.alias("text"), line_height(b).alias("line_height"), F.when(note != "", note.cast("int")).alias("number"), "gone")
    return made.where(F.col("e.h").isNotNull() & ((F.col("text") != "") | (F.col("e.t") != "paragraph"))).select("doc_id", "page", "nth", F.col("e.t").alias("element_type"), F.col("e.h").alias("html"), "text", "line_height", F.when(F.col("e.t") == "footnote", F.col("number")).alias("footnote"))


def layout_errors(docs: DataFrame, doc: str = "doc_id", body: str = "json") -> DataFrame:
    return docs.where(F.col(body).isNotNull() & F.from_json(body, SCHEMA).getField("pdf_info").isNull()).select(F.col(doc).alias("doc_id"), F.lit("not a layout file").alias("error"))


def read_snapshots(spark: SparkSession, path: str, provenance: str = "original") -> DataFrame:
    """Serialised documents; ``provenance`` "file" takes the file's own path and hash instead of the stored ones."""
    rows = spark.read.schema(SNAPSHOT + ", bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "bad").json(path)
    if provenance == "file":
        rows = rows.withColumn("source_path", F.col("_metadata.file_path")).withColumn("source_hash", F.lit(None).cast("string"))
    return rows
