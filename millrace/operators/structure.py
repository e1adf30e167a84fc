"""Structure repair: heading levels, titles, references, footnotes, groups of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_metadata
from ..plans.tables import write_table


def effective_size(size: Column, capitals: Column, centred: Column, bold: Column) -> Column:
    """Font size, a fifth more in capitals, a fifth more if centred, a tenth more if bold; one decimal, half to even."""
    factor = F.when(capitals, 1.2).otherwise(1.0) * F.when(centred, 1.2).otherwise(1.0) * F.when(bold, 1.1).otherwise(1.0)
    return F.bround(F.coalesce(size, F.lit(0.0)) * factor, 1)


def size_levels(headings: DataFrame, doc: str, size: str, levels: int = 6) -> DataFrame:
    """Adds ``level``: larger sizes are higher; more sizes than levels are squeezed in proportion; size 0 has none."""
    known = F.when(F.col(size) > 0, F.col(size))
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(known.desc_nulls_last())) - 1
    ranked = headings.withColumn("__rank", rank)
    count = F.max(F.when(known.isNotNull(), F.col("__rank"))).over(Window.partitionBy(doc)) + 1
    level = F.when(F.col("__count") <= levels, F.col("__rank") + 1).otherwise(F.least(F.floor(F.col("__rank") * levels / F.col("__count")) + 1, F.lit(levels)))
    return ranked.withColumn("__count", count).withColumn("level", F.when(known.isNotNull(), level).cast("int")).drop("__rank", "__count")


def normalise_levels(headings: DataFrame, doc: str = "doc_id", level: str = "level") -> DataFrame:
    """Levels without gaps, from 1."""
    return headings.withColumn(level, F.dense_rank().over(Window.partitionBy(doc).orderBy(level)).cast("int"))


def shift_levels(headings: DataFrame, doc: str = "doc_id", level: str = "level") -> DataFrame:
    """Levels moved so that the least is 1."""
    return headings.withColumn(level, (F.col(level) - F.min(level).over(Window.partitionBy(doc)) + 1).cast("int"))


def detect_title(headings: DataFrame, doc: str = "doc_id", last_page: int = 4, least: int = 3) -> DataFrame:
    """``doc_id, pos, title``: of level-1 headings on early pages that don't look like metadata, the largest,
    then the centred, then the first."""
    fit = headings.where((F.col("level") == 1) & (F.col("page").isNull() | (F.col("page") <= last_page)) & (F.length(F.trim("text")) >= least) & ~looks_like_metadata(F.col("text")))
    best = F.struct(F.coalesce(F.col("size"), F.lit(0.0)).alias("size"), F.col("centred").cast("int").alias("centred"), (-F.col("pos")).alias("first"), "pos", F.col("text").alias("title"))
    return fit.groupBy(doc).agg(F.max(best).alias("b")).select(doc, "b.pos", "b.title")


def main_heading(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The first heading of the highest level in each document."""
    return elements.where("element_type = 'heading'").groupBy(doc).agg(F.min_by("text", F.struct("level", "pos")).alias("heading"), F.min("level").cast("int").alias("level"))


def inline_refs(elements: DataFrame) -> DataFrame:
    """``doc_id, pos, nth, target_id, rel`` of the ``<ref id rel>`` tags, in order; unknown relations are skipped."""
    ids = F.regexp_extract_all("html", F.lit(r'<ref [^>]*?id="([^"]*)"'), F.lit(1))
    rels = F.regexp_extract_all("html", F.lit(r'<ref [^>]*?rel="([^"]*)"'), F.lit(1))
    rows = elements.where(F.col("html").contains("<ref ")).select("doc_id", "pos", F.posexplode(F.arrays_zip(ids.alias("target_id"), rels.alias("rel"))).alias("nth", "r"))
    return rows.select("doc_id", "pos", "nth", "r.target_id", "r.rel").where(F.col("rel").isin("image", "footnote", "table", "figure"))


def broken_refs(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """References without a target in their document."""
    return refs.join(elements.select("doc_id", F.col("element_id").alias("target_id")), ["doc_id", "target_id"], "left_anti")


def orphaned_footnotes(elements: DataFrame, refs: DataFrame) -> DataFrame:
    """Footnotes that no reference names."""
    used = refs.where("rel = 'footnote'").select("doc_id", F.col("target_id").alias("element_id"))
    return elements.where("element_type = 'footnote'").join(used, ["doc_id", "element_id"], "left_anti")


def footnote_score(before: Column, after: Column, start: Column, in_order: Column, late: Column) -> Column:
    """How well a number in running text fits as a footnote's mark."""
    rule = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return (
        rule(~in_order, -10)
        + rule(start == 0, -5)
        + rule(after.rlike(r"^\.\d"), -4)
        + rule((start == 0) & after.rlike(r"^[.)][ \t]+[^ \t]"), -3)
        + rule(before.rlike(r"\d$"), -2)
        + rule(before.rlike(r"[=+*/<>-] ?$") | after.rlike(r"^ ?[=+*/<>]"), -3)
        + rule(before.rlike(r"[.,;:!?)\"']$"), 4)
        + rule(before.rlike(r"[a-z]$"), 2)
        + rule(late, 1)
    ).cast("int")


def best_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of several candidates the best score, then the earliest element and place; a sole candidate wins unscored."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "element_pos", "start")
    return candidates.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def footnote_candidates(elements: DataFrame, footnotes: DataFrame, context: int = 50) -> DataFrame:
    """Occurrences of each footnote's number in its document's other elements on the same page, outside
    tags; digits may be spaced, and no digit may follow. Joined on document and page."""
    both = elements.where("element_type <> 'footnote'").alias("e").join(footnotes.alias("f"), (F.col("e.doc_id") == F.col("f.doc_id")) & F.col("e.page").eqNullSafe(F.col("f.page")))
    pattern = F.concat(F.array_join(F.filter(F.split(F.col("f.number").cast("string"), ""), lambda c: c != ""), r"\s*"), F.lit(r"(?!\d)"))
    pieces = F.split(F.regexp_replace(F.col("e.text"), pattern, F.lit("\x01")), "\x01")
    marks = F.regexp_extract_all(F.col("e.text"), pattern, F.lit(0))
    rows = both.select(F.col("f.doc_id"), F.col("f.number"), F.col("e.pos").alias("element_pos"), F.col("e.text").alias("text"), pieces.alias("pieces"), marks.alias("marks"), F.posexplode(marks).alias("nth", "mark"))
    shown = F.transform(F.slice("pieces", F.lit(1), F.col("nth") + F.lit(1)), lambda p, i: F.concat(p, F.when(i < F.col("nth"), F.get(F.col("marks"), i)).otherwise("")))
    before = F.array_join(shown, "")
    after = F.substring("text", F.length(before) + F.length("mark") + F.lit(1), F.length("text"))
    return rows.select("doc_id", "number", "element_pos", "nth", F.length(before).alias("start"), F.substring(before, F.greatest(F.length(before) - context + 1, F.lit(1)), F.lit(context)).alias("before"), F.substring(after, 1, context).alias("after"))


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(root, node)`` for all nodes that follow from a root along ``(src, dst)``, itself included.

    Each round joins only the rows found in the last one and writes what is new, so plans stay short.
    Longer paths than ``most_rounds`` raise an error."""
    spark = roots.sparkSession
    new, path = write_table(roots.select(F.col("node").alias("root"), "node").distinct(), "reached")
    paths = [path]
    for _ in range(most_rounds):
        seen = spark.read.schema(new.schema).parquet(*paths)
        found = new.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node")).distinct()
        new, path = write_table(found.join(seen, ["root", "node"], "left_anti"), "reached")
        if new.isEmpty():
            return seen
        paths.append(path)
    raise RuntimeError(f"paths of more than {most_rounds} steps")
