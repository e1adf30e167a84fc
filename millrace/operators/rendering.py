"""Rendering elements to HTML, plain text and Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.text import escape, visible


def resolve_refs(elements: DataFrame, inline: DataFrame) -> DataFrame:
    """``html`` with each ``<ref id>`` replaced by its target's inline form (``doc_id, target_id, shown``);
    references without target or id show as such. One join on the references, none on the texts' rows."""
    tag = r"<ref [^>]*?/?>(?:</ref>)?"
    with_refs = elements.where(F.col("html").contains("<ref "))
    tags = with_refs.select("doc_id", "pos", F.posexplode(F.regexp_extract_all("html", F.lit(f"({tag})"), F.lit(1))).alias("nth", "tag"))
    named = tags.withColumn("target_id", F.regexp_extract("tag", r'id="([^"]*)"', 1)).join(inline, ["doc_id", "target_id"], "left")
    shown = F.when(F.col("target_id") == "", "[invalid ref: no id]").otherwise(F.coalesce("shown", F.concat(F.lit("[missing ref: "), F.col("target_id"), F.lit("]"))))
    parts = named.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("nth", shown.alias("shown")))).alias("shown"))
    joined = elements.join(parts, ["doc_id", "pos"], "left")
    pieces = F.split("html", tag)
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("shown"), i)["shown"], F.lit("")))), "")
    return joined.withColumn("html", F.when(F.col("shown").isNotNull(), woven).otherwise(F.col("html"))).drop("shown")


def render(elements: DataFrame, form: str = "html", joint: str = "\n") -> DataFrame:
    """``doc_id, rendered``: elements in order, as html, plain text or Markdown."""
    shown = {"html": F.col("html"), "plain": visible(F.col("html")), "markdown": to_markdown("html")}[form]
    rows = elements.select("doc_id", F.struct("pos", shown.alias("s")).alias("e"))
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return ordered.select("doc_id", F.array_join(F.transform("es", lambda e: e["s"]), joint).alias("rendered"))


def metadata_header(name: str, fields: dict[str, str]):
    """A definition list of metadata columns under a heading, escaped."""
    rows = [F.concat(F.lit(f"<dt>{k}</dt><dd>"), escape(F.col(c).cast("string")), F.lit("</dd>")) for k, c in fields.items()]
    return F.concat(F.lit(f"<header><h1>{name}</h1><dl>"), F.concat_ws("", *rows), F.lit("</dl></header>"))


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.href = [], [], []

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "blockquote", "pre"):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "))
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "br":
            self.out.append("\\\n")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")

    def handle_data(self, data):
        self.out.append(re.sub(r"\s+", " ", data))


def markdown(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


@pandas_udf(StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown)
