"""Oversize tables and lists cut into fragments that stand alone: header rows are repeated, numbering goes on."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..sources.html import Node, Tree


def _nodes(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def _rows(table: Node) -> tuple[list[Node], list[Node]]:
    """Header rows (of the head, or leading rows of header cells alone) and the others."""
    head, rest = [], []
    for part in _nodes(table):
        for row in [part] if part.tag == "tr" else [r for r in _nodes(part) if r.tag == "tr"]:
            only = bool(_nodes(row)) and all(c.tag == "th" for c in _nodes(row))
            (head if part.tag == "thead" or (only and not rest) else rest).append(row)
    return head, rest


def fragments(html: str, size: Callable[[str], int], budget: int) -> list[str]:
    """The markup itself if it fits or can't be cut; else runs of rows, items or term groups, each as long as
    fits; a single unit above the budget stands alone."""
    if size(html) <= budget:
        return [html]
    roots = _nodes(Tree(html).root)
    if len(roots) != 1:
        return [html]
    root = roots[0]
    if root.tag == "table":
        head, units = _rows(root)
        groups = [[u] for u in units]
        top = "".join(r.html() for r in head)
        wrap = lambda us, _: f"<table>{f'<thead>{top}</thead>' if top else ''}<tbody>{''.join(u.html() for u in us)}</tbody></table>"
    elif root.tag in ("ul", "ol"):
        groups = [[u] for u in _nodes(root) if u.tag == "li"]
        first = int(root.attrs.get("start") or 1) if (root.attrs.get("start") or "1").isdigit() else 1
        wrap = lambda us, at: f"<{root.tag}{f' start="{first + at}"' if root.tag == 'ol' and first + at != 1 else ''}>{''.join(u.html() for u in us)}</{root.tag}>"
    elif root.tag == "dl":
        groups = []
        for u in _nodes(root):
            if u.tag == "dt" and (not groups or groups[-1][-1].tag == "dd") or not groups:
                groups.append([])
            groups[-1].append(u)
        wrap = lambda us, _: f"<dl>{''.join(u.html() for u in us)}</dl>"
    else:
        return [html]
    if len(groups) < 2:
        return [html]
    out, held, at = [], [], 0
    for i, g in enumerate(groups):
        if held and size(wrap(held + g, at)) > budget:
            out.append(wrap(held, at))
            held, at = [], i
        held = held + g
    return [*out, wrap(held, at)]


def split_elements(elements: DataFrame, budget: int) -> DataFrame:
    """Elements with oversize tables and lists cut up: adds ``fragment``, from 0. Sizes are words of the markup's
    text; the cutting stays inside a row."""

    @pandas_udf(ArrayType(StringType()))
    def run(html: pd.Series) -> pd.Series:
        words = lambda h: len(re.sub("<[^>]*>", " ", h).split())
        return html.map(lambda h: None if h is None else fragments(h, words, budget))

    others = [c for c in elements.columns if c != "html"]
    return elements.select(*others, F.posexplode(run("html")).alias("fragment", "html"))
