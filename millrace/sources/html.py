"""HTML pages as elements.

``strict`` takes only direct children of the body with a known tag, as lenient tree builders without
implied end tags see them; ``unwrap`` opens listed wrappers (article, section, main, div without own
text) first. One pass of Arrow batches over the pages, nothing shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape as quote
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {f"h{i}": "heading" for i in range(1, 8)} | {"p": "paragraph", "div": "paragraph", "table": "table", "ul": "list", "ol": "list", "dl": "list", "img": "image", "aside": "footnote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNWRAPPED = ("article", "section", "main", "div")
SCHEMA = "page_id long, pos int, element_type string, level int, html string, text string, footnote int"
_NOTE = re.compile(r"^(?:footnote-|fn_|note)(\w+)$")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else "" if c.tag in ("script", "style") else c.text() for c in self.children)

    def html(self) -> str:
        inner = "".join((c if self.tag in ("script", "style") else quote(c, False)) if isinstance(c, str) else c.html() for c in self.children)
        attrs = "".join(f' {k}="{quote(v or "")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"

    def has_own_text(self) -> bool:
        return any(isinstance(c, str) and c.strip() for c in self.children)

    def find(self, tag: str) -> Node | None:
        todo = [self]
        while todo:
            n = todo.pop()
            if n.tag == tag:
                return n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        return None


class Tree(HTMLParser):
    """A tree without implied end tags: an element ends at its own end tag or its ancestor's."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID and len(self.stack) < 900:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _opened(nodes: list, tags: tuple[str, ...]) -> list:
    out = []
    for n in nodes:
        if isinstance(n, Node) and n.tag in tags and not n.has_own_text():
            out += _opened(n.children, tags)
        else:
            out.append(n)
    return out


def _frame(table: Node) -> Node | None:
    """The cell of a table that only frames one cell: a head of one, and nothing in its body."""
    cells = []
    todo = [table]
    while todo:
        n = todo.pop()
        if n.tag in ("th", "td"):
            cells.append(n)
        else:
            todo += [c for c in n.children if isinstance(c, Node)]
    return cells[0] if len(cells) == 1 and cells[0].tag == "th" else None


def page_elements(source: str | None, mode: str = "strict", tags: tuple[str, ...] = UNWRAPPED) -> tuple[str | None, list[tuple]]:
    """The page's title and its elements: ``(element_type, level, html, text, footnote number)``."""
    root = Tree(source or "").root
    title = root.find("title")
    body = root.find("body") or root
    nodes = _opened(body.children, tags) if mode == "unwrap" else body.children
    out = []
    for n in nodes:
        if not isinstance(n, Node):
            continue
        if n.tag == "table" and (cell := _frame(n)):
            n = Node("div", {})
            n.children = cell.children
        if n.tag not in KINDS:
            continue
        kind, level, note = KINDS[n.tag], None, None
        if n.tag[0] == "h" and n.tag[1:].isdigit():
            level = min(6, int(n.tag[1]))
        elif n.tag == "p" and "heading" in (n.attrs.get("class") or "").split():
            kind, level = "heading", 6
        elif n.tag == "aside" and "footnote" not in (n.attrs.get("class") or "").split():
            continue
        text = n.text().strip("\n -")
        if n.tag == "p" and (m := _NOTE.match(n.attrs.get("id") or "")):
            kind = "footnote"
            note = int(m[1]) if m[1].isdigit() else None
            text = re.sub(r"^\[\d+\]\s*", "", text)
        if n.tag == "img" and not (n.attrs.get("src") or "").startswith("data:"):
            continue
        if level and n.tag != f"h{level}":
            head = Node(f"h{level}", n.attrs)
            head.children = n.children
            n = head
        out.append((kind, level, n.html().strip(), text, note))
    return (title.text() if title else None), out


def html_elements(pages: DataFrame, mode: str = "strict", tags: tuple[str, ...] = UNWRAPPED) -> DataFrame:
    """``page_id, html`` → elements."""
    if mode not in ("strict", "unwrap"):
        raise ValueError(f"mode must be strict or unwrap, not {mode}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(page, i, *e) for page, h in zip(b.column(0).to_pylist(), b.column(1)) for i, e in enumerate(page_elements(h.as_py(), mode, tags)[1])]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, SCHEMA)


def page_titles(pages: DataFrame) -> DataFrame:
    """Titles and first headings by expression alone; the markup must close both."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    return pages.select("page_id", inner("title").alias("title"), inner("h1").alias("heading"))
