"""Documents cut into parts that fit a token budget, by the coarsest means that does.

A document that fits is one part. Else it is cut at the headings of the highest level that occurs twice,
and each piece is looked at anew. A piece without such a level is packed element by element, every part led by the last
heading of each level before it. An element above the budget is cut by its structure (rows, items, term groups), else
into sentences, else into overlapping slices of tokens.

Cases with a defined result: elements without text are left out; a document without any gives no part; of
elements in one place the order is that of their type, then their markup; repeated documents (one doc_id) are one document; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenizers import Tokenizer, resolve
from .fragments import fragments

#: Content tokens below which a slice isn't shrunk, and those that must be left beside headings and overlap.
FLOOR, ROOM = 16, 100
_TAG, _END = re.compile(r"<[^>]*>"), re.compile(r"(?<=[.!?])\s+")


class Part(NamedTuple):
    headings: tuple[str, ...]
    text: str
    how: str

    def whole(self) -> str:
        return "\n\n".join([*self.headings, self.text] if self.text else self.headings)


class Element(NamedTuple):
    kind: str
    level: int
    html: str

    def text(self) -> str:
        return " ".join(entities.unescape(_TAG.sub(" ", self.html)).split())


def plain(elements: list[Element]) -> str:
    return "\n\n".join(t for t in (e.text() for e in elements) if t)


def slices(text: str, headings: tuple[str, ...], t: Tokenizer, budget: int, overlap: int) -> list[str]:
    """Runs of tokens that overlap; each is measured as the part that it becomes and shrunk until that fits."""
    room = budget - (t.count("\n\n".join(headings)) if headings else 0)
    if room - overlap <= ROOM:
        raise ValueError(f"{room} tokens beside the headings and an overlap of {overlap} leave too little room")
    tokens, out, at = t.encode(text), [], 0
    while at < len(tokens):
        size = room
        while True:
            piece = t.decode(tokens[at : at + size])
            now = t.count(Part(headings, piece, "").whole())
            if now <= budget or size <= FLOOR:
                break
            size = max(FLOOR, min(size - 1, size * budget // now))
        out.append(piece)
        if at + size >= len(tokens):
            break
        at = max(at + 1, at + size - min(overlap, size // 2))
    return out


def sentences(text: str, headings: tuple[str, ...], t: Tokenizer, budget: int) -> list[str] | None:
    """Runs of sentences as long as fit; None if there is but one, or one that is too long by itself."""
    found = [s for s in _END.split(text) if s.strip()]
    fits = lambda x: t.count(Part(headings, x, "").whole()) <= budget
    if len(found) < 2 or not all(map(fits, found)):
        return None
    out, held = [], found[0]
    for s in found[1:]:
        if fits(f"{held} {s}"):
            held = f"{held} {s}"
        else:
            out.append(held)
            held = s
    return [*out, held]


def oversize(e: Element, headings: tuple[str, ...], t: Tokenizer, budget: int, overlap: int) -> Iterator[Part]:
    size = lambda h: t.count(Part(headings, Element(e.kind, 0, h).text(), "").whole())
    cut = fragments(e.html, size, budget)
    for piece in cut:
        text = Element(e.kind, 0, piece).text()
        if size(piece) <= budget:
            yield Part(headings, text, "structure")
        elif (found := sentences(text, headings, t, budget)) is not None:
            yield from (Part(headings, s, "sentences") for s in found)
        else:
            yield from (Part(headings, s, "slices") for s in slices(text, headings, t, budget, overlap))


def packed(elements: list[Element], t: Tokenizer, budget: int, overlap: int) -> Iterator[Part]:
    """Element by element; a heading joins what follows it, and repeats before every later part below it."""
    last: dict[int, str] = {}
    context: tuple[str, ...] = ()
    held: list[str] = []
    used = 0

    def weigh(text: str) -> int:
        return t.count(text) if text else 0

    for e in elements:
        text = e.text()
        if not text:
            continue
        if e.kind == "heading":
            if held:
                yield Part(context, "\n\n".join(held), "elements")
                held = []
            last[e.level] = text
            context = tuple(last.values())
            used = weigh("\n\n".join(context))
            continue
        size = weigh(text)
        # Sizes are summed, and the part as a whole is counted where they come near the budget.
        if held and used + size > budget * 0.9 and weigh(Part(context, "\n\n".join([*held, text]), "").whole()) > budget:
            yield Part(context, "\n\n".join(held), "elements")
            held, used = [], weigh("\n\n".join(context))
        if not held and weigh(Part(context, text, "").whole()) > budget:
            yield from oversize(e, context, t, budget, overlap)
            continue
        held.append(text)
        used += size
    if held:
        yield Part(context, "\n\n".join(held), "elements")
    elif elements and elements[-1].kind == "heading" and context:
        yield Part(context, "", "elements")


def cascade(elements: list[Element], t: Tokenizer, budget: int, overlap: int) -> list[Part]:
    """The parts of one document, in reading order."""
    out: list[Part] = []
    stack = [[e for e in elements if e.text()]]
    while stack:
        now = stack.pop()
        if not now:
            continue
        if t.count(whole := plain(now)) <= budget:
            out.append(Part((), whole, "whole"))
            continue
        levels = [e.level for e in now if e.kind == "heading"]
        twice = [k for k in sorted(set(levels)) if levels.count(k) > 1]
        if not twice:
            out.extend(packed(now, t, budget, overlap))
            continue
        at = [i for i, e in enumerate(now) if e.kind == "heading" and e.level == twice[0]]
        bounds = [0, *at[1:], len(now)]  # what precedes the first heading joins the first piece
        stack.extend(now[a:b] for a, b in reversed(list(zip(bounds, bounds[1:]))))
    return out


def split_cascade(elements: DataFrame, budget: int = 7000, overlap: int = 200, tokenizer: Tokenizer | str | None = None) -> DataFrame:
    """``doc_id, pos, element_type, level, html`` → ``doc_id, split_sequence`` (from 1), ``split_total, how, n_tokens,
    headings, text``. A document is one row of its elements: they are gathered once, by document."""
    t: Callable = resolve(tokenizer)
    rows = elements.select("doc_id", F.struct("pos", F.coalesce("element_type", F.lit("")).alias("kind"), F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.coalesce("html", F.lit("")).alias("html")).alias("e"))
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias("es"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = cascade([Element(e["kind"], e["level"], e["html"]) for e in b.column(1)[i].as_py()], t, budget, overlap)
                if parts:
                    columns = [pa.array([n] * len(parts), k) for n, k in ((b.column(0)[i].as_py(), b.schema.types[0]),)]
                    columns += [pa.array(range(1, len(parts) + 1), pa.int32()), pa.array([len(parts)] * len(parts), pa.int32()), pa.array([p.how for p in parts])]
                    columns += [pa.array([t.count(p.whole()) for p in parts], pa.int32()), pa.array([list(p.headings) for p in parts], pa.list_(pa.string())), pa.array([p.text for p in parts], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "split_sequence", "split_total", "how", "n_tokens", "headings", "text"])

    kind = dict(elements.dtypes)["doc_id"]
    return whole.mapInArrow(run, f"doc_id {kind}, split_sequence int, split_total int, how string, n_tokens int, headings array<string>, text string")
