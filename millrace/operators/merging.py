"""Merging two parses of the same documents by aligning their elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markup_richness

OPS = "doc_id long, seq int, op string, a_pos array<int>, b_pos array<int>, html string, reason string"
#: Operations, and characters in them, after which a task sends what it has.
OUT_ROWS, OUT_SIZE = 10_000, 8 << 20
_TAG = re.compile(r"<[^>]*>")
_RICH = re.compile(r"<(?:b|strong|i|em|u|s|a|sub|sup|code|mark)[ >]")


def _key(html: str) -> str:
    return " ".join(_TAG.sub("", html).casefold().split())


def _richer(a: str, b: str) -> tuple[str, str]:
    if a == b:
        return a, "tie a"
    ra, rb = len(_RICH.findall(a)), len(_RICH.findall(b))
    if ra != rb:
        return (a, "richer a") if ra > rb else (b, "richer b")
    la, lb = len(_key(a)), len(_key(b))
    return (b, "longer b") if lb > la else (a, "tie a")


def _alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio is at least ``least``; its two cheap upper bounds are asked first."""
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least


def align(a: list[tuple[int, str]], b: list[tuple[int, str]], insertions: bool = True, least: float = 0.6) -> list[tuple]:
    """Operations that merge ``b`` into ``a``: keep, merge, insert or delete, with positions and result."""
    keys = {h: _key(h) for h in {h for _, h in a} | {h for _, h in b}}
    ka, kb = [keys[h] for _, h in a], [keys[h] for _, h in b]
    out: list[tuple] = []
    for op, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(range(i, j), range(k, m)):
                html, why = _richer(a[x][1], b[y][1])
                out.append(("keep" if a[x][1] == b[y][1] else "merge", [a[x][0]], [b[y][0]], html, why))
            continue
        if op == "replace":
            alike = j - i == m - k == 1 or _alike(" ".join(ka[i:j]), " ".join(kb[k:m]), least)
            if alike:
                if j - i == m - k == 1:
                    html, why = _richer(a[i][1], b[k][1])
                else:
                    one, other = ("".join(h for _, h in s) for s in (a[i:j], b[k:m]))
                    html, why = _richer(one, other)
                out.append(("merge", [p for p, _ in a[i:j]], [p for p, _ in b[k:m]], html, why))
                continue
        if i < j:
            out.append(("delete", [p for p, _ in a[i:j]], [], "", "only in a"))
        if k < m and insertions:
            out += [("insert", [], [p], h, "only in b") for p, h in b[k:m]]
    return out


def merge_operations(a: DataFrame, b: DataFrame, insertions: bool = True, least: float = 0.6) -> DataFrame:
    """The operations for every document of either side. Documents come sorted and are aligned as they pass; a task
    holds the one that it is reading and a batch of operations."""
    sided = lambda d, side: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(side).alias("side"), F.col("pos").cast("int").alias("pos"), F.coalesce("html", F.lit("")).alias("html"))
    rows = sided(a, 0).unionByName(sided(b, 1)).repartition("doc_id").sortWithinPartitions("doc_id", "side", "pos", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OPS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]
        out, size = [], 0
        elements = (e for batch in batches for e in zip(*(batch[c].to_pylist() for c in ("doc_id", "side", "pos", "html"))))
        for doc_id, group in groupby(elements, lambda e: e[0]):
            sides = [], []
            for _, side, pos, html in group:
                sides[side].append((pos, html))
            for n, o in enumerate(align(*sides, insertions, least)):
                out.append((doc_id, n, *o))
                size += len(o[3])
            if len(out) >= OUT_ROWS or size >= OUT_SIZE:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, OPS)


def apply_operations(ops: DataFrame) -> DataFrame:
    """The merged elements in order: ``doc_id, seq, html``."""
    return ops.where("op <> 'delete'").select("doc_id", "seq", "html")


def select_heading(level_a: Column, level_b: Column, trusted_a: Column, trusted_b: Column) -> Column:
    """A trusted parser's level, else the higher of both."""
    return F.when(trusted_a & ~trusted_b, level_a).when(trusted_b & ~trusted_a, level_b).otherwise(F.least(level_a, level_b))


def select_paragraph(a: Column, b: Column) -> Column:
    ra, rb = markup_richness(a), markup_richness(b)
    return F.when(rb > ra, b).when(ra > rb, a).when(F.length(b) > F.length(a), b).otherwise(a)


def select_table(a: Column, b: Column) -> Column:
    """More header cells, then more rows, then the first."""
    heads, rows = (lambda t: F.regexp_count(t, F.lit("<th[ >]"))), (lambda t: F.regexp_count(t, F.lit("<tr[ >]")))
    return F.when(heads(b) > heads(a), b).when(heads(a) > heads(b), a).when(rows(b) > rows(a), b).otherwise(a)
