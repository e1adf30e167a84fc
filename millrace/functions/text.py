"""Predicates and projections over text and markup, inside whole-stage code generation where possible."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_RICH = r"<(b|strong|i|em|u|s|a|sub|sup|code|mark)[ >]"
_FORMS = (r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$", r"^[a-z]{1,4}[-/ ]?\d{2,}$", r"^page \d+", r"^\d+$")


def escape(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+.!|>~-])", r"\\$1")


def visible(html: Column) -> Column:
    """Text without tags, trimmed of line breaks, spaces and hyphens."""
    bare = F.regexp_replace(html, "<[^>]*>", "")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(safe), F.lit(raw))
    return F.regexp_replace(bare, r"^[\n -]+|[\n -]+$", "")


def looks_like_metadata(text: Column) -> Column:
    """Fewer letters than half of the characters, or the form of a date, code, page or number."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    low = F.lower(F.trim(text))
    found = letters < F.length(text) * 0.5
    for form in _FORMS:
        found = found | low.rlike(form)
    return F.coalesce(found, F.lit(True))


def all_capitals(text: Column) -> Column:
    """At least one letter, and every letter upper case (letters without case aren't)."""
    return text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_bold(html: Column) -> Column:
    weight = F.regexp_extract(html, r"(?i)font-weight:\s*(\d+)", 1)
    return html.rlike(r"(?i)<(b|strong)[ >]|font-weight:\s*bold") | (F.when(weight != "", weight.cast("int")).otherwise(0) >= 600)


def is_centred(html: Column) -> Column:
    return html.rlike(r"(?i)style\s*=\s*\"[^\"]*text-align:\s*center")


def font_size(html: Column) -> Column:
    """The first font size in points; pixels count three quarters, em and rem twelve."""
    found = r"(?i)font-size:\s*([0-9.]+)\s*(pt|px|em|rem)"
    size, unit = F.regexp_extract(html, found, 1), F.lower(F.regexp_extract(html, found, 2))
    factor = F.when(unit == "px", 0.75).when(unit.isin("em", "rem"), 12.0).otherwise(1.0)
    return F.when(size != "", size.cast("double") * factor)


def heading_level(html: Column) -> Column:
    level = F.regexp_extract(html, "(?i)<h([1-6])[ >]", 1)
    return F.when(level != "", level.cast("int"))


def with_heading_level(html: Column, level: Column) -> Column:
    """The heading's markup with another level."""
    name = F.concat(F.lit("h"), level.cast("string"))
    opened = F.regexp_replace(html, F.lit("(?i)<h[1-6]"), F.concat(F.lit("<"), name))
    return F.regexp_replace(opened, F.lit("(?i)</h[1-6]"), F.concat(F.lit("</"), name))


def markup_richness(html: Column) -> Column:
    """Rich tags, one more for each styled span, two for each reference."""
    return F.regexp_count(html, F.lit(_RICH)) + F.regexp_count(html, F.lit(r"<span style")) + 2 * F.regexp_count(html, F.lit(r"<ref "))


def sentences(text: Column) -> Column:
    """Pieces that end at . ! or ? before white space; blank ones are left out."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\f\r]+", "$1\x01")
    return F.filter(F.split(marked, "\x01"), lambda s: F.trim(s) != "")


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), "[ \t\n\r]+")))


def squeeze_blank_lines(text: Column) -> Column:
    """Runs of n line breaks, n above 1, become half as many, rounded up."""
    halves = F.transform(F.split(text, r"(?<=\n)(?=[^\n])|(?<=[^\n])(?=\n)"), lambda p: F.when(p.rlike(r"^\n\n+$"), F.repeat(F.lit("\n"), F.ceil(F.length(p) / 2).cast("int"))).otherwise(p))
    return F.array_join(halves, "")


@pandas_udf(StringType())
def comparison_form(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space closed up, quotes unified, subscript marks and full stops removed."""
    import re

    quotes = {ord(c): "'" for c in "‘’‚`´"} | {ord(c): '"' for c in "“”„«»"}

    def form(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", re.sub(r"~([^~]*)~", r"\1", t)).casefold().translate(quotes)
        return " ".join(t.replace(".", "").split())

    return text.map(form)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b) + 1e-12)
