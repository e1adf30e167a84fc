"""Deterministic ids and content hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, NUL, DOMAIN = "\x1f", "\x00", "millrace/document/1\n"


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def uuid_shape(hex_digest: Column) -> Column:
    """The first 32 hex digits, printed as a UUID."""
    return F.concat_ws("-", *(F.substring(hex_digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunk_id(source_id: Column, split_sequence: Column, ordinal: Column, content_hash: Column) -> Column:
    return uuid_shape(F.sha2(F.concat_ws(UNIT, *map(_text, (source_id, split_sequence, ordinal, content_hash))), 256))


def mention_id(source_id: Column, content_hash: Column, ordinal: Column, payload_json: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, *map(_text, (source_id, content_hash, ordinal, payload_json))), 256)


def entity_id(member_ids: Column) -> Column:
    """The hash of the sorted member ids."""
    return F.sha2(F.array_join(F.array_sort(member_ids), NUL), 256)


def source_of(source_id: Column, source_path: Column, own_id: Column) -> Column:
    """The first of source id, path and id that isn't blank."""
    return F.coalesce(F.nullif(source_id, F.lit("")), F.nullif(source_path, F.lit("")), own_id)


def token_of(stored: Column) -> Column:
    """A stored change token; blank means none, which always counts as changed."""
    return F.nullif(stored, F.lit(""))


def content_hash(title: Column, elements: Column) -> Column:
    """SHA-256 over the canonical JSON of title and ordered elements.

    ``elements``: array of structs whose fields are in alphabetical order. Keys are sorted, nothing is
    spaced, nulls are printed.
    """
    options = {"ignoreNullFields": "false"}
    head = F.coalesce(F.get(F.split(F.to_json(F.struct(title.alias("t")), options), '^\\{"t":', 2), F.lit(1)), F.lit("null}"))
    return F.sha2(F.concat(F.lit(DOMAIN), F.lit('{"elements":'), F.to_json(elements, options), F.lit(',"title":'), head), 256)
