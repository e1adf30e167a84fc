"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size; shards take turns, each
claiming the first slot of its order that is still free, until none is. The table's size is a parameter
(a few thousand small integers), so it is broadcast as a literal, and a row's shard is one array access:
no shuffle, and adding or losing a shard moves few rows.

Cases with a defined result: a null key is placed as the key "null"; repeated rows go to one shard; an
empty table gives an empty result; further columns pass through untouched, and a column of the new
column's name is refused.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_names

SHARDS, SLOTS = 64, 8191


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For every slot, the index of its shard. ``slots`` must be prime and no fewer than the shards."""
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each differently")
    marks = [int.from_bytes(hashlib.md5(s.encode()).digest(), "big") for s in shards]
    at = [m % slots for m in marks]
    skip = [(m >> 64) % (slots - 1) + 1 for m in marks]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A row's slot: 60 bits of its key's MD5, modulo the number of slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str | Column = "doc_id", shards: list[str] | None = None, slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """The rows with all their columns and one more: the shard's index."""
    refuse_names(rows, name)
    shards = shards or [f"shard-{i:05d}" for i in range(SHARDS)]
    # One folded constant: the table as text, split once when the plan is made.
    table = F.split(F.lit(",".join(map(str, lookup(shards, slots)))), ",").cast("array<int>")
    key = F.col(key) if isinstance(key, str) else key
    return rows.withColumn(name, F.element_at(table, slot(key, slots) + 1))


def sql(table: str = "documents", shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The placement in DuckDB SQL over the same filled table."""
    filled = ", ".join(map(str, lookup([f"shard-{i:05d}" for i in range(shards)], slots)))
    spot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {slots})"
    return f"WITH t AS (SELECT [{filled}] AS filled) SELECT doc_id, {spot}::INTEGER AS slot, filled[{spot} + 1]::INTEGER AS shard, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM {table}, t"
