"""Mentions to entities: exact seeds, blocking by cosine, review, merging, canonical form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.ids import entity_id, mention_id
from .components import components, join_roots

#: Most vectors of a block; vectors of a tile, whose products stay in the cache; pairs that a task holds before it sifts or sends them.
BLOCK, TILE, HELD = 1 << 15, (512, 1024), 1 << 20


def finalise_mentions(mentions: DataFrame, source: str = "source_id") -> DataFrame:
    """Ordinals run over a source's mentions by split and place; ids are minted from them."""
    order = Window.partitionBy(source).orderBy("split", "place")
    numbered = mentions.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
    return numbered.withColumn("mention_id", mention_id(F.col(source), F.col("content_hash"), F.col("ordinal"), F.col("payload")))


def identity_text(fields: dict[str, Column]) -> Column:
    """Lines of ``key: value``; nulls are skipped."""
    return F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()))


def seeds(mentions: DataFrame, text: str = "identity") -> DataFrame:
    """Adds ``seed``: mentions of the same trimmed, lower-cased identity."""
    return mentions.withColumn("seed", F.lower(F.trim(F.col(text))))


def _packed(group: pa.Table) -> pa.Table:
    """The vectors of one cell as a row."""
    v = group["v"].combine_chunks()
    if len(pc.unique(pc.list_value_length(v))) > 1:
        raise ValueError("the vectors differ in length")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return pa.table({"cell": group["cell"][:1], "ids": pa.array([group["id"].to_numpy().tobytes()], pa.binary()), "v": pa.array([flat.tobytes()], pa.binary())})


def _block_pairs(vectors: DataFrame, run: Callable, schema: str, own: str, vector: str, block: int) -> DataFrame:
    """``run`` over every pair of blocks of vectors, a block with itself included: it gets ``ids, v`` of the first and of
    the second block (None for a block with itself) and yields record batches. Every pair is a task's group and moves
    as two rows, so memory is bounded by the block; blocks are of ``block`` vectors at most, 16 MB of doubles at most."""
    n, width = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    most = min(block, max(BLOCK // 32, (16 << 20) // (8 * max(1, width or 1))))
    busy = math.ceil(math.sqrt(4 * vectors.sparkSession.sparkContext.defaultParallelism))
    cells = max(1, -(-n // most), min(busy, n // (BLOCK // 32)))
    kind = "float" if vectors.schema[vector].dataType == ArrayType(FloatType()) else "double"
    rows = vectors.where(F.col(vector).isNotNull() & F.col(own).isNotNull()).select(F.col(own).cast("long").alias("id"), F.pmod(F.xxhash64(own), F.lit(cells)).cast("int").alias("cell"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    blocks = rows.groupBy("cell").applyInArrow(_packed, "cell int, ids binary, v binary")
    met = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("other")).select(F.least("cell", "other").alias("r"), F.greatest("cell", "other").alias("c"), "cell", "ids", "v")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        sides = []
        for k in np.argsort(table["cell"].to_numpy()):
            ids = np.frombuffer(table["ids"][int(k)].as_py(), np.int64)
            sides.append((ids, np.frombuffer(table["v"][int(k)].as_py(), np.float32 if kind == "float" else float).reshape(len(ids), -1)))
        alone = table["r"][0].as_py() == table["c"][0].as_py()
        if alone or len(sides) == 2:  # else the other cell is empty
            yield from run(sides[0], None if alone else sides[1])

    group.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return met.repartition(cells * (cells + 1), "r", "c").groupBy("r", "c").applyInArrow(group, schema)


def _tiles(a: np.ndarray, b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places ``i, j`` and cosine of all pairs of at least ``least``, tile by tile; without ``b``, of ``a`` with itself, ``i < j``.
    Products in single precision sift, at a bound below ``least`` by more than their rounding; doubles decide."""
    same, b = b is None, a if b is None else b
    if a.shape[1] != b.shape[1]:
        raise ValueError("the vectors differ in length")
    squares = [np.einsum("ij,ij->i", x, x, dtype=float) for x in (a, b)]
    ua, ub = ((x / np.sqrt(np.where(q > 0, q, 1))[:, None]).astype(np.float32) for x, q in zip((a, b), squares))
    bound = np.float32(least - (a.shape[1] + 16) * 2.0**-23)
    few = max(64, (2 << 20) // max(1, a.shape[1]))
    for x in range(0, len(a), TILE[0]):
        for y in range(x // TILE[1] * TILE[1] if same else 0, len(b), TILE[1]):
            hit = ua[x : x + TILE[0]] @ ub[y : y + TILE[1]].T >= bound
            flat = hit.ravel()
            whole = flat.size // 8 * 8
            at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # eight at a time: few are set
            at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
            i, j = np.divmod(at, hit.shape[1])
            i, j = i + x, j + y
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), few):
                p, q = i[k : k + few], j[k : k + few]
                under = np.sqrt(squares[0][p] * squares[1][q])
                cosine = np.einsum("ij,ij->i", a[p].astype(float), b[q].astype(float)) / np.where(under > 0, under, 1)
                ok = cosine >= least
                yield p[ok], q[ok], cosine[ok]


def _best(own: np.ndarray, near: np.ndarray, cosine: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best rows of every id, ties by the other id."""
    order = np.lexsort((near, -cosine, own))
    begins = np.diff(own[order], prepend=own[order[:1]] - 1) != 0
    places = np.arange(len(order))
    keep = order[places - np.maximum.accumulate(np.where(begins, places, 0)) < most]
    return own[keep], near[keep], cosine[keep]


def near_pairs(vectors: DataFrame, least: float = 0.9, most: int | None = 5, own: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``id, near_id, cosine, rank``: each vector's neighbours of cosine at least ``least``, the best ``most``
    of them (all for None), ties by id. Exact: the vectors are cut into blocks, every pair of blocks is compared once, in
    matrix products, and only pairs above the threshold leave it, at most ``most`` of an id."""

    def run(one: tuple, other: tuple | None) -> Iterator[pa.RecordBatch]:
        ia, ib = one[0], (other or one)[0]
        held, size, limit = [], 0, HELD

        def batch(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["id", "near_id", "cosine"])

        for i, j, cosine in _tiles(one[1], other and other[1], least):
            ok = ia[i] != ib[j]
            p, q, cosine = ia[i[ok]], ib[j[ok]], np.trunc(cosine[ok] * 1e6 + np.copysign(0.5, cosine[ok])) / 1e6 + 0.0
            held.append((np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([cosine, cosine])))
            size += 2 * len(p)
            if size >= limit:
                rows = tuple(map(np.concatenate, zip(*held)))
                if most is None:
                    yield batch(rows)
                    held, size = [], 0
                else:
                    held = [_best(*rows, most)]
                    size = len(held[0][0])
                    limit = max(HELD, 2 * size)
        if size:
            rows = tuple(map(np.concatenate, zip(*held)))
            yield batch(rows if most is None else _best(*rows, most))

    pairs = _block_pairs(vectors, run, "id long, near_id long, cosine double", own, vector, block)
    if most is None:
        return pairs
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "near_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def near_links(vectors: DataFrame, least: float = 0.9, own: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``u, v``: links with the same components as all of ``near_pairs``, but of every pair of blocks no more than it has vectors."""

    def run(one: tuple, other: tuple | None) -> Iterator[pa.RecordBatch]:
        n = len(one[0])
        ids = one[0] if other is None else np.concatenate([one[0], other[0]])
        root = np.arange(len(ids))
        for i, j, _ in _tiles(one[1], other and other[1], least):
            join_roots(root, i, j if other is None else j + n)
        linked = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["u", "v"])

    return _block_pairs(vectors, run, "u long, v long", own, vector, block)


def canonical(members: DataFrame, cluster: str, mention: str = "mention_id", identity: str = "identity", source: str = "source_id") -> DataFrame:
    """One row per cluster: the payload of the least identity, sorted aliases, members and sources, and the id."""
    ids = F.array_sort(F.collect_set(mention))
    return members.groupBy(cluster).agg(entity_id(ids).alias("entity_id"), F.min(identity).alias("canonical"), F.array_join(F.array_sort(F.collect_set(identity)), " | ").alias("aliases"), F.size(ids).alias("n_members"), F.array_join(F.array_sort(F.collect_set(F.col(source).cast("string"))), " | ").alias("sources"))


@dataclass
class Resolution:
    entities: DataFrame
    pending: DataFrame
    rounds: int


def resolve(clusters: DataFrame, embed: Column | Callable, review: Callable[[DataFrame], DataFrame], least: float = 0.9, most: int = 5, rounds: int = 3) -> Resolution:
    """``cluster, identity`` → merged clusters. Each round embeds the representatives, takes near pairs,
    lets ``review`` mark pairs (``id, near_id, cosine`` → also ``merge`` boolean, ``pending`` boolean), merges
    components, and represents each by its members' sorted texts. Ends when a round merges nothing."""
    from ..plans.tables import write_table

    now, _ = write_table(clusters.select(F.col("cluster").cast("long").alias("cluster"), F.col("cluster").cast("long").alias("root"), "identity"), "clusters")
    pending, done = None, 0
    for done in range(1, rounds + 1):
        texts = now.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("identity")), " | ").alias("text"))
        vectors = texts.select(F.col("root").alias("vec_id"), (embed(F.col("text")) if callable(embed) else embed).alias("embedding"))
        judged, _ = write_table(review(near_pairs(vectors, least, most)), "judged")
        pending = judged.where("pending").select("id", "near_id", "cosine")
        merged = judged.where("merge").select(F.col("id").alias("u"), F.col("near_id").alias("v"))
        if merged.isEmpty():
            break
        roots = components(merged)
        now, _ = write_table(now.join(roots.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("cluster", F.coalesce("new", "root").alias("root"), "identity"), "clusters")
    return Resolution(now, pending, done)
