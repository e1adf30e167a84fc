"""Near copies by the exact Jaccard similarity of word shingles, found by SimHash and the trie join.

Texts of the same shingle set are one node, with a SimHash fingerprint of ``PARTS`` parts of ``PART_BITS`` bits. Each
part is joined with itself by the binary trie of ``simhash``; nodes that differ in at most ``BUDGET`` bits of one
part, and in at most ``CHECK_MOST`` of the ``CHECK`` bits that go along, are candidates. Two sets of similarity 0.8 differ in
15 % of the bits: by the binomial law they are missed with a chance of 7 in a million (2 in a thousand for sets of four and
five shingles, which differ in 19 %), more similar ones more seldom. Every candidate is decided by its whole sets: first each node
is compared with its candidate that has most candidates, then the pairs that these links leave in different
components, so that a large cluster of copies costs few comparisons.

Cases with a defined result: a null text counts as empty, and empty texts are copies of each other; a
text of fewer words than a shingle is one shingle; a null doc_id keeps its row, and its component_id is
the smallest doc_id that is not null in its component (null if none is); repeated rows stay; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, free_name, shuffle_partitions, write_table
from .components import components
from .simhash import SEED, shingle_hashes, trie_links

WORDS = 5
#: Least similarity as a fraction, so that the comparison is one of integers.
LEAST = (4, 5)
#: The fingerprint: its parts, their bits, and how many of these may differ.
PARTS, PART_BITS, BUDGET = 40, 24, 2
#: Bits of the fingerprint that go along with each part, and how many of these may differ.
CHECK, CHECK_MOST = 128, 40
#: Nodes in a block of the trie join, and pairs that are expanded at a time.
BLOCK, _PAIRS = 1 << 18, 1 << 20
_SLICE = 128
_WORDS = PARTS * PART_BITS // 64
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, _WORDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, words))


def wide_simhash(found: np.ndarray) -> bytes | None:
    """The fingerprint: a bit is 1 if it is set in over half the hashes, from each of which ``_WORDS`` are made;
    the empty set has none."""
    if not len(found):
        return None
    total = np.zeros(_WORDS * 64, np.int64)
    for i in range(0, len(found), 255):
        x = found[i : i + 255, None] * _TIMES + _PLUS
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _MIX
        x ^= x >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(found)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether the sets' intersection is at least that fraction of their union."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * least[1] >= least[0] * (len(a) + len(b) - shared)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets take more room than their texts: a few rows are worked on at a time."""
    for b in batches:
        for i in range(0, b.num_rows, _SLICE):
            yield b.slice(i, _SLICE)


def text_hash() -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def marked_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, text_hash, node, n, fp, hashes)``: the set's own hash, its size, fingerprint and bytes."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array([wide_simhash(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, fp binary, hashes binary")


def linked_rows(keys: np.ndarray, checks: np.ndarray, n: np.ndarray, other: tuple | None, least: tuple[int, int] = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one part's block, or of two blocks: the trie links their distinct keys, whose rows are then compared
    by check bits and sizes, a bounded number at a time."""
    own = other is None
    sides = []
    for k, c, m in ((keys, checks, n), (keys, checks, n) if own else other):
        order = np.argsort(k, kind="stable")
        values, starts, counts = np.unique(k[order], return_index=True, return_counts=True)
        sides.append((order, values, starts, counts, c, m))
    (order_a, a, start_a, count_a, check_a, n_a), (order_b, b, start_b, count_b, check_b, n_b) = sides
    i, j = trie_links(a, None if own else b, BUDGET)
    if own:  # rows of one key are linked by it
        same = np.flatnonzero(count_a > 1)
        i, j = np.concatenate([i, same]), np.concatenate([j, same])
    # Each row of the left key meets all rows of the right one.
    left = count_a[i]
    row = np.repeat(start_a[i], left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    lo, wide, equal = np.repeat(start_b[j], left), np.repeat(count_b[j], left), np.repeat((i == j) & own, left)
    ends = np.cumsum(wide)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        w = wide[at:to]
        x = np.repeat(row[at:to], w)
        y = np.repeat(lo[at:to], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        ok = ~np.repeat(equal[at:to], w) | (x < y)
        x, y = order_a[x[ok]], order_b[y[ok]]
        ok = np.minimum(n_a[x], n_b[y]) * least[1] >= np.maximum(n_a[x], n_b[y]) * least[0]
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(check_a[x] ^ check_b[y]).sum(axis=1) <= CHECK_MOST
        yield x[ok], y[ok]
        at = to


def candidates(nodes: DataFrame, count: int, least: tuple[int, int] = LEAST, block: int = BLOCK) -> DataFrame:
    """The pairs ``(u, v)`` of ``(node, n, fp)``, ``count`` rows of distinct nodes, that the trie joins of the parts link.

    A part's keys are cut by their first bits into blocks; blocks whose prefixes differ in more than ``BUDGET`` bits never meet."""
    k = min(PART_BITS, max(0, int(np.ceil(np.log2(max(1, count / block))))))
    masks = np.array([sum(1 << i for i in bits) for size in range(min(BUDGET, k) + 1) for bits in combinations(range(k), size)], np.int64)
    places = 1 << np.arange(PART_BITS - 1, -1, -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            keys = (np.unpackbits(fps, axis=1).reshape(b.num_rows, PARTS, PART_BITS) @ places).astype(np.int64)
            words = np.ascontiguousarray(fps).view(np.int64)
            node, n = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for part in range(PARTS):
                # The check bits lie elsewhere in the fingerprint than the part.
                first = (part * PART_BITS // 64 + 2) % _WORDS
                check = words[:, [(first + c) % _WORDS for c in range(CHECK // 64)]]
                mine = keys[:, part] >> (PART_BITS - k)
                for m in masks:
                    columns = [np.full(b.num_rows, part), np.minimum(mine, mine ^ m), np.maximum(mine, mine ^ m), keys[:, part], *check.T, node, n]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

    def join(group: pa.Table) -> pa.Table:
        part, low, high, key, *check, node, n = (group.column(c).to_numpy() for c in names)
        check = np.stack(check, axis=1).view(np.uint64)
        top = key.astype(np.uint64) << np.uint64(64 - PART_BITS)
        if low[0] == high[0]:
            made = linked_rows(top, check, n, None, least)
            found = [(node[x], node[y]) for x, y in made]
        else:
            left = (key >> (PART_BITS - k)) == low
            made = linked_rows(top[left], check[left], n[left], (top[~left], check[~left], n[~left]), least)
            found = [(node[left][x], node[~left][y]) for x, y in made]
        u, v = (np.concatenate([f[s] for f in found]) if found else np.empty(0, np.int64) for s in (0, 1))
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    names = ["part", "low", "high", "key", *(f"check{c}" for c in range(CHECK // 64)), "node", "n"]
    rows = nodes.select("node", "n", "fp").where("n > 0").mapInArrow(spread, ", ".join(f"{c} long" for c in names))
    # A group is much work in few bytes: the number of tasks is set here, not by the bytes shuffled.
    on = ["part", "low", "high"]
    return rows.repartition(max(4 * PARTS, shuffle_partitions(nodes.sparkSession)), *on).groupBy(*on).applyInArrow(join, "u long, v long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs ``(u, v)`` of nodes whose sets, ``(node, hashes)``, are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            a, b = (batch.column(i) for i in (2, 3))
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(a, b)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u")
    full = first.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: ``doc_id, text_hash, component_id, stays``; of each component the row of the smallest
    doc_id stays, of that id's different texts the one of the smallest hash (of equal rows, every one)."""
    marked, marked_path = write_table(marked_sets(docs, words), "sets")
    lowest_row = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    firsts, firsts_path = write_table(marked.groupBy("node").agg(lowest_row.alias("first"), F.max("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    pairs, pairs_path = write_table(candidates(firsts, firsts.count(), least), "pairs")
    # A node's hub is that of its candidates which has most: the text that the others were made from.
    both = pairs.union(pairs.select("v", "u"))
    met = both.groupBy("u").agg(F.count("*").alias("met"))
    hubs = both.join(met.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.max(F.struct("met", "v")).alias("hub"))
    stars, stars_path = write_table(hubs.select(F.greatest("u", "hub.v").alias("u"), F.least("u", "hub.v").alias("v")).distinct(), "stars")
    # One set a candidate moves, not the sets of all rows. Equal sets have equal bytes: any row of a node will do.
    # Whether the candidates' ids are broadcast or shuffled is left to their size on disk.
    asked, asked_path = write_table(met.select(F.col("u").alias("node")), "ids")
    sets, sets_path = write_table(marked.select("node", "hashes").join(asked, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "asked")
    links, links_path = write_table(verified(stars, sets, least), "verified")
    found, found_path = write_table(components(links), "named")
    root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    rest, rest_path = write_table(apart.select("u", "v").join(stars, ["u", "v"], "left_anti"), "rest")
    more, more_path = write_table(verified(rest, sets, least), "verified")
    roots = components(links.union(more))
    linked = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    named = linked.join(lowest, "root").select("node", "lowest")
    stays = (F.col("doc_id") == F.col("lowest.doc_id")) & (F.col("text_hash") == F.col("lowest.text_hash"))
    out, _ = write_table(marked.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "text_hash", F.col("lowest.doc_id").alias("component_id"), F.coalesce(stays, F.lit(False)).alias("stays")), "copies")
    for path in (marked_path, firsts_path, pairs_path, stars_path, asked_path, sets_path, links_path, found_path, rest_path, more_path):
        drop_path(docs.sparkSession, path)
    return out


def first_copies(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of which one of each component stays (see ``near_copies``), with all their columns. Rows without an
    id stay; of rows that repeat the chosen id and text, the first by their other columns stays."""
    decided = near_copies(docs, words, least).where("doc_id is not null")
    gone = decided.where("not stays").select("doc_id", "text_hash").distinct()
    id_name, hash_name = free_name(docs, "__id"), free_name(docs, "__hash")
    marked = docs.withColumns({id_name: F.col("doc_id").cast("long"), hash_name: text_hash()})
    on = lambda some: [F.col(id_name) == some["doc_id"], F.col(hash_name) == some["text_hash"]]
    kept = marked.join(gone, on(gone), "left_anti")
    # Only texts that repeat under one id are looked at again, by their few rows.
    twice = decided.where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = kept.join(twice, on(twice), "left_semi").groupBy(id_name, hash_name).agg(F.min(F.struct(*others, "doc_id", "text")).alias("r"))
    return kept.join(twice, on(twice), "left_anti").select(*docs.columns).unionByName(again.select("r.*").select(*docs.columns))
