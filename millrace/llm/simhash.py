"""SimHash near-duplicates: 64-bit fingerprints linked by a binary-trie self-join.

The distinct fingerprints are sorted across the cluster and cut into blocks, which are ranges inside
one trie node of depth k. Block pairs whose node prefixes already differ in more than the allowed
bits are never made; every other pair is one task, which walks both sub-tries together, adds up the
differing bits on the way down and drops a pair of nodes once it exceeds the budget.

Cases with a defined result: a null text counts as empty and has fingerprint zero; a null doc_id keeps
its row, and its component_id is the smallest doc_id that is not null among those it reaches (null if
none is); repeated rows stay, each with its component; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_partitions, write_table
from .components import components

SEED = 42
#: Fingerprints in a block: 8 bytes each, so that a block pair is a quarter of a megabyte.
BLOCK = 16384
_FRONTIER = 400_000
_TOP = np.uint64(1 << 63)


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """Unsigned XXH64 of each word shingle, repeats included; A-Z is lower-cased, words end at ASCII white space."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(w) - words + 1)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned int; a bit is 1 if set in over half of the shingle hashes."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i : i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp being the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted, distinct unsigned arrays whose values differ in at most ``budget`` bits.

    ``b`` None joins ``a`` with itself, each pair once and no value with itself. The frontier of node
    pairs is cut into pieces, so memory follows the piece and not the number of pairs alive.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def ones(x: np.ndarray, depth: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum((x >> np.uint64(63 - depth)) & np.uint64(1)))).astype(np.int64)

    counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found_a, found_b = [], []
    stack = [(0, np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64))]
    while stack:
        depth, f = stack.pop()
        if f.shape[1] > _FRONTIER:
            half = f.shape[1] // 2
            stack += [(depth, f[:, :half]), (depth, f[:, half:])]
            continue
        sizes = (f[1] - f[0]) * (f[3] - f[2])
        small = (sizes <= 16) | (depth == 64)
        if small.any():
            g = f[:, small]
            n, wide = sizes[small], (g[3] - g[2])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ia = np.repeat(g[0], n) + at // np.repeat(wide, n)
            ib = np.repeat(g[2], n) + at % np.repeat(wide, n)
            ok = np.bitwise_count(a[ia] ^ b[ib]) <= budget
            if own:
                ok &= ia < ib
            found_a.append(ia[ok])
            found_b.append(ib[ok])
            f = f[:, ~small]
        if not f.shape[1]:
            continue
        if depth not in counted:
            ca = ones(a, depth)
            counted[depth] = (ca, ca if own else ones(b, depth))
        ca, cb = counted[depth]
        am, bm = f[1] - (ca[f[1]] - ca[f[0]]), f[3] - (cb[f[3]] - cb[f[2]])
        cross = f[4] + 1
        parts = [np.stack([f[0], am, f[2], bm, f[4]]), np.stack([am, f[1], bm, f[3], f[4]]), np.stack([f[0], am, bm, f[3], cross])]
        other = np.stack([am, f[1], f[2], bm, cross])
        parts.append(other[:, f[0] != f[2]] if own else other)
        f = np.concatenate(parts, axis=1)
        stack.append((depth + 1, f[:, (f[0] < f[1]) & (f[2] < f[3]) & (f[4] <= budget)]))
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _blocks(sorted_fps: DataFrame, k: int, block: int) -> DataFrame:
    """Ranges of the sorted fingerprints, cut where the k-bit prefix changes or a block is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def cut(x: np.ndarray) -> pa.RecordBatch:
            lo, hi = int(x[0]), int(x[-1])
            same = 64 - (lo ^ hi).bit_length()
            mask = ((1 << 64) - 1) ^ ((1 << (64 - same)) - 1)
            signed = np.array([lo, hi, mask], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lo >> (64 - k) if k else 0], pa.int64()), pa.array(signed[:1]), pa.array(signed[2:]), pa.array([x.tobytes()], pa.binary())], ["prefix", "lo", "mask", "data"])

        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _TOP
            if held:
                x = np.concatenate([*held, x])
            starts = np.flatnonzero(np.diff(x >> np.uint64(64 - k))) + 1 if k and len(x) > 1 else np.empty(0, np.int64)
            pieces = np.split(x, starts)
            for p in pieces[:-1]:
                for i in range(0, len(p), block):
                    yield cut(p[i : i + block])
            last = pieces[-1]
            while len(last) > block:
                yield cut(last[:block])
                last = last[block:]
            held = [last] if len(last) else []
        if held:
            yield cut(held[0])

    return sorted_fps.mapInArrow(run, "prefix long, lo long, mask long, data binary")


def fingerprint_links(fps: DataFrame, n: int, budget: int = 2, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints of at most ``budget`` differing bits.

    ``fps``: one column ``fp``, distinct; ``n``: its row count, which sets the depth of the blocks.
    """
    spark = fps.sparkSession
    k = min(24, max(0, int(np.ceil(np.log2(max(1, n / block))))))
    parts = max(1, min(shuffle_partitions(spark), -(-n // block)))
    # Flipping the top bit makes Spark's signed order the trie's unsigned order.
    flipped = fps.select(F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("fp"))
    blocks, _ = write_table(_blocks(flipped.repartitionByRange(parts, "fp").sortWithinPartitions("fp"), k, block), "blocks")
    masks = [sum(1 << i for i in bits) for size in range(min(budget, k) + 1) for bits in combinations(range(k), size)]
    meta = blocks.select("prefix", "lo", "mask")
    left = meta.select(F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: m.cast("long").bitwiseXOR(F.col("prefix")))).alias("p"), F.col("lo").alias("lo1"), F.col("mask").alias("mask1"))
    right = meta.select(F.col("prefix").alias("p"), F.col("lo").alias("lo2"), F.col("mask").alias("mask2"))
    least = F.bit_count(F.col("lo1").bitwiseXOR(F.col("lo2")).bitwiseAND(F.col("mask1")).bitwiseAND(F.col("mask2")))
    pairs = left.join(right, "p").where((F.col("lo1") <= F.col("lo2")) & (least <= budget)).select("lo1", "lo2")
    full = pairs.join(blocks.select(F.col("lo").alias("lo1"), F.col("data").alias("a")), "lo1").join(blocks.select(F.col("lo").alias("lo2"), F.col("data").alias("b")), "lo2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, a, b in zip(*(batch.column(i) for i in range(4))):
                a = np.frombuffer(a.as_buffer(), np.uint64)
                b = None if x.as_py() == y.as_py() else np.frombuffer(b.as_buffer(), np.uint64)
                i, j = trie_links(a, b, budget)
                u, v = a[i].view(np.int64), (a if b is None else b)[j].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    # A pair is much work in few bytes: the number of tasks is set here, not by the bytes shuffled.
    return full.select("lo1", "lo2", "a", "b").repartition(2 * shuffle_partitions(spark)).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    marked, _ = write_table(fingerprints(docs, words, id_col, text_col), "fingerprints")
    firsts, _ = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(fingerprint_links(firsts.select("fp"), firsts.count(), budget))
    linked = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
