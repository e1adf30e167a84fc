"""Winnowed fingerprints: rolling k-gram hashes, the least of each window, the rightmost of equal ones.

Any passage of at least ``window + k - 1`` code points that two texts share leaves a common hash in
both fingerprints, and the kept positions tell where. Texts are worked on in stretches, so a very long
one needs no more memory than its text.

Cases with a defined result: a null text counts as empty; an empty text has an empty fingerprint, and
two empty fingerprints are alike (1.0); a text shorter than k has one hash, of all of it; in the order
of documents null doc_ids come last and repeated doc_ids follow each other by text; a sole document is
its own successor; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shuffle_partitions

K, WINDOW = 16, 16
_BASE, _STRETCH, _POS = 0x9E3779B97F4A7C15, 1 << 20, 24
_LOW = np.uint64((1 << _POS) - 1)
_LAST, _SPREAD = -(1 << 63), 1 << 40


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes (40 bits) of all runs of k code points: a polynomial built by doubling, then mixed."""
    if not len(points):
        return np.empty(0, np.uint64)
    k = min(k, len(points))
    unit = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    unit ^= unit >> np.uint64(32)
    whole, size = None, 0
    h, step = unit, 1
    while True:
        if k & step:
            if whole is None:
                whole, size = h, step
            else:  # the part so far, then ``step`` more points
                n = len(points) - size - step + 1
                whole = whole[:n] * np.uint64(pow(_BASE, step, 1 << 64)) + h[size : size + n]
                size += step
        step *= 2
        if step > k:
            break
        half = step // 2
        h = h[:-half] * np.uint64(pow(_BASE, half, 1 << 64)) + h[half:]
    whole ^= whole >> np.uint64(33)
    whole *= np.uint64(0xFF51AFD7ED558CCD)
    return whole >> np.uint64(24)


def winnow(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and hashes of a text's fingerprint."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = max(1, len(points) - k + 1)
    wide = min(window, grams)
    kept, hashes = [], []
    for at in range(0, grams - wide + 1, _STRETCH):
        n = min(_STRETCH + wide - 1, grams - at)
        h = gram_hashes(points[at : at + n + k - 1], k)
        key = (h << np.uint64(_POS)) | (_LOW - np.arange(n, dtype=np.uint64))
        low, span = key, 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: n - wide + 1], low[wide - span :])
        p = (_LOW - (low & _LOW)).astype(np.int64)
        p = p[np.concatenate(([True], p[1:] != p[:-1]))]
        kept.append(p + at)
        hashes.append(h[p])
    pos, h = np.concatenate(kept), np.concatenate(hashes)
    first = np.concatenate(([True], pos[1:] != pos[:-1]))
    return pos[first], h[first]


def digest(pos: np.ndarray, h: np.ndarray) -> str:
    return f"{len(pos)}-{xxhash.xxh3_128_hexdigest(pos.tobytes() + h.tobytes())}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, positions, hashes, fingerprint``."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [winnow(t, k, window) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([h.astype(np.int64) for _, h in found], pa.list_(pa.int64())), pa.array([digest(*f) for f in found])],
                ["doc_id", "n_chars", "positions", "hashes", "fingerprint"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, positions array<long>, hashes array<long>, fingerprint string")


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, text, trailer`` in descending doc_id order, each partition followed by the head of the next.

    Texts are shuffled once. The cut points and heads, of which there are as many as partitions, are
    found from the ids alone.
    """
    # Rows without an id come last, in the order of their texts; five bytes of these spread them, so that they too can be cut.
    head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 5)), 10, "0"), 16, 10).cast("long")
    order = F.coalesce("doc_id", F.lit(_LAST + _SPREAD) - head)
    ids = docs.select(order.alias("id"))
    cuts = sorted({int(x) for x in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts)}, reverse=True) if parts > 1 else []
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)] or [[]]

    def place(col):  # how many cuts lie above the id: by group of 64, then inside the group
        if not cuts:
            return F.lit(0)
        longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        full = F.size(F.filter(longs([g[-1] for g in groups]), lambda c: c > col))
        inner = F.element_at(F.array(*map(longs, groups)), F.least(full + 1, F.lit(len(groups))))
        return F.least(full * 64 + F.size(F.filter(inner, lambda c: c > col)), F.lit(len(cuts))) if len(groups) > 1 else F.size(F.filter(inner, lambda c: c > col))

    heads = {r.part: r.head for r in ids.groupBy(place(F.col("id")).alias("part")).agg(F.max("id").alias("head")).collect()}
    live = sorted(heads)
    before = {p: live[i - 1] for i, p in enumerate(live)}  # the first one's head follows the last partition
    back = F.array(*(F.lit(before.get(p, 0)) for p in range(len(cuts) + 1)))
    rows = docs.select("doc_id", "text", order.alias("id")).withColumn("part", place(F.col("id")))
    own = F.struct(F.col("part").alias("to"), F.lit(0).alias("trailer"))
    copy = F.struct(F.element_at(back, F.col("part") + 1).alias("to"), F.lit(1).alias("trailer"))
    sent = F.when(F.col("id").isin(list(heads.values())), F.array(own, copy)).otherwise(F.array(own))
    spread = rows.select("doc_id", "text", "id", F.explode(sent).alias("s")).select("doc_id", "text", "id", "s.to", "s.trailer")
    return spread.repartitionById(len(cuts) + 1, F.col("to").cast("int")).sortWithinPartitions("trailer", F.desc("id"), "text").select("doc_id", "text", "trailer")


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document against its edited text (its last third replaced by the start of the next document's)
    and against the next document, in descending doc_id order."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for doc, text, trailer in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                pos, h = winnow(text, k, window)
                now = (doc, text, digest(pos, h), np.unique(h))
                if last is not None:
                    n = len(last[1])
                    edited = last[1][: n - n // 3] + text[: n // 3]
                    pos, h = winnow(edited, k, window)
                    out.append((last[0], n, hashlib.sha256(edited.encode()).hexdigest(), last[2], digest(pos, h), likeness(last[3], np.unique(h)), likeness(last[3], now[3])))
                last = None if trailer else now
                if trailer:
                    break
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    ordered = _in_order(docs, 2 * shuffle_partitions(docs.sparkSession))
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
