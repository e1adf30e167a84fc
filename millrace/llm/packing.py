"""Best-fit packing of tokenized documents into fixed-length sequences, by exact complements.

Only a histogram of piece lengths (one count per length up to the capacity) is planned on the driver;
it never grows with the data. The plan fills each gap exactly with one, two or three lengths that are
still available and, where no such combination exists, best-fits the longest piece that goes in and
looks again. Pieces find their places by rank within their length, which tasks count for themselves,
so no length, however common, is gathered in one task.

Cases with a defined result: a null or empty text is one piece, holding the closing id alone; repeated
rows are packed each for itself; a null doc_id stays null; an empty table gives no pieces; columns
beyond the id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, write_table

CAPACITY, CLOSING_ID = 2048, 0
#: Characters whose classes are the same in every Unicode version and in ``re``; other texts go to the tokenizer whole.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e¡-±´-¸º»¿-ɏ‐-‧‰-›€]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")
_CACHE_SIZE, _STRETCH = 1_000_000, 1 << 19
#: Longest pieces in bytes that are merged together; longer ones go to the tokenizer.
_WIDTHS = (8, 16, 32)
#: Texts of an Arrow batch that are encoded together.
_TOGETHER = 200
_held: dict = {}


class _Merges:
    """The merges of a byte-level BPE, for many short pieces at once: in every step each piece joins its
    pair of the lowest rank, the leftmost of equal ones, until it has none."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pad = max(vocab.values()) + 1
        keys = np.array([vocab[a] * (self.pad + 1) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("a pair has two ranks")
        # Bytes that are no printable characters stand as characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = sorted(set(range(256)).difference(printable))
        self.first = np.array([vocab[chr(b if b in printable else 256 + others.index(b))] for b in range(256)], np.int32)

    @staticmethod
    def of(made: dict) -> _Merges | None:
        """For a tokenizer file whose model is nothing but ranked merges of bytes, else nothing."""
        model = made["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or not model["merges"] or any(model.get(k) for k in odd):
            return None
        try:
            return _Merges(model)
        except (KeyError, ValueError):
            return None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.pad + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def encode(self, raw: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of at most ``width`` bytes."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        places = np.arange(width + 1)
        ids = np.full((len(raw), width + 1), self.pad, np.int32)
        ids[places < size[:, None]] = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        left, now = np.arange(len(raw)), ids.copy()
        rank = self._ranks(now[:, :-1], now[:, 1:])
        while len(left):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(left)), at]
            more = best < self.NONE
            if not more.all():
                ids[left[~more]] = now[~more]
                left, now, rank, at, best = left[more], now[more], rank[more], at[more], best[more]
            row, behind = np.arange(len(left)), places[:-1] > at[:, None]
            now[:, :-1] = np.where(behind, now[:, 1:], now[:, :-1])
            now[row, at] = self.made[best]
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self.NONE
            rank[row, at] = self._ranks(now[row, at], now[row, at + 1])
            row, at = row[at > 0], at[at > 0]
            rank[row, at - 1] = self._ranks(now[row, at - 1], now[row, at])
        held, step = ids.astype("<u4").tobytes(), 4 * (width + 1)
        return [held[i : i + 4 * n] for i, n in zip(range(0, len(held), step), (ids != self.pad).sum(axis=1).tolist())]


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    A byte-level BPE works inside the pieces of a fixed regular expression, so pieces seen before come
    from a cache of bounded size. Texts with characters outside ``_PLAIN``, or with a special token's
    string, and tokenizers of another make, are encoded by the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"] or {}
        self.by_piece = made["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.merges = _Merges.of(made) if self.by_piece else None
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces into the cache."""
        if self.merges:
            raw = [p.encode() for p in pieces]
            size = np.fromiter(map(len, raw), np.int64, len(raw))
            for low, width in zip((0, *_WIDTHS), _WIDTHS):
                some = np.flatnonzero((size > low) & (size <= width)).tolist()
                self.cache.update(zip([pieces[i] for i in some], self.merges.encode([raw[i] for i in some], width)))
            pieces = [pieces[i] for i in np.flatnonzero(size > _WIDTHS[-1]).tolist()]
        for p, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.cache[p] = array("I", e.ids).tobytes()

    def _stretches(self, texts: list[str]) -> list[bytes]:
        lists = [_SPLIT.findall(t) for t in texts]
        pieces = set().union(*lists)
        missing = pieces.difference(self.cache)
        if len(self.cache) + len(missing) > _CACHE_SIZE:
            self.cache.clear()
            missing = pieces
        self._learn(list(missing))
        return [b"".join(map(self.cache.__getitem__, x)) for x in lists]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Texts meet the cache together, up to a length of ``_STRETCH`` at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        length = 0

        def flush() -> None:
            for (i, _), ids in zip(held, self._stretches([t for _, t in held])):
                out[i].append(ids)
            held.clear()

        for i, text in enumerate(texts):
            if not self.by_piece or any(s in text for s in self.special) or not _PLAIN.fullmatch(text):
                out[i].append(self._whole(text))
                continue
            at = 0
            while at < len(text):
                cut = _CUT.search(text, at + _STRETCH // 2) if len(text) - at > _STRETCH else None
                end = cut.start() if cut else len(text)
                if length + end - at > _STRETCH:
                    flush()
                    length = 0
                held.append((i, text[at:end]))
                length += end - at
                at = end
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each Python worker."""
    if path not in _held:
        _held.clear()
        _held[path] = Encoder(path)
    return _held[path]


def _encoded(enc: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Each text's ids, a null's as the empty text's; only a few texts are held at once."""
    for i in range(0, len(texts), _TOGETHER):
        yield from enc.encode_all([t or "" for t in texts.slice(i, _TOGETHER).to_pylist()])


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, part, nth`` and, if asked, ``ids``.

    A document is its ids and the closing id, cut into pieces of ``capacity`` of which the first may be
    shorter. ``nth`` counts the pieces of equal length within the writing task ``part``.
    """
    bound_batches(docs.sparkSession)
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            ids_out = []
            for doc, ids in zip(b.column(0).to_pylist(), _encoded(enc, b.column(1))):
                ids += closing
                n, at, k = len(ids) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    raw = ids[4 * at : 4 * (at + size)]
                    for c, v in zip(cols, (doc, k, at, size, zlib.crc32(raw), part, seen[size])):
                        c.append(v)
                    if with_ids:
                        ids_out.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays, names = [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class _Sums:
    """Which one, two or three available lengths sum exactly to a gap; longer ones are preferred."""

    def __init__(self, free: np.ndarray) -> None:
        self.free = free

    def one(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.free[gap] > 0 else ()

    def two(self, gap: int) -> tuple[int, ...]:
        has = self.free[: gap + 1] > 0
        both = has & has[::-1]
        both[: (gap + 1) // 2] = False
        if gap % 2 == 0 and self.free[gap // 2] < 2:
            both[gap // 2] = False
        a = np.flatnonzero(both)
        return (int(a[-1]), gap - int(a[-1])) if len(a) else ()

    def three(self, gap: int) -> tuple[int, ...]:
        has = (self.free[: gap + 1] > 0).astype(np.float32)
        sums = np.rint(np.fft.irfft(np.fft.rfft(has, 2 * gap + 2) ** 2, 2 * gap + 2))[: gap + 1]
        for a in np.flatnonzero((has > 0) & (sums[::-1] > 0))[::-1]:
            self.free[a] -= 1
            rest = self.two(gap - int(a)) if gap > a else ()
            self.free[a] += 1
            if rest:
                return (int(a), *rest)
        return ()

    def fill(self, gap: int) -> tuple[int, ...]:
        return self.one(gap) or self.two(gap) or self.three(gap)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that it makes, using up ``counts``
    (indexed by length, 0 unused). Every step uses up some length, so steps follow the capacity."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    out = []
    while counts.any():
        lead = int(np.flatnonzero(counts)[-1])
        chosen, free = [lead], counts.copy()
        free[lead] -= 1
        gap = capacity - lead
        while gap:
            rest = _Sums(free).fill(gap)
            if not rest:
                fits = np.flatnonzero(free[: gap + 1] > 0)
                if not len(fits):
                    break
                rest = (int(fits[-1]),)
            for r in rest:
                chosen.append(r)
                free[r] -= 1
                gap -= r
        lengths, times = np.unique(chosen, return_counts=True)
        n = int((counts[lengths] // times).min())
        counts[lengths] -= n * times
        out.append((tuple(sorted(chosen, reverse=True)), n))
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, sequence and offset of each run of ranks."""
    at: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((at.get(x, 0), sequence, offset))
            at[x] = at.get(x, 0) + n
            offset += x
        sequence += n
    return {x: tuple(np.array(r, np.int64).T) for x, r in runs.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    pieces, _ = write_table(tokenize(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "pieces")
    tallies, _ = write_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "tallies")
    counts = np.zeros(capacity + 1, np.int64)
    for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row for each length
        counts[r.length] = r.n
    places = _places(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tallies.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # The offsets grow with the tasks, so they aren't to be broadcast.
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("part", "nth", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                starts, sequences, offsets = places[int(x)]
                i = np.searchsorted(starts, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = sequences[i] + rank[mine] - starts[i], offsets[i]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed rows of ``pack(..., with_ids=True)`` as whole sequences: ``sequence_id, ids``.

    A group holds at most one sequence's ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
