"""WARC archives: written once with revisit records, read back by boundary-chain verification.

Reading splits every archive into byte ranges. Each task emits candidate records of its range, with the
offset where each would end (its successor), and follows them to where they leave the range. Pointer
jumping from offset 0 over these exits, doubling its stride each round, keeps the candidates that a
reader starting at the head of the file would reach; whatever merely looks like a record inside a
payload is never reached. A second pass reads each range from its proven entry.

Cases with a defined result: null html is an empty payload; a row without page_id is kept, as a revisit
where an identified row has the same payload, else as a response; of repeated rows of the chosen
page_id, one is the response and the rest revisit it; a null url is left out of the record, and control
characters in one are percent-encoded; an empty table writes no archive and gives no records; further
columns are ignored. Of a damaged archive, the records before the damage are returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_path, new_folder, shuffle_partitions, write_table

FILE_BYTES, SPLIT_BYTES = 256 << 20, 16 << 20
_NO_ID = -(1 << 63)
SALTS = 16
_READ = 1 << 18
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08[\x00-\x1f]")
_WIDEST = 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, payload_digest: str | None = None) -> bytes:
    """One record: a response, or a revisit that keeps only the response's head."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {refers_to} {url}')}>"]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest or digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, compress: bool = True, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Write ``page_id, url, html`` rows; returns the table ``path, size`` of the archives and its path.

    Of equal payloads of at least ``min_bytes``, the largest page_id's is stored and the others revisit
    it. A file counts only once its task's row is committed, so retried tasks leave no doubles behind.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"), "url", text.alias("html"), F.sha1(text).alias("sha"))
    ids = rows.select("page_id", "sha", F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    best = ids.groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1")
    copied = ids.join(best, "sha").select("page_id", "sha", "best").distinct()
    # Both sides meet where they are placed, by id, payload and, for pages without an id, one of a few salts.
    keys, salts = ["page_id", "sha", "salt"], F.sequence(F.lit(0), F.lit(SALTS - 1))
    rows = rows.withColumn("salt", F.when(F.col("page_id") == _NO_ID, F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = copied.withColumn("salt", F.explode(F.when(F.col("page_id") == _NO_ID, salts).otherwise(F.array(F.lit(0)))))
    parts = shuffle_partitions(spark)
    placed = rows.repartition(parts, *keys).join(copied.repartition(parts, *keys), keys, "left").sortWithinPartitions("page_id", "sha", "url").select("page_id", "url", "html", "sha", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, last = None, "", 0, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "size"])

        for b in batches:
            for page, url, html, sha, best in zip(*(b.column(i) for i in range(5))):
                page, sha, best = page.as_py(), sha.as_py(), best.as_py()
                first = last != (page, sha)
                last = (page, sha)
                revisit = best is not None and best != _NO_ID and not (page == best and first)
                raw = record(None if page == _NO_ID else page, url.as_py(), html.as_py().encode(), best if revisit else None, base64.b32encode(bytes.fromhex(sha)).decode())
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=_READ)
                size += out.write(_gzip(raw) if compress else raw)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return write_table(placed.mapInArrow(run, "path string, size long"), "archives")


class _File:
    """Bytes of one archive by offset, read in pieces."""

    def __init__(self, path: str) -> None:
        fs, at = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def get(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""


def _plain(f: _File, at: int) -> tuple[int, bytes, int] | None:
    """End of the record that would begin at an offset, its header and the offset of its block."""
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0:
        more = f.get(at + len(head), 8192)
        if not more or len(head) > 1 << 20:
            return None
        head += more
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", head[: end + 2].lower())
    if not m:
        return None
    block = at + end + 4
    stop = block + int(m[1])
    return (stop + 4, head[:end], block) if stop + 4 <= f.size and f.get(stop, 4) == b"\r\n\r\n" else None


def _inflate(f: _File, at: int, keep: bool) -> tuple[int, bytes] | None:
    """End of the gzip member at an offset, and its content; None unless it is one whole record."""
    z, out, begin, pos = zlib.decompressobj(31), [], b"", at
    try:
        while not z.eof:
            raw = f.get(pos, _READ if begin else 4096)
            if not raw:
                return None
            got = z.decompress(raw)
            pos += len(raw)
            if len(begin) < 5:
                begin += got[:5]
                if not b"WARC/".startswith(begin[:5]):
                    return None
            if keep:
                out.append(got)
        return pos - len(z.unused_data), b"".join(out)
    except zlib.error:
        return None


def _candidates(f: _File, start: int, end: int) -> list[tuple[int, int]]:
    """Each offset in a range where a record may begin, with its successor."""
    found = []
    at = start
    while at < end:
        piece = f.get(at, min(1 << 22, end - at) + _WIDEST - 1)
        for m in _MAGIC.finditer(piece):
            p = at + m.start()
            if p < min(end, at + (1 << 22)):
                whole = _plain(f, p) if m[0][:1] == b"W" else _inflate(f, p, False)
                if whole:
                    found.append((p, whole[0]))
        at += 1 << 22
    return found


def _exits(found: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """Each candidate, with the first offset at or beyond the range's end that its chain comes to."""
    leave: dict[int, int] = {}
    for p, succ in reversed(found):
        to = succ if succ >= end else leave.get(succ)
        if to is not None:
            leave[p] = to
        else:
            leave[p] = -1 - succ  # the chain breaks inside the range: nothing lies beyond
    return list(leave.items())


def _fields(header: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in header.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _row(path: str, at: int, header: bytes, block: bytes, with_payload: bool) -> list:
    h = _fields(header)
    kind = h.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = h.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda x: int(x) if x is not None else None
    if kind == "response":
        n, real = len(payload), digest(payload)
    else:
        n, real = number(_fields(b"\r\n" + http.partition(b"\r\n")[0] + b"\r\n" + http.partition(b"\r\n")[2]).get("content-length")), said
    row = [path, at, number(h.get("warc-page-id")), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to-page")), n, real, real == said]
    return [*row, payload if kind == "response" else None] if with_payload else row


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Every reachable record of the archives in ``path, size``; ``valid`` tells whether the payload has its digest."""
    spark = archives.sparkSession
    bound_batches(spark)
    wide = 2 * shuffle_partitions(spark)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = archives.where("size > 0").select("path", "size", starts.alias("start")).select("path", "start", F.least("size", F.col("start") + split_bytes).alias("end"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                out = _exits(_candidates(_File(path), start, end), end)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([o for o, _ in out], pa.int64()), pa.array([e for _, e in out], pa.int64())], ["path", "offset", "to"])

    jumps, jumps_path = write_table(splits.repartition(wide).mapInArrow(scan, "path string, offset long, to long"), "jumps")
    entries, entries_path = write_table(jumps.where("offset = 0").select("path", "offset"), "entries")
    most = archives.agg(F.max("size")).first()[0] or 0
    # Only offsets that some chain comes to can be entered.
    jumps = jumps.join(jumps.select("path", F.col("to").alias("offset")).distinct().union(entries), ["path", "offset"], "left_semi").distinct()
    stride = 1
    while stride < -(-most // split_bytes):
        jumps, new_jumps = write_table(jumps, "jumps")
        further = entries.join(jumps, ["path", "offset"]).where("to >= 0").select("path", F.col("to").alias("offset"))
        entries, new_entries = write_table(entries.union(further).distinct(), "entries")
        for old in (jumps_path, entries_path):
            drop_path(spark, old)
        jumps_path, entries_path = new_jumps, new_entries
        jumps = jumps.join(jumps.select("path", F.col("offset").alias("to"), F.col("to").alias("beyond")), ["path", "to"]).select("path", "offset", F.col("beyond").alias("to"))
        stride *= 2
    entered = entries.withColumn("start", F.floor(F.col("offset") / split_bytes) * split_bytes).join(splits, ["path", "start"]).select("path", "offset", "end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                f, rows, held = _File(path), [], 0
                while at < end:
                    if f.get(at, 2) == b"\x1f\x8b":
                        whole = _inflate(f, at, True)
                        if not whole:
                            break
                        header, _, rest = whole[1].partition(b"\r\n\r\n")
                        block, after = rest[:-4], whole[0]
                    else:
                        found = _plain(f, at)
                        if not found:
                            break
                        after, header, start = found
                        block = f.get(start, after - 4 - start)
                    rows.append(_row(path, at, header, block, with_payload))
                    held += len(block)
                    at = after
                    if len(rows) >= 1000 or held > _READ * 16:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return entered.repartition(wide).mapInArrow(read, RECORD + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and return what the archives hold of each."""
    archives, _ = write_archives(pages, new_folder(pages.sparkSession, "warc"))
    return read_archives(archives)
