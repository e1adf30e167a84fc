import base64
import hashlib

import pyarrow.fs as pafs

from millrace.llm.common import new_folder
from millrace.llm.warc import _gzip, read_archives, record, round_trip, write_archives

SCHEMA = "page_id long, url string, html string, path string, size int"


def brute(rows):
    want = []
    for i, (page, url, html) in enumerate(rows):
        raw = (html or "").encode()
        same = [j for j, r in enumerate(rows) if (r[2] or "") == (html or "")]
        known = [rows[j][0] for j in same if rows[j][0] is not None]
        refers = None
        if known and (page != max(known) or i != next(j for j in same if rows[j][0] == max(known))):
            refers = max(known)
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(want, key=str)


def trap(n=3):
    inner = record(666, "http://evil", b"inside")
    return (inner * n).decode()


ROWS = [(1, "http://a", "<p>x</p>"), (2, None, None), (3, "u\r\nWARC-Type: x", ""), (4, "http://b é", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "alone"), (5, "t", trap()), (6, "t", "pre " + trap(1)), (7, "big", "é" * 70000), (8, "w", "WARC/1.1\r\n"), (9, "r", "rep"), (9, "r", "rep"), (9, "r", "rep"), (10, "z", "\x1f\x08 \x00x")]
ROWS += [(100 + i, f"http://p/{i}", f"<html>{i % 7}{'q' * (i * 37 % 900)}</html>" if i % 3 else "hot") for i in range(300)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def digest_columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages_come_back(spark):
    got = round_trip(frame(spark, ROWS))
    assert digest_columns(got) == brute(ROWS)
    assert got.where("not valid").count() == 0


def test_plain_archives_with_records_inside_payloads_and_small_splits(spark):
    archives, _ = write_archives(frame(spark, ROWS).repartition(3), new_folder(spark, "warc"), compress=False, file_bytes=60_000)
    assert archives.count() > 3
    for split in (97, 1000, 1 << 20):
        got = read_archives(archives, split_bytes=split, with_payload=True)
        assert digest_columns(got) == brute(ROWS)
    stored = {r.page_id: r.payload for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert all(stored[p].decode() == (h or "") for p, _, h in ROWS if p in stored)
    assert {r.url for r in got.where("page_id = 3").collect()} == {"u%0D%0AWARC-Type:%20x"}


def test_gzip_small_splits(spark):
    archives, _ = write_archives(frame(spark, ROWS), new_folder(spark, "warc"))
    assert digest_columns(read_archives(archives, split_bytes=501)) == brute(ROWS)


def test_members_stored_inside_members_and_a_cut_file(spark):
    folder = new_folder(spark, "made")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    whole = _gzip(record(1, "a", b"one")) + record(2, "b", b"x" + _gzip(record(9, "in", b"no")) + record(8, "in", b"no")) + _gzip(record(3, "c", b"three"))
    paths = []
    for name, raw in (("whole", whole), ("cut", whole[:-9]), ("empty", b"")):
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(raw)
        paths.append((f"{folder}/{name}", len(raw)))
    df = spark.createDataFrame(paths, "path string, size long")
    for split in (64, 300, 1 << 20):
        got = sorted((r.path.rsplit("/", 1)[1], r.page_id) for r in read_archives(df, split_bytes=split).collect())
        assert got == [("cut", 1), ("cut", 2), ("whole", 1), ("whole", 2), ("whole", 3)]


def test_empty_table(spark):
    assert round_trip(frame(spark, [])).collect() == []
